"""Bounded samples of labelled rows, and a small logistic fit, for the classifiers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: list[int], per_class: int, most_bytes: int = 64 << 10) -> tuple[list[tuple[str, int]], float]:
    """Up to per_class texts of each class, lowest hash first, of the rows whose remainder is not in held.

    Also the log odds by which class 1 is commoner among all those rows than in the sample.
    The ids are at most 2 * per_class, so they may be broadcast; rows without a label or id are left out, and texts of more
    than most_bytes, so that the driver gets 2 * per_class * most_bytes at the most. Of rows that repeat an id one is taken.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~remainder("doc_id", mod).isin(held))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    parts = [own.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = parts[0].union(parts[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    there = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    shift = math.log(there[1] / min(there[1], per_class)) - math.log(there[0] / min(there[0], per_class)) if len(there) == 2 else 0.0
    return sorted({(r["text"], r["label"]) for r in rows}), shift


def shifted(model: tuple[np.ndarray, np.ndarray, np.ndarray], by: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale, w = model
    w = w.copy()
    w[-1] += by
    return mean, scale, w


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised features: mean, scale and weights (bias last). Without both classes: the prior."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w = np.zeros(x.shape[1] + 1)
    if len(set(y.tolist())) < 2:
        w[-1] = 4.0 if len(y) and y[0] == 1 else -4.0
        return mean, scale, w
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + l2 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + (l2 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def apply_logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
