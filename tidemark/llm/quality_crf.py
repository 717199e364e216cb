"""Quality classifier: a linear-chain conditional random field over lines.

Each line is good or bad. What speaks for either are features of the line and of the lines beside it; neighbouring
labels are tied by transition weights. Weights are fitted by gradient steps on a bounded sample of labelled documents,
whose lines carry the document's label. Forward-backward gives each line's marginal; their mean, weighted by line length,
is calibrated to the document's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices
from .labelled import apply_logistic, fit_logistic, labelled_sample, remainder, shifted

SYMBOLS = "#*$%&<>"
ENDS = frozenset(".!?:;\"”»")
N_OWN = 11


@dataclass(frozen=True)
class Params:
    per_class: int = 1500  #: most labelled documents of each class that the model is fitted on
    most_lines: int = 400  #: of a document that it is fitted on; scoring takes documents of any length
    steps: int = 150
    l2: float = 0.02


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each line with a word: its features, those of the lines before and after, a bias; and its length.

    A text without words has one line of length 1 that says so.
    """
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        rows.append(
            (
                math.log(n),
                min(3.0, sum(map(line.count, SYMBOLS)) / n),
                min(3.0, line.count("|") / n),
                min(3.0, line.count("!") / n),
                sum(map(str.isupper, words)) / n,
                sum(map(eq, words, words[1:])) / n,
                len(set(words)) / n,
                min(20.0, size / n) / 10,
                line[-1:] in ENDS or words[-1][-1] in ENDS,
                line in seen,
                n < 4,
            )
        )
        seen.add(line)
        sizes.append(size)
    if not rows:
        return np.array([[0.0] * (3 * N_OWN) + [1.0, 1.0]]), np.ones(1)
    own = np.array(rows, float)
    edge = np.zeros((1, N_OWN))
    empty = np.zeros((len(own), 1))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), empty, np.ones((len(own), 1))]), np.array(sizes, float)


def marginals(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line. emit: log odds of good; trans[a, b]: weight of label b after a. In odds, kept within e^±40."""
    t = np.exp(trans)
    (t00, t01), (t10, t11) = t.tolist()
    e = np.exp(np.clip(emit, -30, 30)).tolist()
    n = len(e)
    fwd, bwd = [0.0] * n, [1.0] * n
    r = fwd[0] = e[0]
    for k in range(1, n):
        r = fwd[k] = min(max(e[k] * (t01 + r * t11) / (t00 + r * t10), 1e-17), 1e17)
    s = 1.0
    for k in range(n - 2, -1, -1):
        s *= e[k + 1]
        s = bwd[k] = min(max((t10 + s * t11) / (t00 + s * t01), 1e-17), 1e17)
    odds = np.array(fwd) * np.array(bwd)
    return odds / (1 + odds)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    calibration: tuple = ()

    def features(self, text: str | None) -> list[float]:
        x, size = line_features(text)
        p = marginals((x - self.mean) / self.scale @ self.weights, self.trans)
        good = float((p * size).sum() / size.sum())
        return [good, math.log((good + 1e-4) / (1 - good + 1e-4))]


@dataclass
class Batch:
    """Documents of like length: x[line, document] padded to the longest, sizes, labels, and the weight of a line of each."""

    x: np.ndarray
    size: np.ndarray
    y: np.ndarray
    per_line: np.ndarray


def padded(docs: list[np.ndarray], y: np.ndarray, share: np.ndarray) -> Iterator[Batch]:
    """docs come by length. A batch's longest has at most 1.5 times the lines of its shortest, and 8 more."""
    size = np.array([len(x) for x in docs])
    start = 0
    while start < len(docs):
        end = int(np.searchsorted(size, 1.5 * size[start] + 8, side="right"))
        x = np.zeros((size[end - 1], end - start, docs[0].shape[1]))
        for k in range(start, end):
            x[: size[k], k - start] = docs[k]
        own = slice(start, end)
        yield Batch(x, size[own], y[own], share[own] / size[own])  # long and short documents weigh alike
        start = end


def gradient(b: Batch, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted log likelihood of the labels, by w and by trans: told minus expected counts."""
    longest, n, y = len(b.x), len(b.size), b.y
    alive = [int(np.searchsorted(b.size, t, side="right")) for t in range(longest)]  # documents from there on have line t
    emit = b.x @ w
    la = np.zeros((longest, n, 2))
    la[0, :, 1] = emit[0]
    for t in range(1, longest):
        a = alive[t]
        la[t, a:] = np.logaddexp(la[t - 1, a:, 0, None] + trans[0], la[t - 1, a:, 1, None] + trans[1])
        la[t, a:, 1] += emit[t, a:]
    lb = np.zeros((longest, n, 2))
    grad_t = np.zeros((2, 2))
    log_z = np.logaddexp(*la[b.size - 1, np.arange(n)].T)
    for t in range(longest - 2, -1, -1):
        a = alive[t + 1]
        after = lb[t + 1, a:] + np.stack([np.zeros(n - a), emit[t + 1, a:]], 1)
        lb[t, a:] = np.logaddexp(after[:, None, 0] + trans[:, 0], after[:, None, 1] + trans[:, 1])
        pair = np.exp(np.clip(la[t, a:, :, None] + trans + after[:, None, :] - log_z[a:, None, None], -60, 0))
        told = np.zeros((n - a, 2, 2))
        told[np.arange(n - a), y[a:], y[a:]] = 1
        grad_t += ((told - pair) * b.per_line[a:, None, None]).sum(0)
    p = np.exp(np.clip(la[:, :, 1] + lb[:, :, 1] - log_z, -60, 0))
    mask = (np.arange(longest)[:, None] < b.size) * b.per_line
    return np.tensordot((y - p) * mask, b.x, axes=([0, 1], [0, 1])), grad_t


def fit(sample: list[tuple[str, int]], params: Params, prior_shift: float = 0.0) -> Model:
    docs = [(line_features(t)[0], y) for t, y in sample]
    docs = [(x, y) for x, y in docs if len(x) <= params.most_lines]
    width = 3 * N_OWN + 2
    if not docs:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), fit_logistic(np.zeros((0, 2)), np.zeros(0)))
    flat = np.vstack([x for x, _ in docs])
    mean, scale = flat.mean(0), flat.std(0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    docs.sort(key=lambda d: len(d[0]))
    y = np.array([label for _, label in docs])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(docs)  # both classes weigh alike
    batches = list(padded([(x - mean) / scale for x, _ in docs], y, share))
    w, trans = np.zeros(width), np.zeros((2, 2))
    m, v, step = np.zeros(width + 4), np.zeros(width + 4), 0.15
    for it in range(1, params.steps + 1):
        grad_w, grad_t = np.zeros(width), np.zeros((2, 2))
        for b in batches:
            more_w, more_t = gradient(b, w, trans)
            grad_w += more_w
            grad_t += more_t
        g = np.concatenate([grad_w / len(docs) - params.l2 * w, (grad_t / len(docs) - params.l2 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = step * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    model = Model(mean, scale, w, trans)
    f = np.array([model.features(t) for t, _ in sample])
    model.calibration = shifted(fit_logistic(f, np.array([label for _, label in sample]), l2=1e-2), prior_shift)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, score (0 to 1), predicted. Null and empty texts count as one line without words. Repeated rows score alike."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in slices(batches, "text"):
            s = apply_logistic(model.calibration, np.array([model.features(t) for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op9_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    params = Params()
    sample, shift = labelled_sample(docs, labels, "quality", 5, [0], params.per_class)
    model = fit(sample, params, shift)
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == F.lit(0)).alias("held_out"), "score", "predicted")
