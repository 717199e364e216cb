"""Packing by power-of-two decomposition.

The token ids of a document, closed by an end id, are cut into pieces of the context length and, for the rest, into the
powers of two of its binary form. Each piece is a sequence of its own: no sequence crosses documents and none is padded.
Pieces are bucketed by length, so that a batch holds equal lengths only.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, shuffle_parts, slices, staged, unstage

CORE = re.compile(r"([^\W\d_]+)([.,;:!?|%$&*#]*)")


def binary_lengths(n: int, context: int = 4096) -> list[int]:
    """Whole contexts first, then the powers of two of what is left, longest first."""
    out = [context] * (n // context)
    rest = n % context
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Pieces:
    """A tokenizer file, and what each space-delimited piece of text encodes to.

    Only white space is cut at, which the tokenizer's own pattern never crosses and drops.
    """

    def __init__(self, path: str, most_held: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.held: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.most_held = most_held

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin (and the last ones end)."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [x for x in words if x not in self.held]
        if len(self.held) + len(new) > self.most_held:
            self.held = {"": b""} | {x: self.held[x] for x in words if x in self.held}
        self._learn(new)
        own = list(map(self.held.__getitem__, words))
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool, at = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        ids = pool[np.repeat(at[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]

    def _learn(self, new: list[str]) -> None:
        split = [self._core(x) for x in new]
        own = list({y for s in split for y in s if y not in self.held})
        letters = [x for x in own if x.isalpha()]
        for k in range(0, len(letters), 512):
            self._letters(letters[k : k + 512])
        self._each([x for x in own if not x.isalpha()])
        for x, s in zip(new, split, strict=True):
            if len(s) > 1 or s[0] != x:
                self.held[x] = b"".join(map(self.held.__getitem__, s))

    def _each(self, words: list[str]) -> None:
        for x, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.held[x] = np.array(e.ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        """Words of letters only, each one token run: encoded as one text and told apart by the marks of word ends."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        raw, start = ids.tobytes(), 0
        for x, z in zip(words, (4 * ends).tolist(), strict=True):
            self.held[x] = raw[start:z]
            start = z

    @staticmethod
    def _core(x: str) -> list[str]:
        """Letters and the marks after them, which the tokenizer's pattern separates too; lower case where that is plain."""
        m = CORE.fullmatch(x)
        if not m or "\u0130" in x:  # whose lower case ends with a mark that joins what follows
            return [x]
        core = m[1].lower() if m[1].isascii() else m[1]
        return [core, m[2]] if m[2] else [core]


_held: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def pack(docs: DataFrame, path: str, context: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids.

    A null or empty text is one piece: the end id. Repeated rows get pieces of their own. context must be a power of two.
    Other columns are ignored.
    """
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        p = pieces_of(path)
        for b in slices(batches, "text"):
            at, start, length, crc, total, ids = [], [], [], [], [], []
            all_ids, offsets = p.encode(pc.fill_null(b.column(1), ""))
            for k, (first, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                x = all_ids[first:last].tobytes() + end
                s = 0
                for n in binary_lengths(len(x) // 4, context):
                    at.append(k)
                    start.append(s)
                    length.append(n)
                    own = x[4 * s : 4 * (s + n)]
                    crc.append(zlib.crc32(own))
                    total.append(len(x) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int64))
                    s += n
            cols = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<bigint>" * with_ids)
    cut = staged(rows, "pieces")
    bucketed = cut.repartitionByRange(shuffle_parts(spark), F.col("length").desc(), F.xxhash64("id", "start")).sortWithinPartitions(F.col("length").desc(), "id", "start")
    kept = staged(bucketed, "buckets")
    unstage(cut)
    # Numbered as the written files are read: a task that is run again reads the same rows in the same order.
    return kept.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
