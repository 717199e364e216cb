"""Byte-level BPE in length-bucketed, padded numpy matrices.

Words (matches of the pattern) that a worker has not met yet are laid out as rows of byte ids, padded to the width of
their bucket. In each round every row looks all its neighbouring pairs up in a hash table of ranks, merges its leftmost
pair of lowest rank, and closes the gap; rows without a known pair leave the matrix. What a word or a space-delimited
piece encodes to is remembered, so a text costs a split, a lookup a piece and one join.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import read_table, slices

NONE = np.int32(0x7FFFFFFF)
#: White space as the Unicode property has it; \s of Python also takes the separators 1C to 1F.
SPACES = r"\t-\r\x20\x85\xa0  -     　"
LONG = 512  #: Bytes from which a word takes the heap: a matrix would cost the square of its width.


def explicit_spaces(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out, inside classes and outside."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(SPACES if in_class else f"[{'^' * (two == r'\S')}{SPACES}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = two[0] == "[" or in_class and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


class PairTable:
    """Open addressing with linear probing, filled and read by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        self.last = 0
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == -1
            first = np.unique(s[free], return_index=True)[1]
            won = todo[free][first]
            self.keys[slot[won]] = key[won]
            self.vals[slot[won]] = rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + (self.keys[slot[todo]] != -1)) & ((1 << self.bits) - 1)
            self.last += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            got = self.keys[slot]
            hit = got == key[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            go = ~hit & (got != -1)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Codec:
    """The merges of a rank file; encodes lists of words, remembers, decodes."""

    def __init__(self, path: str, pattern: str, most_held: int = 600_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(explicit_spaces(pattern))
        self.runs = regex.compile(f"[{SPACES}]{{2}}|[{SPACES}--[ \\n]]", regex.V1)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(x, np.int32) for x in zip(*triples, strict=True))
        self.pairs = PairTable(left, right, rank)
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.token_len = np.zeros(by_rank[-1][1] + 1, np.int64)
        self.token_at = np.zeros(by_rank[-1][1] + 1, np.int64)
        at = 0
        for t, r in by_rank:
            self.token_len[r], self.token_at[r] = len(t), at
            at += len(t)
        self.pool = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.held: dict[str, bytes] = {}
        self.held_words: dict[str, bytes] = {}
        self.most_held = most_held

    def _heap(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        look = lambda i: int(self.pairs(np.array([ids[i]], np.int32), np.array([ids[nxt[i]]], np.int32))[0]) if nxt[i] < len(ids) else int(NONE)
        first = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or nxt[i] >= len(ids) or ids[nxt[i]] != b:
                continue
            j = nxt[i]
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
            for k in (i, prv[i]):
                if k >= 0 and (s := look(k)) != NONE:
                    heapq.heappush(heap, (s, k, ids[k], ids[nxt[k]]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words])
        for k in np.flatnonzero(size > LONG):
            out[k] = self._heap(words[k])
        width, low = 4, 0
        while low < LONG:
            rows = np.flatnonzero((size > low) & (size <= width))
            for at in range(0, len(rows), max(1, 400_000 // width)):
                self._matrix(words, rows[at : at + max(1, 400_000 // width)], width, out)
            low, width = width, width * 2
        for k in np.flatnonzero(size == 0):
            out[k] = np.zeros(0, np.int32)
        return out

    def _matrix(self, words: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        n = np.array([len(words[k]) for k in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.byte_id[np.frombuffer(b"".join(words[k] for k in rows), np.uint8)]
        cols = np.arange(width)
        while len(rows):
            rank = self.pairs(ids[:, :-1], ids[:, 1:])
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), at]
            done = low == NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : n[k]].copy()
            go = ~done
            rows, ids, at, low, n = rows[go], ids[go], at[go], low[go], n[go] - 1
            if len(rows):
                ids[np.arange(len(rows)), at] = low
                shifted = np.concatenate([ids[:, 1:], np.full((len(rows), 1), -1, np.int32)], axis=1)
                ids = np.where(cols > at[:, None], shifted, ids)
                width = int(n.max())
                ids, cols = ids[:, : max(width, 2)], cols[: max(width, 2)]

    def pieces(self, text: str) -> list[str]:
        """Cuts that no match of the pattern crosses: before each single white-space character between other characters."""
        if self.runs.search(text):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        out = [first, *(f" {x}" for x in rest)]
        if "\n" in text:
            out = [y for x in out for y in ([x] if "\n" not in x else [z if k == 0 else "\n" + z for k, z in enumerate(x.split("\n"))])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        if len(self.held) > self.most_held:
            self.held.clear()
        if len(self.held_words) > self.most_held:
            self.held_words.clear()
        new = list(set().union(*cut).difference(self.held))
        parts = [self.words.findall(x) for x in new]
        fresh = list({w for p in parts for w in p if w not in self.held_words})
        for w, ids in zip(fresh, self.encode_words([w.encode() for w in fresh]), strict=True):
            self.held_words[w] = ids.astype("<u4").tobytes()
        for x, p in zip(new, parts, strict=True):
            self.held[x] = b"".join(map(self.held_words.__getitem__, p))
        return [b"".join(map(self.held.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        k = np.frombuffer(ids, "<u4")
        n = self.token_len[k]
        ends = np.cumsum(n)
        if not len(k):
            return b""
        return self.pool[np.repeat(self.token_at[k] - (ends - n), n) + np.arange(ends[-1])].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids.

    A null text is the empty text: 0 tokens. Very long words take a heap instead of a matrix. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches, "text", 4 << 20):
            ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            cols = [
                b.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return out.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids).withColumnRenamed("id", id_col)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
