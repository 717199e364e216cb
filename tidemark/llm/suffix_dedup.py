"""Removal of repeated byte strings, by column-wise construction over aligned documents.

Every window of `length` bytes belongs to one anchor: its `gram`-byte string of lowest hash (the rightmost of equals).
Equal windows have equal anchors at equal places, so only strings around equal anchors need be compared.

1. Units. A text is cut into units: an anchor with all the windows that belong to it. Spark counts units by a 128-bit
   hash of their bytes. A unit found twice repeats in all its windows; this settles the inside of long repeats.
2. Columns. Other units whose anchor occurs in a second, different unit are ragged: they overlap an end of some repeat.
   They are aligned at the anchor, and the collection is built column by column from the right: each round inserts one
   symbol of every string, and updates the order of all suffixes (the collection's positional Burrows-Wheeler transform)
   and the common prefixes of neighbours. A window repeats if its common prefix with a neighbour reaches `length`.
   The rounds run over sequential blocks of about `block` strings, which Spark's sort hands over as sorted runs and
   spills to disk if need be; an anchor's strings are always in one block.
3. An anchor with more than `widest` different units is divided first, so that no task gets them all: windows at a like
   distance from the anchor share a core, the bytes that are in all of them. A unit's part of such windows is counted like
   a unit, and a core like an anchor, by ever smaller parts, until a core has few different parts, which are then built
   column by column. A part that is one window has no other to differ from.

Runs of repeated windows then meet per document, are united and cut out. Anchors, units and windows that many rows share
are dealt over many tasks (`salted_join`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, read_table, salted_join, shuffle_parts, slices, staged, unstage, with_row

GRAM = 40
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Where a unit's anchor lies belongs to what it is.
MARKS = [k.to_bytes(4, "little") for k in range(1 << 12)]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * MIX
        h = (h ^ (h >> np.uint64(29))) * MIX
        return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all gram-byte strings, by doubling."""
    with np.errstate(over="ignore"):
        h, width, power = data.astype(np.uint64) + np.uint64(1), 1, BASE
        parts, rest = None, gram
        at = 0
        while rest:
            if rest & 1:
                if parts is None:
                    parts = h
                else:
                    n = len(h) - at
                    parts = parts[:n] * power + h[at : at + n]
                at += width
            rest >>= 1
            if rest:
                h = h[: len(h) - width] * power + h[width:]
                power = power * power
                width *= 2
        return _mixed(parts[: len(data) - gram + 1])


PLACE = np.uint64((1 << 24) - 1)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest value (of its upper 40 bits), the rightmost of equals, of each run of width values."""
    if len(h) > int(PLACE):  # places have 24 bits; longer texts go in pieces that overlap by a run
        step = int(PLACE) - width + 1
        return np.concatenate([window_minima(h[k : k + int(PLACE)], width) + k for k in range(0, len(h) - width + 1, step)])
    val = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
    done = 1
    while done < width:
        step = min(done, width - done)
        val = np.minimum(val[step:], val[: len(val) - step])
        done += step
    return (PLACE - (val & PLACE)).astype(np.int64)


def units(text: bytes, length: int = 200, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, anchor hashes, first and last windows of the units; windows by their first byte. Short texts have none."""
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    at = window_minima(h, length - gram + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [len(at) - 1]])
    return at[first], h[at[first]].view(np.int64), first, last


def hash16(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def repeated_windows(strings: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Which windows of aligned strings repeat: bool, a row for each string, a column for each window's first byte.

    strings: uint8 columns; a string has bytes in [left, right). Columns are inserted from the right. order lists the
    strings by their suffixes from the current column; prefix holds the common prefix of each with the one before it.
    """
    n, width = strings.shape
    out = np.zeros((n, width), bool)
    order, prefix = np.arange(n), np.zeros(n, np.int32)
    for col in range(width - 1, -1, -1):
        inside = (left <= col) & (col < right)
        symbol = np.where(inside, strings[:, col].astype(np.int16) + 1, 0)[order]
        new = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[new]
        low = np.zeros(n, np.int32)
        bounds = np.flatnonzero(np.diff(sorted_symbol, prepend=-1))
        for a, b in zip(bounds, np.append(bounds[1:], n), strict=True):
            if sorted_symbol[a] and b - a > 1:  # the lowest prefix between a string and the one before it with its symbol
                at = new[a:b]
                low[a + 1 : b] = np.minimum.reduceat(prefix, at[:-1] + 1)
                last = prefix[at[-2] + 1 : at[-1] + 1].min()  # reduceat runs its last piece to the end
                low[b - 1] = last
                low[a + 1 : b] += 1
        order, prefix = order[new], low
        hit = prefix >= length
        if hit.any():
            hit[:-1] |= hit[1:].copy()
            out[order[hit], col] = True
    return out


def runs_of(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True)


def repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, block: int = 20_000, widest: int = 1_000) -> DataFrame:
    """docs: (row, text); row is a key of docs, never null. A row per run of repeated windows: row, first, last (bytes)."""
    spark = docs.sparkSession
    ids = dict(docs.dtypes)["row"]

    def cut(batches):
        for b in slices(batches, "text", 4 << 20):
            cols: list[list] = [[], [], []]
            rows, digests = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                data = (t or "").encode()
                at, anchor, first, last = units(data, length, gram)
                rows.append(np.full(len(at), k))
                for c, v in zip(cols, (anchor, first, last), strict=True):
                    c.append(v)
                digests += [hash16(MARKS[j] + data[f:z]) for j, f, z in zip((at - first).tolist(), first.tolist(), (last + length).tolist(), strict=True)]
            anchor, first, last = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digests, pa.binary()), b.column(0).take(pa.array(np.concatenate(rows))), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["anchor", "unit", "row", "first", "last"])

    every = docs.select("row", "text").mapInArrow(cut, f"anchor long, unit binary, row {ids}, first int, last int")
    counts = staged(every.groupBy("anchor", "unit").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("one")), "units")
    shared = staged(counts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("n").alias("n")).filter((F.col("kinds") > 1) | (F.col("n") > 1)), "anchors")
    free_shuffles(spark)
    told = staged(salted_join(counts, shared.select("anchor", "kinds"), ["anchor"], "kinds", F.col("unit")).filter((F.col("kinds") > 1) | (F.col("n") > 1)), "shared-units")
    unstage(counts, shared)
    # Only units that need more than their count: a unit of its own kind, or the one that stands for its copies.
    used = told.select("unit", "kinds", "n", "one")
    met = staged(salted_join(every.drop("anchor"), told.select("anchor", *used.columns), ["unit"], "n", F.struct("row", "first")), "met")
    unstage(told)
    free_shuffles(spark)
    whole = met.filter(F.col("n") > 1).select("row", "first", "last")
    ragged = met.filter((F.col("kinds") > 1) & (F.struct("row", "first") == F.col("one")))
    need = staged(ragged.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "last", (F.col("n") == 1).alias("open"), (F.col("kinds") > widest).alias("wide"))).alias("need")), "need")

    def strings(batches):
        for b in slices(batches, "text", 4 << 20):
            rows, out = [], [[], [], [], [], [], []]
            for k, (t, need) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                data = (t or "").encode()
                for u in need or ():
                    rows.append(k)
                    for c, v in zip(out, (u["anchor"], u["first"], u["last"], u["open"], u["wide"], data[u["first"] : u["last"] + length]), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["row", "anchor", "first", "last", "open", "wide", "data"])

    cuts = staged(docs.select("row", "text").join(need, "row").mapInArrow(strings, f"row {ids}, anchor long, first int, last int, open boolean, wide boolean, data binary"), "strings")
    unstage(need)
    parts = shuffle_parts(spark)

    def columns(batches):
        def block_of(held: list[dict]) -> pa.RecordBatch:
            table = [[], [], []]
            if len(held) > 1:
                reach = length - gram
                width = 2 * reach + gram
                grid = np.zeros((len(held), width), np.uint8)
                left, right = np.zeros(len(held), np.int32), np.zeros(len(held), np.int32)
                for k, r in enumerate(held):
                    at = anchor_place(r["data"], length, gram)
                    left[k], right[k] = reach - at, reach - at + len(r["data"])
                    grid[k, left[k] : right[k]] = np.frombuffer(r["data"], np.uint8)
                found = repeated_windows(grid, left, right, length)
                for k, r in enumerate(held):
                    if r["open"]:
                        for a, z in runs_of(found[k]):
                            for c, v in zip(table, (r["row"], r["first"] + a - int(left[k]), r["first"] + z - int(left[k])), strict=True):
                                c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(table[0], row_type[0]), pa.array(table[1], pa.int32()), pa.array(table[2], pa.int32())], ["row", "first", "last"])

        row_type = [pa.int64()]
        held: list[dict] = []
        group: list[dict] = []
        for b in batches:
            row_type[0] = b.schema.field("row").type
            for r in b.to_pylist():
                if group and group[0]["anchor"] != r["anchor"]:
                    if len(group) > 1:
                        if len(held) + len(group) > block and held:
                            yield block_of(held)
                            held = []
                        held += group
                    group = []
                group.append(r)
        if len(group) > 1:
            held += group
        if held:
            yield block_of(held)

    found = [whole]
    flat = [cuts.filter(~F.col("wide")).select("anchor", "row", "first", "last", "open", "data")]
    wide, step = cuts.filter("wide").select("row", "first", "last", "open", "data"), length - gram + 1
    while step > 1 and not wide.isEmpty():
        step = -(-step // 4)
        part = staged(wide.mapInArrow(divided(step, length, gram), f"core long, part binary, row {ids}, first int, last int, open boolean, data binary"), "parts")
        counts = staged(part.groupBy("core", "part").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("one")), "part-counts")
        kinds = staged(counts.groupBy("core").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).filter((F.col("kinds") > 1) | (F.col("most") > 1)).drop("most"), "cores")
        told = staged(salted_join(counts, kinds, ["core"], "kinds", F.col("part")).select("part", "kinds", "n", "one"), "shared-parts")
        met = staged(salted_join(part, told, ["part"], "n", F.struct("row", "first")), "met-parts")
        unstage(part, counts, kinds, told)
        found.append(met.filter(F.col("open") & (F.col("n") > 1)).select("row", "first", "last"))
        on = met.filter((F.col("kinds") > 1) & (F.struct("row", "first") == F.col("one"))).withColumn("open", F.col("open") & (F.col("n") == 1))
        flat.append(on.filter(F.col("kinds") <= widest).select(F.col("core").alias("anchor"), "row", "first", "last", "open", "data"))
        wide = on.filter(F.col("kinds") > widest).select("row", "first", "last", "open", "data")
    strings_of = reduce(DataFrame.unionByName, flat)
    found.append(staged(strings_of.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(columns, f"row {ids}, first int, last int"), "columns"))
    unstage(cuts)
    return reduce(DataFrame.unionByName, found)


def divided(step: int, length: int, gram: int):
    """Cuts units, or parts of them, into parts whose windows begin at one of `step` distances before the anchor.

    Equal windows are in parts of equal cores. The core is told by 64 bits, which only groups; a part by 128.
    """

    def run(batches):
        for b in slices(batches, "data", 1 << 20):
            rows, cols = [], [[], [], [], [], [], []]
            for k, (first, last, is_open, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("first", "last", "open", "data")), strict=True)):
                at = anchor_place(data, length, gram)
                f = first
                while f <= last:
                    before = at - (f - first)  # bytes of the window before its anchor
                    slab = before // step
                    end = min(last, f + before - slab * step)
                    own = data[f - first : end - first + length]
                    core = data[at - slab * step : at + length - slab * step - step + 1]
                    rows.append(k)
                    mark = MARKS[before]
                    for c, v in zip(cols, (int.from_bytes(hash16(MARKS[slab] + core)[:8], "little", signed=True), hash16(mark + own), f, end, is_open, own), strict=True):
                        c.append(v)
                    f = end + 1
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            core, part, *rest = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([core, part, b.column(0).take(pa.array(rows, pa.int64())), *rest], ["core", "part", "row", "first", "last", "open", "data"])

    return run


def anchor_place(data: bytes, length: int, gram: int) -> int:
    """Where the anchor of a unit's bytes lies: it is that of the unit's first window."""
    return int(window_minima(gram_hashes(np.frombuffer(data[:length], np.uint8), gram), length - gram + 1)[0])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM, block: int = 20_000, widest: int = 1_000, with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes.

    Bytes under a string of `length` bytes that starts anywhere else too, in the same text or another, are removed; they
    are judged on the input. Null is the empty text, which loses nothing. Rows that repeat an id, with the same text or
    another, and rows whose id is null are rows of their own: equal texts take each other's bytes. Other columns are ignored.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows, _ = with_row(docs, id_col, text_col)
    runs = repeats(rows.select("row", "text"), length, gram, block, widest).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    free_shuffles(spark)

    def run(batches):
        for b in slices(batches, "text"):
            n_bytes, removed, spans, digest, kept = [], [], [], [], []
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = t.encode()
                edge = np.zeros(len(data) + 1, np.int32)
                for r in own or ():
                    edge[r["first"]] += 1
                    edge[r["last"] + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                n_bytes.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(sum(1 for _ in runs_of(gone)))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, removed, spans)), pa.array(digest, pa.string())] + [pa.array(kept, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return rows.join(runs, "row", "left").select("id", "text", "runs").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text).withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
