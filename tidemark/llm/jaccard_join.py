"""Similarity self-join of documents on five-word shingles, by chosen paths.

Equal shingle sets are one class before anything is compared. Each class is embedded as `coords` minhash values, its
tokens. A run starts with all classes in one bucket and splits it on sampled tokens: a node samples one coordinate, or
two with probability 1/threshold - 1, and sends each class to the child that its token there names. Buckets up to `small`
are compared whole; larger ones are split again, `depth` levels at most. Two sets of the least similarity stay together
through a level about once on average, so a run finds them with the probability that such a branching survives, and runs
are repeated until all of them together reach the target recall. Of what still shares a large bucket after the last level,
each member is compared with the pivot of its run's bucket first. Similarity is not transitive, so a bucket whose members
are not of one class by then is compared whole, block by block; and the links of every class that met a large bucket are
counted block by block.
Candidates pass a sketch test, are verified exactly on their texts, and components of the links are the classes.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, read_table, salted_join, slices, staged, unstage, with_row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def survival(threshold: float, depth: int) -> float:
    """How likely two sets of that similarity share a bucket after depth levels of one run."""
    p, two = 1.0, 1 / threshold - 1
    for _ in range(depth):
        q = threshold * p
        p = (1 - two) * q + two * (1 - (1 - q) ** 2)
    return p


def runs_for(recall: float, threshold: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth))))


class Shingler:
    """Hashed shingle sets. Words hash the same in every process."""

    def __init__(self, width: int = 5, most_held: int = 300_000):
        self.width, self.held, self.most_held = width, {}, most_held

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; a text of fewer words has one shingle of them all, one without words none."""
        words = WORD.findall(text or "")
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.held) > self.most_held:
            self.held.clear()
        for w in set(words).difference(self.held):
            self.held[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        h = np.fromiter(map(self.held.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        with np.errstate(over="ignore"):
            g = np.full(len(h) - width + 1, np.uint64(width))
            for k in range(width):
                g = (g ^ h[k : len(h) - width + 1 + k]) * MIX
                g ^= g >> np.uint64(31)
        return np.unique(g)


def coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 1 << 63, coords, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 63, coords, dtype=np.uint64)


def signature(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minhash values of 31 bits."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(g), 4096):
            low = np.minimum(low, (g[k : k + 4096, None] * a + b).min(axis=0))
        low = (low ^ (low >> np.uint64(33))) * MIX
    return (low >> np.uint64(33)).astype(np.int32)


def descend(keys: np.ndarray, sigs: np.ndarray, level: int, two: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes: (row taken, child key). keys: a node for each row of sigs."""
    with np.errstate(over="ignore"):
        h = (keys.view(np.uint64) ^ np.uint64(level + 1)) * MIX
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    n = sigs.shape[1]
    first = (h % np.uint64(n)).astype(np.int64)
    more = ((h >> np.uint64(20)) % np.uint64(1000)).astype(np.int64) < round(1000 * two)
    second = (first + 1 + ((h >> np.uint64(40)) % np.uint64(n - 1)).astype(np.int64)) % n
    rows = np.concatenate([np.arange(len(keys)), np.flatnonzero(more)])
    at = np.concatenate([first, second[more]])
    with np.errstate(over="ignore"):
        out = (h[rows] ^ (at.astype(np.uint64) << np.uint64(32)) ^ sigs[rows, at].astype(np.uint64)) * MIX
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return rows, (out ^ (out >> np.uint64(31))).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each vertex of the edges (a, b) with the least vertex of its component. Labels spread and jump until still."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("c")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        new = staged(labels.join(heard, "v", "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("d")), "labels")
        jump = new.select(F.col("v").alias("d"), F.col("d").alias("e"))
        done = staged(new.join(jump, "d", "left").select("v", "c", F.least("d", F.coalesce("e", "d")).alias("d")), "labels")
        unstage(new, labels)
        labels = done.select("v", F.col("d").alias("c"))
        labels._staged_path = done._staged_path
        if done.filter("c <> d").isEmpty():
            unstage(both)
            return labels


def verified(near: DataFrame, text: DataFrame, kind: str, threshold: float, width: int, together: int = 64) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that are linked. text: (id, text).

    The pairs of an a are dealt into groups of about `together`. A group holds a's text once and that of each b, sorted so
    that a comes first, and is compared as its rows go by.
    """
    met = staged(near.groupBy("a").agg(F.count("*").alias("n")), "met")
    dealt = salted_join(near, met, ["a"], "n", F.col("b")).withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / together)))
    members = staged(dealt.select("a", "part", F.col("b").alias("id")), "members")
    members = members.union(members.select("a", "part", F.col("a").alias("id")).distinct())
    often = staged(members.groupBy("id").agg(F.count("*").alias("n")), "often")
    rows = salted_join(members, often, ["id"], "n", F.struct("a", "part"), also=text)
    rows = rows.select("a", "part", "id", "text", (F.col("a") != F.col("id")).alias("later")).repartition("a", "part").sortWithinPartitions("a", "part", "later")

    def compare(batches):
        shingles = Shingler(width)
        own, g = None, None
        for b in slices(batches, "text"):
            first, second, told = [], [], []
            for a, part, x, t, later in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                h = shingles(t)
                if not later:
                    own, g = (a, part), h
                    continue
                assert own == (a, part)
                shared = len(np.intersect1d(g, h, assume_unique=True))
                similarity = shared / (len(g) + len(h) - shared)
                if similarity >= threshold - 1e-12:
                    first.append(a)
                    second.append(x)
                    told.append(similarity)
            yield pa.RecordBatch.from_arrays([pa.array(first, b.column(0).type), pa.array(second, b.column(0).type), pa.array(told, pa.float64())], ["a", "b", "similarity"])

    return rows.mapInArrow(compare, f"a {kind}, b {kind}, similarity double")


def links(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.99, coords: int = 64, small: int = 48, first_level: int = 2, depth: int = 5) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """docs: (id, text). Classes of equal sets: (id, set, rep, copies); verified links between them: (a, b, similarity), a < b;
    and, if there are any, the large buckets of the last level, whose members met their pivot only: (key, rep)."""
    kind = dict(docs.dtypes)["id"]
    two = 1 / threshold - 1
    n_runs = runs_for(recall, threshold, depth)

    def embed(batches):
        shingles, (a, b) = Shingler(width), coefficients(coords)
        for batch in slices(batches, "text"):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None for g in sets]
            sigs = [signature(g, a, b) if len(g) else None for g in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([len(g) for g in sets], pa.int32()), pa.array(sigs, pa.list_(pa.int32()))], ["id", "set", "n", "sig"])

    sets = staged(docs.select("id", "text").mapInArrow(embed, f"id {kind}, set binary, n int, sig array<int>"), "sets")
    known = sets.filter(F.col("set").isNotNull())
    reps = staged(known.groupBy("set").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")
    told = staged(salted_join(known, reps, ["set"], "copies", F.col("id")).filter(F.col("id") == F.col("rep")).dropDuplicates(["rep"]).select("rep", "n", "sig"), "told")

    def start(batches):
        for b in batches:
            sigs = np.array(b.column(2).to_pylist(), np.int32).reshape(b.num_rows, coords)
            for run in range(n_runs):
                rows, keys = np.arange(b.num_rows), np.full(b.num_rows, run, np.int64)
                for level in range(first_level):
                    at, keys = descend(keys, sigs[rows], level, two)
                    rows = rows[at]
                yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), run, np.int32))], ["key", "rep", "n", "run"])

    def onward(level: int):
        def step(batches):
            for b in batches:
                sigs = np.array(b.column(4).to_pylist(), np.int32).reshape(b.num_rows, coords)
                rows, keys = descend(b.column(0).to_numpy(), sigs, level, two)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(1).take(at), b.column(2).take(at), b.column(3).take(at)], ["key", "rep", "n", "run"])

        return step

    shape = f"key long, rep {kind}, n int, run int"
    found: list[DataFrame] = []
    crowd = None
    rows = staged(told.mapInArrow(start, shape), "paths")
    for level in range(first_level, depth + 1):
        sizes = staged(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        met = rows.join(sizes.filter(F.col("size") <= small), "key").groupBy("key").agg(F.collect_list(F.struct("rep", "n")).alias("m"))
        pairs = met.select(F.explode(F.expr(f"flatten(transform(m, x -> transform(filter(m, y -> x.rep < y.rep AND x.n >= {threshold} * y.n AND y.n >= {threshold} * x.n), y -> struct(x.rep AS a, y.rep AS b))))")).alias("p")).select("p.a", "p.b").distinct()
        found.append(staged(pairs, "pairs"))
        large = sizes.filter(F.col("size") > small)
        if large.isEmpty():
            unstage(rows, sizes)
            break
        left = salted_join(rows, staged(large, "large-keys"), ["key"], "size", F.col("rep")).drop("size")
        if level == depth:
            crowd = left = staged(left, "large")
            order = F.xxhash64("rep", "run")
            pivots = staged(left.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("pivot"), F.col("n").alias("m"))).alias("p")).select("key", "p.pivot", "p.m"), "pivots")
            star = left.join(pivots, "key").filter((F.col("rep") != F.col("pivot")) & (F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n")))
            found.append(staged(star.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(), "pairs"))
            unstage(rows, sizes, pivots)
        else:
            new = staged(left.join(told.select("rep", "sig"), "rep").select("key", "rep", "n", "run", "sig").mapInArrow(onward(level), shape), "paths")
            unstage(rows, sizes)
            rows = new
    free_shuffles(docs.sparkSession)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.distinct()
    # A sketch that errs by four standard deviations passes still.
    least = math.floor(coords * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / coords)))
    sig = told.select(F.col("rep"), F.col("sig"))
    near = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
    near = staged(near.filter(F.expr(f"size(filter(zip_with(x, y, (u, v) -> u = v), e -> e)) >= {least}")).select("a", "b"), "near")
    unstage(*found)
    text = docs.select("id", "text").join(told.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    sure = staged(verified(near, text, kind, threshold, width), "links")
    unstage(near, told)
    free_shuffles(docs.sparkSession)
    return sets.select("id", "set").filter(F.col("set").isNull()).withColumns({"rep": F.lit(None).cast(kind), "copies": F.lit(None).cast("long")}).unionByName(salted_join(known.select("id", "set"), reps, ["set"], "copies", F.col("id"))), sure, crowd.select("key", "rep") if crowd is not None else None


def linked_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets are linked, as a matrix. Shared counts are a product over the tokens that at least two sets hold."""
    n, size = len(sets), np.array([len(g) for g in sets])
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    token = token[count > 1]
    shared = np.zeros((n, n), np.float32)
    for k in range(0, len(token), 4096):
        part = token[k : k + 4096]
        grid = np.zeros((n, len(part)), np.float32)
        for row, g in enumerate(sets):
            at = np.searchsorted(part, g)
            at[at == len(part)] = 0
            grid[row, at[part[at] == g]] = 1
        shared += grid @ grid.T
    return shared / (size[:, None] + size - shared) >= threshold - 1e-12


def block_links(sets: list[np.ndarray], copies: np.ndarray, blocks: np.ndarray, threshold: float) -> np.ndarray:
    """For each set, the copies of the other sets that it is linked with: of its own block if there is one, else of the other."""
    linked = linked_sets(sets, threshold)
    linked &= (blocks[:, None] != blocks) if blocks.min() != blocks.max() else ~np.eye(len(sets), dtype=bool)
    return linked @ copies


def hashed_sets(large: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """large, a row for each rep, with `shingles`: the bytes of its set, hashed from its text once. rows: (id, text)."""
    kind = dict(large.dtypes)["rep"]

    def run(batches):
        shingles = Shingler(width)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["rep", "shingles"])

    own = rows.join(large.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    return staged(own.select("id", "text").mapInArrow(run, f"rep {kind}, shingles binary"), "hashed")


def block_count(m: str, shingles: str, block: int, most: int) -> Column:
    """Blocks of a group of m sets: so many that one has about `block` sets and `most` shingles at the most."""
    return F.greatest(F.ceil(F.col(m) / block), F.ceil(F.col(shingles) / most))


def in_block_pairs(large: DataFrame) -> DataFrame:
    """large has rep and n_blocks, of the row's group: each row once for every pair of the group's blocks (lo, hi) with its own."""
    rows = large.withColumn("own", F.pmod(F.xxhash64("rep"), "n_blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def links_across(crowd: DataFrame, labels: DataFrame, rows: DataFrame, threshold: float, width: int, block: int = 1024, most: int = 2 << 20) -> DataFrame:
    """(a, b): verified links that join the classes which a large bucket's members are of so far. crowd: (key, rep).

    Buckets of one class are settled, and of buckets with the same members one is enough. The others are dealt over blocks,
    and each pair of blocks is compared in one task, which returns at most one link for two classes.
    """
    kind = dict(crowd.dtypes)["rep"]
    of = staged(crowd.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("c", F.coalesce("c", "rep")), "crowd-classes")
    mixed = of.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c"), F.max("c").alias("d"), F.expr("bit_xor(xxhash64(rep))").alias("x"), F.max(F.xxhash64("rep")).alias("y")).filter("c <> d")
    once = staged(mixed.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"), "mixed")
    kept = staged(salted_join(of, once, ["key"], "m", F.col("rep")), "mixed-rows")
    hashed = hashed_sets(kept, rows, width)
    sized = staged(kept.join(hashed.select("rep", (F.octet_length("shingles") / 8).cast("long").alias("n")), "rep").groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total")), "mixed-sizes")
    dealt = salted_join(kept.drop("m"), sized, ["key"], "m", F.col("rep")).withColumn("n_blocks", block_count("m", "total", block, most))
    dealt = in_block_pairs(dealt).select("key", "rep", "c", "own", "lo", "hi")

    def run(pdf):
        import pandas as pd

        out = []
        rep, blocks, code = pdf["rep"].to_numpy(), pdf["own"].to_numpy(), pd.factorize(pdf["c"])[0]
        alone = pdf["lo"].iloc[0] != pdf["hi"].iloc[0] and blocks.min() == blocks.max()
        if not alone and code.max() > 0:
            sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
            i, j = np.nonzero(linked_sets(sets, threshold) & (code[:, None] < code))
            first = np.unique(code[i].astype(np.int64) * len(code) + code[j], return_index=True)[1]
            out = [(min(x, y), max(x, y)) for x, y in zip(rep[i[first]], rep[j[first]], strict=True)]
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.join(hashed, "rep").groupBy("key", "lo", "hi").applyInPandas(run, f"a {kind}, b {kind}")


def links_in_large(large: DataFrame, rows: DataFrame, threshold: float, width: int, block: int = 1024, most: int = 2 << 20) -> DataFrame:
    """(rep, linked) for classes of many different sets: large has rep, c, m (sets of the class) and copies; rows: (id, text).

    Texts are hashed once. A class is dealt over blocks, and each pair of its blocks is compared in one task, which returns
    sums, not pairs. The work grows with the square of a class's different sets, the memory of a task does not grow.
    """
    kind = dict(large.dtypes)["rep"]
    hashed = hashed_sets(large, rows, width)
    sized = staged(large.join(hashed.select("rep", (F.octet_length("shingles") / 8).cast("long").alias("n")), "rep").groupBy("c").agg(F.count("*").alias("m"), F.sum("n").alias("total")), "class-sizes")
    dealt = salted_join(large.drop("m"), sized, ["c"], "m", F.col("rep")).withColumn("n_blocks", block_count("m", "total", block, most))
    told = in_block_pairs(dealt).select("rep", "c", "copies", "own", "lo", "hi").join(hashed, "rep")

    def run(pdf):
        import pandas as pd

        blocks = pdf["own"].to_numpy()
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0] and blocks.min() == blocks.max():
            return pd.DataFrame({"rep": pdf["rep"], "linked": 0})
        got = block_links([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], pdf["copies"].to_numpy(), blocks, threshold)
        return pd.DataFrame({"rep": pdf["rep"], "linked": got.astype("int64")})

    return told.groupBy("c", "lo", "hi").applyInPandas(run, f"rep {kind}, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, small: int = 48, count_all: bool = True, **how) -> DataFrame:
    """Per row: id, class_id (least id of its class), rep_id (least id with the same shingle set), n_links.

    n_links counts the other rows that the row is linked with: those of its own set, and of the sets linked with it. In
    classes of more than `small` different sets, and in those with a set of a large bucket, the links are counted anew,
    block by block (not if count_all is off). Texts without words have no set: each is a class of its own, without links.
    Rows that repeat an id, with the same text or another, and rows whose id is null are rows of their own; a class of such
    rows only has a null class_id. Other columns are ignored.
    """
    rows, plain = with_row(docs, id_col, text_col)
    told = classes(rows.select(F.col("row").alias("id"), "text"), threshold, width, small, count_all, **how)
    if not plain:
        told = staged(told.join(rows.select(F.col("row").alias("id"), F.col("id").alias("own")), "id"), "numbered-classes")
        for part in ("class_id", "rep_id"):
            least = staged(told.groupBy(part).agg(F.min("own").alias("least"), F.count("*").alias("n")), "least")
            told = salted_join(told, least, [part], "n", F.col("id")).drop("n", part).withColumnRenamed("least", part)
        told = told.drop("id").withColumnRenamed("own", "id")
    return told.select(F.col("id").alias(id_col), "class_id", "rep_id", "n_links")


def classes(rows: DataFrame, threshold: float, width: int, small: int, count_all: bool, **how) -> DataFrame:
    """near_duplicates of rows (id, text) whose ids are a key."""
    members, sure, crowd = links(rows, threshold=threshold, width=width, small=small, **how)
    labels = components(sure)
    if crowd is not None:
        more = staged(links_across(crowd, labels, rows, threshold, width), "across")
        if not more.isEmpty():
            labels = components(labels.filter("c <> v").select(F.col("c").alias("a"), F.col("v").alias("b")).union(more))
    sizes = staged(members.filter(F.col("id") == F.col("rep")).select("rep", "copies").distinct(), "sizes")
    both = sure.select("a", "b").union(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("linked"))
    of_rep = staged(labels.join(degree, labels["v"] == degree["rep"], "left").select(F.col("v").alias("rep"), "c", "linked"), "classes")
    met = of_rep.select(F.lit(False).alias("met"), "rep", "c") if crowd is None else of_rep.join(crowd.select("rep", F.lit(True).alias("met")).distinct(), "rep", "left").select("met", "rep", "c")
    wide = staged(met.groupBy("c").agg(F.count("*").alias("m"), F.max("met").alias("met")).filter((F.col("m") > small) | F.col("met")).select("c", "m"), "large-classes")
    if count_all and not wide.isEmpty():
        large = staged(salted_join(of_rep, wide, ["c"], "m", F.col("rep")).join(sizes, "rep").select("rep", "c", "m", "copies"), "large")
        anew = staged(links_in_large(large, rows, threshold, width), "anew").withColumnRenamed("linked", "exact")
        of_rep = staged(of_rep.join(anew, "rep", "left").select("rep", "c", F.coalesce("exact", "linked").alias("linked")), "classes")
    out = salted_join(members.drop("copies"), staged(sizes.join(of_rep, "rep", "left"), "rep-links"), ["rep"], "copies", F.col("id"), "left")
    return out.select(
        "id",
        F.coalesce("c", "rep", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("rep_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs of the least id of each class, with all their columns.

    Where ids are null or several texts share one, rows are told apart by id and text: they are numbered in that order.
    """
    told = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    if not told.groupBy("id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("id IS NULL OR lo <> hi").isEmpty():
        numbers = staged(told.distinct().orderBy("id", "hash").withColumn("__row", F.monotonically_increasing_id()), "numbers")
        same = docs[id_col].eqNullSafe(numbers["id"]) & (F.xxhash64(docs[text_col]) == numbers["hash"])
        numbered = staged(docs.join(numbers, same).select(*(docs[c] for c in docs.columns), "__row"), "numbered")
        return one_of_each(numbered, "__row", text_col, **how).drop("__row")
    keep = near_duplicates(docs, id_col, text_col, count_all=False, **how).filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col)).distinct()
    return docs.join(staged(keep, "kept"), id_col, "left_semi").dropDuplicates([id_col])


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
