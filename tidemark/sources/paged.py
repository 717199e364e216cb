"""Reading in shards and pages: windows over pages, half-open ranges, pages by offset, contiguous groups, federated searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query


def page_window(df: DataFrame, page: Column, start: int, budget: int, pages: int) -> DataFrame:
    """The rows of `budget` pages from `start` on, going on from page 0 after the last."""
    return df.filter(F.pmod(page - start, F.lit(pages)) < min(budget, pages))


def shard_of(key: Column, bounds: list[float]) -> Column:
    """The half-open range [bound, next bound) that a key lies in: rows of one key are never parted, and none is in two."""
    return reduce(lambda a, b: a + b, (F.when(key >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def read_shards(df: DataFrame, key: str, bounds: list[float]) -> DataFrame:
    """Every shard read by a range of its own, as a source without cursors is; null keys come with the first."""
    edges = [None, *bounds, None]
    parts = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        rows = df if lo is None else df.filter(F.col(key) >= lo)
        rows = rows if hi is None else rows.filter((F.col(key) < hi) | (F.col(key).isNull() if k == 0 else F.lit(False)))
        parts.append(rows.withColumn("shard", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def read_pages(fetch: Callable[[int], list[dict]], retries: int = 3, most: int = 10_000) -> tuple[list[dict], bool]:
    """All rows of a source of numbered pages, and whether `most` pages ended it. An empty page is the end; what the source
    planned is not trusted. A page that fails is asked for again, `retries` times in all."""
    rows: list[dict] = []
    for page in range(most):
        for turn in range(retries):
            try:
                got = fetch(page)
                break
            except OSError:
                if turn == retries - 1:
                    raise
        if not got:
            return rows, False
        rows += got
    return rows, True


def contiguous(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key next to each other in one partition, so that a loader sees a group in one go."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


@dataclass(frozen=True)
class Source:
    """A searchable source: its rows, with title, location and url."""

    name: str
    rows: DataFrame

    def search(self, title: str, location: str = "", page: int = 0, size: int = 50) -> DataFrame:
        """One page of what holds the title's words and the place, by url: source, title, location, url."""
        hits = self.rows.filter(F.col("location").ilike(f"%{location}%")) if location else self.rows
        hits = reduce(lambda df, w: df.filter(F.col("title").ilike(f"%{w}%")), title.split(), hits)
        return hits.orderBy("url").offset(page * size).limit(size).select(F.lit(self.name).alias("source"), "title", "location", "url")


def federated(sources: list[Source], title: str, location: str = "", page: int = 0, size: int = 50) -> DataFrame:
    """The page of every source, one under the other; of rows with one url the first source's stays."""
    parts = [s.search(title, location, page, size).withColumn("__turn", F.lit(k)) for k, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, parts)
    rest = ["source", "title", "location"]
    first = every.groupBy("url").agg(F.min_by(F.struct(*rest), "__turn").alias("r"))
    return first.select(*(F.col(f"r.{c}").alias(c) for c in rest), "url")


@query("page_window_scan", "S-9", "SELECT id, page FROM (SELECT id, id // 100 % 600 AS page FROM {postings}) WHERE page >= 590 OR page < 30")
def _window(t):
    rows = t.postings.select("id", F.floor(F.col("id") / 100 % 600).alias("page"))
    return page_window(rows, F.col("page"), 590, 40, 600)


@query("half_open_shards", "S-17 S-18", "SELECT o_orderkey, CAST((o_totalprice >= 50000) AS INTEGER) + CAST((o_totalprice >= 120000.5) AS INTEGER) + CAST((o_totalprice >= 300000) AS INTEGER) AS shard FROM orders")
def _half_open(t):
    bounds = [50000, 120000.5, 300000]
    read = read_shards(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", bounds)
    return read.filter(F.col("shard") == shard_of(F.col("o_totalprice"), bounds)).select("o_orderkey", "shard")


@query("offset_pages", "S-17", "SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 25 AS page FROM part")
def _offset_pages(t):
    """Pages by offset within each category, numbered in one pass."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return t.part.select("p_partkey", "p_brand", F.floor(n / 25).alias("page"))


@query("contiguous_groups", "S-21", "SELECT l_orderkey, count(*) AS n, true AS together FROM lineitem GROUP BY 1")
def _contiguous(t):
    """Where the rows of a key stand after the sort: next to each other, in one partition."""
    placed = contiguous(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"]).withColumn("at", F.monotonically_increasing_id())
    return placed.groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.max("at") - F.min("at") + 1 == F.count("*")).alias("together"))


@query(
    "federated_search",
    "S-20 O-4",
    """WITH a AS (SELECT 'board' AS source, title, 'Graz' AS location, 'https://x.org/' || title_key AS url, 1 AS turn FROM {jobs} WHERE id % 2 = 0 AND title LIKE '%ring%' AND title LIKE '%blue%'),
b AS (SELECT 'feed' AS source, p_name || ' ' || lower(p_type) AS title, 'Graz, AT' AS location, 'https://x.org/' || p_partkey AS url, 2 AS turn FROM part WHERE p_name LIKE '%ring%' AND p_name || ' ' || lower(p_type) LIKE '%blue%'),
u AS (SELECT DISTINCT * FROM a UNION ALL SELECT * FROM b)
SELECT source, title, location, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY turn) AS k FROM u) WHERE k = 1""",
)
def _federated(t):
    board = t.jobs.filter("id % 2 = 0").select("title", F.lit("Graz").alias("location"), F.concat(F.lit("https://x.org/"), F.col("title_key").cast("string")).alias("url")).distinct()
    feed = t.part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("title"), F.lit("Graz, AT").alias("location"), F.concat(F.lit("https://x.org/"), F.col("p_partkey").cast("string")).alias("url"))
    return federated([Source("board", board), Source("feed", feed)], "blue ring", "graz", size=100_000)
