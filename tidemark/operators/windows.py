"""Order, limits, windows and scans by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query


def first_by(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key: one row a key, by a window."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def fair_queue(df: DataFrame, group: str, due: str, key: str, n: int) -> DataFrame:
    """Round-robin over groups, those never or longest ago served first; only the first n of a group can be taken."""
    turn = Window.partitionBy(group).orderBy(F.col(due).asc_nulls_first(), key)
    return df.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= n).orderBy("turn", F.col(due).asc_nulls_first(), key).limit(n)


def seeded_rank(key: str, seed: int = 17) -> Column:
    """A repeatable stand-in for a random rank."""
    return F.xxhash64(F.col(key), F.lit(seed))


@query("fair_queue", "W-1 F-23", "SELECT company_id, ats, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY ats ORDER BY last_synced_at ASC NULLS FIRST, company_id) AS turn FROM {companies} WHERE company_status = 'active' AND (last_synced_at IS NULL OR last_synced_at < {as_of} - INTERVAL 60 MINUTE)) ORDER BY turn, last_synced_at NULLS FIRST, company_id LIMIT 150")
def _fair(t):
    due = t.companies.filter("company_status = 'active'").filter(F.col("last_synced_at").isNull() | F.expr("last_synced_at < TIMESTAMP_NTZ '2001-08-02 00:00:00' - INTERVAL 60 MINUTE"))
    return fair_queue(due, "ats", "last_synced_at", "company_id", 150).select("company_id", "ats", "turn")


@query("first_of_company", "W-3", "SELECT company_id, id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id) AS k FROM {postings}) WHERE k = 1")
def _first(t):
    return t.postings.groupBy("company_id").agg(F.min("id").alias("id"))


@query("latest_by_path", "W-4", "SELECT title_key, id, last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY last_seen_at DESC NULLS LAST, id) AS k FROM {postings}) WHERE k = 1")
def _latest(t):
    return first_by(t.postings.select("title_key", "id", "last_seen_at"), ["title_key"], [F.col("last_seen_at").desc_nulls_last(), F.col("id")])


@query("survivor", "W-5", "SELECT ats, ats_slug, company_id, live FROM (SELECT *, row_number() OVER (PARTITION BY ats, ats_slug ORDER BY live DESC, company_id) AS k FROM (SELECT c.ats, c.ats_slug, c.company_id, count(j.id) AS live FROM {companies} c LEFT JOIN {postings} j ON j.company_id = c.company_id AND j.removed_at IS NULL GROUP BY 1, 2, 3)) WHERE k = 1")
def _survivor(t):
    live = t.postings.filter(F.col("removed_at").isNull()).groupBy("company_id").agg(F.count("*").alias("n"))
    rows = t.companies.join(live, "company_id", "left").select("ats", "ats_slug", "company_id", F.coalesce("n", F.lit(0)).alias("live"))
    return first_by(rows, ["ats", "ats_slug"], [F.desc("live"), F.col("company_id")])


@query("first_wins", "W-6", "SELECT lower(ats_slug) AS slug, min(company_id) AS company_id FROM {companies} GROUP BY 1")
def _first_wins(t):
    return t.companies.groupBy(F.lower("ats_slug").alias("slug")).agg(F.min("company_id").alias("company_id"))


@query("last_wins", "W-7", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def _last_wins(t):
    return t.events.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("m")).select("user_id", "m.event_id", "m.event_type")


@query("board_order", "W-8 W-11", "SELECT id, first_seen_at FROM {postings} WHERE removed_at IS NULL ORDER BY first_seen_at DESC, id LIMIT 50 OFFSET 100")
def _board_order(t):
    return t.postings.filter(F.col("removed_at").isNull()).select("id", "first_seen_at").orderBy(F.desc("first_seen_at"), "id").offset(100).limit(50)


@query("seeded_board_order", "W-8 S-12 H9")
def _seeded(t):
    return t.postings.filter(F.col("removed_at").isNull()).select("id", "first_seen_at").orderBy(F.desc("first_seen_at"), seeded_rank("id")).limit(50)


@query("demand_order", "W-9 W-12", "SELECT user_id, count(*) AS search_count, min(value) AS last_result FROM events GROUP BY 1 ORDER BY search_count DESC, last_result ASC NULLS LAST, user_id LIMIT 20")
def _demand(t):
    own = t.events.groupBy("user_id").agg(F.count("*").alias("search_count"), F.min("value").alias("last_result"))
    return own.orderBy(F.desc("search_count"), F.col("last_result").asc_nulls_last(), "user_id").limit(20)


@query("active_first", "W-10", "SELECT company_id, company_status FROM {companies} ORDER BY (company_status = 'active') DESC, company_id LIMIT 40")
def _active(t):
    return t.companies.select("company_id", "company_status").orderBy((F.col("company_status") == "active").desc(), "company_id").limit(40)


@query("top_companies", "W-12 A-5", "SELECT company_name, count(*) AS jobs FROM {postings} JOIN {companies} USING (company_id) WHERE removed_at IS NULL GROUP BY 1 ORDER BY jobs DESC, company_name LIMIT 25")
def _top(t):
    counts = t.postings.filter(F.col("removed_at").isNull()).groupBy("company_id").agg(F.count("*").alias("jobs"))
    return counts.join(t.companies, "company_id").select("company_name", "jobs").orderBy(F.desc("jobs"), "company_name").limit(25)


@query("point_lookup", "S-4", "SELECT id, company_name, title FROM {jobs} JOIN {companies} USING (company_id) WHERE id = 7")
def _point(t):
    return t.jobs.filter("id = 7").join(t.companies, "company_id").select("id", "company_name", "title")


@query("keyset_scan", "S-1 S-5 S-7", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 AND o_orderkey <= 900")
def _keyset(t):
    return t.orders.filter("o_orderkey > 500 AND o_orderkey <= 900").select("o_orderkey", "o_totalprice")


@query("composite_keyset", "S-6", "SELECT id, first_seen_at FROM {postings} WHERE (first_seen_at, id) > (TIMESTAMP '1998-01-01 00:00:00', 100) ORDER BY first_seen_at, id LIMIT 200")
def _composite(t):
    at = F.struct(F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'").alias("first_seen_at"), F.lit(100).cast("long").alias("id"))
    return t.postings.select("id", "first_seen_at").filter(F.struct("first_seen_at", "id") > at).orderBy("first_seen_at", "id").limit(200)


@query("modulo_partition", "S-10", "SELECT count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderkey % 4 = 3")
def _modulo(t):
    return t.orders.filter(F.pmod("o_orderkey", F.lit(4)) == 3).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("page_sample", "S-11")
def _sample(t):
    return t.orders.sample(0.1, seed=11).select("o_orderkey")


@query("candidate_scan", "S-9 F-22", "SELECT id FROM (SELECT j.id, coalesce(j.posted_at, j.first_seen_at) AS effective, j.last_seen_at < c.last_synced_at - INTERVAL 5 MINUTE AS gone FROM {postings} j JOIN {companies} c USING (company_id) WHERE j.removed_at IS NULL) WHERE effective < {as_of} - INTERVAL 30 DAY OR gone")
def _candidates(t):
    live = t.postings.filter("removed_at IS NULL").join(t.companies, "company_id")
    return live.filter(F.expr("coalesce(posted_at, first_seen_at) < TIMESTAMP_NTZ '2001-08-02 00:00:00' - INTERVAL 30 DAY OR last_seen_at < last_synced_at - INTERVAL 5 MINUTE")).select("id")


@query("claim_batch", "S-13", "SELECT company_id FROM {companies} WHERE company_status = 'active' ORDER BY last_synced_at NULLS FIRST, company_id LIMIT 100")
def _claim(t):
    return t.companies.filter("company_status = 'active'").orderBy(F.col("last_synced_at").asc_nulls_first(), "company_id").select("company_id").limit(100)


@query("range_shards", "S-18", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS shard, count(*) AS n FROM orders GROUP BY 1")
def _shards(t):
    """Half-open ranges of a key that is not unique: ties stay in one shard."""
    return t.orders.groupBy(F.floor(F.col("o_totalprice") / 50000).alias("shard")).agg(F.count("*").alias("n"))
