"""Joins: star reads, outer joins with conditions, semi and anti joins, twins, and derived keys; and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query


def name_key(*columns: str) -> Column:
    """Trimmed lower-case columns, joined by a pipe."""
    return F.concat_ws("|", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in columns))


def url_key(url: Column) -> Column:
    """Scheme, host and path in lower case, without query, fragment and trailing slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", ""))


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


@query("star_join", "J-2", "SELECT id, title_key, company_name, ats FROM {postings} JOIN {companies} USING (company_id) WHERE removed_at IS NULL")
def _star(t):
    return t.postings.filter(F.col("removed_at").isNull()).join(t.companies, "company_id").select("id", "title_key", "company_name", "ats")


@query("left_join", "J-3", "SELECT id, company_name FROM {postings} LEFT JOIN (SELECT * FROM {companies} WHERE company_status = 'active') c USING (company_id)")
def _left(t):
    return t.postings.join(t.companies.filter("company_status = 'active'"), "company_id", "left").select("id", "company_name")


@query("left_join_on_condition", "J-4", "SELECT c.company_id, count(j.id) AS live_jobs FROM {companies} c LEFT JOIN {postings} j ON j.company_id = c.company_id AND j.removed_at IS NULL GROUP BY 1")
def _left_on(t):
    """Companies without live postings stay with 0. Postings are counted before the join."""
    live = t.postings.filter(F.col("removed_at").isNull()).groupBy("company_id").agg(F.count("*").alias("n"))
    return t.companies.join(live, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("live_jobs"))


@query("semi_join", "J-5", "SELECT company_id FROM {companies} c WHERE EXISTS (SELECT 1 FROM {postings} j WHERE j.company_id = c.company_id AND j.is_remote)")
def _semi(t):
    return t.companies.select("company_id").join(t.postings.filter("is_remote"), "company_id", "left_semi")


@query("anti_join", "J-6", "SELECT company_id FROM {companies} c WHERE NOT EXISTS (SELECT 1 FROM {postings} j WHERE j.company_id = c.company_id AND j.is_remote)")
def _anti(t):
    return t.companies.select("company_id").join(t.postings.filter("is_remote"), "company_id", "left_anti")


@query("tuple_semi_join", "J-7", "SELECT company_id, ats, ats_slug FROM {companies} WHERE (ats, ats_slug) IN (SELECT ats, ats_slug FROM {companies} GROUP BY 1, 2 HAVING count(*) > 1)")
def _tuple(t):
    again = t.companies.groupBy("ats", "ats_slug").agg(F.count("*").alias("n")).filter("n > 1")
    return t.companies.join(again, ["ats", "ats_slug"], "left_semi").select("company_id", "ats", "ats_slug")


def twins(feed: DataFrame, native: DataFrame) -> DataFrame:
    """Rows of a feed with the live row of the board that their link names: key (external_id, board) of feed, both of native."""
    named = feed.filter(F.col("key").isNotNull()).withColumns({"external_id": F.col("key.external_id"), "board": F.col("key.board")}).drop("key")
    return named.join(native, ["external_id", "board"])


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value is not among the values, as SQL's NOT IN has it: an anti join by hash, since nulls are looked for first."""
    found = values.toDF("__v")
    if not found.filter("__v IS NULL").isEmpty():
        return df.limit(0)
    rows = df if found.isEmpty() else df.filter(F.col(column).isNotNull())
    return rows.join(found, F.col(column) == F.col("__v"), "left_anti")


@query("not_in_subquery", "J-8", "SELECT s_suppkey FROM (SELECT CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey END AS s_suppkey FROM supplier) WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R')")
def _not_in(t):
    """NOT IN with nulls: a null is in no result, and a null among the values would empty it."""
    own = t.supplier.select(F.when(F.col("s_suppkey") % 10 > 0, F.col("s_suppkey")).alias("s_suppkey"))
    return not_in(own, "s_suppkey", t.lineitem.filter("l_quantity > 49 AND l_returnflag = 'R'").select("l_suppkey"))


@query("not_in_with_null", "J-8", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT CASE WHEN l_linenumber > 1 THEN l_suppkey END FROM lineitem)")
def _not_in_null(t):
    return not_in(t.supplier.select("s_suppkey"), "s_suppkey", t.lineitem.select(F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("l_suppkey")))


@query("array_membership", "J-9", "SELECT id FROM {postings} WHERE role_category IN ('1-URGENT', '2-HIGH') AND experience_level IS NOT NULL AND experience_level <> 'lead'")
def _member(t):
    return t.postings.filter(F.col("role_category").isin("1-URGENT", "2-HIGH") & ~F.col("experience_level").isin("lead")).select("id")


LOSERS = "(SELECT company_id AS loser, first_value(company_id) OVER (PARTITION BY ats, ats_slug ORDER BY company_id) AS keeper FROM {companies})"


@query("loser_keeper_join", "J-10 W-5", f"WITH m AS (SELECT * FROM {LOSERS} WHERE loser <> keeper) SELECT j.id AS loser_id, k.id AS keeper_id FROM m JOIN {{postings}} j ON j.company_id = m.loser JOIN {{postings}} k ON k.company_id = m.keeper AND k.title_key = j.title_key AND k.role_category = j.role_category")
def _loser(t):
    keep = t.companies.groupBy("ats", "ats_slug").agg(F.min("company_id").alias("keeper"))
    m = t.companies.join(keep, ["ats", "ats_slug"]).filter("company_id <> keeper").select(F.col("company_id").alias("loser"), "keeper")
    a = t.postings.select(F.col("id").alias("loser_id"), F.col("company_id").alias("loser"), "title_key", "role_category")
    b = t.postings.select(F.col("id").alias("keeper_id"), F.col("company_id").alias("keeper"), "title_key", "role_category")
    return a.join(m, "loser").join(b, ["keeper", "title_key", "role_category"]).select("loser_id", "keeper_id")


@query("scalar_subquery", "J-11", "SELECT c.company_id, (SELECT count(*) FROM {postings} j WHERE j.company_id = c.company_id) AS jobs, (SELECT min(j.external_id) FROM {postings} j WHERE j.company_id = c.company_id) AS first_external FROM {companies} c")
def _scalar(t):
    own = t.postings.groupBy("company_id").agg(F.count("*").alias("n"), F.min("external_id").alias("first_external"))
    return t.companies.join(own, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("jobs"), "first_external")


@query("fill_from_subquery", "J-12", "SELECT j.id, coalesce(j.visa_sponsorship, m.visa) AS visa_sponsorship FROM {postings} j LEFT JOIN (SELECT company_id, CASE WHEN min(visa_sponsorship) = max(visa_sponsorship) THEN min(visa_sponsorship) END AS visa FROM {postings} GROUP BY 1) m USING (company_id)")
def _fill(t):
    from .aggregates import unanimous

    m = unanimous(t.postings, ["company_id"], ["visa_sponsorship"]).withColumnRenamed("visa_sponsorship", "visa")
    return t.postings.join(m, "company_id", "left").select("id", F.coalesce("visa_sponsorship", "visa").alias("visa_sponsorship"))


@query("stale_after_sync", "J-13 P-8", "SELECT j.id, j.last_seen_at < c.last_synced_at - INTERVAL 5 MINUTE AS missing_from_sync FROM {postings} j JOIN {companies} c USING (company_id) WHERE j.removed_at IS NULL AND c.last_synced_at IS NOT NULL")
def _stale(t):
    live = t.postings.filter(F.col("removed_at").isNull())
    return live.join(t.companies.filter("last_synced_at IS NOT NULL"), "company_id").select("id", F.expr("last_seen_at < last_synced_at - INTERVAL 5 MINUTE").alias("missing_from_sync"))


@query("feed_twins", "J-14 U-2", "SELECT f.id AS feed_id, min(n.id) AS native_id FROM {postings} f JOIN {companies} fc ON fc.company_id = f.company_id JOIN {postings} n ON n.title_key = f.title_key AND n.role_category = f.role_category JOIN {companies} nc ON nc.company_id = n.company_id WHERE f.id % 11 = 0 AND n.id % 11 <> 0 AND n.removed_at IS NULL AND fc.ats_slug = nc.ats_slug GROUP BY 1")
def _twins(t):
    """Rows of a feed that name a posting its own board also carries: equal keys and equal board."""
    rows = t.postings.join(t.companies.select("company_id", "ats_slug"), "company_id")
    feed = rows.filter("id % 11 = 0").select(F.col("id").alias("feed_id"), "title_key", "role_category", "ats_slug")
    native = rows.filter("id % 11 <> 0 AND removed_at IS NULL").groupBy("title_key", "role_category", "ats_slug").agg(F.min("id").alias("native_id"))
    return feed.join(native, ["title_key", "role_category", "ats_slug"]).select("feed_id", "native_id")


@query(
    "feed_twin_links",
    "J-14 U-2",
    "SELECT f.o_orderkey AS feed_id, n.o_orderkey AS native_id FROM orders f JOIN orders n ON n.o_orderkey = f.o_orderkey + 1 AND n.o_custkey % 400 = f.o_custkey % 400 WHERE f.o_orderkey % 2 = 1 AND n.o_orderstatus <> 'F'",
)
def _twin_links(t):
    """A feed's rows name a posting by its link; the twin has that id, and its board is the link's."""
    from ..functions.text import posting_key

    k = F.col("o_orderkey")
    board = F.concat(F.lit("board"), (F.col("o_custkey") % 400).cast("string"))
    feed = t.orders.filter(k % 2 == 1).select(k.alias("feed_id"), F.concat(F.lit("https://boards.greenhouse.io/"), F.initcap(board), F.lit("/jobs/"), (k + 1).cast("string"), F.lit("?gh_src=x")).alias("url"))
    native = t.orders.filter((k % 2 == 0) & (F.col("o_orderstatus") != "F")).select(k.alias("native_id"), F.concat(F.lit("greenhouse_"), k.cast("string")).alias("external_id"), board.alias("board"))
    return twins(feed.withColumn("key", posting_key(F.lit("greenhouse"), F.col("url"))), native).select("feed_id", "native_id")


@query("name_key_join", "J-15", "SELECT concat(lower(trim(c_name)), '|', lower(trim(c_mktsegment))) AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _name_key(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(counts, "c_custkey").groupBy(name_key("c_name", "c_mktsegment").alias("k")).agg(F.sum("n").alias("n"))


@query("url_key_anti_join", "J-16 O-2", "WITH k AS (SELECT page_id, lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')) AS k FROM pages) SELECT page_id, k FROM k WHERE page_id % 2 = 0 AND k NOT IN (SELECT k FROM k WHERE page_id % 2 = 1)")
def _url_anti(t):
    rows = t.pages.select("page_id", url_key(F.col("url")).alias("k"))
    return missing_from(rows.filter("page_id % 2 = 0"), rows.filter("page_id % 2 = 1"), ["k"]).select("page_id", "k")


@query("map_join", "J-17 P-9", "SELECT o_orderkey AS id, n AS job_count FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def _late(t):
    """Late materialisation: the page is cut first, and only its rows are joined with what is wide."""
    page = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("job_count"))
    return F.broadcast(page).join(counts, "o_custkey").select(F.col("o_orderkey").alias("id"), "job_count")


@query("zip_join", "J-18", "SELECT o_orderkey AS id, reason FROM orders JOIN (SELECT unnest([1, 5, 9, 13]) AS k, unnest(['dead', 'twin', 'dead', 'moved']) AS reason) ON o_orderkey = k")
def _zip(t):
    pairs = t.spark.range(1).select(F.explode(F.arrays_zip(F.lit([1, 5, 9, 13]).alias("k"), F.lit(["dead", "twin", "dead", "moved"]).alias("reason"))).alias("p")).select("p.*")
    return t.orders.join(F.broadcast(pairs), F.col("o_orderkey") == F.col("k")).select(F.col("o_orderkey").alias("id"), "reason")


@query("sibling_lookup", "J-19", "SELECT a.company_id, min(b.company_id) AS sibling FROM {companies} a JOIN {companies} b ON a.ats_slug = b.ats_slug AND a.ats <> b.ats GROUP BY 1")
def _sibling(t):
    """The least company of another ATS with the same slug: per slug and ATS first, so that groups are never paired."""
    least = t.companies.groupBy("ats_slug", "ats").agg(F.min("company_id").alias("low"))
    other = least.select("ats_slug", F.col("ats").alias("other"), "low")
    best = least.select("ats_slug", "ats").join(other, "ats_slug").filter("ats <> other").groupBy("ats_slug", "ats").agg(F.min("low").alias("sibling"))
    return t.companies.join(best, ["ats_slug", "ats"]).select("company_id", "sibling")


@query("json_path", "J-1", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def _json(t):
    k = F.get_json_object("props", "$.k")
    return t.events.filter(k.isNotNull()).groupBy(k.cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("union_of_sets", "O-1", "SELECT company_id, array_to_string(list_sort(list_distinct(list(v))), '|') AS codes FROM (SELECT company_id, employment_type AS v FROM {postings} UNION ALL SELECT company_id, workplace_type FROM {postings}) WHERE v IS NOT NULL GROUP BY 1")
def _union(t):
    own = t.postings.groupBy("company_id").agg(F.array_union(F.collect_set("employment_type"), F.collect_set("workplace_type")).alias("c"))
    return own.filter(F.size("c") > 0).select("company_id", F.array_join(F.array_sort("c"), "|").alias("codes"))


@query("key_difference", "O-3", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 25")
def _difference(t):
    return missing_from(t.orders.filter("o_orderkey % 3 <> 0").select("o_orderkey"), t.lineitem.filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("first_claim_union", "O-4 O-5", "SELECT id, claim FROM (SELECT id, claim, row_number() OVER (PARTITION BY id ORDER BY priority) AS k FROM (SELECT id, 'board' AS claim, 1 AS priority FROM {postings} WHERE is_remote UNION ALL SELECT id, 'feed', 2 FROM {postings} WHERE experience_level = 'entry')) WHERE k = 1")
def _claim(t):
    board = t.postings.filter("is_remote").select("id", F.lit("board").alias("claim"), F.lit(1).alias("priority"))
    feed = t.postings.filter("experience_level = 'entry'").select("id", F.lit("feed").alias("claim"), F.lit(2).alias("priority"))
    return board.union(feed).groupBy("id").agg(F.min_by("claim", "priority").alias("claim"))


def first_site(parts: list[DataFrame], key: str) -> DataFrame:
    """Whole rows of several sites, by key: of rows with one key that of the first site stays."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, (p.withColumn("__turn", F.lit(k)) for k, p in enumerate(parts)))
    rest = [c for c in every.columns if c not in (key, "__turn")]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "__turn").alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


@query(
    "first_site_rows",
    "O-5",
    "SELECT external_id, site, title FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY turn) AS k FROM (SELECT external_id, 'one' AS site, role_category AS title, 0 AS turn FROM {postings} WHERE id % 2 = 0 UNION ALL SELECT external_id, 'two', experience_level, 1 FROM {postings} WHERE id % 3 = 0 UNION ALL SELECT external_id, 'three', 'x', 2 FROM {postings})) WHERE k = 1",
)
def _first_site(t):
    sites = [(t.postings.filter("id % 2 = 0"), "one", F.col("role_category")), (t.postings.filter("id % 3 = 0"), "two", F.col("experience_level")), (t.postings, "three", F.lit("x"))]
    return first_site([df.select("external_id", F.lit(name).alias("site"), title.alias("title")) for df, name, title in sites], "external_id")


@query("intersection", "O-6", "SELECT company_id FROM {postings} WHERE is_remote INTERSECT SELECT company_id FROM {postings} WHERE visa_sponsorship = 'yes'")
def _intersect(t):
    return t.postings.filter("is_remote").select("company_id").intersect(t.postings.filter("visa_sponsorship = 'yes'").select("company_id"))
