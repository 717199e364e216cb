"""Aggregations: facets, conditional and capped counts, votes, unanimity, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query


def facet(df: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values; unknown ones are no value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts for several columns in one pass: each row is spread once, and partial counts are merged."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))


def capped_count(df: DataFrame, cap: int = 10_000) -> DataFrame:
    """Exact to the cap: each partition stops early, and one more than the cap says that there are more."""
    n = F.count("*")
    return df.limit(cap + 1).agg(F.least(n, F.lit(cap)).alias("total"), (n > cap).alias("capped"))


def unanimous(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key, each column's value if all rows that have one agree on it."""
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != ""), F.min(c)).alias(c)
    return df.groupBy(*keys).agg(*(one(c) for c in columns))


def place_countries(df: DataFrame, least_rows: int = 20, least_share: float = 0.3, most: int = 3) -> DataFrame:
    """(place, country) votes: a country's share of a place's rows, if the place has enough, the commonest first."""
    from pyspark.sql import Window

    votes = df.groupBy("place", "country").agg(F.count("*").alias("n"))
    all_of = Window.partitionBy("place")
    ranked = votes.withColumn("total", F.sum("n").over(all_of)).withColumn("rank", F.row_number().over(all_of.orderBy(F.desc("n"), "country")))
    return ranked.filter((F.col("total") >= least_rows) & (F.col("n") >= least_share * F.col("total")) & (F.col("rank") <= most)).select("place", "country", "n", "rank")


@query("facet_counts", "A-1 F-1", "SELECT role_category AS value, count(*) AS n FROM {postings} WHERE removed_at IS NULL AND role_category IS NOT NULL GROUP BY 1")
def _facet_counts(t):
    return facet(t.postings.filter(F.col("removed_at").isNull()), "role_category")


@query(
    "facet_distribution",
    "A-2",
    "WITH live AS (SELECT * FROM {postings} WHERE removed_at IS NULL) SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM live WHERE {c} IS NOT NULL GROUP BY 2" for c in ("role_category", "employment_type", "workplace_type", "experience_level", "visa_sponsorship"))
    + ")",
)
def _facet_distribution(t):
    return facets(t.postings.filter(F.col("removed_at").isNull()), ["role_category", "employment_type", "workplace_type", "experience_level", "visa_sponsorship"])


@query("capped_count", "A-3 R-6", "SELECT least(count(*), 10000) AS total, count(*) > 10000 AS capped FROM (SELECT 1 FROM {postings} WHERE removed_at IS NULL LIMIT 10001)")
def _capped(t):
    return capped_count(t.postings.filter(F.col("removed_at").isNull()))


@query("estimated_count", "A-4", "SELECT count(*) AS estimate FROM orders")
def _estimated(t):
    """Row counts come from the footers: no column is read."""
    return t.orders.agg(F.count("*").alias("estimate"))


@query(
    "conditional_counts",
    "A-5 A-19",
    "SELECT company_id, count(*) AS total, count(*) FILTER (WHERE removed_at IS NULL) AS live, count(*) FILTER (WHERE is_remote) AS remote, CAST(sum(CASE WHEN salary_min_annual IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpriced FROM {postings} GROUP BY 1",
)
def _conditional(t):
    return t.postings.groupBy("company_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("removed_at").isNull()).alias("live"), F.count_if("is_remote").alias("remote"), F.sum(F.when(F.col("salary_min_annual").isNull(), 1).otherwise(0)).alias("unpriced")
    )


@query("count_distinct", "A-6", "SELECT role_category, count(DISTINCT company_id) AS companies, count(DISTINCT title_key) AS titles FROM {postings} GROUP BY 1")
def _count_distinct(t):
    return t.postings.groupBy("role_category").agg(F.count_distinct("company_id").alias("companies"), F.count_distinct("title_key").alias("titles"))


@query(
    "merged_facets",
    "A-7",
    "WITH a AS (SELECT employment_type AS value, count(*) AS n FROM {postings} WHERE is_remote AND employment_type IS NOT NULL GROUP BY 1), b AS (SELECT employment_type AS value, count(*) AS n FROM {postings} WHERE experience_level = 'senior' AND employment_type IS NOT NULL GROUP BY 1) SELECT value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1",
)
def _merged_facets(t):
    """Facets of several role queries added up: a row that two roles hit counts for both."""
    parts = [facet(t.postings.filter(c), "employment_type") for c in (F.col("is_remote"), F.col("experience_level") == "senior")]
    return parts[0].unionByName(parts[1]).groupBy("value").agg(F.sum("n").alias("n"))


@query(
    "place_country_vote",
    "A-8",
    "WITH v AS (SELECT c_mktsegment AS place, n_name AS country, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY place) AS total, row_number() OVER (PARTITION BY place ORDER BY n DESC, country) AS rank FROM v) SELECT place, country, n, CAST(rank AS INTEGER) AS rank FROM r WHERE total >= 20 AND n >= 0.04 * total AND rank <= 3",
)
def _place_vote(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return place_countries(rows.select(F.col("c_mktsegment").alias("place"), F.col("n_name").alias("country")), least_share=0.04)


@query("duplicate_groups", "A-9", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _duplicates(t):
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).filter("n > 1")


@query(
    "unanimous_values",
    "A-10",
    "SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) AND min(l_returnflag) <> '' THEN min(l_returnflag) END AS l_returnflag, CASE WHEN min(l_linestatus) = max(l_linestatus) AND min(l_linestatus) <> '' THEN min(l_linestatus) END AS l_linestatus FROM lineitem GROUP BY 1",
)
def _unanimous(t):
    return unanimous(t.lineitem, ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("array_roll_up", "A-11", "SELECT company_id, array_to_string(list_sort(list_distinct(list(role_category))), '|') AS roles, min(id) AS first_id FROM {postings} GROUP BY 1")
def _arrays(t):
    return t.postings.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_set("role_category")), "|").alias("roles"), F.min("id").alias("first_id"))


@query("age_histogram", "A-12", "SELECT CAST(floor(date_diff('day', o_orderdate, {as_of}) / 90) AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _histogram(t):
    return t.orders.groupBy(F.floor(F.datediff(F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'"), "o_orderdate") / 90).alias("bucket")).agg(F.count("*").alias("n"))


@query("trailing_window", "A-13 X-13", "SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 24 HOUR) AS last_day FROM events WHERE ts <= TIMESTAMP '2024-01-30 23:00:00'")
def _trailing(t):
    at = F.expr("TIMESTAMP_NTZ '2024-01-30 23:00:00'")
    ts = F.col("ts").cast("timestamp_ntz")
    return t.events.filter(ts <= at).agg(F.count_if(ts > at - F.expr("INTERVAL 1 HOUR")).alias("last_hour"), F.count_if(ts > at - F.expr("INTERVAL 24 HOUR")).alias("last_day"))


@query("source_counts", "A-14", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _source_counts(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("id_bounds", "A-15", "SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def _bounds(t):
    return t.orders.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query(
    "board_roll_up",
    "A-16 W-15",
    "SELECT ats, ats_slug, min(first_seen_at) AS first_seen, max(last_seen_at) AS last_seen, count(*) FILTER (WHERE removed_at IS NULL) AS live, count(*) FILTER (WHERE removed_at IS NOT NULL) AS retired, array_to_string(list_slice(list_sort(list_distinct(list(external_id))), 1, 3), '|') AS samples FROM {postings} JOIN {companies} USING (company_id) GROUP BY 1, 2",
)
def _board(t):
    """Postings are summed by company before they meet their boards. Samples are a board's three least ids, of the
    three least of each of its companies, which share the shuffle of the sums."""
    from pyspark.sql import Window

    own = t.postings.withColumn("k", F.row_number().over(Window.partitionBy("company_id").orderBy("external_id")))
    sums = own.groupBy("company_id").agg(
        F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.count_if(F.col("removed_at").isNull()).alias("live"), F.count_if(F.col("removed_at").isNotNull()).alias("retired"),
        F.collect_list(F.when(F.col("k") <= 3, F.col("external_id"))).alias("least"),
    )
    boards = sums.join(t.companies.select("company_id", "ats", "ats_slug"), "company_id").groupBy("ats", "ats_slug")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))), 1, 3)
    return boards.agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("live").alias("live"), F.sum("retired").alias("retired"), F.array_join(least, "|").alias("samples"))


@query("transition_matrix", "A-17", "SELECT coalesce(visa_sponsorship, '') AS was, CASE WHEN id % 2 = 0 THEN coalesce(visa_sponsorship, '') ELSE 'no' END AS now, count(*) AS n FROM {postings} GROUP BY 1, 2")
def _transitions(t):
    was = F.coalesce("visa_sponsorship", F.lit(""))
    return t.postings.groupBy(was.alias("was"), F.when(F.col("id") % 2 == 0, was).otherwise("no").alias("now")).agg(F.count("*").alias("n"))


@query(
    "quality_scorecard",
    "A-18",
    "SELECT ats, round(100.0 * count(salary_min_annual) / count(*), 1) AS salary_pct, round(100.0 * count(employment_type) / count(*), 1) AS type_pct, round(100.0 * count(posted_at) / count(*), 1) AS posted_pct FROM {postings} JOIN {companies} USING (company_id) WHERE removed_at IS NULL GROUP BY 1",
)
def _scorecard(t):
    live = t.postings.filter(F.col("removed_at").isNull()).join(t.companies, "company_id")
    pct = lambda c, name: F.round(100.0 * F.count(c) / F.count("*"), 1).alias(name)
    return live.groupBy("ats").agg(pct("salary_min_annual", "salary_pct"), pct("employment_type", "type_pct"), pct("posted_at", "posted_pct"))


@query("prefix_counts", "A-20", "SELECT split_part(external_id, '_', 1) AS feed, ats, count(*) AS n FROM {postings} JOIN {companies} USING (company_id) GROUP BY 1, 2")
def _prefix(t):
    return t.postings.join(t.companies, "company_id").groupBy(F.substring_index("external_id", "_", 1).alias("feed"), "ats").agg(F.count("*").alias("n"))


@query("distinct_places", "A-21", "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY first_line, l_suppkey) AS suppliers FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _places(t):
    """The different suppliers of an order, in the order of their first lines."""
    once = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_line", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string"))
    return once.groupBy("l_orderkey").agg(F.array_join(listed, ",").alias("suppliers"))


@query(
    "commonest_value",
    "A-22",
    "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem WHERE l_returnflag <> '' GROUP BY 1, 2) SELECT l_orderkey, l_returnflag AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first_line, l_returnflag) AS k FROM c) WHERE k = 1",
)
def _mode(t):
    """The commonest value, the first seen among equals: two counts, no window."""
    counts = t.lineitem.filter("l_returnflag <> ''").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first_line"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first_line", F.col("l_returnflag").alias("value")))
    return counts.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.value")
