"""Merge policies: stored state and a batch give new state. One full outer join; rules are data, one for each column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query

Rule = Callable[[Column, Column], Column]


def new(o: Column, n: Column) -> Column:
    return n


def old(o: Column, n: Column) -> Column:
    return o


def new_or_old(o: Column, n: Column) -> Column:
    return F.coalesce(n, o)


def old_or_new(o: Column, n: Column) -> Column:
    return F.coalesce(o, n)


def stated(o: Column, n: Column) -> Column:
    """The new value unless it is '' or null."""
    return F.when(n != "", n).otherwise(o)


def unless(flag: str) -> Rule:
    """Keep what is stored where the flag column of the stored row is set."""
    return lambda o, n: F.when(F.col(f"o.{flag}").isNotNull(), o).otherwise(F.coalesce(n, o))


def follows(column: str) -> Rule:
    """Keep what is stored where the batch leaves `column` open and the stored row states it."""
    return lambda o, n: F.when(F.col(f"n.{column}").isNull() & F.col(f"o.{column}").isNotNull(), o).otherwise(n)


@dataclass(frozen=True)
class Policy:
    """rules: by column, for rows found on both sides; a column without one takes `default`."""

    keys: tuple[str, ...]
    rules: dict[str, Rule] = field(default_factory=dict)
    default: Rule = new_or_old
    revive: bool = True


#: The rules of an authoritative sync: it owns titles and links, never unlearns pay or place, and respects stated facts.
AUTHORITATIVE = Policy(
    ("external_id", "company_id"),
    {c: new for c in ("title", "department", "url", "role_category", "raw_data")}
    | {c: new_or_old for c in ("location", "workplace_type", "salary_min", "salary_max", "salary_currency", "salary_interval", "salary_min_annual", "salary_max_annual", "description")}
    | {c: unless("ats_facts_at") for c in ("employment_type", "posted_at")}
    | {c: stated for c in ("visa_sponsorship", "experience_level")}
    | {c: follows("workplace_type") for c in ("is_remote", "remote_worldwide")}
    | {"first_seen_at": old},
)
GAP_FILL = Policy(("external_id", "company_id"), {}, old_or_new, revive=False)
OVERWRITE = Policy(("external_id", "company_id"), {"first_seen_at": old}, new)
REPLICA = Policy(("external_id", "company_id"), {"title": new, "url": new, "posted_at": new, "description": new_or_old}, old)


def last_of_batch(batch: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One row for each key: the last in the batch's order."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge(stored: DataFrame, batch: DataFrame, policy: Policy, now: Column | None = None, order: Column | None = None) -> DataFrame:
    """New state, and `change`: inserted, updated or kept.

    Columns of stored decide the shape; a column the batch lacks keeps its value. `last_seen_at`, `absent_syncs` and
    `removed_at`, if stored has them, are set by the policy on rows of the batch. Of rows of the batch that repeat a key the
    one with the largest `order` counts, a column of the batch or an expression; without it, the last as the batch is read.
    """
    batch = last_of_batch(batch.withColumn("__order", F.monotonically_increasing_id() if order is None else order), policy.keys, "__order").drop("__order")
    o, n, keys = stored.alias("o"), batch.withColumn("__in", F.lit(True)).alias("n"), policy.keys
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = o.withColumn("__had", F.lit(True)).alias("o").join(n, on, "full_outer")
    had, came = F.col("o.__had").isNotNull(), F.col("n.__in").isNotNull()
    out = []
    for c in stored.columns:
        a = F.col(f"o.{c}")
        if c in keys:
            v = F.coalesce(a, F.col(f"n.{c}"))
        elif c == "last_seen_at" and now is not None:
            v = F.when(came, now).otherwise(a)
        elif c == "absent_syncs":
            v = F.when(came, F.lit(0)).otherwise(a)
        elif c == "removed_at":
            v = F.when(came, F.lit(None) if policy.revive else a).otherwise(a)
        elif c not in batch.columns:
            v = a
        else:
            b = F.col(f"n.{c}")
            v = F.when(had & came, policy.rules.get(c, policy.default)(a, b)).when(came, b).otherwise(a)
        out.append(v.cast(stored.schema[c].dataType).alias(c))
    return both.select(*out, F.when(~had, "inserted").when(came, "updated").otherwise("kept").alias("change"))


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the batch's rows of new keys; of rows that repeat a key the first as the batch is read stays."""
    first = last_of_batch(batch.withColumn("__order", -F.monotonically_increasing_id()), tuple(keys), "__order").drop("__order")
    fresh = first.join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def counting(state: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, n, last, least): running counts of hits (key, at, found). Both sides are reduced before they meet."""
    own = hits.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.min("found").alias("least"))
    return state.unionByName(own).groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.min("least").alias("least"))


def absence(state: DataFrame, seen: DataFrame, synced: DataFrame, retire_after: int = 3, armed: bool = False, as_of: Column | None = None) -> DataFrame:
    """Count a posting's absence from syncs of its company, and retire it after retire_after of them if armed.

    synced: (company_id, complete, n_rows). Only complete syncs that found something count; what is seen starts anew.
    """
    whole = synced.filter(F.col("complete") & (F.col("n_rows") > 0)).select("company_id", F.lit(True).alias("__whole")).distinct()
    marked = state.join(seen.select("external_id", "company_id").distinct().withColumn("__seen", F.lit(True)), ["external_id", "company_id"], "left").join(whole, "company_id", "left")
    live = F.col("removed_at").isNull()
    n = F.when(F.col("__seen"), 0).when(F.col("__whole") & live, F.col("absent_syncs") + 1).otherwise(F.col("absent_syncs"))
    out = marked.withColumn("absent_syncs", n.cast("int"))
    gone = F.lit(armed) & live & (F.col("absent_syncs") >= retire_after)
    return out.withColumn("removed_at", F.when(F.col("__seen"), F.lit(None)).when(gone, as_of if as_of is not None else F.current_timestamp()).otherwise(F.col("removed_at"))).select(*state.columns)


def retire(state: DataFrame, reasons: DataFrame, as_of: Column) -> DataFrame:
    """Soft: live rows named in reasons (id, reason) get removed_at; all rows stay."""
    hit = state.join(reasons.groupBy("id").agg(F.min("reason").alias("reason")), "id", "left")
    return hit.withColumn("removed_at", F.when(F.col("removed_at").isNull() & F.col("reason").isNotNull(), as_of).otherwise(F.col("removed_at")))


def retire_request(state: DataFrame, ids: list[int], external_ids: list[str], most: int = 5000) -> DataFrame:
    """A verdict for each posting asked for: retired, already_retired, or unknown. The request's size is bounded."""
    if len(ids) + len(external_ids) > most:
        raise ValueError(f"at most {most} postings a call")
    spark = state.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(None).cast("string").alias("external_id")) for i in ids), *(F.struct(F.lit(None).cast("long").alias("id"), F.lit(e).alias("external_id")) for e in external_ids))).alias("a")).select("a.*")
    by_id = asked.filter("id IS NOT NULL").select("id").distinct().join(state.select("id", "removed_at").withColumn("known", F.lit(True)), "id", "left").select(F.col("id").cast("string").alias("asked"), "known", "removed_at")
    by_ext = asked.filter("external_id IS NOT NULL").select("external_id").distinct().join(state.select("external_id", "removed_at").withColumn("known", F.lit(True)), "external_id", "left").select(F.col("external_id").alias("asked"), "known", "removed_at")
    return by_id.union(by_ext).select("asked", F.when(F.col("known").isNull(), "unknown").when(F.col("removed_at").isNotNull(), "already_retired").otherwise("retired").alias("verdict"))


def dirty(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose fields differ, null-safe as one tuple, with new and lost keys."""
    b, a = before.select(key, F.struct(*fields).alias("b")), after.select(key, F.struct(*fields).alias("a"))
    return b.join(a, key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("b").isNull(), "inserted").when(F.col("a").isNull(), "deleted").otherwise("changed").alias("change"))


def miss_counter(previous: Column, error: Column, now: Column, grace_days: int = 7, least: int = 3) -> dict[str, Column]:
    """misses, since, retire and message of a board that failed again; the state is read from the message's end."""
    pattern = r"\(missing since (\d{4}-\d{2}-\d{2}T[\d:.]+Z), miss (\d+)\)$"
    count = F.regexp_extract(F.coalesce(previous, F.lit("")), pattern, 2)
    stamp = F.regexp_extract(F.coalesce(previous, F.lit("")), pattern, 1)
    since = F.coalesce(F.when(stamp != "", F.try_to_timestamp(stamp)), now)
    misses = F.when(count != "", count.cast("int") + 1).otherwise(1)
    base = F.substring(F.trim(F.regexp_replace(F.coalesce(error, F.lit("unknown error")), pattern, "")), 1, 150)
    return {
        "misses": misses,
        "since": since,
        "retire": (misses >= least) & (F.unix_timestamp(now) - F.unix_timestamp(since) >= grace_days * 86400),
        "message": F.concat(base, F.lit(" (missing since "), F.date_format(since, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(", miss "), misses.cast("string"), F.lit(")")),
    }


def _two_sides(t):
    """Stored: postings of even keys; batch: every third, with other values, and for every fifteenth an older row too."""
    base = t.orders.select(F.concat(F.lit("x_"), F.col("o_orderkey").cast("string")).alias("external_id"), F.col("o_custkey").alias("company_id"), "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    stored = base.filter(k % 2 == 0).select(
        "external_id", "company_id", F.col("o_orderpriority").alias("title"), F.when(k % 4 == 0, "stored place").alias("location"), F.when(k % 5 == 0, "yes").otherwise("").alias("visa_sponsorship"),
        F.when(k % 10 == 0, "Remote").alias("workplace_type"), (k % 10 == 0).alias("is_remote"), F.when(k % 8 == 0, F.col("o_orderdate")).alias("ats_facts_at"), F.lit("Full-time").alias("employment_type"),
        F.col("o_orderdate").alias("first_seen_at"), (k % 3).cast("int").alias("absent_syncs"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("removed_at"),
    )
    batch = base.filter(k % 3 == 0).select(
        "external_id", "company_id", F.concat(F.lit("new "), "o_orderpriority").alias("title"), F.when(k % 9 == 0, "new place").alias("location"), F.when(k % 6 == 0, "no").otherwise("").alias("visa_sponsorship"),
        F.lit(None).cast("string").alias("workplace_type"), F.lit(False).alias("is_remote"), F.lit("Contract").alias("employment_type"), F.col("o_orderdate").alias("first_seen_at"),
    )
    batch = batch.withColumn("seq", F.lit(1))
    older = base.filter(k % 15 == 0).select("external_id", "company_id", F.lit("older").alias("title"), F.lit("older place").alias("location"), F.lit("yes").alias("visa_sponsorship"), F.lit("Remote").alias("workplace_type"), F.lit(True).alias("is_remote"), F.lit("Part-time").alias("employment_type"), F.col("o_orderdate").alias("first_seen_at"), F.lit(0).alias("seq"))
    return stored, batch.unionByName(older)


STORED = """(SELECT concat('x_', CAST(o_orderkey AS VARCHAR)) AS external_id, o_custkey AS company_id, o_orderpriority AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'stored place' END AS location, CASE WHEN o_orderkey % 5 = 0 THEN 'yes' ELSE '' END AS visa_sponsorship, CASE WHEN o_orderkey % 10 = 0 THEN 'Remote' END AS workplace_type, o_orderkey % 10 = 0 AS is_remote, CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate END AS ats_facts_at, 'Full-time' AS employment_type, CAST(o_orderkey % 3 AS INTEGER) AS absent_syncs, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS removed_at FROM orders WHERE o_orderkey % 2 = 0)"""
BATCH = """(SELECT concat('x_', CAST(o_orderkey AS VARCHAR)) AS external_id, o_custkey AS company_id, concat('new ', o_orderpriority) AS title, CASE WHEN o_orderkey % 9 = 0 THEN 'new place' END AS location, CASE WHEN o_orderkey % 6 = 0 THEN 'no' ELSE '' END AS visa_sponsorship, false AS is_remote, 'Contract' AS employment_type FROM orders WHERE o_orderkey % 3 = 0)"""
BOTH = f"FROM {STORED} o FULL OUTER JOIN {BATCH} n ON o.external_id = n.external_id AND o.company_id = n.company_id"


@query(
    "merge_authoritative",
    "K-1 X-14",
    f"""SELECT coalesce(o.external_id, n.external_id) AS external_id, coalesce(n.title, o.title) AS title, coalesce(n.location, o.location) AS location,
CASE WHEN n.external_id IS NULL THEN o.visa_sponsorship WHEN o.external_id IS NULL OR n.visa_sponsorship <> '' THEN n.visa_sponsorship ELSE o.visa_sponsorship END AS visa_sponsorship,
CASE WHEN n.external_id IS NULL THEN o.is_remote WHEN o.workplace_type IS NOT NULL THEN o.is_remote ELSE n.is_remote END AS is_remote,
CASE WHEN n.external_id IS NULL OR o.ats_facts_at IS NOT NULL THEN o.employment_type ELSE n.employment_type END AS employment_type,
CASE WHEN n.external_id IS NOT NULL THEN CASE WHEN o.external_id IS NULL THEN 0 ELSE 0 END ELSE o.absent_syncs END AS absent_syncs,
CASE WHEN n.external_id IS NULL THEN o.removed_at END AS removed_at,
CASE WHEN o.external_id IS NULL THEN 'inserted' WHEN n.external_id IS NULL THEN 'kept' ELSE 'updated' END AS change {BOTH}""",
)
def _authoritative(t):
    return merge(*_two_sides(t), AUTHORITATIVE, order=F.col("seq")).select("external_id", "title", "location", "visa_sponsorship", "is_remote", "employment_type", "absent_syncs", "removed_at", "change")


@query("merge_gap_fill", "K-2", f"SELECT coalesce(o.external_id, n.external_id) AS external_id, coalesce(o.title, n.title) AS title, coalesce(o.location, n.location) AS location, o.removed_at {BOTH}")
def _gap_fill(t):
    return merge(*_two_sides(t), GAP_FILL, order=F.col("seq")).select("external_id", "title", "location", "removed_at")


@query("merge_overwrite", "K-3", f"SELECT coalesce(o.external_id, n.external_id) AS external_id, coalesce(n.title, o.title) AS title, CASE WHEN n.external_id IS NOT NULL THEN n.location ELSE o.location END AS location, CASE WHEN n.external_id IS NULL THEN o.removed_at END AS removed_at {BOTH}")
def _overwrite(t):
    return merge(*_two_sides(t), OVERWRITE, order=F.col("seq")).select("external_id", "title", "location", "removed_at")


@query("merge_inserted_flag", "K-4", f"SELECT coalesce(o.external_id, n.external_id) AS external_id, o.external_id IS NULL AS inserted {BOTH} WHERE n.external_id IS NOT NULL")
def _inserted(t):
    return merge(*_two_sides(t), AUTHORITATIVE, order=F.col("seq")).filter("change <> 'kept'").select("external_id", (F.col("change") == "inserted").alias("inserted"))


@query("merge_replica", "K-5", f"SELECT coalesce(o.external_id, n.external_id) AS external_id, coalesce(n.title, o.title) AS title, CASE WHEN o.external_id IS NULL THEN n.location ELSE o.location END AS location {BOTH}")
def _replica(t):
    return merge(*_two_sides(t), REPLICA, order=F.col("seq")).select("external_id", "title", "location")


@query("insert_if_absent", "K-6", "SELECT c_custkey AS id, 'stored' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'batch' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def _insert(t):
    ids = t.customer.select(F.col("c_custkey").alias("id"))
    return insert_absent(ids.filter("id % 2 = 0").withColumn("origin", F.lit("stored")), ids.filter("id % 3 = 0").withColumn("origin", F.lit("batch")), ["id"])


@query("first_known_name", "K-7", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, lower(c_name)) AS name FROM customer")
def _name(t):
    stored = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    batch = t.customer.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name"))
    return merge(stored, batch, Policy(("id",), {"name": old_or_new})).select("id", "name")


@query("counting_upsert", "K-8 X-8", "SELECT concat(event_type, '|', CAST(user_id AS VARCHAR)) AS key, count(*) AS n, max(ts) AS last, min(value) AS least FROM events GROUP BY 1")
def _counting(t):
    hits = t.events.select(F.concat("event_type", F.lit("|"), F.col("user_id").cast("string")).alias("key"), F.col("ts").alias("at"), F.col("value").alias("found"), "event_id")
    state = hits.filter("event_id % 2 = 0").groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.min("found").alias("least"))
    return counting(state, hits.filter("event_id % 2 = 1"))


@query("soft_retire", "K-9 K-10", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderkey % 10 = 3 THEN {as_of} END AS removed_at, CASE WHEN o_orderkey % 10 = 3 THEN 'twin' END AS reason FROM orders")
def _retire(t):
    state = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp_ntz")).alias("removed_at"))
    return retire(state, state.filter("id % 10 = 3").select("id", F.lit("twin").alias("reason")), F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'"))


@query("retire_request", "K-11 D1", "SELECT * FROM (SELECT CAST(k AS VARCHAR) AS asked, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'already_retired' ELSE 'retired' END AS verdict FROM (SELECT unnest([1, 2, 3, 4, -9]) AS k) LEFT JOIN orders ON o_orderkey = k UNION ALL SELECT k, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'already_retired' ELSE 'retired' END FROM (SELECT unnest(['ats_10', 'none']) AS k) LEFT JOIN orders ON concat('ats_', CAST(o_orderkey AS VARCHAR)) = k)")
def _retire_request(t):
    return retire_request(t.postings, [1, 2, 3, 4, -9], ["ats_10", "none"])


@query("hard_delete_by_age", "K-12 D3", "SELECT id FROM {postings} WHERE NOT (removed_at IS NOT NULL AND removed_at < {as_of} - INTERVAL 90 DAY)")
def _hard_delete(t):
    return t.postings.filter(F.expr("NOT coalesce(removed_at < TIMESTAMP_NTZ '2001-08-02 00:00:00' - INTERVAL 90 DAY, false)")).select("id")


@query("move_to_parent", "K-13", "WITH j AS (SELECT id, company_id, title_key FROM {postings}), target AS (SELECT DISTINCT company_id, title_key FROM j) SELECT j.id, CASE WHEN t.company_id IS NULL THEN j.company_id + 1 ELSE j.company_id END AS company_id, t.company_id IS NOT NULL AS retired FROM j LEFT JOIN target t ON t.company_id = j.company_id + 1 AND t.title_key = j.title_key")
def _move(t):
    taken = t.postings.select((F.col("company_id") - 1).alias("company_id"), "title_key", F.lit(True).alias("taken")).distinct()
    rows = t.postings.select("id", "company_id", "title_key").join(taken, ["company_id", "title_key"], "left")
    return rows.select("id", F.when(F.col("taken").isNull(), F.col("company_id") + 1).otherwise(F.col("company_id")).alias("company_id"), F.col("taken").isNotNull().alias("retired"))


@query("batched_update", "K-14", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 20 = 0 THEN 'Hybrid' ELSE o_orderstatus END AS value FROM orders")
def _batched(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"))
    told = rows.filter("id % 20 = 0").select("id", F.lit("Hybrid").alias("new"))
    return rows.join(told, "id", "left").select("id", F.coalesce("new", "value").alias("value"))


@query("dirty_rows", "K-16 K-17 P-8", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 1 THEN 'inserted' WHEN o_orderkey % 50 = 2 THEN 'deleted' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 50 IN (1, 2, 3)")
def _dirty(t):
    k = F.col("o_orderkey")
    before = t.orders.filter(k % 50 != 1).select(k.alias("id"), F.col("o_orderstatus").alias("a"), F.lit(None).cast("string").alias("b"))
    after = t.orders.filter(k % 50 != 2).select(k.alias("id"), F.col("o_orderstatus").alias("a"), F.when(k % 50 == 3, "told").alias("b"))
    return dirty(before, after, "id", ["a", "b"])


@query("absence_counter", "X-4 H10", f"SELECT o.external_id, CASE WHEN o.company_id % 3 = 0 AND n.external_id IS NOT NULL THEN 0 WHEN o.company_id % 3 = 0 AND o.removed_at IS NULL THEN o.absent_syncs + 1 ELSE CASE WHEN n.external_id IS NOT NULL THEN 0 ELSE o.absent_syncs END END AS absent_syncs, CASE WHEN n.external_id IS NOT NULL THEN NULL WHEN o.removed_at IS NOT NULL THEN o.removed_at WHEN o.company_id % 3 = 0 AND o.absent_syncs + 1 >= 3 THEN {{as_of}} WHEN o.absent_syncs >= 3 THEN {{as_of}} END AS removed_at FROM {STORED} o LEFT JOIN {BATCH} n ON o.external_id = n.external_id AND o.company_id = n.company_id")
def _absence(t):
    stored, batch = _two_sides(t)
    state = stored.select("external_id", "company_id", "absent_syncs", F.col("removed_at").cast("timestamp_ntz").alias("removed_at"))
    synced = t.customer.select(F.col("c_custkey").alias("company_id"), (F.col("c_custkey") % 3 == 0).alias("complete"), F.lit(10).alias("n_rows"))
    return absence(state, batch, synced, armed=True, as_of=F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'")).select("external_id", "absent_syncs", "removed_at")


@query("board_miss_counter", "X-5 X-6 X-7")
def _board_miss(t):
    k = F.col("c_custkey")
    seen = F.when(k % 3 == 0, F.concat(F.lit("timeout (missing since 2001-07-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z, miss "), (k % 5).cast("string"), F.lit(")")))
    return t.customer.select(k.alias("company_id"), *(c.alias(n) for n, c in miss_counter(seen, F.lit("HTTP 404"), F.to_timestamp(F.lit("2001-08-02 00:00:00"))).items()))


@query("delta_rows", "S-22", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 8 = 1)")
def _delta(t):
    return t.orders.filter("o_orderkey % 4 = 1").select("o_orderkey").join(t.orders.filter("o_orderkey % 8 = 1").select("o_orderkey"), "o_orderkey", "left_anti")
