"""The outbox and the boards' own state: claims, stamps, outcomes of a sync and when a board is due again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query

# Rows a claim and claims a run; minutes until a board is due, after a sync, a miss, a failure that passes.
CLAIM, CLAIMS = 500, 4
STALE, RETRY_MISS, RETRY_SOON = 60, 360, 10


def claimed(outbox: DataFrame, most: int = CLAIM) -> DataFrame:
    """The oldest dirty rows, a bounded number of them."""
    return outbox.filter(F.col("dirty_at").isNotNull()).orderBy("dirty_at", "id").limit(most)


def cleared(outbox: DataFrame, shipped: DataFrame) -> DataFrame:
    """outbox with the stamps of shipped rows taken away, where they have not moved past the newest that was shipped.

    shipped: at most a claim's rows (id, dirty_at), so it is small enough to broadcast.
    """
    newest = shipped.agg(F.max("dirty_at")).first()[0]
    if newest is None:
        return outbox
    rows = outbox.join(F.broadcast(shipped.select("id", F.lit(True).alias("__done")).distinct()), "id", "left")
    return rows.withColumn("dirty_at", F.when(F.col("__done").isNull() | (F.col("dirty_at") > F.lit(newest)), F.col("dirty_at"))).drop("__done")


def drain(read: Callable[[], DataFrame], ship: Callable[[DataFrame], None], clear: Callable[[DataFrame], int], most: int = CLAIM, rounds: int = CLAIMS) -> dict[str, int]:
    """Claim, ship and clear, round by round; a round that clears nothing ends the run, or it would go on for ever."""
    told = {"shipped": 0, "rounds": 0, "aborted": 0}
    for _ in range(rounds):
        batch = claimed(read(), most).cache()
        n = batch.count()
        if not n:
            break
        ship(batch)
        told["rounds"] += 1
        gone = clear(batch)
        told["shipped"] += n
        batch.unpersist()
        if not gone:
            told["aborted"] = 1
            break
        if n < most:
            break
    return told


def split_changes(rows: DataFrame, twins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, dead): rows to index and ids to remove: retired ones, and those of a feed that the board itself has (twins: id)."""
    marked = rows.join(twins.select("id").distinct().withColumn("__twin", F.lit(True)), "id", "left")
    gone = F.col("removed_at").isNotNull() | F.coalesce("__twin", F.lit(False))
    return marked.filter(~gone).drop("__twin"), marked.filter(gone).select("id")


def after_sync(companies: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """companies with what syncs told of them. outcomes: (company_id, outcome, message, ats, ats_slug, name, logo), one a company.

    discovered: source and slug are known, the board is active; synced: names that came replace old ones, a note of a missing
    board goes; unsupported and failed: the board's status; miss: due again after RETRY_MISS; passing: after RETRY_SOON.
    last_synced_at says when a board is due: a board is, STALE minutes after it.
    """
    told = outcomes.select("company_id", *(F.col(c).alias(f"__{c}") for c in ("outcome", "message", "ats", "ats_slug", "name", "logo")))
    rows = companies.join(told, "company_id", "left")
    is_ = lambda *kinds: F.col("__outcome").isin(*kinds)
    ago = lambda minutes: as_of + F.make_interval(mins=F.lit(minutes))
    active = F.col("company_status") == "active"
    miss = is_("miss") & active
    changed = is_("discovered", "synced", "unsupported", "failed", "passing") | miss
    return rows.withColumns(
        {
            "ats": F.when(is_("discovered"), F.col("__ats")).otherwise(F.col("ats")),
            "ats_slug": F.when(is_("discovered"), F.col("__ats_slug")).otherwise(F.col("ats_slug")),
            "company_name": F.when(is_("synced"), F.coalesce(F.nullif("__name", F.lit("")), "company_name")).otherwise(F.col("company_name")),
            "logo_url": F.when(is_("synced"), F.coalesce(F.nullif("__logo", F.lit("")), "logo_url")).otherwise(F.col("logo_url")),
            "company_status": F.when(is_("discovered"), "active").when(is_("unsupported", "failed"), F.col("__outcome")).otherwise(F.col("company_status")),
            "error_message": F.when(is_("discovered") | (is_("synced") & F.col("error_message").contains("(missing since ")), None).when(is_("failed") | miss, F.col("__message")).otherwise(F.col("error_message")),
            "last_synced_at": F.when(is_("synced"), as_of).when(miss, ago(max(STALE, RETRY_MISS) - STALE)).when(is_("passing"), ago(-max(0, STALE - RETRY_SOON))).otherwise(F.col("last_synced_at")),
            "updated_at": F.when(changed, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*companies.columns)


def due(companies: DataFrame, as_of: Column) -> DataFrame:
    """Active boards that were never synced, or STALE minutes ago."""
    return companies.filter((F.col("company_status") == "active") & (F.col("last_synced_at").isNull() | (F.col("last_synced_at") <= as_of - F.make_interval(mins=F.lit(STALE)))))


def health(rows: DataFrame) -> DataFrame:
    """One line of text about a table of postings: live and retired rows, boards."""
    live = F.count_if(F.col("removed_at").isNull())
    return rows.agg(F.format_string("live=%d retired=%d boards=%d", live, F.count("*") - live, F.count_distinct("company_id")).alias("value"))


AT = "TIMESTAMP '2001-08-02 00:00:00'"
OUTBOX = "(SELECT id, CASE WHEN id % 2 = 0 THEN first_seen_at END AS dirty_at FROM {postings})"


@query(
    "outbox_round",
    "X-1",
    f"""WITH c AS (SELECT id, dirty_at FROM {OUTBOX} WHERE dirty_at IS NOT NULL ORDER BY dirty_at, id LIMIT 500), m AS (SELECT max(dirty_at) AS newest FROM c),
s AS (SELECT o.id, CASE WHEN o.id % 14 = 0 THEN o.dirty_at + INTERVAL 900 DAY ELSE o.dirty_at END AS dirty_at FROM {OUTBOX} o)
SELECT s.id, CASE WHEN c.id IS NULL OR s.dirty_at > m.newest THEN s.dirty_at END AS dirty_at FROM s LEFT JOIN c USING (id), m""",
)
def _round(t):
    """One claim is shipped while every seventh of its rows changes again; those stay dirty."""
    box = t.postings.select("id", F.when(F.col("id") % 2 == 0, F.col("first_seen_at")).alias("dirty_at"))
    moved = box.withColumn("dirty_at", F.when(F.col("id") % 14 == 0, F.col("dirty_at") + F.expr("INTERVAL 900 DAY")).otherwise(F.col("dirty_at")))
    return cleared(moved, claimed(box))


@query("changes_without_twins", "X-3", "SELECT id, removed_at IS NOT NULL OR title_key % 50 = 0 AND id % 11 = 0 AS dead FROM {postings}")
def _split(t):
    live, dead = split_changes(t.postings, t.postings.filter("title_key % 50 = 0 AND id % 11 = 0"))
    return live.select("id", F.lit(False).alias("dead")).unionByName(dead.withColumn("dead", F.lit(True)))


STATE = "(SELECT *, CASE WHEN company_id % 5 = 0 THEN 'x (missing since y)' END AS error_message, CAST(NULL AS VARCHAR) AS logo_url FROM {companies})"


@query(
    "company_outcomes",
    "K-19 X-7",
    f"""SELECT company_id, CASE WHEN company_id % 7 = 0 THEN 'lever' ELSE ats END AS ats, CASE WHEN company_id % 7 = 1 AND company_id % 2 = 0 THEN 'New name' ELSE company_name END AS company_name,
CASE company_id % 7 WHEN 0 THEN 'active' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'failed' ELSE company_status END AS company_status,
CASE WHEN company_id % 7 IN (0, 1) THEN NULL WHEN company_id % 7 = 3 OR company_id % 7 = 4 AND company_status = 'active' THEN 'gone' ELSE error_message END AS error_message,
CASE WHEN company_id % 7 = 1 THEN {AT} WHEN company_id % 7 = 4 AND company_status = 'active' THEN {AT} + INTERVAL 300 MINUTE WHEN company_id % 7 = 5 THEN {AT} - INTERVAL 50 MINUTE ELSE last_synced_at END AS last_synced_at FROM {STATE}""",
)
def _outcomes(t):
    k = F.col("company_id")
    state = t.companies.withColumns({"error_message": F.when(k % 5 == 0, "x (missing since y)"), "logo_url": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    kind = F.element_at(F.lit(["discovered", "synced", "unsupported", "failed", "miss", "passing"]), (k % 7 + 1).cast("int"))
    told = t.companies.filter("company_id % 7 < 6").select("company_id", kind.alias("outcome"), F.lit("gone").alias("message"), F.lit("lever").alias("ats"), "ats_slug", F.when(k % 2 == 0, "New name").otherwise("").alias("name"), F.lit(None).cast("string").alias("logo"))
    return after_sync(state, told, F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'")).select("company_id", "ats", "company_name", "company_status", "error_message", "last_synced_at")


@query("due_boards", "X-7 F-24", f"SELECT company_id FROM {{companies}} WHERE company_status = 'active' AND (last_synced_at IS NULL OR last_synced_at <= {AT} - INTERVAL 60 MINUTE)")
def _due(t):
    return due(t.companies, F.expr("TIMESTAMP_NTZ '2001-08-02 00:00:00'")).select("company_id")


@query("health_line", "K-20", "SELECT 'live=' || count(*) FILTER (WHERE removed_at IS NULL) || ' retired=' || count(*) FILTER (WHERE removed_at IS NOT NULL) || ' boards=' || count(DISTINCT company_id) AS value FROM {postings}")
def _health(t):
    return health(t.postings)
