from pyspark.sql import functions as F

from tidemark.operators.merging import AUTHORITATIVE, GAP_FILL, absence, last_of_batch, merge, miss_counter

SHAPE = "external_id string, company_id long, title string, description string, visa_sponsorship string, salary_min string, removed_at string, absent_syncs int, first_seen_at string"


def rows(df):
    return {r.external_id: r for r in df.collect()}


def test_rules(spark):
    stored = spark.createDataFrame([("a", 1, "old", "text", "yes", "10", "2020", 2, "f"), ("b", 1, "stay", None, "", None, None, 1, "f")], SHAPE)
    batch = spark.createDataFrame([("a", 1, "new", None, "", None), ("c", 1, "fresh", "d", "no", "5")], "external_id string, company_id long, title string, description string, visa_sponsorship string, salary_min string")
    got = rows(merge(stored, batch, AUTHORITATIVE))
    assert got["a"][2:9] == ("new", "text", "yes", "10", None, 0, "f") and got["a"].change == "updated"
    assert got["b"].title == "stay" and got["b"].absent_syncs == 1 and got["b"].change == "kept"
    assert got["c"].title == "fresh" and got["c"].change == "inserted"
    filled = rows(merge(stored, batch, GAP_FILL))
    assert filled["a"].title == "old" and filled["a"].removed_at == "2020"


def test_empty_batch_and_last_wins(spark):
    stored = spark.createDataFrame([("a", 1, "old", "text", "yes", "10", None, 2, "f")], SHAPE)
    none = spark.createDataFrame([], "external_id string, company_id long, title string")
    assert rows(merge(stored, none, AUTHORITATIVE))["a"].change == "kept"
    twice = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2)], "external_id string, company_id long, title string, at int")
    assert [r.title for r in last_of_batch(twice, ("external_id", "company_id"), "at").collect()] == ["y"]


def test_absence_needs_a_whole_sync(spark):
    state = spark.createDataFrame([("a", 1, 2, None), ("b", 1, 2, None), ("c", 2, 2, None)], "external_id string, company_id long, absent_syncs int, removed_at timestamp")
    seen = spark.createDataFrame([("b", 1)], "external_id string, company_id long")
    synced = spark.createDataFrame([(1, True, 5), (2, False, 5)], "company_id long, complete boolean, n_rows int")
    got = rows(absence(state, seen, synced, armed=True, as_of=F.to_timestamp(F.lit("2024-01-01"))))
    assert (got["a"].absent_syncs, got["b"].absent_syncs, got["c"].absent_syncs) == (3, 0, 2)
    assert got["a"].removed_at and not got["b"].removed_at and not got["c"].removed_at
    assert not rows(absence(state, seen, synced))["a"].removed_at


def test_miss_counter(spark):
    cases = [(None, False, 1), ("x (missing since 2024-01-01T00:00:00.000Z, miss 2)", True, 3), ("x (missing since 2024-01-09T00:00:00.000Z, miss 12)", False, 13), ("other", False, 1)]
    df = spark.createDataFrame([(c[0],) for c in cases], "previous string").withColumn("k", F.monotonically_increasing_id())
    out = df.select("k", *(c.alias(n) for n, c in miss_counter(F.col("previous"), F.lit("HTTP 404"), F.to_timestamp(F.lit("2024-01-10"))).items())).orderBy("k").collect()
    assert [(r.retire, r.misses) for r in out] == [c[1:] for c in cases]
    assert out[0].message == "HTTP 404 (missing since 2024-01-10T00:00:00.000Z, miss 1)"
