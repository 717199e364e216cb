"""The drain's rounds: it ends when nothing is dirty, and when a round clears nothing."""

from pyspark.sql import functions as F

from tidemark.operators import boards, merging


def test_drain_rounds(spark):
    box = [spark.range(12).select("id", F.col("id").alias("dirty_at"))]
    shipped = []

    def clear(batch):
        box[0] = spark.createDataFrame(boards.cleared(box[0], batch).collect(), "id long, dirty_at long")
        return batch.count()

    told = boards.drain(lambda: box[0], lambda b: shipped.append({r.id for r in b.collect()}), clear, most=5)
    assert told == {"shipped": 12, "rounds": 3, "aborted": 0} and shipped == [set(range(5)), set(range(5, 10)), {10, 11}]
    assert box[0].filter("dirty_at IS NOT NULL").isEmpty()


def test_drain_ends_when_nothing_clears(spark):
    box = spark.range(9).select("id", F.col("id").alias("dirty_at"))
    assert boards.drain(lambda: box, lambda b: None, lambda b: 0, most=5) == {"shipped": 5, "rounds": 1, "aborted": 1}
    assert boards.drain(lambda: box.limit(0), lambda b: None, lambda b: 0) == {"shipped": 0, "rounds": 0, "aborted": 0}


def test_last_of_a_batch_counts(spark):
    stored = spark.createDataFrame([("a", 1, "old")], "external_id string, company_id int, title string")
    batch = spark.createDataFrame([("a", 1, "first"), ("b", 1, "x"), ("a", 1, "last")], "external_id string, company_id int, title string").coalesce(1)
    got = merging.merge(stored, batch, merging.OVERWRITE).collect()
    assert {(r.external_id, r.title, r.change) for r in got} == {("a", "last", "updated"), ("b", "x", "inserted")} and len(got) == 2
    assert {(r.external_id, r.title) for r in merging.insert_absent(stored, batch, ["external_id"]).collect()} == {("a", "old"), ("b", "x")}
