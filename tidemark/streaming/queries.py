"""Named queries over the streaming operators; each drains its input once and returns what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..registry import query
from . import outbox


def scratch(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed(t, name: str, most_files: int = 1):
    """The table as a stream: its own files, so many a batch, which holds the source back where the sink is slower.

    A table is a file or a folder of files. Only a path with a pattern may name either, hence the class of one letter.
    """
    table = getattr(t, name)
    return t.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", most_files).parquet(f"{t.dir}/{name}.parque[t]")


@query("outbox_drain", "K-15 W-7", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS title, CASE WHEN o_orderstatus <> 'F' THEN c_name END AS company_name, o_orderstatus = 'F' AS deleted FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _outbox(t):
    stream = streamed(t, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("removed_at"), F.col("o_orderkey").alias("version"))
    base = scratch(t.spark)
    outbox.drain(stream, t.customer.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name")), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").drop("batch")


@query("company_fan_out", "X-2 K-17", "SELECT id FROM {postings} JOIN {companies} USING (company_id) WHERE removed_at IS NULL AND company_status = 'failed'")
def _fan_out(t):
    return outbox.fan_out(t.companies.filter("company_status = 'failed'"), t.postings).select("id")


@query("demand_stream", "X-8 X-10", "SELECT event_type AS key, count(*) AS n, max(ts) AS last, min(value) AS least FROM events GROUP BY 1")
def _demand(t):
    hits = streamed(t, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("at"), F.col("value").alias("found"))
    base = scratch(t.spark)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")
    outbox.demand_counts(hits).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.parquet(f"{base}/out")
    return out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")


@query("absence_stream", "X-4", "SELECT user_id AS key, CAST(coalesce(min(k) FILTER (WHERE seen), count(*) + 1) - 1 AS INTEGER) AS absent_syncs FROM (SELECT user_id, event_type = 'view' AS seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) GROUP BY 1")
def _absence(t):
    rows = streamed(t, "events").select(F.col("user_id").alias("key"), (F.col("event_type") == "view").alias("seen"), F.lit(True).alias("complete"), F.col("event_id").alias("sync"))
    base = scratch(t.spark)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")
    outbox.absences(rows).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.parquet(f"{base}/out")
    return out.groupBy("key").agg(F.max_by("absent_syncs", "batch").alias("absent_syncs"))
