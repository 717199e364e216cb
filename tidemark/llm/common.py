"""Shared helpers: reading tables, staging between jobs, Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of 8 MB instead of the default 64, which a task holds several times over in the JVM and in Python.

    A session whose setting is not the default keeps its own.
    """
    if spark.conf.get(BATCH) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(BATCH, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session on a local master, such as a test's, gets a folder of its own; on a cluster that would be
    another folder on every machine, so there it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            got = held.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            got = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
            spark.sparkContext.setCheckpointDir(got)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return got.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and no executor's loss can undo it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and let Spark free the shuffle files behind them."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect: the context cleaner then drops the shuffle files of finished jobs."""
    spark.sparkContext._jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """name, or name with underscores before it, so that no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """id, text (null is empty) and row, a key: the id, if ids are that, else a number that is written down with the text.

    Also whether row is the id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("id").agg(F.count("*").alias("n")).filter("id IS NULL OR n > 1").isEmpty():
        return rows.withColumn("row", F.col("id")), True
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "numbered"), False


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def give_back() -> None:
    """Return what earlier tasks of this worker have freed to the machine: workers are used again, stage after stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each slice stays near most_bytes; a longer single text is a slice of its own."""
    give_back()
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(b.column(k)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield b.slice(start)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, by: Column, how: str = "inner", also: DataFrame | None = None) -> DataFrame:
    """left joined with right on keys, the hot keys spread over several tasks. right is staged and has a row for each key.

    weight, a column of right, is about how many rows of left have the key. A key with more than 1 / (8 * partitions) of
    them all is dealt over salts of that size, by the hash of `by`, and its row of right is repeated for each. There are
    fewer than 8 * partitions such keys, whatever the data, so they may be broadcast. left is read once. Null keys meet
    nothing. The weight stays a column of the result. also, with a row for each key too, is joined to right on the way.
    """
    least = max(1000, int(right.agg(F.sum(weight)).first()[0] or 0) // (8 * shuffle_parts(left.sparkSession)))
    salts = F.ceil(F.col(weight) / least).cast("long")
    hot = right.filter(F.col(weight) > least).select(*keys, salts.alias("__salts"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("__salts")))).drop("__salts")
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1).cast("long")) - 1)))
    if also is not None:
        repeated = repeated.join(also, keys)
    return dealt.withColumn("__salt", F.col("__salt").cast("long")).join(repeated, [*keys, "__salt"], how).drop("__salt")
