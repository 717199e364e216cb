"""Exact dedup by a tree merge of sorted digest runs.

A run is a partition's (digest, length, second hash, kept id, rows), sorted by digest. In round r the partitions meet in
groups of `1 << fan_bits`: an owner keeps the digests whose r-th bits are its own and sends the others to the owners
that differ from it in those bits only (binomial rounds). Round one makes the runs. From then on what an owner fetches
are sorted runs, and Spark's sort merges them: under several keys it is a TimSort, which finds the ascending runs and
merges them, and it spills sorted runs and merges those from disk. A sort aggregate passes over the merged run and
leaves one row per distinct text, in order again, for the next round. A digest that a third of all rows share is spread over P / 4 owners in the first
round, over P / 16 rows in the second, and so on: no task ever gets all its rows. After log(P) / fan_bits rounds each
owner holds one range of digest bits.

A SHA-256 match counts only if the byte length and an independent 64-bit hash of the text match too (verified ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, read_table, salted_join, shuffle_parts, staged, text_or_empty

KEY = ("sha", "n_bytes", "second")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs; a null text counts as the empty text."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("second"),
    )


def tree_merge(runs: DataFrame, keep: str = "min", fan_bits: int = 2) -> DataFrame:
    """Groups of the digest rows: KEY, keep_id (the smallest id, or the largest with keep="max"; null ids lose), n_rows."""
    best = {"min": F.min, "max": F.max}[keep]
    bits = max(1, (shuffle_parts(runs.sparkSession) - 1).bit_length())
    owners = 1 << bits
    lead: Column = F.conv(F.substring(F.hex("sha"), 1, 7), 16, 10).cast("int")
    # The identifier travels with what verifies it. A struct is no fixed-width buffer, so Spark aggregates sorted runs.
    level = runs.withColumn("kept", F.when(F.col("id").isNotNull(), F.struct("id", "n_bytes"))).withColumn("n_rows", F.lit(1).cast("long"))
    level = level.select(F.pmod(F.spark_partition_id(), F.lit(owners)).alias("owner"), *KEY, "kept", "n_rows")
    for shift in range(0, bits, fan_bits):
        mask = (min(owners, 1 << (shift + fan_bits)) - 1) & ~((1 << shift) - 1)
        target = F.col("owner").bitwiseAND(F.lit(owners - 1 - mask)).bitwiseOR(lead.bitwiseAND(F.lit(mask)))
        level = level.withColumn("owner", target).repartitionById(owners, F.col("owner"))
        level = level.groupBy("owner", *KEY).agg(best("kept").alias("kept"), F.sum("n_rows").alias("n_rows"))
    return level.select(*KEY, F.col("kept.id").alias("keep_id"), "n_rows")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Per row of docs: its id, keep_id, group_size (rows with the text), kept, text_sha256.

    Null texts equal the empty text. Rows that repeat an id and its text are all marked kept (they are one document);
    `unique_documents` leaves one of them. A group whose ids are all null keeps the null id. Extra columns are ignored.
    The rows meet their groups by a join that deals hot digests over many tasks.
    """
    runs = staged(digests(docs, id_col, text_col), "digests")
    groups = staged(tree_merge(runs, keep), "digest-groups")
    joined = salted_join(runs, groups, list(KEY), "n_rows", F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n_rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each distinct text."""
    sha, keep_id = free_name(docs.columns, "__sha"), free_name(docs.columns, "__keep")
    groups = staged(tree_merge(digests(docs, id_col, text_col), keep).select(F.col("keep_id").alias(keep_id), F.col("sha").alias(sha)), "kept-texts")
    told = F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))
    # One row of groups for each text: a key is as hot as a row is repeated with its id and text.
    stay = docs.join(groups, docs[id_col].eqNullSafe(groups[keep_id]) & (told == groups[sha]), "left_semi")
    return stay.withColumn(sha, told).dropDuplicates([id_col, sha]).drop(sha)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
