"""Change data to a projection, and running counters, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(changes: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of changed postings: documents to add, and ids to delete; the last change of an id counts."""
    rest = [c for c in changes.columns if c != "id"]
    last = changes.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("id", "r.*")
    live = last.filter(F.col("removed_at").isNull()).join(companies, "company_id", "left")
    return live, last.filter(F.col("removed_at").isNotNull()).select("id")


def fan_out(changed_companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Live postings of changed companies: their documents hold the company's fields."""
    return jobs.filter(F.col("removed_at").isNull()).join(changed_companies.select("company_id").distinct(), "company_id", "left_semi")


def drain(stream: DataFrame, companies: DataFrame, target: str, checkpoint: str):
    """Start a drain of the outbox into Parquet: a folder a batch, so that a batch that runs again replaces itself."""

    def ship(batch: DataFrame, number: int) -> None:
        add, gone = documents(batch, companies)
        both = add.select("id", "title", "company_name", F.lit(False).alias("deleted")).unionByName(gone.select("id", F.lit(True).alias("deleted")), allowMissingColumns=True)
        both.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(ship).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demand_counts(stream: DataFrame) -> DataFrame:
    """Running counts of searches (key, at, found): update mode."""
    return stream.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.min("found").alias("least"))


#: Stands for a sync without number: older than all others, as a descending ORDER BY has it.
UNNUMBERED = -(2**63)


def count_absences(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState over (key, seen, complete, sync): complete syncs after the last that saw the key.

    The state holds that sync and the later ones themselves: a key's rows come in pieces, and files in batches, in any order.
    """
    last, later = state.get if state.exists else (None, [])
    later = np.array(later, dtype="int64")
    for rows in batches:
        sync, seen = rows["sync"].to_numpy("int64"), rows["seen"].to_numpy(bool)
        later = np.concatenate([later, sync[rows["complete"].to_numpy(bool) & ~seen]])
        if seen.any():
            last = int(sync[seen].max()) if last is None else max(last, int(sync[seen].max()))
        if last is not None:
            later = later[later > last]
    state.update((last, later.tolist()))
    yield pd.DataFrame({"key": [key[0]], "absent_syncs": [len(later)]})


def absences(stream: DataFrame) -> DataFrame:
    no, first = F.lit(False), F.lit(UNNUMBERED)
    rows = stream.select("key", F.coalesce("seen", no).alias("seen"), F.coalesce("complete", no).alias("complete"), F.coalesce("sync", first).alias("sync"))
    return rows.groupBy("key").applyInPandasWithState(count_absences, "key long, absent_syncs int", "last long, later array<long>", "update", "NoTimeout")
