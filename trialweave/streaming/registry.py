"""Continuous registry updates: files of studies in, a versioned trial table out.

The batch updater polls with an overlapping look-back and skips what it has seen; as a stream, the overlap is
dropped by key and hash within the watermark, and every micro-batch is one upsert.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.upsert import VersionedTable, latest


def read_studies(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def new_versions(studies: DataFrame, event_time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Studies without those whose id and hash came within the watermark already."""
    return studies.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["nct_id", "source_hash"])


def changes(studies: DataFrame) -> DataFrame:
    """(nct_id, source_hash, change): new, changed or unchanged against the last hash of the study, kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for h in rows["source_hash"]:
            out.append((key[0], h, "new" if last is None else "unchanged" if h == last else "changed"))
            last = h
        state.update((last,))
        yield pd.DataFrame(out, columns=["nct_id", "source_hash", "change"])

    return studies.groupBy("nct_id").applyInPandasWithState(step, "nct_id string, source_hash string, change string", "hash string", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(studies: DataFrame, table: VersionedTable, checkpoint: str, once: bool = True, interval: str = "1 hour") -> StreamingQuery:
    """Writes each micro-batch as an upsert of its latest row per study; a repeated batch gives the same table."""

    def write(batch: DataFrame, _: int) -> None:
        rows = latest(batch, "nct_id", ["ts", "source_hash"])
        if rows.limit(1).count():
            table.upsert(rows, "nct_id")

    writer = studies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling or sliding window, with late data up to the delay."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
