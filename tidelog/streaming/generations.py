"""A log stream written as generations, one for each micro-batch, and a stream's state by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import log as ops


def write_generations(log: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch is folded and overwrites its own gen=<batch> folder, so a batch run twice is written once."""

    def put(batch: DataFrame, epoch: int) -> None:
        rows = ops.fold(batch).select("key", "value", "is_tombstone")
        rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/gen={epoch}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(log: DataFrame) -> DataFrame:
    """Streaming fold: each key's newest row; run it in update or complete mode."""
    return ops.fold(log)


def operations_by_window(log: DataFrame, size: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Counts by event-time window and kind.  An extension: the engine's own streams have no event-time windows."""
    return log.withWatermark("ts", lateness).groupBy(F.window("ts", size), "op").agg(F.count("*").alias("n"))
