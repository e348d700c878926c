"""Streaming liveness: state for each (observer, node), a processing-time timer for the time-out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "observer string, node string, heartbeat long, status string"


class Liveness(StatefulProcessor):
    """Keeps the highest counter.  Only a strictly higher one re-arms the timer; when it runs out the node is DEAD."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "heartbeat long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        top = max(int(p["heartbeat"].max()) for p in rows)
        old = self.best.get() if self.best.exists() else None
        if old is not None and top <= old[0]:
            return
        if old is not None:
            self.handle.deleteTimer(old[1])
        at = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        self.handle.registerTimer(at)
        self.best.update((top, at))
        yield pd.DataFrame([(*key, top, "ALIVE")], columns=["observer", "node", "heartbeat", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.best.exists():
            yield pd.DataFrame([(*key, self.best.get()[0], "DEAD")], columns=["observer", "node", "heartbeat", "status"])

    def close(self) -> None:
        pass


def liveness(beats: DataFrame, timeout_ms: int = 5000) -> DataFrame:
    """Changes of status from a stream (observer, node, heartbeat)."""
    return beats.groupBy("observer", "node").transformWithStateInPandas(
        statefulProcessor=Liveness(timeout_ms), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime"
    )
