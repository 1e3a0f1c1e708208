"""Re-runs of incomplete work as a stateful stream: what happened to a target goes in, its state and the time of its next attempt come out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: After how many seconds a failed or partial target is tried again, for each failure in a row; after the last, no more.
WAITS = (60, 300, 1800)
EVENTS = "meeting_id long, target string, seq long, status string, post_id string, error string, at timestamp"
STATES = "meeting_id long, target string, kind string, status string, post_id string, error string, attempts int, next_at timestamp"
_STATE = "seq long, status string, post_id string, error string, attempts int, due long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Incomplete(StatefulProcessor):
    """One target of one meeting. Events count in the order of seq; one that is not after the last seen changes nothing, so replays are harmless. A failure sets a
    timer; when it fires, an attempt is handed out, once."""

    def __init__(self, waits: tuple[int, ...] = WAITS):
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def _row(self, key, kind: str, s: tuple) -> dict:
        seq, status, post, error, attempts, due = s
        return {"meeting_id": key[0], "target": key[1], "kind": kind, "status": status, "post_id": post, "error": error, "attempts": attempts, "next_at": pd.Timestamp(due, unit="ms") if due else pd.NaT}

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["meeting_id", "target", "kind", "status", "post_id", "error", "attempts", "next_at"])
        return out.astype({"attempts": "int32", "meeting_id": "int64", "next_at": "datetime64[ns]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        now = tuple(old) if old else (-1, "pending", None, None, 0, 0)
        events = pd.concat(list(rows)).sort_values("seq")
        for e in events.itertuples(index=False):
            if e.seq <= now[0]:
                continue
            failed = e.status in ("failed", "partial")
            attempts = now[4] + 1 if failed else 0
            due = int(e.at.timestamp() * 1000) + self.waits[attempts - 1] * 1000 if failed and attempts <= len(self.waits) else 0
            post = e.post_id if isinstance(e.post_id, str) else now[2]  # a post once made stays known
            now = (int(e.seq), e.status, post, e.error if isinstance(e.error, str) else None, attempts, due)
        if old is None or now != tuple(old):
            if old and old[5]:
                self.handle.deleteTimer(old[5])
            if now[5]:
                self.handle.registerTimer(now[5])
            self.state.update(now)
            yield self._frame([self._row(key, "state", now)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get())
        if now[5] and now[5] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((*now[:5], 0))
            yield self._frame([self._row(key, "attempt", now)])

    def close(self) -> None:
        pass


def reruns(events: DataFrame, waits: tuple[int, ...] = WAITS, late: str = "1 hour") -> DataFrame:
    """events (EVENTS, a stream) as rows of STATES: kind state whenever a target's state changes, kind attempt when the time of its next attempt has come, by the
    events' own clock. Synced, blocked and pending targets have none; after the last wait a target stays failed. Events may come again and up to late out of order."""
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    timed = events.where(F.col("meeting_id").isNotNull() & F.col("target").isNotNull()).withWatermark("at", late)
    return timed.groupBy("meeting_id", "target").transformWithStateInPandas(statefulProcessor=Incomplete(waits), outputStructType=STATES, outputMode="Append", timeMode="EventTime")
