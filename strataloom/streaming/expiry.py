"""State per key that expires: the last values and a count, kept as long as events come within a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strataloom.streaming.events import timed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, status string, n long, last timestamp"


class Expiring(StatefulProcessor):
    """Per key: how many events since the state began, and the time of the last one. A timer at that time plus ``ttl_ms``
    ends the state once the watermark has passed it; a later event moves the timer."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "n long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, -1)
        for batch in rows:
            n += len(batch)
            last = max(last, int(batch["ms"].max()))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.ttl_ms)
        self.state.update((n, last))
        yield self.row(key, "live", n, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.state.get()
        self.state.clear()
        yield self.row(key, "expired", n, last)

    def close(self) -> None:
        pass

    @staticmethod
    def row(key, status: str, n: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "status": [status], "n": [n], "last": pd.to_datetime([last], unit="ms")})


def with_expiry(events: DataFrame, ttl: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """A stream of (user_id, status, n, last): ``live`` after each micro-batch with events of the user, and ``expired`` once
    no event has come for ``ttl``; the next event begins anew. Events without a user or a time are left out.

    State lies in the state store by key, so it is dealt like the keys, survives restarts and lost executors, and is
    dropped when it expires. The session's state store must be STORE (``use_store``).
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = timed(events).where("user_id is not null and ts is not null").withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Expiring(ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def live_keys(changes: DataFrame) -> DataFrame:
    """(user_id, n, last) of the keys whose latest change (by time, live after expired) is live."""
    latest = changes.groupBy("user_id").agg(F.max(F.struct("batch", (F.col("status") == "live").alias("live"), "n", "last")).alias("r"))
    return latest.where("r.live").select("user_id", "r.n", "r.last")
