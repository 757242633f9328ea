"""Keyed state of streams: what is known of each key survives batches and restarts, and closes by a timer.

``latest`` keeps, for each key, its last row (by order, then value: late rows do not undo later ones), the number of rows and their
running mean, and gives the key's new summary after each batch that has rows of it. With ``quiet``, a key without rows for so
long, in event time, is closed: its summary is given once more, and its state goes. State is in the checkpoint; a query that is
started again on it goes on where it stopped. Keys are spread by hash; a key's own state is one row, whatever its number of rows.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that this kind of state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans state has no package


class Latest(StatefulProcessor):
    """State of one key: (at, value, n, total)."""

    def __init__(self, key: str, at: str, value: str, quiet_ms: int | None, zone: str):
        self.key, self.at, self.value, self.quiet_ms, self.zone = key, at, value, quiet_ms, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "at timestamp, value double, n long, total double")

    def _row(self, key, held: tuple, closed: bool) -> pd.DataFrame:
        at, value, n, total = held
        return pd.DataFrame({self.key: [key[0]], "at": [pd.Timestamp(at)], "value": [value], "n": [n], "mean": [total / n], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Each call of the state is a message to the JVM: one to read, one to write. A key's rows are few, so arrays and no frames.
        at, value, n, total = self.state.get() or (None, None, 0, 0.0)
        for some in rows:
            times, values = some[self.at].to_numpy("datetime64[ns]"), some[self.value].to_numpy(np.float64)
            kept = ~(np.isnat(times) | np.isnan(values))
            times, values = times[kept], values[kept]
            if not len(times):
                continue
            newest = times.max()
            new = (pd.Timestamp(newest).to_pydatetime(), float(values[times == newest].max()))
            if at is None or new > (pd.Timestamp(at).to_pydatetime(), value):
                at, value = new
            n, total = n + len(times), total + float(values.sum())
        if not n:
            return
        self.state.update((at, value, n, total))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # From the newest row or the watermark: a key of late rows only is quiet from now on.
            newest = int(pd.Timestamp(at).tz_localize(self.zone).timestamp() * 1000)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.quiet_ms)
        yield self._row(key, (at, value, n, total), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held:
            self.state.clear()
            yield self._row(key, held, True)

    def close(self) -> None:
        pass


def latest(events: DataFrame, key: str, at: str, value: str, quiet: datetime.timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, at, value, n, mean, closed) of a stream, an update of each key for each batch that has it. Rows with a null key, time or value are left out."""
    use_state_store(events.sparkSession)
    rows = events.select(F.col(key), F.col(at).cast("timestamp").alias(at), F.col(value).cast("double").alias(value)).where(F.col(key).isNotNull())
    rows = rows.withWatermark(at, late) if quiet is not None else rows
    processor = Latest(key, at, value, None if quiet is None else int(quiet.total_seconds() * 1000), events.sparkSession.conf.get("spark.sql.session.timeZone"))
    schema = f"{key} {dict(events.dtypes)[key]}, at timestamp, value double, n long, mean double, closed boolean"
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Update", "None" if quiet is None else "EventTime")


def summary(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The same of a table: (key, at, value, n, mean)."""
    rows = events.select(F.col(key), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).dropna()
    last = F.max(F.struct("at", "value"))
    return rows.groupBy(key).agg(last.alias("l"), F.count("*").alias("n"), F.avg("value").alias("mean")).select(key, "l.at", "l.value", "n", "mean")
