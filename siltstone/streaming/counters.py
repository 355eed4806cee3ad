"""Counters over the latest seconds of a key, with state that ends by timers."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that list state and timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Counters(StatefulProcessor):
    """For each row the rows of its key in the last `spans` seconds, itself included; older seconds are forgotten."""

    def __init__(self, ident: str, at: str, spans: list[int]):
        self.ident, self.at, self.spans = ident, at, spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(t), int(i)) for pdf in rows for t, i in zip(pdf[self.at], pdf[self.ident]))
        every = sorted([r[0] for r in self.seen.get()] + [t for t, _ in new])
        out = [(i, *(bisect_right(every, t) - bisect_left(every, t - s) for s in self.spans)) for t, i in new]
        keep = every[bisect_left(every, every[-1] - max(self.spans)) :]
        self.seen.put([(t,) for t in keep])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((every[-1] + max(self.spans) + 1) * 1000)
        yield pd.DataFrame(out, columns=[self.ident, *(f"n_{s}" for s in self.spans)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def sliding_counts(events: DataFrame, key: str, ident: str, ts: str, spans: tuple[int, ...] = (60, 3600), late: str = "10 minutes") -> DataFrame:
    """ident, n_<span>...: for each event of a stream the events of its key in the last seconds so far, itself included.

    A key holds the seconds of its longest span only, and nothing once the watermark has passed that; events later than the
    watermark are dropped. The session needs STATE_STORE.
    """
    rows = events.withWatermark(ts, late).select(key, F.col(ident).cast("long").alias(ident), ts, F.unix_timestamp(ts).alias("second"))
    schema = ", ".join([f"{ident} long", *(f"n_{s} long" for s in spans)])
    return rows.groupBy(key).transformWithStateInPandas(Counters(ident, "second", list(spans)), schema, "Append", "EventTime")


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The keys of a stream, each once within the watermark's delay; a key is forgotten after it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys).select(*keys)
