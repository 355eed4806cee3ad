"""Streams: windows under watermarks, dedup, sessions, alerts, change detection and staged tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, ts: str, keys: list[str], aggs: list, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding aggregates; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(*aggs)


def sessions(events: DataFrame, ts: str, keys: list[str], aggs: list, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)


def deduplicate(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; a key is remembered for the watermark's delay."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def changes(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, version, digest each time a key's content differs from the one before."""

    def run(k, frames, state: GroupState):
        last, version = state.get if state.exists else ("", 0)
        out = []
        for pdf in frames:
            for text in pdf[content]:
                digest = hashlib.sha256((text or "").encode()).hexdigest()
                if digest != last:
                    last, version = digest, version + 1
                    out.append((k[0], version, digest))
        state.update((last, version))
        yield pd.DataFrame(out, columns=[key, "version", "digest"])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, version long, digest string", "last string, version long", "append", GroupStateTimeout.NoTimeout)


def alerts(metrics: DataFrame, limits: DataFrame, name: str, ts: str, value: str) -> DataFrame:
    """The latest value of each metric with whether it is over its limit; for foreachBatch or a batch."""
    latest = metrics.groupBy(name).agg(F.max_by(value, ts).alias("latest"))
    return latest.join(limits, name, "left").withColumn("alert", F.coalesce(F.col("latest") > F.col("limit"), F.lit(False)))


def stage(source: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet table with its own checkpoint, for all data there is; the next stage reads the table."""
    return source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
