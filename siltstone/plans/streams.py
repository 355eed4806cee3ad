"""Batch forms of the streaming operators; siltstone.streaming has the streams themselves."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.registry import query
from siltstone.sources.writers import shared_path
from siltstone.streaming import counters as C


@query("x6_low_novelty_exit", "SELECT user_id, event_id, round(m, 6) AS trailing FROM (SELECT user_id, event_id, avg(value) OVER w AS m, row_number() OVER w2 AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n >= 5 AND m < 20")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").select("user_id", "event_id", F.avg("value").over(w.rowsBetween(-2, 0)).alias("m"), F.row_number().over(w).alias("n"))
    return e.where("n >= 5 and m < 20").select("user_id", "event_id", F.round("m", 6).alias("trailing"))


@query("x8_change_detection", "SELECT user_id, event_id FROM (SELECT user_id, event_id, md5(event_type) AS h, lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR h <> b")
def _(t):
    h = F.md5(F.col("event_type").cast("binary"))
    e = t("events").select("user_id", "event_id", h.alias("h"), F.lag(h).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    return e.where("b is null or h <> b").select("user_id", "event_id")


@query("x9_seen_set_dedup", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("x10_sliding_counters", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp(F.col("ts").cast("timestamp"))).rangeBetween(-3600, 0)
    return t("events").select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("x13_threshold_alerts", "SELECT event_type, latest, latest > 50 AS alert FROM (SELECT event_type, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY event_type)")
def _(t):
    return t("events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest")).withColumn("alert", F.col("latest") > 50)


@query("x18_tumbling_window", "SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("x18_session_window", "WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM s) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM g GROUP BY user_id, sid")
def _(t):
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")


def _arriving(t):
    """(folder, writers of four slices of events in order of time): files that a stream finds one after another."""
    e = t("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    spark = e.sparkSession
    folder = shared_path(spark, "arriving")
    cuts = [None, *e.select(F.unix_timestamp("ts").alias("s")).approxQuantile("s", [0.25, 0.5, 0.75], 0.01), None]

    def slice_(low, high):
        at = F.unix_timestamp("ts")
        part = e.where((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high))
        part.write.mode("append").parquet(folder)

    return folder, [lambda low=a, high=b: slice_(low, high) for a, b in zip(cuts[:-1], cuts[1:])]


def _streamed(t, build, schema: str):
    """The rows of build(stream) over the arriving slices; the stream is stopped after two and goes on from its checkpoint."""
    folder, slices = _arriving(t)
    spark = t("events").sparkSession
    out, state = shared_path(spark, "streamed"), shared_path(spark, "stream-state")
    before = {k: spark.conf.get(k, None) for k in C.STATE_STORE}
    for k, v in C.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for i, write in enumerate(slices):
            write()
            if i % 2:
                read = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 10_000).parquet(folder)
                stream = build(read).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
                stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(out)


SLIDING = "count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("x10_stream_counters", f"SELECT event_id, {SLIDING.format(60)} AS n_60, {SLIDING.format(3600)} AS n_3600 FROM events")
def _(t):
    """The counters as a stream with a restart between the slices."""
    return _streamed(t, lambda e: C.sliding_counts(e, "user_id", "event_id", "ts"), "event_id long, n_60 long, n_3600 long")


@query("x9_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    """Each user's kinds of event once, as a stream that remembers a key for ten years of event time."""
    return _streamed(t, lambda e: C.first_seen(e, ["user_id", "event_type"], "ts", "3650 days"), "user_id long, event_type string")
