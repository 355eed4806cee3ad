"""Aggregations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.registry import query



@query(
    "agg_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    count(*) AS n_rows FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_rows")
    )


@query("a1_table_profile", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def _(t):
    return t("events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "a2_keyword_match_scoring",
    """WITH k AS (SELECT unnest(['the', 'tion', 'sch', 'que']) AS kw),
    m AS (SELECT doc_id, kw, CAST((length(lower(text)) - length(replace(lower(text), kw, ''))) // length(kw) AS BIGINT) AS freq FROM documents, k WHERE contains(lower(text), kw)),
    g AS (SELECT doc_id, count(DISTINCT kw) AS kc, CAST(sum(freq) AS BIGINT) AS f, max(CASE WHEN kw = 'the' THEN 1 ELSE 0 END) AS exact FROM m GROUP BY doc_id)
    SELECT doc_id, kc, f, CAST(10 * kc + 2 * f + 20 * exact AS BIGINT) AS score FROM g ORDER BY score DESC, doc_id LIMIT 100""",
)
def _(t):
    words = ["the", "tion", "sch", "que"]
    low = t("documents").select("doc_id", F.lower("text").alias("x"))
    counts = low.select("doc_id", *[((F.length("x") - F.length(F.replace("x", F.lit(w), F.lit("")))) / len(w)).cast("long").alias(f"c{i}") for i, w in enumerate(words)])
    cs = [F.col(f"c{i}") for i in range(len(words))]
    kc = sum(((c > 0).cast("long") for c in cs), F.lit(0))
    out = counts.select("doc_id", kc.cast("long").alias("kc"), sum(cs, F.lit(0)).cast("long").alias("f"), (cs[0] > 0).cast("int").alias("exact")).where("kc > 0")
    return out.select("doc_id", "kc", "f", (10 * F.col("kc") + 2 * F.col("f") + 20 * F.col("exact")).cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(100)


@query("a3_stats_by_type", "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS avg_chars, max(n_chars) AS max_chars FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.max("n_chars").alias("max_chars"))


@query("a7_metric_aggregates", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS med, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.median("value"), 6).alias("med"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
    )


@query("a9_two_count_bys", "SELECT 'type' AS kind, event_type AS k, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*) FROM events GROUP BY hour(ts)")
def _(t):
    # both counts in one scan and one shuffle
    e = t("events").select(F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("k")), F.struct(F.lit("hour").alias("kind"), F.hour("ts").cast("string").alias("k")))).alias("p"))
    return e.groupBy("p.kind", "p.k").agg(F.count("*").alias("n"))


@query("a15_confidence_bins", "SELECT CAST(floor(l_discount * 100) * 10 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy((F.floor(F.col("l_discount") * 100) * 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("a18_language_distribution", "SELECT lang, source, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY lang, source")
def _(t):
    g = t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query(
    "a21_keyword_frequency",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b[a-z]{3,}\b')) AS w FROM documents),
    c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w NOT IN ('the', 'and', 'for', 'that', 'with') GROUP BY doc_id, w)
    SELECT doc_id, w, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c) WHERE r <= 5""",
)
def _(t):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![A-Za-z0-9_])[a-z]{3,}(?![A-Za-z0-9_])"), F.lit(0))).alias("w")
    c = t("documents").select("doc_id", words).where(~F.col("w").isin("the", "and", "for", "that", "with")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))).where("r <= 5").drop("r")


@query("a23_latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("a24_contribution_shares", "SELECT source, round(sum(n_chars) * 1.0 / (SELECT sum(n_chars) FROM documents), 8) AS share FROM documents GROUP BY source")
def _(t):
    g = t("documents").groupBy("source").agg(F.sum("n_chars").alias("s"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("s").alias("all")))).select("source", F.round(F.col("s") / F.col("all"), 8).alias("share"))


@query("a25_weighted_mean", "SELECT l_suppkey, round(sum(l_discount * w) / nullif(sum(w), 0), 8) AS mean FROM (SELECT l_suppkey, l_discount, least(l_quantity / 30.0, 1.0) AS w FROM lineitem) GROUP BY l_suppkey")
def _(t):
    w = F.least(F.col("l_quantity") / 30.0, F.lit(1.0))
    return t("lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * w) / F.nullif(F.sum(w), F.lit(0.0)), 8).alias("mean"))


@query("a27_merge_by_normalised_name", "SELECT lower(trim(p_type)) AS k, count(*) AS n, arg_max(p_partkey, (p_retailprice, p_partkey)) AS best, count(DISTINCT p_brand) AS brands, round(least(1.0, max(p_size) / 100.0 + 0.1 * (count(*) - 1)), 6) AS confidence FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy(F.lower(F.trim("p_type")).alias("k")).agg(
        F.count("*").alias("n"), F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"), F.countDistinct("p_brand").alias("brands"),
        F.round(F.least(F.lit(1.0), F.max("p_size") / 100.0 + 0.1 * (F.count("*") - 1)), 6).alias("confidence"),
    )


@query("m1_cost_rollup", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS cost, count(*) AS n, round(sum(o_totalprice) / greatest((SELECT sum(o_totalprice) FROM orders), 0.001), 8) AS ratio FROM orders GROUP BY o_orderpriority")
def _(t):
    g = t("orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    total = g.agg(F.greatest(F.sum("s"), F.lit(0.001)).alias("all"))
    return g.crossJoin(F.broadcast(total)).select("o_orderpriority", F.round("s", 2).alias("cost"), "n", F.round(F.col("s") / F.col("all"), 8).alias("ratio"))


@query("m4_quality_bands", "SELECT lang, count(*) AS n, sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN n_chars BETWEEN 500 AND 2000 THEN 1 ELSE 0 END)::BIGINT AS mid, sum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END)::BIGINT AS low FROM documents GROUP BY lang")
def _(t):
    c = F.col("n_chars")
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(c > 2000).alias("high"), F.count_if(c.between(500, 2000)).alias("mid"), F.count_if(c < 500).alias("low"))


@query("m9_baseline_comparison", "WITH m AS (SELECT event_type, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS base, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS cur FROM events GROUP BY event_type) SELECT event_type, round(CASE WHEN base <= 0 THEN 0 ELSE (cur - base) / base * 100 END, 6) AS pct FROM m")
def _(t):
    even = F.pmod("event_id", F.lit(2)) == 0
    m = t("events").groupBy("event_type").agg(F.avg(F.when(even, F.col("value"))).alias("base"), F.avg(F.when(~even, F.col("value"))).alias("cur"))
    return m.select("event_type", F.round(F.when(F.col("base") <= 0, 0.0).otherwise((F.col("cur") - F.col("base")) / F.col("base") * 100), 6).alias("pct"))


@query("m3_insight_groups", "SELECT p_type, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY p_type HAVING count(*) >= 3 ORDER BY mean DESC, p_type LIMIT 10")
def _(t):
    g = t("part").groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean")).where("n >= 3")
    return g.orderBy(F.desc("mean"), "p_type").limit(10)


@query("g1_rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
