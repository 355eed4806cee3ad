"""Quality and credibility scores as wide projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.registry import query


def _times(c, w):
    return (F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w)


@query("q1_priority_score", "SELECT o_orderkey, round(greatest(0, least(1, (0.5 * least(1.0, o_totalprice / 400000.0) + 0.3 * CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.7 ELSE 0.3 END + 0.2 * CASE o_orderstatus WHEN 'O' THEN 1.0 ELSE 0.4 END) * 0.9)), 6) AS score FROM orders")
def _(t):
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).when(F.col("o_orderpriority") == "2-HIGH", 0.7).otherwise(0.3)
    s = (0.5 * F.least(F.lit(1.0), F.col("o_totalprice") / 400000.0) + 0.3 * p + 0.2 * F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.4)) * 0.9
    return t("orders").select("o_orderkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6).alias("score"))


@query("q2_keyword_relevance", "SELECT doc_id, round((least(1.0, ln((length(l) - length(replace(l, 'the', ''))) / 3.0 + 1) / ln(5)) * 1.0 + least(1.0, ln((length(l) - length(replace(l, 'que', ''))) / 3.0 + 1) / ln(5)) * 0.8) / 2, 6) AS r FROM (SELECT doc_id, lower(text) AS l FROM documents)")
def _(t):
    f = lambda w, k: F.least(F.lit(1.0), F.log(_times(F.lower("text"), w) + 1) / F.log(F.lit(5.0))) * k
    return t("documents").select("doc_id", F.round((f("the", 1.0) + f("que", 0.8)) / 2, 6).alias("r"))


@query("q3_uniqueness", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2) SELECT doc_id, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS hapax FROM c GROUP BY doc_id")
def _(t):
    w = t("documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    return w.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("hapax"))


@query("q4_content_quality", r"SELECT doc_id, round(0.5 * least(1.0, length(text) / 2000.0) + 0.5 * (1 - length(regexp_replace(text, '[^A-Z]', '', 'g')) * 1.0 / greatest(length(text), 1)), 6) AS quality FROM documents")
def _(t):
    caps = F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))
    return t("documents").select("doc_id", F.round(0.5 * F.least(F.lit(1.0), F.length("text") / 2000.0) + 0.5 * (1 - caps), 6).alias("quality"))


@query("q5_cross_reference", r"SELECT doc_id, round(least(1.0, ln(len(regexp_extract_all(text, '\d+')) + 1) / ln(10)), 6) AS score FROM documents")
def _(t):
    return t("documents").select("doc_id", F.round(F.least(F.lit(1.0), F.log(F.regexp_count("text", F.lit(r"\d+")) + 1.0) / F.log(F.lit(10.0))), 6).alias("score"))


@query("q8_temporal_relevance", "SELECT o_orderkey, round(least(1.0, exp(-0.1 * y) + CASE WHEN y > 30 THEN least(0.3, y / 100) ELSE 0 END), 6) AS r FROM (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') / 365.0 AS y FROM orders)")
def _(t):
    y = F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date")) / 365.0
    return t("orders").select("o_orderkey", F.round(F.least(F.lit(1.0), F.exp(-0.1 * y) + F.when(y > 30, F.least(F.lit(0.3), y / 100)).otherwise(0.0)), 6).alias("r"))


@query("q10_domain_reputation", "SELECT s_suppkey, round(CASE WHEN r_name = 'ASIA' THEN 0.5 * 0.2 WHEN r_name = 'EUROPE' THEN greatest(0.8, 0.5) ELSE 0.5 END, 6) AS reputation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    r = F.when(F.col("r_name") == "ASIA", 0.5 * 0.2).when(F.col("r_name") == "EUROPE", 0.8).otherwise(0.5)
    return j.select("s_suppkey", F.round(r, 6).alias("reputation"))


@query("q12_risk_factors", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS risks FROM documents")
def _(t):
    r = F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.contains("text", F.lit("!!")), "shouting"), F.when(F.contains("text", F.lit("|")), "table"))
    return t("documents").select("doc_id", F.array_join(F.array_compact(r), ",").alias("risks"))


@query("q15_intelligence_score", "SELECT user_id, round(sum(CASE WHEN event_type = m THEN 0.3 ELSE 0.1 END * least(value / 100.0, 1.0)) / nullif(count(*), 0), 6) AS score FROM events, (SELECT min(event_type) AS m FROM events) GROUP BY user_id")
def _(t):
    e = t("events")
    m = e.agg(F.min("event_type").alias("m"))
    part = F.when(F.col("event_type") == F.col("m"), 0.3).otherwise(0.1) * F.least(F.col("value") / 100.0, F.lit(1.0))
    return e.crossJoin(F.broadcast(m)).groupBy("user_id").agg(F.round(F.sum(part) / F.count(F.lit(1)), 6).alias("score"))
