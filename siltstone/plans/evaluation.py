"""Retrieval evaluation and claim operators over the driver's tables: ranked lists stand for results, labels for relevance."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.registry import query

#: Results: the documents of a source by length; relevance: their quality label.
RANKED = "r AS (SELECT d.source AS q, d.doc_id, coalesce(l.quality, 0) AS rel, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _ranked(t):
    d = t("documents").select("doc_id", "source", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return d.select(F.col("source").alias("q"), "doc_id", F.coalesce("quality", F.lit(0)).alias("rel"), rn.alias("rn"))


@query("e1_recall_precision_at_k", f"WITH {RANKED}, k AS (SELECT unnest([1, 3, 5, 10, 20]) AS k) SELECT q, k, round(sum(CASE WHEN rn <= k THEN rel ELSE 0 END) * 1.0 / nullif(sum(rel), 0), 6) AS recall, round(sum(CASE WHEN rn <= k THEN rel ELSE 0 END) * 1.0 / k, 6) AS precision_ FROM r, k GROUP BY q, k")
def _(t):
    # one pass: a conditional sum for each k instead of a copy of the rows
    ks = (1, 3, 5, 10, 20)
    g = _ranked(t).groupBy("q").agg(F.sum("rel").alias("all"), *[F.sum(F.when(F.col("rn") <= k, F.col("rel")).otherwise(0)).alias(f"h{k}") for k in ks])
    each = g.select("q", "all", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks])).alias("x"))
    return each.select("q", "x.k", F.round(F.col("x.h") / F.nullif(F.col("all"), F.lit(0)), 6).alias("recall"), F.round(F.col("x.h") / F.col("x.k"), 6).alias("precision_"))


def _ndcg(t, gain, discount):
    r = _ranked(t)
    r = r.withColumn("ideal", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rel"), "rn")))
    g = r.groupBy("q").agg(F.sum(F.when(F.col("rn") <= 10, gain * discount(F.col("rn")))).alias("dcg"), F.sum(F.when(F.col("ideal") <= 10, gain * discount(F.col("ideal")))).alias("idcg"))
    return g.select("q", F.round(F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"))


def _ndcg_sql(gain, discount):
    d = lambda c: discount.replace("#", c)
    return f"""WITH {RANKED}, i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, rn) AS ir FROM r),
    g AS (SELECT q, sum(CASE WHEN rn <= 10 THEN ({gain}) * {d('rn')} END) AS dcg, sum(CASE WHEN ir <= 10 THEN ({gain}) * {d('ir')} END) AS idcg FROM i GROUP BY q)
    SELECT q, round(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END, 6) AS ndcg FROM g"""


@query("e2_ndcg_exponential", _ndcg_sql("pow(2, rel) - 1", "(1 / log2(# + 1))"))
def _(t):
    return _ndcg(t, F.pow(F.lit(2.0), F.col("rel")) - 1, lambda n: 1 / F.log2(n + 1))


@query("e3_ndcg_shifted", _ndcg_sql("rel", "(CASE WHEN # = 1 THEN 1.0 ELSE 1 / log2(#) END)"))
def _(t):
    return _ndcg(t, F.col("rel"), lambda n: F.when(n == 1, 1.0).otherwise(1 / F.log2(n)))


@query("e5_ndcg_linear", _ndcg_sql("rel", "(1 / log2(# + 1))"))
def _(t):
    return _ndcg(t, F.col("rel"), lambda n: 1 / F.log2(n + 1))


@query("e4_mrr", f"WITH {RANKED} SELECT q, round(1.0 / min(CASE WHEN rel > 0 THEN rn END), 6) AS rr FROM r GROUP BY q")
def _(t):
    return _ranked(t).groupBy("q").agg(F.round(1.0 / F.min(F.when(F.col("rel") > 0, F.col("rn"))), 6).alias("rr"))


@query("e6_evidence_coverage", "SELECT p_brand, round(avg(CASE WHEN n >= 26 THEN 1.0 ELSE 0 END), 6) AS coverage FROM (SELECT p_partkey, p_brand, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY p_brand")
def _(t):
    each = t("part").select("p_partkey", "p_brand").join(t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")), F.col("p_partkey") == F.col("l_partkey"), "left")
    return each.groupBy("p_brand").agg(F.round(F.avg((F.coalesce("n", F.lit(0)) >= 26).cast("double")), 6).alias("coverage"))


@query("e8_groundedness", "SELECT p_brand, round(avg(g), 6) AS groundedness FROM (SELECT p_partkey, p_brand, coalesce(avg(0.6 * l_discount * 10 + 0.4 * l_tax * 10), 0) AS g FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY p_brand")
def _(t):
    per = t("lineitem").groupBy("l_partkey").agg(F.avg(0.6 * F.col("l_discount") * 10 + 0.4 * F.col("l_tax") * 10).alias("g"))
    each = t("part").select("p_partkey", "p_brand").join(per, F.col("p_partkey") == F.col("l_partkey"), "left")
    return each.groupBy("p_brand").agg(F.round(F.avg(F.coalesce("g", F.lit(0.0))), 6).alias("groundedness"))


@query("e9_hallucination_rate", "SELECT round(avg(CASE WHEN m < 0.05 THEN 1.0 ELSE 0 END), 6) AS rate FROM (SELECT l_partkey, avg(l_discount) AS m FROM lineitem GROUP BY l_partkey)")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("m")).agg(F.round(F.avg((F.col("m") < 0.05).cast("double")), 6).alias("rate"))


@query("e13_threshold_gates", "SELECT event_type, (avg(value) >= 10 AND min(value) >= 0 AND count(*) >= 2000) AS passed FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(((F.avg("value") >= 10) & (F.min("value") >= 0) & (F.count(F.lit(1)) >= 2000)).alias("passed"))


# -- claims: orders are claims, their lines evidence ----------------------------------------------


@query("g16_claim_support", "SELECT l_orderkey, round(greatest(0, least(1, sum(CASE WHEN l_returnflag <> 'R' THEN 0.3 ELSE 0 END) - sum(CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE 0 END) + sum(l_discount * l_tax))), 6) AS support FROM lineitem GROUP BY l_orderkey")
def _(t):
    returned = F.col("l_returnflag") == "R"
    s = F.sum(F.when(~returned, 0.3).otherwise(0.0)) - F.sum(F.when(returned, 0.2).otherwise(0.0)) + F.sum(F.col("l_discount") * F.col("l_tax"))
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6).alias("support"))


@query("g17_status_bands", "SELECT CASE WHEN v >= 0.8 THEN 'verified' WHEN v >= 0.6 THEN 'likely' WHEN v >= 0.4 THEN 'uncertain' WHEN v >= 0.2 THEN 'doubtful' ELSE 'refuted' END AS band, count(*) AS n FROM (SELECT l_discount * 10 AS v FROM lineitem) GROUP BY 1")
def _(t):
    v = F.col("l_discount") * 10
    band = F.when(v >= 0.8, "verified").when(v >= 0.6, "likely").when(v >= 0.4, "uncertain").when(v >= 0.2, "doubtful").otherwise("refuted")
    return t("lineitem").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("k4_quantitative_contradiction", "SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, round(abs(a.l_quantity - b.l_quantity) / nullif(greatest(a.l_quantity, b.l_quantity), 0), 6) AS gap FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag = b.l_returnflag WHERE abs(a.l_quantity - b.l_quantity) / nullif(greatest(a.l_quantity, b.l_quantity), 0) > 0.5")
def _(t):
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")  # noqa: E741
    p = l.alias("a").join(l.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_returnflag = b.l_returnflag"))
    gap = F.abs(F.col("a.l_quantity") - F.col("b.l_quantity")) / F.nullif(F.greatest("a.l_quantity", "b.l_quantity"), F.lit(0.0))
    return p.where(gap > 0.5).select("a.l_orderkey", F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"), F.round(gap, 6).alias("gap"))


@query("k6_topic_grouping", "WITH c AS (SELECT doc_id, [length(l) - length(replace(l, 'the', '')), length(l) - length(replace(l, 'sch', '')), length(l) - length(replace(l, 'que', ''))] AS n FROM (SELECT doc_id, lower(text) AS l FROM documents)) SELECT CASE WHEN list_max(n) = 0 THEN 'general' ELSE ['the', 'sch', 'que'][list_position(n, list_max(n))] END AS topic, count(*) AS docs FROM c GROUP BY 1")
def _(t):
    low = F.lower("text")
    n = F.array(*[F.length(low) - F.length(F.replace(low, F.lit(w), F.lit(""))) for w in ("the", "sch", "que")])
    c = t("documents").select(n.alias("n"))
    topic = F.when(F.array_max("n") == 0, "general").otherwise(F.element_at(F.array(F.lit("the"), F.lit("sch"), F.lit("que")), F.expr("cast(array_position(n, array_max(n)) as int)")))
    return c.groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("docs"))


@query("k11_confidence_penalty", "SELECT o_orderkey, round(greatest(0.1, 0.9 - least(0.8, coalesce(p, 0))), 6) AS confidence FROM orders LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 0.3 ELSE 0.0 END) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(t):
    p = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 0.3).otherwise(0.0)).alias("p"))
    o = t("orders").select("o_orderkey").join(p, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.round(F.greatest(F.lit(0.1), 0.9 - F.least(F.lit(0.8), F.coalesce("p", F.lit(0.0)))), 6).alias("confidence"))


MONTHS = "m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS s, o_custkey AS c FROM orders), n AS (SELECT s, count(*) AS n FROM m GROUP BY s), b AS (SELECT x.s AS s1, y.s AS s2, count(*) AS both_ FROM m x JOIN m y ON x.c = y.c AND x.s < y.s GROUP BY 1, 2)"


@query("k18_set_correlation", f"WITH {MONTHS} SELECT s1, s2, round((both_ * 1.0 / (p.n + q.n - both_) + both_ * 1.0 / least(p.n, q.n)) / 2, 6) AS r FROM b JOIN n p ON s1 = p.s JOIN n q ON s2 = q.s")
def _(t):
    # sources are months, their members customers; sources meet through shared members, so that no pair without any is made
    m = t("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("s"), F.col("o_custkey").alias("c")).distinct()
    n = m.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    b = m.toDF("s1", "c").join(m.toDF("s2", "c"), "c").where("s1 < s2").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("both"))
    b = b.join(n.toDF("s1", "n1"), "s1").join(n.toDF("s2", "n2"), "s2")
    return b.select("s1", "s2", F.round((F.col("both") / (F.col("n1") + F.col("n2") - F.col("both")) + F.col("both") / F.least("n1", "n2")) / 2, 6).alias("r"))
