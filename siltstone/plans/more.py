"""Further operators: near-duplicate groups, paths, windows, projections and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import relational as R
from siltstone.plans.graphs import N, _chain
from siltstone.plans.statements import doubles
from siltstone.registry import query

SHINGLES = r"(SELECT doc_id, list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda x: x <> '') AS w FROM documents)"


def project(name: str, table: str, key: str, column: str, expression: str, sql: str | None = None) -> None:
    """A projection whose expression is the same SQL text in both engines, or has a text of its own for the other."""
    query(name, f"SELECT {key}, {doubles(sql or expression)} AS {column} FROM {table}")(lambda t: t(table).selectExpr(*key.split(", "), f"{doubles(expression)} as {column}"))


# -- near-duplicate groups ---------------------------------------------------------------------


def shingles(words):
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.array_distinct(F.when(n >= 3, many).otherwise(F.array(F.array_join(words, " "))))


def _words(t):
    return t("documents").select("doc_id", F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda w: w != "").alias("w"))


@query("d1_word_shingles", f"SELECT doc_id, CAST(CASE WHEN len(w) < 3 THEN 1 ELSE len(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS BIGINT) AS n FROM {SHINGLES}")
def _(t):
    return _words(t).select("doc_id", F.size(shingles(F.col("w"))).cast("long").alias("n"))


@query("d5_duplicate_merge", "SELECT md5(text) AS k, count(*) AS n, min(doc_id) AS first_id, max(n_chars) AS longest, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    k = F.md5(F.col("text").cast("binary")).alias("k")
    g = t("documents").groupBy(k).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("longest"), F.countDistinct("source").alias("sources"))
    return g.where("n > 1")


@query("d7_representative", "SELECT k, doc_id FROM (SELECT md5(text) AS k, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY 0.3 * least(1.0, n_chars / 1000.0) + 0.2 * CASE WHEN source < 'src5' THEN 1 ELSE 0 END DESC, doc_id) AS n FROM documents) WHERE n = 1")
def _(t):
    d = t("documents").select(F.md5(F.col("text").cast("binary")).alias("k"), "doc_id", (0.3 * F.least(F.lit(1.0), F.col("n_chars") / 1000.0) + 0.2 * (F.col("source") < "src5").cast("int")).alias("s"))
    return R.first_per(d, ["k"], [F.desc("s"), "doc_id"]).select("k", "doc_id")


# -- paths ---------------------------------------------------------------------------------------


@query("g3_two_hop_neighbourhood", f"WITH {N}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) SELECT a, b FROM u UNION SELECT x.a, y.b FROM u x JOIN u y ON x.b = y.a WHERE x.a <> y.b")
def _(t):
    e = _chain(t)
    u = e.toDF("a", "b").union(e.select(F.col("dst"), F.col("src"))).distinct()
    two = u.alias("x").join(u.alias("y"), F.expr("x.b = y.a and x.a <> y.b")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    return u.union(two).distinct()


@query("g5_walks_to_depth_3", f"WITH {N}, p1 AS (SELECT src AS a, dst AS b, 1 AS c FROM e), p2 AS (SELECT a, dst AS b, sum(c) AS c FROM p1 JOIN e ON b = src GROUP BY 1, 2), p3 AS (SELECT a, dst AS b, sum(c) AS c FROM p2 JOIN e ON b = src GROUP BY 1, 2) SELECT a, b, CAST(sum(c) AS BIGINT) AS walks FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY 1, 2")
def _(t):
    # walks are counted at each step, not listed
    e = _chain(t)
    step = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("c"))
    out = step
    for _i in range(2):
        step = step.join(e, F.col("b") == F.col("src")).groupBy("a", F.col("dst").alias("b")).agg(F.sum("c").alias("c"))
        out = out.unionByName(step)
    return out.groupBy("a", "b").agg(F.sum("c").alias("walks"))


@query("g18_edge_filter", "SELECT l_orderkey, l_linenumber, o_orderstatus, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
def _(t):
    r = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    j = r.join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand")


# -- windows and aggregates -----------------------------------------------------------------------


@query("w14_timeline", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE value >= 50")
def _(t):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t("events").where("value >= 50").select("user_id", "event_id", pos.alias("pos"))


@query("w18_last_n_summary", "SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5 GROUP BY user_id")
def _(t):
    e = R.top_per(t("events").select("user_id", "ts", "event_id", "value"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("a17_temporal_stats", "SELECT event_type, min(ts) AS oldest, max(ts) AS newest, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS span_days, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("span_days"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("a22_weighted_overall", "SELECT user_id, round(0.6 * avg(least(value / 100.0, 1.0)) + 0.4 * avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS overall FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.round(0.6 * F.avg(F.least(F.col("value") / 100.0, F.lit(1.0))) + 0.4 * F.avg((F.col("value") > 50).cast("double")), 6).alias("overall"))


@query("a26_merge_event_group", "SELECT user_id, event_type, arg_max(event_id, (value, event_id)) AS base, round(sum(epoch_us(ts) / 1e6 * value) / nullif(sum(value), 0), 0) AS at FROM events GROUP BY 1, 2")
def _(t):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("base"), F.round(F.sum(sec * F.col("value")) / F.nullif(F.sum("value"), F.lit(0.0)), 0).alias("at"))


@query("m6_base_claim_confidence", "SELECT l_orderkey, floor(greatest(0.1e0, least(0.9e0, 0.4e0 * least(count(*) / 3e0, 1e0) + 0.3e0 * least(count(DISTINCT l_suppkey) / 3e0, 1e0) + 0.3e0 * sum(CAST(round(least(l_quantity, 20) * l_discount * 100) AS BIGINT)) / (200e0 * count(*)))) * 1e6 + 0.25e0) / 1e6 AS confidence FROM lineitem GROUP BY l_orderkey")
def _(t):
    c = 0.4 * F.least(F.count("*") / 3.0, F.lit(1.0)) + 0.3 * F.least(F.countDistinct("l_suppkey") / 3.0, F.lit(1.0)) + 0.3 * F.sum(F.round(F.least(F.col("l_quantity"), F.lit(20.0)) * F.col("l_discount") * 100).cast("long")) / (200.0 * F.count("*"))
    return t("lineitem").groupBy("l_orderkey").agg((F.floor(F.greatest(F.lit(0.1), F.least(F.lit(0.9), c)) * 1e6 + 0.25) / 1e6).alias("confidence"))


@query("m7_tuning_argmax", "SELECT event_type, arg_min(user_id, (m, user_id)) AS best FROM (SELECT event_type, user_id, round(avg(value), 6) AS m FROM events GROUP BY 1, 2) WHERE m > 10 GROUP BY event_type")
def _(t):
    g = t("events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("m")).where("m > 10")
    return g.groupBy("event_type").agg(F.min_by("user_id", F.struct("m", "user_id")).alias("best"))


@query("m8_merge_by_url", "SELECT k, min(page_id) AS first_id, count(*) AS n FROM (SELECT coalesce(nullif(regexp_extract(lower(trim(url)), '^https?://([^?#]*/[a-z]+)/', 1), ''), CAST(page_id AS VARCHAR)) AS k, page_id FROM pages) GROUP BY k")
def _(t):
    k = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("url")), "^https?://([^?#]*/[a-z]+)/", 1), F.lit("")), F.col("page_id").cast("string"))
    return t("pages").groupBy(k.alias("k")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))


@query("k8_contradiction_strength", "SELECT l_partkey, round(avg(l_discount) + least(0.2, 0.05 * count(DISTINCT l_suppkey)), 6) AS strength, CASE WHEN round(avg(l_discount), 8) > 0.06 THEN 'reject' WHEN round(avg(l_discount), 8) > 0.04 THEN 'qualify' ELSE 'keep' END AS strategy FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey")
def _(t):
    m = F.round(F.avg("l_discount"), 8)
    return t("lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(
        F.round(F.avg("l_discount") + F.least(F.lit(0.2), 0.05 * F.countDistinct("l_suppkey")), 6).alias("strength"),
        F.when(m > 0.06, "reject").when(m > 0.04, "qualify").otherwise("keep").alias("strategy"),
    )


@query("k5_source_contradiction", "SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, 0.8 AS strength FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber")
def _(t):
    l = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")  # noqa: E741
    p = l.alias("a").join(l.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.l_linenumber < b.l_linenumber"))
    return p.select("a.l_orderkey", F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"), F.lit(0.8).alias("strength"))


@query("e11_list_overlap", "WITH r AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_extendedprice) DESC, l_partkey) AS b FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(sum(CASE WHEN a <= 10 AND b <= 10 THEN 1 ELSE 0 END) * 1.0 / sum(CASE WHEN a <= 10 OR b <= 10 THEN 1 ELSE 0 END), 6) AS jaccard FROM r GROUP BY l_suppkey")
def _(t):
    g = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 4).alias("p"))
    w = Window.partitionBy("l_suppkey")
    r = g.select("l_suppkey", F.row_number().over(w.orderBy(F.desc("q"), "l_partkey")).alias("a"), F.row_number().over(w.orderBy(F.desc("p"), "l_partkey")).alias("b"))
    both, either = (F.col("a") <= 10) & (F.col("b") <= 10), (F.col("a") <= 10) | (F.col("b") <= 10)
    return r.groupBy("l_suppkey").agg(F.round(F.count_if(both) / F.count_if(either), 6).alias("jaccard"))


@query("v5_multi_table_merge", "SELECT * FROM (SELECT 'part' AS src, p_partkey AS id, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) UNION ALL SELECT * FROM (SELECT 'customer', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)")
def _(t):
    a = t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    b = t("customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return a.unionByName(b)


@query("f30_inverted_index_to_text", "SELECT conv_id, md5(string_agg(role || ' ' || text, ' ' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def _(t):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["role"], F.lit(" "), p["text"])), " ")
    return t("conversations").groupBy("conv_id").agg(F.md5(joined.cast("binary")).alias("h"))


# -- projections -----------------------------------------------------------------------------------

URL = "CASE WHEN o_orderstatus = 'F' THEN concat('http://news.example/', {}, '/a.html') ELSE concat('http://news.example/', CAST(o_orderkey AS {}), '/a.html') END"
project("f11_url_date", "orders", "o_orderkey", "d", f"regexp_extract({URL.format("date_format(o_orderdate, 'yyyy/MM/dd')", "STRING")}, '/([0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}})', 1)", f"regexp_extract({URL.format("strftime(o_orderdate, '%Y/%m/%d')", "VARCHAR")}, '/([0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}})', 1)")
project("f22_entity_normalisation", "customer", "c_custkey", "form", "trim(regexp_replace(lower(c_name), '^(mr|dr|customer)[ #.]*', ''))")
project("f24_entity_id", "supplier", "s_suppkey", "id", "md5(concat(lower(trim(s_name)), '|', 'ORG'))")
project("f43_discourse_type", "documents", "doc_id", "kind", "CASE WHEN text LIKE '#%' THEN 'heading' WHEN text LIKE '- %' OR text LIKE '* %' THEN 'list' WHEN text LIKE '%[1]%' THEN 'citation_heavy' WHEN lower(text) LIKE '%the%' THEN 'argumentative' ELSE 'narrative' END")
project("c12_adaptive_score", "lineitem", "l_orderkey * 10 + l_linenumber AS k, l_tax", "s", "round(greatest(-1.0, least(1.0, CASE WHEN l_discount < 0.05 THEN -0.3 + l_discount * 4 ELSE 0.4 * l_discount * 10 END + l_tax * 0.2)), 6)")
project("r21_temporal_rerank", "orders", "o_orderkey", "score", "round(0.7 * o_totalprice / 500000.0 + 0.3 * exp(-datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) / 365.0), 6)", "round(0.7 * o_totalprice / 500000.0 + 0.3 * exp(-date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 365.0), 6)")
project("r22_criteria_rerank", "part", "p_partkey", "score", "round(0.4 * p_size / 50.0 + 0.3 * p_retailprice / 2500.0 + 0.2 * CASE WHEN p_brand < 'Brand#3' THEN 1 ELSE 0 END + 0.1 * least(1.0, length(p_name) / 40.0), 6)")
project("k1_direct_contradiction", "documents", "doc_id", "score", "round(CASE WHEN lower(text) LIKE '%the%' AND lower(text) LIKE '%not%' THEN 0.3 ELSE 0.0 END + CASE WHEN lower(text) LIKE '%and%' AND lower(text) LIKE '%or%' THEN 0.3 ELSE 0.0 END, 6)")
project("q11_overall_credibility", "part", "p_partkey", "score", "round(0.3 * p_size / 50.0 + 0.4 * CASE WHEN p_brand < 'Brand#3' THEN 0.8 ELSE 0.5 END + 0.2 * least(1.0, p_retailprice / 2000.0) + 0.1 * (1 - p_size / 100.0), 6)")
project("m5_lexical_conflict", "documents", "doc_id", "score", "round(least(1.0, 0.1 * CASE WHEN lower(text) LIKE '% und %' THEN 1 ELSE 0 END + 0.1 * CASE WHEN lower(text) LIKE '% que %' THEN 1 ELSE 0 END + 0.2 * CASE WHEN lower(text) LIKE '% the %' THEN 1 ELSE 0 END), 6)")
project("m12_investigation_confidence", "lineitem", "l_orderkey, l_linenumber", "c", "round(greatest(0.0, least(1.0, 0.3 * l_discount * 10 + 0.25 * l_tax * 10 + 0.25 * l_quantity / 50.0 + 0.2 * least(l_extendedprice / 50000.0, 1.0))), 6)")
project("m13_coalesced_identifier", "events", "event_id", "id", "coalesce(nullif(get_json_object(props, '$.id'), ''), nullif(get_json_object(props, '$.k'), ''), event_type)", "coalesce(nullif(json_extract_string(props, '$.id'), ''), nullif(json_extract_string(props, '$.k'), ''), event_type)")
