"""Filters, joins, windows, sorts, set operations and dedup over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import relational as R
from siltstone.registry import query


@query("p1_transform_list", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def _(t):
    return R.transform(
        t("orders"),
        [
            {"operation": "filter", "params": {"column": "o_orderstatus", "value": "F"}},
            {"operation": "select", "params": {"columns": ["o_orderpriority", "o_totalprice"]}},
            {"operation": "group_by", "params": {"by": ["o_orderpriority"], "aggs": ["count(*) as n", "round(sum(o_totalprice), 2) as total"]}},
            {"operation": "sort", "params": {"by": "n", "desc": True}},
        ],
    )


@query("p3_keyword_predicates", "SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') OR p_name LIKE '%a%' OR p_type LIKE '%STEEL%'")
def _(t):
    hit = F.col("p_brand").isin("Brand#11", "Brand#22") | F.contains("p_name", F.lit("a")) | F.contains("p_type", F.lit("STEEL"))
    return t("part").where(hit).select("p_partkey", "p_name")


@query("p7_audit_event_filter", "SELECT event_id, ts, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    e = t("events")
    low = e.agg(F.min("event_type").alias("k"), F.min("ts").alias("t0"))  # one row
    hit = e.join(F.broadcast(low), (F.col("event_type") == F.col("k")) & (F.col("ts") >= F.col("t0") + F.expr("INTERVAL 1 DAY")))
    return hit.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts", "event_type")


@query("p10_due_source_filter", "WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id) SELECT user_id, last_ts FROM l WHERE last_ts IS NULL OR date_diff('second', last_ts, (SELECT max(ts) FROM events)) >= 3600")
def _(t):
    e = t("events").select("user_id", "ts")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    now = e.agg(F.max("ts").alias("now"))
    gap = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("last_ts").cast("timestamp"))
    return last.crossJoin(F.broadcast(now)).where(F.col("last_ts").isNull() | (gap >= 3600)).select("user_id", "last_ts")


@query("p12_evidence_sufficiency", "SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(*) >= 20 AND count(DISTINCT l_suppkey) >= 3")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers")).where("n >= 20 and suppliers >= 3")


@query("j1_inner_join", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("j2_semi_join_prefilter", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    big = t("orders").where("o_totalprice > 300000").select("o_custkey")
    return t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    "j3_hierarchical_lookup",
    """WITH p AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50),
    c AS (SELECT o_orderkey, o_totalprice, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM p JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT o_orderkey, l_linenumber, l_extendedprice, rank FROM c WHERE rank <= 3""",
)
def _(t):
    parents = t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    children = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(F.broadcast(parents), F.col("l_orderkey") == F.col("o_orderkey"))  # 50 rows
    return R.top_per(children, ["o_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 3).select("o_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query(
    "j6_proximity_self_join",
    """SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, round(1 - abs(date_diff('day', a.l_shipdate, b.l_shipdate)) / 100.0, 6) AS strength
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE abs(date_diff('day', a.l_shipdate, b.l_shipdate)) < 10""",
)
def _(t):
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")  # noqa: E741
    pair = l.alias("a").join(l.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber"))
    gap = F.abs(F.datediff("a.l_shipdate", "b.l_shipdate"))
    return pair.where(gap < 10).select("a.l_orderkey", F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"), F.round(1 - gap / 100.0, 6).alias("strength"))


@query(
    "j8_interval_join",
    """SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type < b.event_type
    AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000""",
)
def _(t):
    e = t("events").select("user_id", "event_id", "event_type", "ts")
    a, b = e.toDF("user_id", "a_id", "a_type", "a_ts"), e.toDF("user_id", "b_id", "b_type", "b_ts")
    return R.within(a, b, ["user_id"], "a_ts", "b_ts", 3600).where("a_type < b_type").select("a_id", "b_id")


@query(
    "j9_nearest_timestamp",
    """WITH o AS (SELECT o_custkey AS k, o_orderkey, o_orderdate FROM orders), m AS (SELECT user_id AS k, event_id, ts FROM events),
    p AS (SELECT o.k, o_orderkey, event_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(epoch_us(ts) - epoch_us(o_orderdate)), ts, event_id) AS n FROM o JOIN m ON o.k = m.k)
    SELECT k, o_orderkey, event_id FROM p WHERE n = 1""",
)
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    m = t("events").select(F.col("user_id").alias("k"), "event_id", "ts")
    # of events at one instant the smallest id counts
    m = R.first_per(m, ["k", "ts"], ["event_id"])
    found = R.nearest(o, m, ["k"], "o_orderdate", "ts", ["event_id"]).where("match is not null")
    return found.select("k", "o_orderkey", F.col("match.event_id").alias("event_id"))


@query("j17_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j10_source_pairs", "WITH s AS (SELECT DISTINCT source FROM documents) SELECT a.source AS source_a, b.source AS source_b FROM s a JOIN s b ON a.source < b.source")
def _(t):
    s = t("documents").select("source").distinct()  # the sources, not the documents
    return s.alias("a").join(s.alias("b"), F.expr("a.source < b.source")).select(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"))


@query("w2_rerank_positions", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS pos FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("pos"))


@query(
    "w3_margin_of_victory",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS s, row_number() OVER w AS pos, lead(l_extendedprice) OVER w AS nx, lag(l_extendedprice) OVER w AS pv
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber))
    SELECT l_orderkey, l_linenumber, round(CASE WHEN pos = 1 THEN s - coalesce(nx, 0) ELSE s - pv END, 4) AS margin FROM r""",
)
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    s = F.col("l_extendedprice")
    margin = F.when(F.row_number().over(w) == 1, s - F.coalesce(F.lead(s).over(w), F.lit(0.0))).otherwise(s - F.lag(s).over(w))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(margin, 4).alias("margin"))


@query(
    "w4_adjacent_change",
    """SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""",
)
def _(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("before", before).where("before is null or before <> event_type").select("user_id", "event_id", "event_type")


@query(
    "w8_prefix_budget",
    """SELECT conv_id, turn, running FROM (SELECT conv_id, turn, CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM conversations) WHERE running <= 200""",
)
def _(t):
    c = t("conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("cost"))
    return R.prefix_budget(c, ["conv_id"], ["turn"], F.col("cost"), 200).select("conv_id", "turn", "running")


@query(
    "w9_greedy_budget",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) // 4 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    s AS (SELECT conv_id, turn, n, c, c <= 200 AS took, CASE WHEN c <= 200 THEN c ELSE 0 END AS used FROM o WHERE n = 1
    UNION ALL SELECT o.conv_id, o.turn, o.n, o.c, s.used + o.c <= 200, CASE WHEN s.used + o.c <= 200 THEN s.used + o.c ELSE s.used END FROM s JOIN o ON o.conv_id = s.conv_id AND o.n = s.n + 1)
    SELECT conv_id, turn, CAST(c AS BIGINT) AS cost FROM s WHERE took""",
)
def _(t):
    c = t("conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("cost"))
    return R.greedy_budget(c, ["conv_id"], "turn", "cost", 200)


@query("t2_recent_n", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def _(t):
    return t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query(
    "t3_weighted_substring_search",
    """SELECT * FROM (SELECT p_partkey, round(2.0 * CAST(contains(lower(p_name), 'a') AS INT) + 1.0 * CAST(contains(lower(p_type), 'steel') AS INT) + 0.5 * CAST(contains(lower(p_brand), '3') AS INT) + 0.5 * p_size / 50.0, 6) AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50""",
)
def _(t):
    has = lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    score = F.round(2.0 * has("p_name", "a") + 1.0 * has("p_type", "steel") + 0.5 * has("p_brand", "3") + 0.5 * F.col("p_size") / 50.0, 6)
    return t("part").select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(50)


@query("t6_multi_key_sort", "SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_nationkey DESC, s_acctbal DESC, s_suppkey) AS pos FROM supplier")
def _(t):
    # supplier is a dimension; the order is by nation, so that ranks are made within nations and moved by the counts before
    s = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("s_nationkey", (F.sum("n").over(Window.orderBy(F.desc("s_nationkey"))) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return s.withColumn("own", own).join(before, "s_nationkey").select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("own") + F.col("before")).cast("long").alias("pos"))


@query("t7_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5")
def _(t):
    l = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")  # noqa: E741
    return R.top_per(l, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5).drop("l_extendedprice")


@query("u1_union_dedup", "WITH u AS (SELECT lower(trim(url)) AS k, page_id, 1 AS src FROM pages UNION ALL SELECT lower(trim(url)), page_id, 2 FROM pages) SELECT k, page_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id, src) AS n FROM u) WHERE n = 1")
def _(t):
    p = t("pages").select(F.lower(F.trim("url")).alias("k"), "page_id")
    both = p.withColumn("src", F.lit(1)).unionByName(p.withColumn("src", F.lit(2)))
    return R.first_per(both, ["k"], ["page_id", "src"]).select("k", "page_id")


@query("u2_distinct_by_content", "SELECT k, page_id FROM (SELECT md5(lower(trim(url)) || '|' || lower(trim(substr(html, 1, 200)))) AS k, page_id, row_number() OVER (PARTITION BY md5(lower(trim(url)) || '|' || lower(trim(substr(html, 1, 200)))) ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def _(t):
    k = F.md5(F.concat_ws("|", F.lower(F.trim("url")), F.lower(F.trim(F.substring("html", 1, 200)))).cast("binary"))
    return R.first_per(t("pages").select(k.alias("k"), "page_id"), ["k"], ["page_id"])


@query("u6_iterative_merge", "WITH old AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), new AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderkey, o_totalprice FROM old UNION ALL SELECT o_orderkey, o_totalprice FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def _(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old, new = o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 200000")
    return old.unionByName(new.join(old.select("o_orderkey"), "o_orderkey", "left_anti")).drop("o_orderstatus")


@query("u8_set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def _(t):
    both = t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))
    return both.exceptAll(t("nation").where("n_regionkey = 0").select("n_nationkey"))
