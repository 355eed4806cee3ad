"""Graph operators over customer-supplier and part-supplier edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.registry import query


def _edges(t):
    return t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


E = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


@query("g8_degree_centrality", f"WITH {E}, n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS degree FROM n GROUP BY node")
def _(t):
    return G.degrees(_edges(t))


@query("a13_graph_statistics", f"WITH {E} SELECT count(DISTINCT src) AS parts, count(DISTINCT dst) AS suppliers, count(*) AS edges FROM e")
def _(t):
    return _edges(t).agg(F.countDistinct("src").alias("parts"), F.countDistinct("dst").alias("suppliers"), F.count(F.lit(1)).alias("edges"))


PAGERANK = f"""WITH RECURSIVE {E}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS out_ FROM e GROUP BY src), """ + ", ".join(
    f"r{i} AS (SELECT n.node, 0.15e0 / (SELECT count(*) FROM n) + 0.85e0 * (coalesce(s.got, 0e0) + (SELECT coalesce(sum(rank), 0e0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n)) AS rank "
    f"FROM n LEFT JOIN (SELECT dst, sum(rank / out_) AS got FROM e JOIN r{i - 1} p ON p.node = e.src JOIN o ON o.src = e.src GROUP BY dst) s ON s.dst = n.node)"
    for i in range(1, 11)
).replace("r0 ", "r0 ") + " SELECT node, round(rank, 9) AS rank FROM r10"
PAGERANK = PAGERANK.replace("r1 AS (", "r0 AS (SELECT node, 1e0 / (SELECT count(*) FROM n) AS rank FROM n), r1 AS (", 1)


@query("g8_pagerank", PAGERANK)
def _(t):
    return G.pagerank(_edges(t), 10).select("node", F.round("rank", 9).alias("rank"))


@query("g12_co_occurrence", "SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def _(t):
    l = t("lineitem").select("l_orderkey", "l_suppkey").distinct()  # noqa: E741
    return l.alias("a").join(l.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey")).groupBy(F.col("a.l_suppkey").alias("s1"), F.col("b.l_suppkey").alias("s2")).agg(F.count(F.lit(1)).alias("n"))


def _chain(t):
    """Edges between the customers of successive orders of the same priority."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("dst"), "o_orderpriority")
    return o.join(nxt, ["o_orderkey", "o_orderpriority"]).where("o_custkey <> dst").select(F.col("o_custkey").alias("src"), "dst").distinct()


N = "e AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND a.o_orderpriority = b.o_orderpriority WHERE a.o_custkey <> b.o_custkey)"


@query("x16_frontier_bfs", f"WITH RECURSIVE {N}, b AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM b JOIN e ON src = node WHERE hops < 3) SELECT node, min(hops) AS hops FROM b GROUP BY node")
def _(t):
    e = _chain(t)
    return G.reach(e, e.sparkSession.createDataFrame([(1,)], "node long"), 3)


@query("g11_triangles", f"WITH {N}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), n AS (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) SELECT node, count(*) AS triangles FROM n GROUP BY node")
def _(t):
    return G.triangles(_chain(t))


@query("j16_typed_path", "SELECT n_name, count(DISTINCT s_suppkey) AS suppliers, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    j = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    l = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))  # noqa: E741
    both = j.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.countDistinct("s_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"))


@query("g10_degree_anomalies", f"WITH {E}, n AS (SELECT dst AS node, count(*) AS degree FROM e GROUP BY dst), s AS (SELECT avg(degree) AS m, stddev_pop(degree) AS sd FROM n) SELECT node, degree FROM n, s WHERE degree > m + 2 * sd")
def _(t):
    n = _edges(t).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    s = n.agg(F.avg("degree").alias("m"), F.stddev_pop("degree").alias("sd"))
    return n.crossJoin(F.broadcast(s)).where("degree > m + 2 * sd").select("node", "degree")


@query("g4_k_hop_subgraph", f"WITH RECURSIVE {N}, q AS (SELECT c_custkey AS node FROM customer WHERE contains(c_name, '77')), b AS (SELECT node, 0 AS hops FROM q UNION SELECT dst, hops + 1 FROM b JOIN e ON src = node WHERE hops < 2) SELECT node, min(hops) AS hops FROM b GROUP BY node")
def _(t):
    seeds = t("customer").where(F.contains("c_name", F.lit("77"))).select(F.col("c_custkey").alias("node"))
    return G.reach(_chain(t), seeds, 2)
