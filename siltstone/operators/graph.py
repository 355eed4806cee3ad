"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over distinct undirected edges (src, dst)."""
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    return ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _cut(df: DataFrame) -> DataFrame:
    """df from files in the shared checkpoint folder, so that plans do not grow with the rounds."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node, rank after `rounds` power steps over distinct directed edges; the mass of sinks is spread evenly.

    All nodes that no edge enters share one rank, a number in each round: what they send is summed over their edges once, and the
    rounds join only the edges between other nodes. Edges are written once; a null node neither sends nor gets.
    """
    from siltstone.operators.networks import written

    e = written(edges.select("src", "dst").distinct(), "edges")
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    known = F.col("node").isNotNull()
    counted = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    nodes = written(counted.select("node", F.when(known, F.col("out")).otherwise(0).alias("out"), (known & (F.col("least") == 0)).alias("entered")), "nodes")
    sink, entered = F.col("out") == 0, F.col("entered")
    n, loose, sinks = nodes.agg(F.count(F.lit(1)), F.count_if(~entered & sink), F.count_if(entered & sink)).first()
    weighted = e.join(nodes.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("node"), "dst", "out", "entered")
    given = weighted.where(~entered).groupBy(F.col("dst").alias("node")).agg(F.sum(1 / F.col("out")).alias("given"))
    inner = written(weighted.where(entered).select("node", "dst", "out"), "edges")
    linked = not inner.isEmpty()
    one = 1.0 / max(n, 1)  # the rank of a node that no edge enters
    ranks = written(nodes.where(entered).join(given, "node", "left").select("node", "out", F.coalesce("given", F.lit(0.0)).alias("given"), F.lit(one).alias("rank")), "ranks")
    for i in range(rounds):
        lost = loose * one + (ranks.where(sink).agg(F.sum("rank")).first()[0] if sinks else 0.0)
        got, spread = F.col("given") * one, (1 - damping + damping * lost) / max(n, 1)
        if linked:
            sent = inner.join(ranks.select("node", "rank"), "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("sent"))
            ranks, got = ranks.join(sent, "node", "left"), got + F.coalesce("sent", F.lit(0.0))
        ranks, one = ranks.select("node", "out", "given", (F.lit(spread) + damping * got).alias("rank")), spread
        if linked and (sinks or i % 3 == 2):  # the mass of sinks is read in the next round
            ranks = written(ranks, "ranks")
    return ranks.select("node", "rank").union(nodes.where(~entered).select("node", F.lit(one).alias("rank")))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """node, hops: breadth-first distance from the seeds over directed edges, up to `depth`."""
    seen = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = front.join(seen, "node", "left_anti").withColumn("hops", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles. Edges point from the lower to the higher degree, so that a hub is the apex of few wedges."""
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    deg = degrees(edges)
    with_deg = ends.join(deg.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    up = with_deg.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = up.alias("p").join(up.alias("q"), F.expr("p.x = q.x and p.y < q.y")).select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    closed = wedge.join(ends, ["a", "b"])
    return closed.select(F.explode(F.array("x", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def _labels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "other").where("node <> other").distinct()
    return both, both.select("node").distinct()


def connected(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, root: the smallest node reachable. Labels jump to their root's label in each round, so that rounds are few."""
    both = _cut(_labels(edges)[0])
    labels = both.select("node").distinct().withColumn("root", F.col("node"))
    total = None
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("low"))
        # each round is cut: the jump reads it twice, and plans would double
        step = _cut(labels.join(near, "node").select("node", F.least("root", "low").alias("root")))
        now = step.agg(F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first()[0]
        if now == total:
            return step
        total = now
        labels = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", F.col("top").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community: each round takes the commonest label around, ties to the smallest."""
    both, nodes = _labels(edges)
    labels = nodes.withColumn("community", F.col("node"))
    for i in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
        if i % 3 == 2:
            labels = _cut(labels)
    return labels
