"""Shortest-path centralities and communities of undirected graphs, in rounds that each end at files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.operators import graph as G
from siltstone.sources.writers import shared_path

#: (source, node) rows of one batch of sources: what a level can hold at most.
BATCH_PAIRS = 20_000_000
#: Edges (both directions) of a connected part that one task searches, and (source, edge) steps that it holds at once.
TASK_EDGES, TASK_STEPS = 4_000_000, 200_000
#: (source, edge) steps of one task, and the most tasks that a part's edges are sent to.
TASK_WORK, SLICES = 50_000_000, 64


def written(df: DataFrame, name: str) -> DataFrame:
    """df from files in the shared folder, so that plans do not grow and a lost executor costs one round."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst in both directions, once each, without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def _levels(both: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """s, node, paths: the nodes at each distance from each source with their numbers of shortest paths, level by level.

    A neighbour lies one level up, on the same one or one down, so that a new level is compared with two others only.
    """
    out = [written(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")), "level")]
    while True:
        step = out[-1].join(both, F.col("node") == F.col("src")).groupBy("s", "dst").agg(F.sum("paths").alias("paths")).withColumnRenamed("dst", "node")
        for old in out[-2:]:
            step = step.join(old.select("s", "node"), ["s", "node"], "left_anti")
        step = written(step.select("s", "node", "paths"), "level")
        if step.isEmpty():
            return out
        out.append(step)


def _batches(both: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """The sources in batches, by the nodes that a search can reach at most."""
    n = both.select("src").distinct().count()
    count = max(-(-n * sources.count() // BATCH_PAIRS), 1)
    return [sources.where(F.pmod(F.xxhash64("node"), F.lit(count)) == i) for i in range(count)]


def _joined(both: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Tables of node, share, reached, steps: Brandes' accumulation by joins, batch by batch of the sources, level by level."""
    out = []
    for batch in _batches(both, sources):
        levels = _levels(both, batch)
        distance = None
        for d, level in enumerate(levels):
            own = level.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.lit(d).cast("long").alias("d"))
            distance = own if distance is None else distance.union(own)
        close = distance.groupBy("s").agg((F.sum("n") - 1).alias("reached"), F.sum(F.col("n") * F.col("d")).alias("steps"))
        out.append(close.select(F.col("s").alias("node"), F.lit(0.0).alias("share"), "reached", "steps"))
        debt = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("share"))
        for level in reversed(levels[:-1]):
            owed = debt.select("s", F.col("node").alias("dst"), ((1 + F.col("share")) / F.col("paths")).alias("per")).join(both, "dst")
            got = owed.groupBy("s", F.col("src").alias("node")).agg(F.sum("per").alias("per"))
            debt = written(level.join(got, ["s", "node"], "left").select("s", "node", "paths", (F.col("paths") * F.coalesce("per", F.lit(0.0))).alias("share")), "share")
            part = debt.where("s <> node").groupBy("node").agg(F.sum("share").alias("share"))
            out.append(part.select("node", "share", F.lit(None).cast("long").alias("reached"), F.lit(None).cast("long").alias("steps")))
    return out


def accumulate(first: np.ndarray, near: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of each node, reached and steps of each source) of the graph whose node v has the neighbours near[first[v]:first[v + 1]].

    A block of sources is searched in step; cell s * n + v stands for the node v as the source s sees it. A level is found from the
    one before or, where that has fewer edges, from the cells not yet seen; its links are places (row, col) in both levels.
    """
    n, degree = len(first) - 1, np.diff(first)
    share, reached, steps = np.zeros(n), [], []
    block = max(TASK_STEPS // max(len(near), 1), 1)

    def around(cells):
        v = cells % n
        d = degree.take(v)
        ends = d.cumsum()
        row = np.arange(len(v)).repeat(d)
        other = near.take(np.arange(len(row)) + (first.take(v) - ends + d).take(row))
        return row, other + (cells - v).take(row)

    for own in (sources[i : i + block] for i in range(0, len(sources), block)):
        fresh, here, place = np.ones(len(own) * n, bool), np.zeros(len(own) * n, bool), np.empty(len(own) * n, np.int64)
        front, paths, links = np.arange(len(own)) * n + own, np.ones(len(own)), []
        fresh[front], here[front], place[front] = False, True, np.arange(len(own))
        left = len(own) * len(near) - degree.take(own).sum()
        found, far = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        while True:
            v = front % n
            if degree.take(v).sum() <= left:
                row, head = around(front)
                new = np.flatnonzero(fresh.take(head))
                row, head = row.take(new), head.take(new)
            else:
                unseen = np.flatnonzero(fresh)
                head, tail = around(unseen)
                new = np.flatnonzero(here.take(tail))
                row, head = place.take(tail.take(new)), unseen.take(head.take(new))
            here = np.zeros(len(fresh), bool)
            here[head] = True
            front = np.flatnonzero(here)  # each new cell once
            if not len(front):
                break
            fresh[front], place[front] = False, np.arange(len(front))
            left -= degree.take(front % n).sum()
            col = place.take(head)
            links.append((v, paths, row, col))
            paths = np.bincount(col, paths.take(row), len(front))
            count = np.bincount(front // n, minlength=len(own))
            found += count
            far += count * len(links)
        debt = np.zeros(len(paths))
        for d in range(len(links) - 1, -1, -1):
            v, before, row, col = links[d]
            debt = before * np.bincount(row, ((1 + debt) / paths).take(col), len(v))
            paths = before
            if d:  # a source owes itself nothing
                share += np.bincount(v, debt, n)
        reached.append(found)
        steps.append(far)
    none = np.zeros(0, np.int64)
    return share, np.concatenate([none, *reached]), np.concatenate([none, *steps])


def _search(rows: pa.Table) -> pa.Table:
    """node, share, reached, steps of one group: edges (src, dst) and the sources (dst null) that are searched over them."""
    src, dst = rows["src"].to_numpy(), rows["dst"]
    edge = dst.is_valid().to_numpy()
    nodes, a = np.unique(src[edge], return_inverse=True)
    b = np.searchsorted(nodes, dst.drop_null().to_numpy())
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(nodes)))])
    sources = np.searchsorted(nodes, np.sort(src[~edge]))
    share, reached, steps = accumulate(first, b[np.lexsort((b, a))], sources)
    of = lambda values: pa.array(np.concatenate([values, np.zeros(len(nodes), np.int64)]), pa.int64(), mask=np.arange(len(values) + len(nodes)) >= len(values))
    return pa.table({
        "node": pa.array(np.concatenate([nodes[sources], nodes]), rows["src"].type), "share": pa.array(np.concatenate([np.zeros(len(sources)), share])), "reached": of(reached), "steps": of(steps),
    })


def _by_parts(both: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Tables of node, share, reached, steps over all connected parts of the graph.

    The sources of a part are dealt to slices of about equal work, and each slice gets the part's edges by shuffle; a part of more
    than TASK_EDGES edges fits no task and is searched by joins.
    """
    roots = written(G.connected(both), "parts")
    at = written(both.join(roots.withColumnRenamed("node", "src"), "src"), "parts")
    wanted = written(sources.join(roots, "node"), "parts")
    work = at.groupBy("root").agg(F.count(F.lit(1)).alias("m")).join(wanted.groupBy("root").agg(F.count(F.lit(1)).alias("k")), "root")
    work = written(work.select("root", "m", F.least(F.ceil(F.col("k") * F.col("m") / TASK_WORK), "k", F.lit(SLICES)).cast("int").alias("slices")), "parts")
    small = work.where(F.col("m") <= TASK_EDGES).select("root", "slices")
    out = []
    if tasks := small.agg(F.sum("slices")).first()[0]:
        null = F.lit(None).cast(dict(both.dtypes)["dst"])
        edges = at.join(small, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "src", "dst")
        own = wanted.join(small, "root").select("root", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"), F.col("node").alias("src"), null.alias("dst"))
        # a number of tasks is asked for: the rows are few and the work is not, so that AQE would join them into one
        rows = edges.union(own).repartition(min(max(2 * tasks, 1), 2_000), "root", "slice")
        kind = dict(both.dtypes)["src"]
        out.append(written(rows.groupBy("root", "slice").applyInArrow(_search, f"node {kind}, share double, reached long, steps long"), "shares"))
    large = written(work.where(F.col("m") > TASK_EDGES).select("root"), "parts")
    if not large.isEmpty():
        out += _joined(written(at.join(large, "root").select("src", "dst"), "edges"), written(wanted.join(large, "root").select("node"), "sources"))
    return out


def path_centralities(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, betweenness, closeness of every node that an edge names, exact over all sources.

    Brandes' accumulation: a breadth-first search from a batch of sources counts shortest paths level by level, then each
    level hands its dependencies to the one before. Betweenness is divided by (n - 1)(n - 2); closeness counts the part of
    the graph that a node reaches. `sources` (node) takes searches from those only and scales betweenness up (an estimate);
    closeness is then that of the sources, null elsewhere. A graph of one or two nodes has betweenness 0.
    """
    both = written(undirected(edges), "edges")
    nodes = both.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    wanted = written(nodes if sources is None else nodes.join(sources.select("node"), "node", "left_semi"), "sources")
    asked = wanted.count()
    every = nodes.select("node", F.lit(0.0).alias("share"), F.lit(None).cast("long").alias("reached"), F.lit(None).cast("long").alias("steps"))
    for part in _by_parts(both, wanted):
        every = every.union(part)
    scale = n / asked / ((n - 1) * (n - 2)) if n > 2 and asked else 0.0
    closeness = F.col("reached") / F.nullif("steps", F.lit(0)) * F.col("reached") / (n - 1)
    total = every.groupBy("node").agg(F.sum("share").alias("share"), F.max("reached").alias("reached"), F.max("steps").alias("steps"))
    return total.select("node", (F.col("share") * scale).alias("betweenness"), closeness.alias("closeness"))


def _shuffled(df: DataFrame) -> DataFrame:
    """A table of nodes for joins that are made again each turn: it is not sent through the driver, however small it looks."""
    return df.hint("merge")


def _modularity(weights: DataFrame, labels: DataFrame, total: int) -> float:
    """Of weighted edges (a, b, w in both directions, loops once) under labels (node, c)."""
    at = weights.join(_shuffled(labels.select(F.col("node").alias("a"), F.col("c").alias("ca"))), "a").join(_shuffled(labels.select(F.col("node").alias("b"), F.col("c").alias("cb"))), "b")
    by = at.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("all"))
    return by.agg(F.sum(F.col("inside") / total - (F.col("all") / total) ** 2)).first()[0] or 0.0


def _move(weights: DataFrame, labels: DataFrame, degrees: DataFrame, total: int, turn: int) -> DataFrame:
    """Labels after the nodes of one half have moved to the neighbouring community of the highest gain, ties to the smallest.

    Gains are whole numbers, so that results do not hang on the order of sums. Only half of the nodes move in a turn: neighbours
    that would swap their communities for ever seldom both do.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    near = weights.where("a <> b").join(_shuffled(labels.select(F.col("node").alias("b"), "c")), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
    sums = labels.join(_shuffled(degrees), "node").groupBy("c").agg(F.sum("k").alias("all"))
    own = labels.join(_shuffled(degrees), "node").where(F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2).select("node", F.col("c").alias("own"), "k")
    open_ = near.join(_shuffled(own), "node").join(_shuffled(sums), "c")
    stays = F.col("c") == F.col("own")
    gain = whole("w") * F.lit(total).cast("decimal(38,0)") - whole("k") * (whole("all") - F.when(stays, whole("k")).otherwise(F.lit(0).cast("decimal(38,0)")))
    best = open_.select("node", "c", "own", gain.cast("decimal(38,0)").alias("gain"), stays.alias("stays"), "k")
    first = F.min_by("c", F.struct((-F.col("gain")).alias("gain"), F.col("c").alias("c")))
    picked = best.groupBy("node").agg(first.alias("best"), F.max("gain").alias("top"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"), F.min("own").alias("own"), F.min("k").alias("k"))
    # a node without a link into its own community loses its own weight there by staying
    lone = -(whole("k") * (whole("all") - whole("k"))).cast("decimal(38,0)")
    moved = picked.join(_shuffled(sums.withColumnRenamed("c", "own")), "own").where(F.col("top") > F.coalesce("stay", lone)).select("node", "best")
    return labels.join(_shuffled(moved), "node", "left").select("node", F.coalesce("best", "c").alias("c"))


def louvain(edges: DataFrame, tolerance: float = 1e-3, turns: int = 12, passes: int = 12) -> DataFrame:
    """node, community (its smallest node): modularity moves until the gain ends, then again over the communities as nodes.

    A turn moves one half of the nodes, then the other, each written; a turn that raises modularity by less than the tolerance is
    undone and ends the pass. Weights are numbers of edges.
    """
    weights = written(undirected(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("w")), "weights")
    total = weights.agg(F.sum("w")).first()[0]
    found = weights.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community"))
    if not total:
        return found
    best = None
    for _ in range(passes):
        degrees = written(weights.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "degrees")
        labels = degrees.select("node", F.col("node").alias("c"))
        began = score = _modularity(weights, labels, total) if best is None else best
        for turn in range(turns):
            half = written(_move(weights, labels, degrees, total, 2 * turn), "labels")
            step = written(_move(weights, half, degrees, total, 2 * turn + 1), "labels")
            now = _modularity(weights, step, total)
            if now <= score + tolerance:
                break
            labels, score = step, now
        best = score
        if score <= began + tolerance:
            break
        # communities by their smallest node, as the nodes of the next pass
        name = labels.groupBy("c").agg(F.min("node").alias("low"))
        labels = written(labels.join(_shuffled(name), "c").select("node", F.col("low").alias("c")), "labels")
        found = written(found.join(_shuffled(labels.select(F.col("node").alias("community"), "c")), "community").select("node", F.col("c").alias("community")), "communities")
        a, b = (_shuffled(labels.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"))) for x in "ab")
        weights = written(weights.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "weights")
    return found


def community_strengths(edges: DataFrame, communities: DataFrame, least: int = 3) -> DataFrame:
    """community, size, inside, outside, strength = inside / (inside + outside + 1) of communities with `least` nodes or more."""
    both = undirected(edges).where("src < dst")
    a, b = (_shuffled(communities.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}"))) for x in ("src", "dst"))
    ends = both.join(a, "src").join(b, "dst").select(F.explode(F.array_distinct(F.array("c_src", "c_dst"))).alias("community"), (F.col("c_src") == F.col("c_dst")).alias("same"))
    links = ends.groupBy("community").agg(F.count_if("same").alias("inside"), F.count_if(~F.col("same")).alias("outside"))
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return sizes.join(_shuffled(links), "community").select("community", "size", "inside", "outside", F.round(F.col("inside") / (F.col("inside") + F.col("outside") + 1), 6).alias("strength"))
