"""Groups of near duplicates: candidates from buckets, verified, in classes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.operators import graph as G
from siltstone.operators.networks import written
from siltstone.operators.vector_index import matrix, unit

#: Vectors of one block (a task holds two), fewest blocks of a large table, and cosines that a task holds at once.
BLOCK_ROWS, BLOCKS, SCORES = 32_768, 8, 1 << 21


def grouped(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root over the links that verify(pairs a < b) keeps among rows (node, x) that share a bucket x.

    Each bucket is first checked against its smallest node, so that m copies give m pairs; what is left between the classes
    found that way is compared in full, so that no link between two of them is lost. Nodes without a link are their own root.
    """
    lead = buckets.groupBy("x").agg(F.min("node").alias("a"))
    star = buckets.join(lead, "x").where("a < node").select("a", F.col("node").alias("b")).distinct()
    links = G._cut(verify(star).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    roots = G.connected(links)
    at = buckets.join(roots, "node", "left").select("x", "node", F.coalesce("root", "node").alias("root"))
    mixed = at.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("x")
    left = at.join(mixed, "x")
    rest = left.alias("p").join(left.alias("q"), F.expr("p.x = q.x and p.node < q.node and p.root <> q.root"))
    rest = rest.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    found = verify(rest).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = G.connected(links.union(found))
    return buckets.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def band_slices(values: int, bands: int) -> list[tuple[int, int]]:
    """(first, length) of bands of nearly equal length that cover all values, from 1."""
    short, extra = divmod(values, bands)
    out, at = [], 1
    for i in range(bands):
        n = short + (i < extra)
        out.append((at, n))
        at += n
    return out


def signature_groups(signatures: DataFrame, key: str, column: str, values: int, equal: int) -> DataFrame:
    """key, leader: classes of rows with `equal` or more of `values` signature positions alike; the leader is the smallest key.

    With values - equal + 1 bands one of them must be alike in every such pair, so that no candidate is missed. Equal
    signatures are one row of the search.
    """
    s = G._cut(signatures.select(F.col(key).alias("key"), F.col(column).alias("sig")))
    one = G._cut(s.groupBy("sig").agg(F.min("key").alias("node")))
    slices = band_slices(values, values - equal + 1)
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("sig", a, n)).alias("h")) for i, (a, n) in enumerate(slices)])
    buckets = one.select("node", F.explode(bands).alias("x"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(one.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(one.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        alike = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        return both.where(alike >= equal).select("a", "b")

    roots = grouped(buckets, verify).join(one, "node").select("sig", F.col("root").alias("leader"))
    return s.join(roots, "sig").select(F.col("key").alias(key), "leader")


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest places of the classes after the links a, b."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((top := root[root]) != root).any():
            root = top


def vector_groups(vectors: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """key, leader: classes of vectors linked by a cosine of `least` or more, exact; the leader is the smallest key.

    Every two blocks of vectors meet in one task, as matrix products of slices; a task hands on one link a row at most, whatever the
    number of copies. Time is quadratic in the vectors, memory is not. Only vectors of one width are compared; null vectors, those
    with nulls inside and zeros are linked with nothing.
    """
    v = written(vectors.select(F.col(key).alias("node"), F.col(vector).alias("v")), "vectors")
    n = v.count()
    blocks = max(-(-n // BLOCK_ROWS), min(BLOCKS, n // 256 + 1))
    kind = dict(v.dtypes)["node"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        at, m = matrix(rows["v"], rows["width"][0].as_py())
        node, one = rows["node"].take(pa.array(at)), rows["one"].to_numpy()[at]
        m = unit(m)
        # rows of the first block against those of the second, or of the only one among themselves
        alone = rows["i"][0].as_py() == rows["j"][0].as_py()
        left = np.flatnonzero(one)
        right = left if alone else np.flatnonzero(~one)
        root = np.arange(len(at))
        step = max(SCORES // max(len(right), 1), 1)
        for i in range(0, len(left), step):
            own, other = left[i : i + step], right[i:] if alone else right
            a, b = np.nonzero(m[own] @ m[other].T >= least)
            root = _united(root, own[a], other[b])
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"src": node.take(pa.array(moved)), "dst": node.take(pa.array(root[moved]))})

    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    both = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = v.where(F.size("v") > 0).select("node", "v", F.size("v").alias("width"), block.alias("block"), both)
    sent = sent.select("node", "v", "width", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("one"))
    # a number of tasks is asked for: AQE would join groups of few bytes, whose work is not small
    sent = sent.repartition(min(blocks * (blocks + 1), 2_000), "width", "i", "j")
    links = sent.groupBy("width", "i", "j").applyInArrow(run, f"src {kind}, dst {kind}")
    roots = G.connected(written(links, "links"))
    return v.join(roots, "node", "left").select(F.col("node").alias(key), F.coalesce("root", "node").alias("leader"))
