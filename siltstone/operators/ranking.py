"""Learned ranking: boosted trees over binned features by pairwise gradients weighted with nDCG."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators.networks import written

#: Bins of a feature, depth of a tree, smallest sum of weights in a leaf, step, damping of leaf values.
BINS, DEPTH, LEAST, RATE, RIDGE = 32, 3, 1.0, 0.3, 1.0
#: Queries whose gradients a task makes.
QUERIES = 1_000
#: Pairs of different scores that a task holds at once.
PAIRS = 1_000_000


def lambdas(score: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, weight) of each document of one query: each pair of different relevance pulls by what swapping it would change in nDCG.

    Documents of equal score and relevance meet as sums, exactly: a pair's pull is its scores' share times a difference of discounts,
    whose sign the scores fix. A query costs the square of its different scores, PAIRS of them at once.
    """
    order = np.argsort(-score, kind="stable")
    rank = np.empty(len(score), int)
    rank[order] = np.arange(len(score))
    discount = 1 / np.log2(rank + 2)
    worth = 2.0**gain - 1
    ideal = (np.sort(worth)[::-1] / np.log2(np.arange(len(worth)) + 2)).sum()
    if ideal == 0:
        return np.zeros(len(score)), np.zeros(len(score))
    values, at = np.unique(score, return_inverse=True)
    levels, of = np.unique(gain, return_inverse=True)
    n, step = len(levels), np.subtract.outer(2.0**levels, 2.0**levels)[of] / ideal  # what each document is worth more than each level
    up, down, both = np.maximum(step, 0), np.maximum(-step, 0), np.abs(step)
    sums = np.hstack([np.bincount(at * n + of, x, len(values) * n).reshape(-1, n) for x in (np.ones(len(score)), discount)])
    far = lambda m: discount[:, None] * m[at, :n] - m[at, n:]
    pulls = [np.empty(sums.shape) for _ in range(3)]
    for own in (slice(i, i + max(PAIRS // len(values), 1)) for i in range(0, len(values), max(PAIRS // len(values), 1))):
        apart = values[own, None] - values[None, :]
        rho, sign = 1 / (1 + np.exp(np.clip(apart, -30, 30))), np.sign(apart)
        for m, share in zip(pulls, (rho, 1 - rho, rho * (1 - rho))):
            m[own] = (share * sign) @ sums
    # of equal scores, those before have the higher discounts
    each = np.zeros((len(score) + 1, 2 * n))
    each[1 + rank, of], each[1 + rank, n + of] = 1, discount
    each = each.cumsum(axis=0)
    first, last = (np.searchsorted(-score[order], -score, side) for side in ("left", "right"))
    before, after = each[rank] - each[first], each[last] - each[rank + 1]
    near = before[:, n:] - after[:, n:] - discount[:, None] * (before[:, :n] - after[:, :n])
    g = (up * (far(pulls[0]) + near / 2) - down * (far(pulls[1]) + near / 2)).sum(axis=1)
    h = (both * (far(pulls[2]) + near / 4)).sum(axis=1)
    return g, np.maximum(h, 0)


@dataclass
class Ranker:
    """Limits of the features' bins and trees of (feature, bin, left, right) nodes or leaf values."""

    features: list[str]
    limits: list[list[float]]
    trees: list = field(default_factory=list)

    def value(self, tree) -> Column:
        """What a tree gives a row: a bin above a cut is a value above the cut's limit; nulls are in bin 0."""
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        i, cut, low, high = tree
        above = F.coalesce(F.col(self.features[i]) > self.limits[i][cut], F.lit(False)) if cut < len(self.limits[i]) else F.lit(False)
        return F.when(above, self.value(high)).otherwise(self.value(low))

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with `score`, in the JVM. A column of that name is replaced."""
        total = F.lit(0.0)
        for t in self.trees:
            total = total + self.value(t)
        return rows.select(*[c for c in rows.columns if c != "score"], total.alias("score"))


def _split(histogram: dict, nodes: list[int], features: int) -> dict:
    """node -> (feature, bin) of the best cut by the sums (g, h) of each bin; ties to the first feature and bin."""
    out = {}
    for node in nodes:
        best = 1e-9
        for f in range(features):
            g, h = (np.array([histogram.get((node, f, b), (0.0, 0.0))[k] for b in range(BINS)]) for k in (0, 1))
            gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
            gain[(hl < LEAST) | (hr < LEAST)] = 0
            b = int(np.round(gain, 9).argmax())
            if round(float(gain[b]), 9) > best:
                best = round(float(gain[b]), 9)
                out[node] = (f, b)
    return out


def train(rows: DataFrame, query: str, relevance: str, features: list[str], rounds: int = 10) -> Ranker:
    """A ranker from rows of (query, relevance, features).

    Limits are quantiles. All candidates of a query lie in one row, a byte a feature, in an order that only their values fix. Each
    round, gradients are made query by query, and each level of the tree asks Spark for sums by node, feature and bin, of which a
    task sends one table and from which the driver, whatever the rows, picks the cuts. Rows of a null query or relevance are left out.
    """
    rows = rows.where(F.col(query).isNotNull() & F.col(relevance).isNotNull())
    cuts = rows.approxQuantile(features, [i / BINS for i in range(1, BINS)], 0.001) if rows.head(1) else [[] for _ in features]
    model = Ranker(features, [sorted(set(c)) for c in cuts])
    held = _packed(rows, query, relevance, model)
    lists = ", ".join(f"b{i} array<tinyint>" for i in range(len(features)))
    for _ in range(rounds):
        pulled = written(held.mapInArrow(_gradients(list(model.trees), len(features)), f"{lists}, g array<double>, h array<double>"), "gradients")
        grown: dict[int, tuple] = {}
        leaves = [1]
        for _ in range(DEPTH):
            found = _split(_sums(pulled, grown, leaves, range(len(features))), leaves, len(features))
            grown.update(found)
            leaves = [c for n in found for c in (2 * n, 2 * n + 1)]
            if not leaves:
                break
        ends = [c for n in grown for c in (2 * n, 2 * n + 1) if c not in grown] or [1]
        total = {n: (0.0, 0.0) for n in ends}
        for (n, _, _), (g, h) in sorted(_sums(pulled, grown, ends, [0]).items()):
            total[n] = (total[n][0] + g, total[n][1] + h)
        model.trees.append(_tree(grown, {n: RATE * g / (h + RIDGE) for n, (g, h) in total.items()}, 1))
    return model


def _packed(rows: DataFrame, query: str, relevance: str, model: Ranker) -> DataFrame:
    """A row for each query: gain and b0, b1, ... (bins: limits below the value; nulls are bin 0) of its candidates as lists, sorted by all of them."""
    limits = [np.array(own, float) for own in model.limits]

    def run(batches):
        for batch in batches:
            offsets, (gain, *values) = _flat(batch.column("d"))
            bins = [np.where(v.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(own, v.to_numpy(zero_copy_only=False))).astype(np.int8) for v, own in zip(values, limits)]
            gain = gain.to_numpy()
            order = np.lexsort((*bins[::-1], gain, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))))
            yield _lists(offsets, {"gain": gain[order], **{f"b{i}": b[order] for i, b in enumerate(bins)}})

    struct = F.struct(F.col(relevance).cast("double").alias("gain"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(model.features)])
    # a number of tasks is asked for: the rows are few and the work is not, so that AQE would join them into few
    tasks = rows.select(F.col(query).alias("q")).distinct().count() // QUERIES
    tasks = min(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), 2_000)
    lists = rows.select(F.col(query).alias("q"), struct.alias("d")).repartition(tasks, "q").groupBy("q").agg(F.collect_list("d").alias("d")).select("d")
    return written(lists.mapInArrow(run, "gain array<double>, " + ", ".join(f"b{i} array<tinyint>" for i in range(len(limits)))), "ranking")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, list]:
    """Where each list begins (and the last ends), and the elements; of structs, their fields."""
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    return offsets - offsets[0], flat.flatten() if pa.types.is_struct(flat.type) else [flat]


def _lists(offsets: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    at = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(v)) for v in columns.values()], list(columns))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy()


def _gradients(trees: list, features: int):
    """Bins of each query and the gradients of its candidates under the trees."""

    def value(tree, bins):
        if not isinstance(tree, tuple):
            return np.full(len(bins[0]), float(tree))
        i, cut, low, high = tree
        return np.where(bins[i] <= cut, value(low, bins), value(high, bins))

    def run(batches):
        for batch in batches:
            offsets, (gain,) = _flat(batch.column("gain"))
            gain, bins = gain.to_numpy(), [_column(batch, f"b{i}") for i in range(features)]
            score, g, h = np.zeros(len(gain)), np.zeros(len(gain)), np.zeros(len(gain))
            for t in trees:
                score += value(t, bins)
            for a, e in zip(offsets[:-1], offsets[1:]):
                g[a:e], h[a:e] = lambdas(score[a:e], gain[a:e])
            yield _lists(offsets, {**{f"b{i}": b for i, b in enumerate(bins)}, "g": g, "h": h})

    return run


def _sums(pulled: DataFrame, grown: dict, nodes: list[int], features) -> dict:
    """(node, feature, bin) -> sums of g and h over the rows that fall into one of the nodes."""
    features = list(features)

    def run(batches):
        slot = np.full(2 * max([*nodes, *grown]) + 2, -1)
        slot[nodes] = np.arange(len(nodes))
        sums = np.zeros((2, len(features), len(nodes) * BINS))
        for batch in batches:
            need = {f for f, _ in grown.values()} | set(features)
            bins = {f: _column(batch, f"b{f}") for f in need}
            at = slot[_node(grown, bins, len(bins[features[0]]))]
            for k, pull in enumerate(_column(batch, c)[at >= 0] for c in "gh"):
                for j, f in enumerate(features):
                    sums[k, j] += np.bincount(at[at >= 0] * BINS + bins[f][at >= 0], pull, sums.shape[2])
        j, cell = np.nonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(nodes)[cell // BINS], np.array(features)[j], cell % BINS, sums[0, j, cell], sums[1, j, cell])], ["node", "f", "b", "g", "h"])

    need = sorted({f for f, _ in grown.values()} | set(features))
    parts = pulled.select(*[f"b{f}" for f in need], "g", "h").mapInArrow(run, "node long, f long, b long, g double, h double")
    return {(r["node"], r["f"], r["b"]): (r["g"], r["h"]) for r in parts.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}


def _node(grown: dict, bins: dict, n: int) -> np.ndarray:
    """The number of the leaf that each row falls into: children of n are 2n and 2n + 1."""
    at = np.ones(n, int)
    for node in sorted(grown):
        f, cut = grown[node]
        hit = at == node
        at[hit] = 2 * node + (bins[f][hit] > cut)
    return at


def _tree(grown: dict, value: dict, at: int):
    if at not in grown:
        return round(value.get(at, 0.0), 12)
    f, b = grown[at]
    return (f, b, _tree(grown, value, 2 * at), _tree(grown, value, 2 * at + 1))
