"""Faults found in the fourth round: what each mended step must do, on small data."""

import tracemalloc
from datetime import datetime
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.operators import graph as G, networks as N, ranking as L, set_join as J


def _both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over the tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    return sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr), sorted(cur.fetchall(), key=repr)


def test_status_of_means_of_zero_and_of_very_large_and_fine_values(spark, tmp_path):
    early, late = datetime(2024, 1, 2), datetime(2024, 1, 20)
    rows = [
        (early, 1, "a", 0.0), (late, 1, "a", -1.0), (early, 1, "b", 0.0), (late, 1, "b", -2.0),  # falls without end
        (early, 2, "a", 0.0), (late, 2, "a", 0.0), (early, 3, "a", 0.0), (late, 3, "a", 31.0),
        (early, 4, "a", 1e-20), (late, 4, "a", 1e-21),
        *((early, 5, "a", 9e22) for _ in range(5)), (late, 5, "a", 8e22),  # a sum that no decimal holds
        (early, 6, "a", float("nan")), (late, 6, "a", 40.0), (early, 7, "a", 40.0), (late, 7, "a", float("inf")),
    ]
    got, want = _both(spark, tmp_path, "m10_status_with_degradations", events=spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string, value double"))
    assert got == want
    assert [r[2] for r in got] == [2, 0, 0, 1, 1, 0, 0]


def test_searches_change_sides_where_few_cells_are_left(monkeypatch):
    # two hubs of many leaves: from a hub or a leaf the last levels are found from the cells not yet seen
    rng = np.random.default_rng(5)
    n = 60
    ends = {(0, 1), *((0, i) for i in range(2, 30)), *((1, i) for i in range(30, 55)), *((int(a), int(b)) for a, b in rng.integers(2, n, (40, 2)) if a < b), *((i - 1, i) for i in range(55, n))}
    near = [sorted({b for a, b in ends if a == v} | {a for a, b in ends if b == v}) for v in range(n)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in near])])
    share, reached, steps = np.zeros(n), [], []
    for s in range(n):  # Brandes, one source and one node at a time
        dist, paths, queue = {s: 0}, dict.fromkeys(range(n), 0), [s]
        paths[s] = 1
        for v in queue:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                paths[w] += paths[v] * (dist[w] == dist[v] + 1)
        debt = dict.fromkeys(range(n), 0.0)
        for w in reversed(queue):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    debt[v] += paths[v] / paths[w] * (1 + debt[w])
        share += [debt[v] * (v != s) for v in range(n)]
        reached.append(len(queue) - 1)
        steps.append(sum(dist.values()))
    for at_once in (200_000, 1):  # all sources at once, one at once
        monkeypatch.setattr(N, "TASK_STEPS", at_once)
        got = N.accumulate(first, Neighbours(np.concatenate(near).astype(np.int64)), np.arange(n))
        assert np.allclose(got[0], share) and got[1].tolist() == reached and got[2].tolist() == steps
    # both runs together look at fewer links than one that looks around every cell
    assert sum(Neighbours.read) < 2 * n * first[-1] * 0.8


class Neighbours(np.ndarray):
    """A list of neighbours that counts what is read of it."""

    read: list[int] = []

    def __new__(cls, values):
        return values.view(cls)

    def take(self, at, *a, **k):
        Neighbours.read.append(len(at))
        return self.view(np.ndarray).take(at, *a, **k)

    __getitem__ = take


def test_candidates_are_all_parts_of_a_supplier(spark, tmp_path):
    # one supplier with more parts than any list held: the one part of least quantity is returned most, and is learned of
    parts = range(1, 401)
    lines = [(s, p, 1.0 if p == 400 else 50.0, 500.0 if p == 400 else 5.0, 0.0, 0.0, "R" if p == 400 else "N", "F", datetime(2024, 1, 2)) for s in range(1, 9) for p in parts for _ in range(3 if p == 400 else 1)]
    names = "l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    tables = {
        "lineitem": spark.createDataFrame(lines, names), "part": spark.createDataFrame([(p, 1, 1.0) for p in parts], "p_partkey long, p_size int, p_retailprice double"),
        "supplier": spark.createDataFrame([(s, 1.0) for s in range(1, 9)], "s_suppkey long, s_acctbal double"),
    }
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    best = catalog.QUERIES["r20_learned_ranking"](spark, str(tmp_path)).where("rank = 1").collect()
    assert sorted((r.l_suppkey, r.l_partkey, r.relevance) for r in best) == [(s, 400, 3) for s in range(1, 9)]


def test_gradients_of_many_equal_scores_hold_no_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    score, gain = rng.choice([0.1, 0.2, 0.7], 20_000), rng.integers(0, 4, 20_000).astype(float)
    tracemalloc.start()
    g, h = L.lambdas(score, gain)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20  # 400 million pairs
    tracemalloc.stop()
    assert abs(g.sum()) < 1e-9 and (h >= 0).all()
    score = rng.random(200)
    whole = L.lambdas(score, gain[:200])
    monkeypatch.setattr(L, "PAIRS", 1_000)
    assert np.allclose(whole, L.lambdas(score, gain[:200]), atol=1e-14)


def test_ranks_of_nodes_that_no_edge_enters_are_one_number(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (3, 2), (4, 3), (4, 5), (6, 5), (7, 7), (6, 5), (8, 1)]  # 5 is a sink, 4, 6 and 8 are not entered
    pairs = sorted(set(edges))
    nodes = sorted({x for e in pairs for x in e})
    out = {v: sum(a == v for a, _ in pairs) for v in nodes}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(10):
        lost = sum(want[v] for v in nodes if not out[v])
        want = {v: 0.15 / len(nodes) + 0.85 * (sum(want[a] / out[a] for a, b in pairs if b == v) + lost / len(nodes)) for v in nodes}
    kept, write = [], N.written
    monkeypatch.setattr(N, "written", lambda d, name: kept.append((name, write(d, name))) or kept[-1][1])
    got = {r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in nodes)
    inner = [d for name, d in kept if name == "edges"][1]
    assert {(r.node, r.dst) for r in inner.collect()} == {(1, 2), (2, 3), (3, 2), (7, 7)}
    assert G.pagerank(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sets_are_sent_once_to_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, brute = [], set()
    for group in range(6):  # sets that are nearly alike, and some chains between them
        base = [f"g{group}-{i}" for i in range(40)]
        rows += [(group * 20 + i, [*base[: 40 - i % 5], *(f"x{rng.integers(8)}" for _ in range(i % 4))]) for i in range(12)]
    words = {i: set(w) for i, w in rows}
    for a in words:
        for b in words:
            if a < b and words[a] != words[b] and 10 * len(words[a] & words[b]) >= 7 * len(words[a] | words[b]):
                brute.add((a, b))
    sets = J.written_sets(J.word_sets(spark.createDataFrame(rows, "id long, w array<string>"), "id", F.col("w")))
    ids = {r.id for r in sets.collect()}
    want = {(a, b): round(len(words[a] & words[b]) / len(words[a] | words[b]), 6) for a, b in brute if {a, b} <= ids}
    monkeypatch.setattr(J, "PAIRS_SENT", 0)
    made, cut = [], J.cells
    monkeypatch.setattr(J, "cells", lambda *a: made.append(cut(*a)) or made[-1])
    got = {(r.a, r.b): r.sim for r in J.similar_sets(sets, Fraction(7, 10)).collect()}
    assert got == want and len(want) > 100
    assert made[0][1].count() == len({x for p in want for x in p})  # all of a group in one cell
    monkeypatch.setattr(J, "CELL_WORDS", 100)  # several blocks a cell
    assert {(r.a, r.b): r.sim for r in J.similar_sets(sets, Fraction(7, 10)).collect()} == want
