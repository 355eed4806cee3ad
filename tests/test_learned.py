"""Context compression against a plain walk; learned ranking against its single features, over partitions."""

import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import compression as C, ranking as L


def test_compression(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 5))
    rows = []
    for q in (1, 2, 3):
        for i in range(1 if q == 3 else 25):
            v = base[i % 6] + rng.normal(size=5) * rng.choice([0.0, 0.3, 0.8])
            rows.append((q, i, None if i == 7 else float(np.round(rng.random(), 2)), int(rng.integers(5, 60)), v.tolist() if i != 9 else None))
    df = spark.createDataFrame(rows, "query_id long, doc_id long, salience double, tokens long, vector array<double>")
    got = {}
    for r in C.compress(df.repartition(3), 300).collect():
        got.setdefault(r["query_id"], {})[r["position"]] = r
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for q in (1, 2, 3):
        own = [r for r in rows if r[0] == q and r[4] is not None]
        novelty = {r[1]: 1 - sum(cos(r[4], s[4]) for s in own if s is not r) / (len(own) - 1) if len(own) > 1 else 1.0 for r in own}
        penalty, stand = {}, []
        for r in sorted(own, key=lambda r: (-(r[2] or 0), r[1])):
            m = max((cos(r[4], s) for s in stand), default=-9)
            penalty[r[1]] = 0.8 if m > 0.85 else 0.5 if m > 0.7 else 0.2 if m > 0.55 else 0.0
            if not penalty[r[1]]:
                stand.append(r[4])
        final = {r[1]: 0.5 * (r[2] or 0) + 0.3 * novelty[r[1]] - 0.2 * penalty[r[1]] for r in own}
        taken, used = [], 0
        for r in sorted(own, key=lambda r: (-final[r[1]], r[1])):
            if used + r[3] <= 300:
                taken.append(r[1])
                used += r[3]
            if used >= 285:
                break
        mine = [got[q][p] for p in range(1, len(got[q]) + 1)]
        assert [r["doc_id"] for r in mine] == taken
        assert all(abs(r["novelty"] - novelty[r["doc_id"]]) < 1e-9 and r["redundancy"] == penalty[r["doc_id"]] and abs(r["score"] - final[r["doc_id"]]) < 1e-9 for r in mine)
    assert C.compress(df.limit(0), 300).count() == 0


def ndcg(rows, score):
    by = {}
    for r in rows:
        by.setdefault(r["q"], []).append(r)
    out = []
    for own in by.values():
        worth = lambda rs: sum((2 ** r["rel"] - 1) / np.log2(i + 2) for i, r in enumerate(rs[:10]))
        best = worth(sorted(own, key=lambda r: -r["rel"]))
        if best:
            out.append(worth(sorted(own, key=lambda r: (-score(r), r["d"]))) / best)
    return sum(out) / len(out)


def test_ranking_beats_its_features(spark):
    rng = random.Random(3)
    rows = []
    for q in range(40):
        for d in range(30):
            a, b, c = rng.random(), rng.random(), rng.random()
            truth = (a > 0.5) * 1.5 + (1 - abs(b - 0.5) * 2) + rng.gauss(0, 0.2)
            rows.append((q, d, a, b if d else None, c, min(3, max(0, int(truth * 1.3)))))
    df = spark.createDataFrame(rows, "q long, d long, a double, b double, c double, rel int")
    model = L.train(df.where("q < 25"), "q", "rel", ["a", "b", "c"], 5)
    held = model.score(df.where("q >= 25")).collect()
    best = max(ndcg(held, lambda r, f=f, s=s: s * (r[f] if r[f] is not None else 0)) for f in "abc" for s in (1, -1))
    assert ndcg(held, lambda r: r["score"]) > best + 0.02
    again = L.train(df.where("q < 25").repartition(7), "q", "rel", ["a", "b", "c"], 5)
    assert again.limits == model.limits and str(again.trees) == str(model.trees)
    assert L.train(df.limit(0), "q", "rel", ["a", "b", "c"], 1).score(df).select(F.max("score")).first()[0] == 0.0


def test_gradients_push_towards_the_better():
    g, h = L.lambdas(np.array([0.0, 1.0, 2.0]), np.array([2.0, 1.0, 0.0]))
    assert g[0] > 0 > g[2] and (h > 0).all() and abs(g.sum()) < 1e-12
    assert not L.lambdas(np.array([1.0, 2.0]), np.array([0.0, 0.0]))[0].any()
