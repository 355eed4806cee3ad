"""Vector index, set joins, sparse retrieval, centralities, communities and versions against brute force."""

import difflib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import networks as N, set_join as J, sparse as S, vector_index as I, versions as V

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    I.build(v.where("vec_id < 300"), "vec_id", "embedding", path)
    I.add(v.where("vec_id >= 300"), "vec_id", "embedding", path)
    return path


def asked(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_index_recall_and_exactness(spark, index):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = {(r["query_id"], r["key"], r["score"]) for r in I.exact(v, asked(spark), "vec_id", "embedding", 10).collect()}
    assert len(want) == 100
    assert {(r["query_id"], r["key"], r["score"]) for r in I.search(spark, index, asked(spark), 10).collect()} == want
    cells = len(I.read_cells(spark, index))
    got = {(r["query_id"], r["key"], r["score"]) for r in I.search(spark, index, asked(spark), 10, probes=cells * 3 // 4).collect()}
    assert len(got & want) >= 90


def test_index_reads_probed_cells_only(spark, index):
    one = asked(spark).where("query_id = 0")
    found = I.search(spark, index, one, 3, probes=2)
    cells = {int(f.split("cell=")[1].split("/")[0]) for f in found.inputFiles()}
    assert len(cells) > 2  # the files of the table
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = spark.read.parquet(f"{index}/vectors")
    q = np.array(one.first()["q"])
    near = np.argsort(-(I.unit(q[None]) @ I.read_cells(spark, index).T)[0])[:2].tolist()
    assert {r["key"] for r in found.collect()} <= {r["key"] for r in read.where(F.col("cell").isin(near)).collect()}


def test_index_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [0.0, 2.0]), (7, [1.0, 2.0, 3.0]), (None, [2.0, 0.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows[:1] + rows[3:4] + rows[5:6], "k long, v array<double>")
    I.build(v, "k", "v", str(tmp_path / "i"), cells=2)
    I.add(spark.createDataFrame(rows[1:3] + rows[4:5] + rows[6:], "k long, v array<double>"), "k", "v", str(tmp_path / "i"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, q array<double>")
    got = [(r["query_id"], r["key"], r["score"]) for r in I.search(spark, str(tmp_path / "i"), q, 5).orderBy("rank").collect()]
    assert got == [(1, None, 1.0), (1, 1, 1.0), (1, 1, 1.0), (1, 6, 0.0)]
    assert I.search(spark, str(tmp_path / "i"), q.limit(0), 5).count() == 0


@pytest.mark.parametrize("least", [Fraction(7, 10), Fraction(1, 2), Fraction(3, 10)])
def test_set_join_against_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    vocab = [f"w{int(rng.expovariate(0.08))}" for _ in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 20, 40]))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(" ".join(w if rng.random() > 0.15 else rng.choice(vocab) for w in base))
    texts += ["", None, texts[0], texts[0], "the the the"]
    rows = [(i, t, rng.choice("ab") if i % 7 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, t string, g string")
    sets = J.written_sets(J.word_sets(df, "k", F.filter(F.split("t", " "), lambda w: w != ""), ["g"]))
    classes = {}
    for i, t, g in rows:
        s = frozenset(w for w in (t or "").split(" ") if w)
        if s:
            classes.setdefault((g, s), []).append(i)
    assert {(r["id"], r["members"], r["size"]) for r in sets.collect()} == {(min(v), len(v), len(s)) for (_, s), v in classes.items()}
    want = {}
    for ((g, s), v), ((h, u), w) in itertools.combinations(classes.items(), 2):
        sim = Fraction(len(s & u), len(s | u))
        if sim >= least:
            want[tuple(sorted((min(v), min(w))))] = (round(float(sim), 6), g != h)
    assert {(r["a"], r["b"]): r["sim"] for r in J.similar_sets(sets, least).collect()} == {k: v[0] for k, v in want.items()}
    other = ~F.col("a_g").eqNullSafe(F.col("b_g"))
    assert {(r["a"], r["b"]) for r in J.similar_sets(sets, least, condition=other, carried=["g"]).collect()} == {k for k, v in want.items() if v[1]}
    best = [(r["a"], r["b"]) for r in J.most_similar(sets, least, 5).collect()]
    above = sorted((-v[0], k) for k, v in want.items() if v[0] > least)
    assert best == [k for _, k in above[:5]]


def test_sparse_search_against_all_scores(spark):
    rng = random.Random(4)
    vocab = [f"term{int(rng.expovariate(0.05))}" for _ in range(500)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(120)] + [(120, ""), (121, None), (122, "the of")]
    asks = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 12])))) for i in range(25)] + [(90, "nothing known"), (91, None)]
    d, q = spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(asks, "k long, t string")
    terms = S.vocabulary(d, "t", 300)

    def grams(t):
        w = [x for x in (t or "").lower().split() if len(x) > 1 and x not in S.STOP]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    cf, df = {}, {}
    for _, t in docs:
        for g in grams(t):
            cf[g] = cf.get(g, 0) + 1
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    kept = sorted(cf, key=lambda g: (-cf[g], g))[:300]
    idf = {g: math.log((1 + len(docs)) / (1 + df[g])) + 1 for g in kept}
    assert {r["term"]: round(r["idf"], 9) for r in terms.collect()} == {g: round(x, 9) for g, x in idf.items()}

    def vector(t):
        v = {}
        for g in grams(t):
            if g in idf:
                v[g] = v.get(g, 0) + idf[g]
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / n for g, x in v.items()}

    dv = {k: vector(t) for k, t in docs}
    index = N.written(S.postings(d, "k", "t", terms), "postings")
    for k in (1, 4, 500):
        want = set()
        for i, t in asks:
            v = vector(t)
            s = sorted((-round(sum(x * dv[j].get(g, 0) for g, x in v.items()), 6), j) for j in dv)
            want |= {(i, j, -x) for x, j in s[:k] if x < 0}
        got = {(r["query_id"], r["key"], r["score"]) for r in S.search(index, S.postings(q, "k", "t", terms), k).collect()}
        assert got == want
    groups = d.select(F.col("k").alias("key"), F.when(F.col("k") % 2 == 0, "x").otherwise("y").alias("group"))
    sims = [sum(x * dv[j].get(g, 0) for g, x in dv[i].items()) for i in range(0, 123, 2) for j in range(1, 123, 2)]
    assert S.mean_similarity(index, groups).first()["sim"] == pytest.approx(sum(sims) / len(sims), abs=1e-6)


def brute_paths(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    nodes = sorted(set(near) | {x for e in edges for x in e if e[0] != e[1]})
    dist, paths = {}, {}
    for s in nodes:
        dist[s], paths[s], front = {s: 0}, {s: 1}, [s]
        while front:
            new = {}
            for v in front:
                for w in near.get(v, ()):
                    if w not in dist[s]:
                        new[w] = new.get(w, 0) + paths[s][v]
            for w, p in new.items():
                dist[s][w], paths[s][w] = dist[s][front[0]] + 1, p
            front = list(new)
    n, out = len(nodes), {}
    for v in nodes:
        total = 0.0
        for s, t in itertools.permutations(nodes, 2):
            if v not in (s, t) and t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                total += paths[s][v] * paths[v][t] / paths[s][t]
        d = sum(dist[v].values())
        r = len(dist[v]) - 1
        out[v] = (total / ((n - 1) * (n - 2)) if n > 2 else 0.0, r / d * r / (n - 1) if d else None)
    return out


def test_path_centralities(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(22)] + [(20, 21), (21, 22), (22, 23), (23, 20), (30, 31), (5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = brute_paths(edges)
    got = {r["node"]: (r["betweenness"], r["closeness"]) for r in N.path_centralities(df).collect()}
    assert set(got) == set(want)
    for v in want:
        assert got[v] == (pytest.approx(want[v][0], abs=1e-12), pytest.approx(want[v][1], abs=1e-12))
    # all sources in several batches give the same
    whole, N.BATCH_PAIRS = N.BATCH_PAIRS, 150
    try:
        again = {r["node"]: r["betweenness"] for r in N.path_centralities(df).collect()}
    finally:
        N.BATCH_PAIRS = whole
    assert all(again[v] == pytest.approx(want[v][0], abs=1e-12) for v in want)
    assert N.path_centralities(df.limit(0)).count() == 0


def modularity(edges, label):
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    m = len(pairs)
    deg, inside = {}, {}
    for a, b in pairs:
        for x in (a, b):
            deg[label[x]] = deg.get(label[x], 0) + 1
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + 1
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in deg.items())


def greedy(edges):
    """Local moves of single nodes until none raises modularity."""
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    label = {v: v for v in nodes}
    best, moved = modularity(edges, label), True
    while moved:
        moved = False
        for v in nodes:
            for c in sorted({label[w] for e in edges if v in e for w in e}):
                old, label[v] = label[v], c
                now = modularity(edges, label)
                if now > best + 1e-12:
                    best, moved = now, True
                else:
                    label[v] = old
    return best


def test_louvain(spark):
    rng = random.Random(7)
    edges = [(g * 10 + a, g * 10 + b) for g in range(4) for a in range(10) for b in range(a) if rng.random() < 0.6]
    edges += [(rng.randrange(40), rng.randrange(40)) for _ in range(12)] + [(90, 91), (3, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    label = {r["node"]: r["community"] for r in N.louvain(df).collect()}
    assert set(label) == {x for e in edges for x in e if e[0] != e[1]}
    assert all(c == min(v for v in label if label[v] == c) for c in label.values())
    assert modularity(edges, label) >= greedy(edges) - 0.005
    assert label == {r["node"]: r["community"] for r in N.louvain(df.repartition(7)).collect()}
    communities = spark.createDataFrame(list(label.items()), "node long, community long")
    for r in N.community_strengths(df, communities).collect():
        own = {v for v in label if label[v] == r["community"]}
        pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
        inside, outside = sum(a in own and b in own for a, b in pairs), sum((a in own) != (b in own) for a, b in pairs)
        assert len(own) >= 3 and (r["size"], r["inside"], r["outside"]) == (len(own), inside, outside)
        assert r["strength"] == round(inside / (inside + outside + 1), 6)
    assert N.louvain(df.limit(0)).count() == 0


def test_blocks_equal_another_implementation():
    rng = random.Random(1)
    cases = [([], []), ([1], []), (["a"] * 50, ["a"] * 31), (list("abcabcabc"), list("bcabca"))]
    for _ in range(150):
        high = rng.choice([2, 4, 30])
        a = [rng.randrange(high) for _ in range(rng.randrange(60))]
        b = a[: rng.randrange(len(a) + 1)] + [rng.randrange(high) for _ in range(rng.randrange(40))] + a[rng.randrange(len(a) + 1) :]
        cases.append((a, b))
    long = [rng.randrange(3000) for _ in range(4000)]
    cases.append((long, [x for x in long if rng.random() < 0.9]))
    for a, b in cases:
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        share, added, gone, lines = V.changes(a, b)
        assert share == pytest.approx(m.ratio(), abs=1e-12)
        codes = [c for c in m.get_opcodes() if c[0] != "equal"]
        assert added == sum(c[4] - c[3] for c in codes) and gone == sum(c[2] - c[1] for c in codes)
        text = lambda x: [f"{v}\n" for v in x]
        if max(len(a), len(b)) < 200:  # beyond, the other one leaves popular lines out
            assert lines == len(list(difflib.unified_diff(text(a), text(b))))


def test_repeated_lines_take_linear_time():
    assert V.changes(["x"] * 30_000, ["x"] * 29_000)[1:3] == (0, 1000)


def test_successive_versions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, f"line {i % 5}\nsame\n{rng.randrange(3)}" if i % 11 else None, "z") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, text string, n string").repartition(6)
    by = {}
    for k, at, text, _ in rows:
        by.setdefault(k, []).append((at, text))
    want = {(k, at): (i + 1, text, v[i - 1][1] if i else None) for k, v in by.items() for i, (at, text) in enumerate(v)}
    got = {(r["k"], r["at"]): (r["n"], r["text"], r["before"]) for r in V.successive(df, "k", "at", "text").collect()}
    assert got == want
    step = F.greatest(F.floor(F.col("total") / 10), F.lit(1))
    sampled = {(r["k"], r["at"], r["before"]) for r in V.successive(df, "k", "at", "text", step).collect()}
    expect = set()
    for k, v in by.items():
        taken = v[:: max(len(v) // 10, 1)]
        expect |= {(k, at, taken[i - 1][1] if i else None) for i, (at, _) in enumerate(taken)}
    assert sampled == expect
    for r in V.with_changes(V.successive(df, "k", "at", "text"), "text", "before").collect():
        if r["text"] is None or r["before"] is None:
            assert r["ratio"] is None and r["kind"] is None
        else:
            m = difflib.SequenceMatcher(None, r["before"].split("\n"), r["text"].split("\n"), autojunk=False)
            assert r["ratio"] == pytest.approx(m.ratio())
