"""Operators that SQL does not express, against brute force."""

import random

import numpy as np

from siltstone.operators import chunking, graph as G, relational as R, retrieval as V


def test_mmr(spark):
    rng = np.random.default_rng(3)
    vectors, relevance = rng.normal(size=(12, 4)), rng.random(12)
    rows = [(q, i, float(relevance[i]), vectors[i].tolist()) for q in (1, 2) for i in range(12)]
    got = {}
    for r in V.mmr(spark.createDataFrame(rows, "query_id long, doc_id long, relevance double, vector array<double>"), 6).collect():
        got.setdefault(r.query_id, {})[r.position] = r.doc_id
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    taken = []
    for _ in range(6):
        def worth(i, taken=taken):
            near = max(((unit[i] @ unit[j] + 1) / 2 for j in taken), default=0.0)
            return 0.7 * (relevance[i] + 1) / 2 - 0.3 * near

        taken.append(max((i for i in range(12) if i not in taken), key=worth))
    assert [got[1][p] for p in range(1, 7)] == taken and got[1] == got[2]


def test_sentence_chunks(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(99)}" + (rng.choice(".!?") if rng.random() < 0.1 else "") for _ in range(n)) for n in (0, 1, 40, 700, 2000)]
    rows = chunking.sentence_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 100, 10).collect()
    for i, text in enumerate(texts):
        words = [r.chunk.split() for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_index)]
        assert all(0 < len(w) <= 100 for w in words)
        joined = []
        for w in words:
            assert not joined or joined[-10:] == w[:10]
            joined += w[10:] if joined else w
        assert joined == text.split()


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "src long, dst long")
    assert {r.node: r.root for r in G.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert {r.node: r.hops for r in G.reach(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_nearest_on_one_key(spark):
    rng = random.Random(5)
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    left, right = [(1, i, rng.randrange(80_000)) for i in range(300)], [(1, i, rng.randrange(80_000)) for i in range(200)]
    a = spark.createDataFrame([(k, i, at(s)) for k, i, s in left], "k int, a int, s string").selectExpr("k", "a", "cast(s as timestamp_ntz) as t")
    b = spark.createDataFrame([(k, i, at(s)) for k, i, s in right], "k int, b int, s string").selectExpr("k", "b", "cast(s as timestamp_ntz) as u")
    got = {r.a: r.gap for r in R.nearest(a, b, ["k"], "t", "u", ["b"]).selectExpr("a", "abs(unix_micros(cast(t as timestamp)) - unix_micros(cast(match.ts as timestamp))) as gap").collect()}
    assert got == {i: min(abs(s - u) for _, _, u in right) * 1_000_000 for _, i, s in left}
    assert R.nearest(a, b.limit(0), ["k"], "t", "u", ["b"]).where("match is not null").count() == 0


def test_greedy_budget_and_stack(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.randrange(1, 60), "x") for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, cost long, note string")
    got = {(r.k, r.i) for r in R.greedy_budget(df, ["k"], "i", "cost", 500).collect()}
    want = set()
    for k in range(3):
        used = 0
        for kk, i, c, _ in rows:
            if kk == k and used + c <= 500:
                used += c
                want.add((k, i))
    assert got == want
    parents = {(r.k, r.i): r.parent for r in R.nearest_lower(df, "k", "i", "cost").collect()}
    costs = {(k, i): c for k, i, c, _ in rows}
    assert parents == {(k, i): max((j for j in range(i) if costs[k, j] < costs[k, i]), default=None) for k, i in costs}


def test_signature_groups_against_all_pairs(spark):
    """Chains, a crowd around one signature and equal signatures: no link between two classes is lost."""
    import numpy as np

    from siltstone.operators import duplicates as D

    rng = np.random.RandomState(3)
    base = rng.randint(0, 1 << 30, (12, 16))
    rows = []
    for b in base:
        cur = b.copy()
        for _ in range(rng.randint(1, 9)):  # each differs from the one before in up to three places
            cur = cur.copy()
            cur[rng.choice(16, rng.randint(0, 4), replace=False)] = rng.randint(0, 1 << 30)
            rows.append(cur)
    order = rng.permutation(len(rows))
    sig = [rows[i].tolist() for i in order]
    parent = list(range(len(sig)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sig)):
        for j in range(i):
            if sum(x == y for x, y in zip(sig[i], sig[j])) >= 13:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sig)], "k long, sig array<long>")
    got = {r["k"]: r["leader"] for r in D.signature_groups(df, "k", "sig", 16, 13).collect()}
    assert got == {i: root(i) for i in range(len(sig))}
    assert D.signature_groups(df.limit(0), "k", "sig", 16, 13).count() == 0


def test_chunks_and_matches_on_odd_texts(spark):
    from siltstone.operators import chunking as C

    texts = [(1, None), (2, ""), (3, "a"), (4, "word " * 500), (5, "x" * 1000), (6, "a@b.cc tail\nc.d@e.org")]
    df = spark.createDataFrame(texts, "k long, text string")
    for size, overlap in ((10, 3), (100, 20)):
        parts = {}
        for r in C.split_at(df, "k", "text", size, overlap, ["\n", " "]).orderBy("k", "chunk_index").collect():
            parts.setdefault(r["k"], []).append(r["chunk"])
        assert set(parts) == {3, 4, 5, 6}
        for k, text in texts[2:]:
            assert all(0 < len(c) <= size for c in parts[k])
            # each chunk begins with the end of the one before
            whole = parts[k][0]
            for c in parts[k][1:]:
                whole += c[overlap:]
            assert whole == text
    found = C.matches(df, "k", "text", r"[\w.]+@[\w.]+", 3).orderBy("start").collect()
    assert [(r["entity"], r["start"], r["end"], r["context"]) for r in found] == [("a@b.cc", 0, 6, "a@b.cc ta"), ("c.d@e.org", 12, 21, "il\nc.d@e.org")]
    assert {r["k"] for r in C.merged_paragraphs(df, "k", "text").collect()} == {3, 4, 5, 6}
