"""Faults found on larger tables: what each mended step must do, on small data."""

from datetime import datetime
from fractions import Fraction
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.functions import text as X
from siltstone.functions.patterns import FLAGS, HELD, IDENTIFIERS
from siltstone.operators import chunking as C, duplicates as D, matching as M, networks as N, ranking as L, relational as R, set_join as J, sparse as S, vector_index as I
from siltstone.plans import statements as T
from siltstone.sources import keyed_table as K, writers


def _sets(spark, rows):
    d = spark.createDataFrame(rows, "id long, w array<string>")
    return J.written_sets(J.word_sets(d, "id", F.col("w")))


def test_most_similar_stops_at_the_highest_step(spark, monkeypatch):
    common = [f"w{i}" for i in range(200)]
    sets = _sets(spark, [(i, [*common, f"x{i}"]) for i in range(6)] + [(10 + i, [*common[:185], *(f"y{i}-{j}" for j in range(4))]) for i in range(6)])
    asked, search = [], J.similar_sets

    def seen(sets, least, *a, **k):
        asked.append(least)
        return search(sets, least, *a, **k)

    monkeypatch.setattr(J, "similar_sets", seen)
    got = J.most_similar(sets, Fraction(3, 10), 10).collect()
    assert asked == [Fraction(99, 100)]
    assert [(r.a, r.b) for r in got] == [(a, b) for a in range(6) for b in range(a + 1, 6)][:10]


def test_most_similar_does_not_trust_ties_at_a_step(spark):
    # 7/10 exactly twice; one pair lies at the threshold and must not end the search before those below are seen
    sets = _sets(spark, [(1, list("abcdefg")), (2, list("abcdefghij")), (3, list("ABCDEFG")), (4, list("ABCDEFGHIJ")), (5, list("klmnop")), (6, list("klmnopqr"))])
    got = J.most_similar(sets, Fraction(3, 10), 2, steps=("7/10",)).collect()
    assert [(r.a, r.b, r.sim) for r in got] == [(5, 6, 0.75), (1, 2, 0.7)]


def _run(spark, tmp_path, name, **tables):
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return catalog.QUERIES[name](spark, str(tmp_path))


def test_status_hangs_neither_on_the_order_of_rows_nor_on_a_mean_of_zero(spark, tmp_path):
    # 30 on the mean, but not as a sum of doubles in this order
    late = [38.26, 41.8, 3.71, 36.23]
    assert sum(late) / len(late) < 30
    early, then = datetime(2024, 1, 2), datetime(2024, 1, 20)
    rows = [(early, 1, "a", 30.0), *((then, 1, "a", v) for v in late), (early, 2, "a", 0.0), (then, 2, "a", 40.0)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1)
    got = {r.user_id: (r.share, r.degraded, r.status) for r in _run(spark, tmp_path, "m10_status_with_degradations", events=events).collect()}
    assert got == {1: (1.0, 0, "passed"), 2: (1.0, 0, "passed")}


def test_micro_batches_hold_many_files(spark, tmp_path):
    events = spark.range(60_000).selectExpr("id AS event_id", "concat('k', id % 3) AS event_type").coalesce(1)
    got = {r.event_type: r.n for r in _run(spark, tmp_path, "x1_micro_batches", events=events).collect()}
    assert got == {"k0": 20_000, "k1": 20_000, "k2": 20_000}
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    newest = max(folder.glob("at-*"), key=lambda p: p.stat().st_mtime)
    assert len([p for p in (newest / "commits").iterdir() if p.name.isdigit()]) == 1


def test_simhashes_equal_the_expression(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "é ü é x"), (4, " "), (5, " ".join(f"w{i}" for i in range(700)))], "doc_id long, text string")
    words = X.word_set(F.col("text"))
    want = {r.doc_id: r.s for r in d.select("doc_id", words.alias("w")).select("doc_id", X.simhash(F.col("w"), 64).alias("s")).collect()}
    assert {r.doc_id: r.simhash for r in X.simhashes(d, "doc_id", words).collect()} == want


def test_splits_hand_chunks_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_CHARS", 1000)
    text = "word and word. " * 2000
    d = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string").coalesce(1)
    seen = C.split_at(d, "doc_id", "text", 400, 40, [". "])
    sizes = [b.num_rows for b in _batches(C, d)]
    assert max(sizes) <= 5 and sum(sizes) == seen.count()


def _batches(module, d):
    """What one task of split_at() hands on, batch by batch."""
    kept = {}

    class Table:
        dtypes = d.dtypes

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            kept["run"] = run
            return self

    module.split_at(Table(), "doc_id", "text", 400, 40, [". "])
    return list(kept["run"](d.toArrow().to_batches()))


def test_a_large_partition_value_is_written_by_several_tasks(spark, tmp_path):
    d = spark.range(400_000).selectExpr("id", "xxhash64(id) AS x", "'k' AS k").repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300KB")
    try:
        writers.write_partitioned(d, str(tmp_path / "parts"), ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "parts" / "k=k").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "parts")).agg(F.sum("id")).first()[0] == 400_000 * 399_999 // 2


def test_patterns_held_back_find_the_same(spark):
    d = spark.createDataFrame([(1, "Mail A.B@ProtonMail.com or @someone_x, ICQ: 1234567 Skype: abc.def_1 48.1, 11.5 48°51'29.5\"N 2°17'40.2\"E"), (2, "HTTP://Example.org/x 0xABCDEF1234 +49 1234 2024-01-02T03:04:05Z t1abcdefgh"), (3, None)], "doc_id long, text string")
    rows = lambda **k: sorted(map(str, M.detected(d, "doc_id", "text", IDENTIFIERS, FLAGS, **k).collect()))
    assert rows(held=HELD) == rows() != []
    assert set(HELD) <= {n for _, n, _ in IDENTIFIERS}


def test_a_task_keeps_its_best_over_slices(spark, monkeypatch):
    monkeypatch.setattr(I, "SCORES", 40)
    rng = np.random.RandomState(3)
    v = rng.randn(500, 8).round(2)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vector array<double>").coalesce(1)
    q = v[:4]
    got = I.scored(d, [0, 1, 2, 3], q, None, 5, None)
    s = np.round(I.unit(v) @ I.unit(q).T, 6)
    rows = got.collect()
    best = {i: sorted((-r.score, r.key) for r in rows if r.query_id == i)[:5] for i in range(4)}
    assert best == {i: sorted((-float(s[j, i]), j) for j in range(500))[:5] for i in range(4)}
    assert len(rows) < 300


def test_turns_of_communities_send_no_table_through_the_driver(spark):
    edges = spark.createDataFrame([(a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10)], "src long, dst long")
    weights = N.undirected(edges).selectExpr("src AS a", "dst AS b", "1L AS w")
    degrees = weights.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    labels = degrees.selectExpr("node", "node AS c")
    moved = N._move(weights, labels, degrees, 42, 0)
    moved.collect()
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()


def test_sentence_chunks_are_cut_where_the_text_lies(spark):
    d = spark.createDataFrame([(1, "x" * 25), (2, "".join(chr(97 + i % 26) for i in range(1000))), (3, None), (4, "")], "doc_id long, text string")
    got = C.chunk_texts(d, "doc_id", "text", 3)
    tree = C.chunk_tree(d, "doc_id", "text").where("level = 3").join(d, "doc_id").select("doc_id", "level", "chunk_index", F.substring("text", F.col("start") + 1, F.col("size")).alias("chunk"))
    assert sorted(got.collect()) == sorted(tree.collect())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_centralities_search_parts_apart(spark, monkeypatch):
    rng = np.random.RandomState(5)
    part = [tuple(map(int, e)) for e in rng.randint(0, 40, (90, 2))]
    d = spark.createDataFrame([(a + 100 * i, b + 100 * i) for i in range(4) for a, b in part], "src long, dst long")
    some = spark.createDataFrame([(i,) for i in range(0, 200, 7)], "node long")
    rows = lambda **k: [(r.node, round(r.betweenness, 12), r.closeness and round(r.closeness, 12)) for r in sorted(N.path_centralities(d, **k).collect())]
    called, joined = [], N._joined
    monkeypatch.setattr(N, "_joined", lambda *a: called.append(1) or joined(*a))
    monkeypatch.setattr(N, "TASK_WORK", 300)  # several slices a part
    monkeypatch.setattr(N, "TASK_STEPS", 400)  # several blocks a slice
    whole, few = rows(), rows(sources=some)
    assert not called and {n for n, *_ in few} == {n for n, *_ in whole} and any(c is None for *_, c in few)
    monkeypatch.setattr(N, "TASK_EDGES", 0)
    assert rows() == whole and rows(sources=some) == few and called
    assert len({(n % 100, x, y) for n, x, y in whole}) == len({n % 100 for n, *_ in whole})


def test_sets_with_one_rare_word_in_common_are_not_read(spark, monkeypatch):
    # each word but the rarest is in many sets; pairs share one rare word, and two are alike
    rng = np.random.RandomState(9)
    rows = [(i, [f"r{i // 2}", *(f"c{j}" for j in rng.choice(4000, 300, replace=False))]) for i in range(60)]
    rows += [(100, [f"z{j}" for j in range(300)]), (101, [f"z{j}" for j in range(20, 300)])]
    read, intersect = spark.sparkContext.accumulator(0), F.array_intersect

    def counted(a, b):
        seen = F.udf(lambda x: read.add(1) or x, "array<long>")
        return intersect(seen(a), b)

    monkeypatch.setattr(J.F, "array_intersect", counted)
    got = J.similar_sets(_sets(spark, rows), Fraction(7, 10)).collect()
    assert [(r.a, r.b) for r in got] == [(100, 101)] and 1 <= read.value < 10


def test_words_lie_by_their_number_of_sets(spark):
    rows = [(i, ["everywhere", f"pair{i // 2}", f"own{i}", *(["half"] if i % 2 else [])]) for i in range(1000)]
    count = {}
    sets = _sets(spark, rows).collect()
    for r in sets:
        for w in r.s:
            count[w] = count.get(w, 0) + 1
    assert all([count[w] for w in r.s] == sorted(count[w] for w in r.s) for r in sets) and len(sets) == 1000


def test_vector_classes_are_exact(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 64)
    monkeypatch.setattr(D, "SCORES", 500)
    rng = np.random.RandomState(11)
    base = rng.randn(120, 6)
    v = np.concatenate([base, base[:80] + 0.2 * rng.randn(80, 6), np.repeat(base[:1], 100, axis=0)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 6), (902, [1.0]), (903, [2.0]), (904, [None, 1.0])]
    got = {r.k: r.leader for r in D.vector_groups(spark.createDataFrame(rows, "k long, e array<double>"), "k", "e", 0.95).collect()}
    u = I.unit(v)
    near, want = u @ u.T >= 0.95, np.arange(len(v))
    for _ in range(len(v)):
        want = np.where(near, want, len(v)).min(axis=1)
    assert got == dict(enumerate(want.tolist())) | {900: 900, 901: 901, 902: 902, 903: 902, 904: 904}


def test_vectors_of_terms_are_made_where_the_text_lies(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_WORDS", 5)
    texts = ["The red fox and the red hen", None, "", "a I", "of the", "Élan vital élan vital élan", "red hen " * 9, "fox", "red fox"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    each = d.select("doc_id", F.explode(S.terms_of(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).collect()
    cf, df = {}, {}
    for r in each:
        cf[r.term], df[r.term] = cf.get(r.term, 0) + r.tf, df.get(r.term, 0) + 1
    most = sorted(cf, key=lambda w: (-cf[w], w))[:6]
    terms = S.vocabulary(d, "text", 6)
    idf = {r.term: r.idf for r in terms.collect()}
    assert {w: round(v, 9) for w, v in idf.items()} == {w: round(float(np.log(10 / (1 + df[w])) + 1), 9) for w in most}
    x = {(r.doc_id, r.term): r.tf * idf[r.term] for r in each if r.term in idf}
    want = {(k, w): round(v / sum(y * y for (q, _), y in x.items() if q == k) ** 0.5, 9) for (k, w), v in x.items()}
    got = S.postings(d, "doc_id", "text", terms)
    assert {(r.key, r.term): round(r.w, 9) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_signatures_equal_the_division(spark):
    rng = np.random.RandomState(4)
    h = np.concatenate([rng.randint(0, T.PRIME, 3000), [0, 1, T.PRIME - 1]]).astype(np.int64)
    a, b = np.array(T.PERM_A, dtype=np.int64), np.array(T.PERM_B, dtype=np.int64)
    every = (a[:, None] * h + b[:, None]) % T.PRIME
    assert (T.least_permuted(h) == every.min(axis=1)).all()
    assert all((T.least_permuted(h[i : i + 1]) == every[:, i]).all() for i in range(2900, len(h)))
    d = spark.createDataFrame([(1, "a b c d e a b c"), (2, None), (3, "é ü"), (4, " "), (5, " ".join(f"w{i}" for i in range(700)))], "doc_id long, text string").coalesce(1)
    expr = d.selectExpr("doc_id", f"{T.GRAM_WORDS} AS w").selectExpr("doc_id", f"transform(transform({T.GRAMS}, g -> md5(g)), m -> {T.GRAM_HASH}) AS h")
    want = {r.doc_id: [((a * x + b) % T.PRIME).tolist() for x in (r.h or [])] for r in expr.collect()}
    got = T.signatures(d)
    assert {r.doc_id: r.sig for r in got.collect()} == {k: [min(c) for c in zip(*v)] if v else [T.PRIME] * 128 for k, v in want.items()}
    assert "conv(" not in got._jdf.queryExecution().executedPlan().toString()


def test_every_two_rows_of_a_key_meet_once(spark):
    rows = [(k, i) for k in range(3) for i in range(k * 10, k * 10 + 7 * k)] + [(2, 33)]
    got = R.paired(spark.createDataFrame(rows, "k long, i long"), ["k"], "i", 4).collect()
    pairs = sorted((r.k, *sorted((r.x.i, r.y.i))) for r in got)
    assert pairs == sorted((k, a, b) for k, a in rows for l, b in rows if k == l and a < b)
    assert R.paired(spark.createDataFrame([], "k long, i long"), ["k"], "i", 4).count() == 0


def test_profiles_are_paired_in_one_join(spark, tmp_path):
    # more brands than one number has bits; suppliers of two nations, twice in one, of none; parts without a brand
    import duckdb

    brands = [None, *(f"b{i:03}" for i in range(150))]
    part = spark.createDataFrame([(i, b) for i, b in enumerate(brands)], "p_partkey long, p_brand string")
    supplier = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(4, 1), (5, 0), (7, 1), (8, None), (30, None)], "s_suppkey long, s_nationkey int")
    lines = [(s, (s * 7 + j * (1 + s % 3)) % 151, 0.01 * (j % 9), float(j % 40), "RNA"[(s + j) % 3]) for s in [*range(22), 30] for j in range(90)]
    lineitem = spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_discount double, l_quantity double, l_returnflag string")
    df = _run(spark, tmp_path, "j11_similar_profiles", part=part, supplier=supplier, lineitem=lineitem)
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLE_SQL["j11_similar_profiles"]).fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) > len(set(want)) > 50
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3  # the pairs' and two of block counts


def test_merges_leave_old_rows_where_they_lie(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, new = (spark.createDataFrame(rows, "k long, v string, bucket int") for rows in ([(i, "a", i % 4) for i in range(40)], [(3, "b", 3), (41, "c", 1)]))
        for fold in (K.replacing(["k"], ["v"]), K.without(["k"]), K.regrouped(["k"])):
            plan = fold(old, new)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merges_go_in_rounds_of_keys(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path / "t"), {**{i: f"v{i}" for i in range(200)}, None: "none"}
    K.create(spark.createDataFrame(list(state.items()), "k long, v string"), path, ["k"], 8)
    monkeypatch.setattr(K, "ROUND_KEYS", 20)  # fewer than some buckets get
    new = {**{i: f"n{i}" for i in range(100, 300)}, None: "again"}
    assert K._rounds([(1, 5), (2, 15), (3, 1), (4, 50), (5, 1)]) == [[1, 2], [3], [4], [5]]
    K.merge(spark, path, spark.createDataFrame(list(new.items()), "k long, v string"), ["k"], K.replacing(["k"], ["v"]))
    state.update(new)
    assert sorted(((r.k, r.v) for r in K.read(spark, path).collect()), key=repr) == sorted(state.items(), key=repr)
    K.merge(spark, path, spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(None,)], "k long"), ["k"], K.without(["k"]))
    assert sorted((r.k, r.v) for r in K.read(spark, path).collect()) == sorted((k, v) for k, v in state.items() if k is not None and k % 2)


def test_frequent_words_are_counted_where_the_text_lies(spark, monkeypatch):
    from collections import Counter

    texts = [(1, "b a b c a d"), (2, "x"), (3, ""), (4, "a a b"), (4, "b b c"), (None, "p q"), (None, "q"), (5, "z y z y x w v"), (6, " ".join("qrst"[i % 4] for i in range(50)))]
    df = spark.createDataFrame(texts, "k long, text string").coalesce(1)
    words = F.regexp_extract_all("text", F.lit("[a-z]"), F.lit(0))
    want = Counter()
    for k, text in texts:
        want.update((k, w) for w in text.split())
    for limit in (1_000_000, 1):
        monkeypatch.setattr(S, "SLICE_WORDS", limit)
        best = {}
        for (k, w), n in want.items():
            best.setdefault(k, []).append((-n, w))
        got = sorted(((r.k, r.keyword, r.frequency) for r in S.frequent_words(df, "k", words, 2).collect()), key=repr)
        assert got == sorted(((k, w, -n) for k, own in best.items() for n, w in sorted(own)[:2]), key=repr)
    plan = S.frequent_words(df.where("k < 4"), "k", words, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_gradients_equal_those_of_all_pairs():
    rng = np.random.default_rng(2)
    for levels in (1, 2, 4, 50):
        score, gain = np.round(rng.normal(size=50), 1), rng.integers(0, levels, 50).astype(float)
        rank = np.argsort(np.argsort(-score, kind="stable"))
        worth, discount = 2.0**gain - 1, 1 / np.log2(rank + 2)
        ideal = sum(w / np.log2(i + 2) for i, w in enumerate(sorted(worth, reverse=True)))
        g, h = np.zeros(50), np.zeros(50)
        for i, j in ((i, j) for i in range(50) for j in range(50) if gain[i] > gain[j]):
            change = abs((worth[i] - worth[j]) * (discount[i] - discount[j])) / ideal
            rho = 1 / (1 + np.exp(score[i] - score[j]))
            g[[i, j]] += rho * change, -rho * change
            h[[i, j]] += rho * (1 - rho) * change
        got = L.lambdas(score, gain)
        assert np.allclose(got[0], g, atol=1e-12) and np.allclose(got[1], h, atol=1e-12)


def test_a_query_is_one_row_and_scores_ask_for_the_cuts_alone(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(q if q else None, float(a), None if i == 3 else int(b), int(a > 0.5) + int(b > 60)) for q in range(13) for i, (a, b) in enumerate(zip(rng.random(30), rng.integers(0, 100, 30)))]
    df = spark.createDataFrame(rows, "q long, a double, b int, rel int").repartition(5)
    kept, write = {}, L.written
    monkeypatch.setattr(L, "written", lambda d, name: kept.setdefault(name, write(d, name)) if name == "ranking" else write(d, name))
    model = L.train(df, "q", "rel", ["a", "b"], 2)
    assert kept["ranking"].count() == 12
    scored = model.score(df)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count(" > ") <= 2 * 7

    def walk(tree, bins):
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree

    for r in scored.collect():
        bins = [sum(v > x for x in own) if v is not None else 0 for v, own in zip((r.a, r.b), model.limits)]
        assert abs(r.score - sum(walk(t, bins) for t in model.trees)) < 1e-12
    assert len({r.score for r in scored.collect()}) > 4
