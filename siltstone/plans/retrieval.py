"""Vector and lexical retrieval and rank fusion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import retrieval as V
from siltstone.registry import query

COS = "round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
#: The stated query set: every vector whose id is divisible by 50.
TOP = f"SELECT query_id, key, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS key, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)"


def _queries(t):
    return t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("v2_batched_top_k", f"{TOP} WHERE rank <= 10")
def _(t):
    return V.top_k(t("embeddings"), _queries(t), "vec_id", "embedding", 10)


@query("v3_top_k_threshold", f"SELECT * FROM ({TOP} WHERE rank <= 10) WHERE score >= 0.3")
def _(t):
    return V.top_k(t("embeddings"), _queries(t), "vec_id", "embedding", 10, 0.3)


@query("v4_relevance_label", f"SELECT query_id, key, CASE WHEN score > 0.35 THEN 'high' ELSE 'medium' END AS label FROM ({TOP} WHERE rank <= 5) WHERE score >= 0.25")
def _(t):
    best = V.top_k(t("embeddings"), _queries(t), "vec_id", "embedding", 5, 0.25)
    return best.select("query_id", "key", F.when(F.col("score") > 0.35, "high").otherwise("medium").alias("label"))


TERMS = ["the", "und", "que", "de"]
BM25 = r"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS len, """ + ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(TERMS)) + """ FROM w),
s AS (SELECT count(*) AS n, avg(len) AS avgdl, """ + ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(4)) + """ FROM c),
b AS (SELECT doc_id AS key, round(""" + " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avgdl)) ELSE 0 END" for i in range(4)) + """, 6) AS score FROM c, s)"""


@query("v7_bm25", f"WITH {BM25} SELECT key, score FROM b")
def _(t):
    return V.bm25(t("documents"), "doc_id", "text", TERMS)


@query("v8_bm25_top_k", f"WITH {BM25} SELECT key, score FROM b ORDER BY score DESC, key LIMIT 20")
def _(t):
    return V.bm25(t("documents"), "doc_id", "text", TERMS).orderBy(F.desc("score"), "key").limit(20)


@query("v11_word_overlap_search", r"SELECT doc_id, round(len(list_intersect(list_distinct(string_split_regex(lower(text), '\s+')), ['the', 'of', 'and', 'ist'])) / 4.0, 6) AS score FROM documents WHERE len(list_intersect(list_distinct(string_split_regex(lower(text), '\s+')), ['the', 'of', 'and', 'ist'])) > 0")
def _(t):
    both = F.size(F.array_intersect(F.split(F.lower("text"), r"\s+"), F.array(*[F.lit(w) for w in ("the", "of", "and", "ist")])))
    return t("documents").select("doc_id", F.round(both / 4.0, 6).alias("score")).where("score > 0")


@query("v14_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the') ORDER BY doc_id LIMIT 50")
def _(t):
    return t("documents").where(F.contains(F.lower("text"), F.lit("tion the"))).select("doc_id").orderBy("doc_id").limit(50)


@query("v13_cross_corpus_similarity", "WITH c AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM c GROUP BY label, i) SELECT a.label AS a_label, b.label AS b_label, round(sum(a.x * b.x), 6) AS sim FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def _(t):
    c = t("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = c.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pair = m.alias("a").join(m.alias("b"), F.expr("a.i = b.i and a.label < b.label"))
    return pair.groupBy(F.col("a.label").alias("a_label"), F.col("b.label").alias("b_label")).agg(F.round(F.sum(F.col("a.x") * F.col("b.x")), 6).alias("sim"))


LISTS = """l AS (SELECT * FROM (SELECT l_partkey AS query_id, 'price' AS source, l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_partkey ORDER BY max(l_extendedprice) DESC, l_suppkey) AS rank FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT l_partkey, 'qty', l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY max(l_quantity) DESC, l_suppkey) FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE rank <= 10)"""


def _lists(t):
    g = t("lineitem").groupBy(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("doc_id")).agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"))
    w = Window.partitionBy("query_id")
    ranked = g.select("query_id", "doc_id", F.row_number().over(w.orderBy(F.desc("p"), "doc_id")).alias("rp"), F.row_number().over(w.orderBy(F.desc("q"), "doc_id")).alias("rq"))
    return ranked.select("query_id", "doc_id", F.explode(F.array(F.struct(F.lit("price").alias("source"), F.col("rp").alias("rank")), F.struct(F.lit("qty").alias("source"), F.col("rq").alias("rank")))).alias("x")).select("query_id", "x.source", "doc_id", "x.rank").where("rank <= 10")


for _name, _formula, _args in (
    ("r1_rrf", "1.0 / (60 + rank)", {}),
    ("r2_rrf_weighted", "CASE source WHEN 'price' THEN 0.3 ELSE 0.4 END / (60 + rank)", {"weights": {"price": 0.3, "qty": 0.4}}),
    ("r3_rrf_zero_based", "1.0 / (60 + rank - 1)", {"base": 0}),
    ("r4_rrf_hybrid", "CASE source WHEN 'price' THEN 0.7 ELSE 0.3 END / (60 + rank - 1)", {"weights": {"price": 0.7, "qty": 0.3}, "base": 0}),
    ("r5_rrf_vector_bm25", "CASE source WHEN 'price' THEN 0.7 ELSE 0.3 END / (60 + rank)", {"weights": {"price": 0.7, "qty": 0.3}}),
):
    query(_name, f"WITH {LISTS} SELECT query_id, doc_id, round(sum({_formula}), 9) AS rrf FROM l GROUP BY query_id, doc_id")(lambda t, a=_args: V.rrf(_lists(t), **a))


@query("r6_rrf_k_sweep", f"WITH {LISTS} SELECT k, round(sum(1.0 / (k + rank)), 6) AS mass FROM l, (SELECT unnest([10, 20, 40, 60, 80, 100]) AS k) GROUP BY k")
def _(t):
    ks = F.explode(F.array(*[F.lit(k) for k in (10, 20, 40, 60, 80, 100)])).alias("k")
    return _lists(t).select("rank", ks).groupBy("k").agg(F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 6).alias("mass"))


@query("r8_duplicate_resolution", "SELECT l_partkey, l_suppkey, round(avg(l_discount) * 1.1, 8) AS merged, max(l_discount) AS best FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def _(t):
    g = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_discount") * 1.1, 8).alias("merged"), F.max("l_discount").alias("best"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").drop("n")


@query("r10_mmr")
def _(t):
    best = V.top_k(t("embeddings"), _queries(t), "vec_id", "embedding", 30)
    ranked = best.join(t("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), "key")
    return V.mmr(ranked.select("query_id", F.col("key").alias("doc_id"), F.col("score").alias("relevance"), "vector"), 10)


@query("r15_diversity_stats", "SELECT label, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT label, list_sum(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label")
def _(t):
    x = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double")).alias("x")
    r = lambda c: F.round(c, 6)
    return t("embeddings").select("label", x).groupBy("label").agg(r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("sd"), r(F.min("x")).alias("low"), r(F.max("x")).alias("high"))


@query("r16_win_rate", "WITH l AS (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), x AS (SELECT a.l_suppkey AS s, CASE WHEN a.p > b.p THEN 1 ELSE 0 END AS win FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey) SELECT s, count(*) AS games, round(avg(win), 6) AS rate FROM x GROUP BY s")
def _(t):
    l = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_extendedprice").alias("p"))  # noqa: E741
    # wins from ranks: no pairs are made
    w = Window.partitionBy("l_orderkey")
    r = l.select("l_suppkey", (F.count(F.lit(1)).over(w) - 1).alias("games"), (F.rank().over(w.orderBy("p")) - 1).alias("wins"))
    return r.groupBy(F.col("l_suppkey").alias("s")).agg(F.sum("games").alias("games"), F.round(F.sum("wins") / F.sum("games"), 6).alias("rate")).where("games > 0")
