"""Context compression and learned ranking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import compression as C, ranking as L, sparse as S, vector_index as I
from siltstone.operators.relational import top_per
from siltstone.plans.retrieval import _queries
from siltstone.registry import query


@query("c16_context_compression")
def _(t):
    """For every document whose id is divisible by 50, what of its 50 nearest documents fits 4,000 tokens.

    Salience: 0.4 cosine of vectors, 0.3 of tf-idf, 0.3 the share of the query's words of three letters that the document has, times
    the weight of its source. Tests hold the operator against brute force.
    """
    docs = t("documents").where("text is not null").select("doc_id", "source", "text")
    near = I.exact(t("embeddings"), _queries(t), "vec_id", "embedding", 50).select("query_id", F.col("key").alias("doc_id"), F.col("score").alias("cosine"))
    near = S.written(near.where("query_id <> doc_id"), "near")
    index = S.written(S.postings(t("documents"), "doc_id", "text", S.vocabulary(t("documents"), "text")), "postings")
    asked = index.join(F.broadcast(near.select(F.col("query_id").alias("key")).distinct()), "key").select(F.col("key").alias("query_id"), "term", F.col("w").alias("wq"))
    sparse = near.join(index.withColumnRenamed("key", "doc_id"), "doc_id").join(asked, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("wq")).alias("sparse"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zà-öø-ÿ]{3,}"), F.lit(0)))
    own = docs.select("doc_id", "source", words(F.col("text")).alias("w"), F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    other = own.select(F.col("doc_id").alias("query_id"), F.col("w").alias("wq"))
    share = F.coalesce(F.size(F.array_intersect("w", "wq")) / F.nullif(F.size("wq"), F.lit(0)), F.lit(0.0))
    weight = F.when(F.col("source").isin("src1", "src2", "src3"), 1.0).when(F.col("source").isNotNull(), 0.8).otherwise(0.5)
    rows = near.join(own, "doc_id").join(other, "query_id").join(sparse, ["query_id", "doc_id"], "left")
    salience = (0.4 * F.col("cosine") + 0.3 * F.coalesce("sparse", F.lit(0.0)) + 0.3 * share) * weight
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    got = C.compress(rows.select("query_id", "doc_id", salience.alias("salience"), "tokens").join(vectors, "doc_id"), 4_000)
    return got.select("query_id", "doc_id", "position", "redundancy", "tokens", *[F.round(c, 6).alias(c) for c in ("salience", "novelty", "score")])


#: Features of a part offered by a supplier; relevance is the number of its lines that were returned, 3 at most.
FEATURES = ["lines", "quantity", "price", "discount", "tax", "size", "retail", "balance", "recency", "rank_lines", "rank_price", "late"]


def _ranking_rows(t):
    l = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice"), "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey")  # noqa: E741
    # one shuffle for the sums by part and both ranks
    rows = l.repartition("l_suppkey").groupBy("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
        F.max("p_size").alias("size"), F.max("p_retailprice").alias("retail"), F.max("s_acctbal").alias("balance"), F.max(F.unix_date(F.to_date("l_shipdate"))).alias("recency"),
        F.sum((F.col("l_linestatus") == "F").cast("int")).alias("late"), F.least(F.sum((F.col("l_returnflag") == "R").cast("int")), F.lit(3)).alias("relevance"),
    )
    by = lambda c: Window.partitionBy("l_suppkey").orderBy(F.desc(c), "l_partkey")
    return rows.withColumn("rank_lines", F.row_number().over(by("lines"))).withColumn("rank_price", F.row_number().over(by("price")))


@query("r20_learned_ranking")
def _(t):
    """The ten best parts of each supplier by a ranker learned from the suppliers whose key's hash is even; tests hold its nDCG."""
    rows = _ranking_rows(t).where(F.col("l_suppkey").isNotNull())
    # a query's candidates: all parts of the supplier
    held = S.written(rows, "candidates")
    learned = F.pmod(F.xxhash64("l_suppkey"), F.lit(2)) == 0
    model = L.train(held.where(learned), "l_suppkey", "relevance", FEATURES, 6)
    scored = model.score(held).withColumn("score", F.round("score", 6))
    best = top_per(scored, ["l_suppkey"], [F.desc("score"), "l_partkey"], 10)
    return best.select("l_suppkey", "l_partkey", "rank", "score", "relevance", (~learned).alias("held_out"))
