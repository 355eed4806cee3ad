"""Vector and lexical retrieval, rank fusion and diversification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators.vector_index import exact


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, key, score, rank: the exact k nearest by cosine of each query, a stated set sent in blocks to all vectors.

    Each batch of vectors meets a block of queries in one matrix product and keeps k rows of a query, so that pairs are not shuffled.
    Vectors without a cosine (null, of zeros, of another width) are not found.
    """
    return exact(vectors, queries, key, vector, k, threshold)


def _equals(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of every document for the query terms (repeated terms count again); idf may be negative.

    One scan gives each document's length and term counts; corpus figures are one row joined back.
    """
    low = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(key).alias("key"), low.alias("w"))
    distinct = sorted(set(terms))
    counts = [F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(distinct)]
    rows = rows.select("key", F.size("w").alias("len"), *counts)
    corpus = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(distinct))])
    both = rows.crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
        score = score + terms.count(t) * F.when(tf > 0, part).otherwise(0.0)
    return both.select("key", F.round(score, 6).alias("score"))


def rrf(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None, base: int = 1) -> DataFrame:
    """query_id, doc_id, rrf from (query_id, source, doc_id, rank from 1): the sum of w / (k + rank - 1 + base)."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("source")), F.lit(1.0))
    return lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(w / (k + F.col("rank") - 1 + base)), 9).alias("rrf"))


def mmr(ranked: DataFrame, k: int = 20, balance: float = 0.7) -> DataFrame:
    """query_id, doc_id, position: greedy maximal marginal relevance over each query's candidates (a bounded top list).

    ranked: query_id, doc_id, relevance, vector. Ties go to the smaller doc_id; rows without vectors are refused.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rel = (pdf["relevance"].to_numpy(float) + 1) / 2
        most = np.zeros(len(pdf))
        taken: list[int] = []
        for _ in range(min(k, len(pdf))):
            score = balance * rel - (1 - balance) * most
            score[taken] = -np.inf
            i = int(score.argmax())
            taken.append(i)
            most = np.maximum(most, (v @ v[i] + 1) / 2)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": pdf["doc_id"].iloc[taken].to_numpy(), "position": range(1, len(taken) + 1)})

    return ranked.where("vector is not null").groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, position long")
