"""Context compression: chunks of a query by salience, novelty and redundancy within a token budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Weights of salience, novelty and redundancy; redundancy by the greatest similarity to a chunk taken before; share of the budget that ends the selection.
SALIENCE, NOVELTY, REDUNDANCY = 0.5, 0.3, 0.2
STEPS = ((0.85, 0.8), (0.70, 0.5), (0.55, 0.2))
ENOUGH = 0.95


def scores(vectors: np.ndarray, salience: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(novelty, redundancy, final score) of chunks, from one block of cosines.

    Novelty is 1 less the mean cosine to the others; redundancy falls in steps with the greatest cosine to the chunks of higher
    salience that are not redundant themselves (ties by place).
    """
    n = len(vectors)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length > 0, length, 1)
    cos = unit @ unit.T
    novelty = 1 - (cos.sum(axis=1) - np.diag(cos)) / (n - 1) if n > 1 else np.ones(n)
    redundancy = np.zeros(n)
    most = np.full(n, -np.inf)  # greatest cosine to a chunk that stands
    for i in np.argsort(-salience, kind="stable").tolist():
        redundancy[i] = next((p for limit, p in STEPS if most[i] > limit), 0.0)
        if redundancy[i] == 0:
            most = np.maximum(most, cos[i])
    return novelty, redundancy, SALIENCE * salience + NOVELTY * novelty - REDUNDANCY * redundancy


def compress(candidates: DataFrame, budget: int) -> DataFrame:
    """query_id, doc_id, position, salience, novelty, redundancy, score, tokens of the chunks that fit the budget, best first.

    candidates: query_id, doc_id, salience, tokens, vector: a bounded list for each query (such as a top-k), which one task holds as
    a block of cosines; no pairs are written. Chunks that do not fit are passed over; the selection ends at ENOUGH of the budget.
    Ties go to the smaller doc_id; rows without a vector are refused; a null salience counts as 0.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        salience = pdf["salience"].fillna(0).to_numpy(float)
        novelty, redundancy, final = scores(np.stack(pdf["vector"].to_numpy()).astype(float), salience)
        tokens, used, taken = pdf["tokens"].to_numpy(), 0, []
        for i in np.argsort(-np.round(final, 12), kind="stable").tolist():
            if used + tokens[i] <= budget:
                taken.append(i)
                used += int(tokens[i])
            if used >= ENOUGH * budget:
                break
        return pd.DataFrame({
            "query_id": pdf["query_id"].iloc[0], "doc_id": pdf["doc_id"].to_numpy()[taken], "position": range(1, len(taken) + 1), "salience": salience[taken],
            "novelty": novelty[taken], "redundancy": redundancy[taken], "score": final[taken], "tokens": tokens[taken],
        })

    rows = candidates.where("vector is not null").select("query_id", "doc_id", "salience", "tokens", "vector")
    return rows.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, position long, salience double, novelty double, redundancy double, score double, tokens long")
