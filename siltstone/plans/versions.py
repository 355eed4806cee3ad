"""Successive versions: turns of conversations and documents of a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import versions as V
from siltstone.registry import query


@query("w5_sequence_ratio")
def _(t):
    """Turns whose characters match those of the turn before by less than 0.9; tests compare with another implementation."""
    pairs = V.successive(t("conversations").where("text is not null"), "conv_id", "turn", "text")
    return V.with_changes(pairs, "text", "before", "character").where("ratio < 0.9").select("conv_id", "turn", F.round("ratio", 9).alias("ratio"))


@query("w6_sampled_evolution")
def _(t):
    """About ten documents of each source at even steps, each against the sample before, by lines."""
    pairs = V.successive(t("documents"), "source", "doc_id", "text", F.greatest(F.floor(F.col("total") / 10), F.lit(1)))
    return V.with_changes(pairs, "text", "before").select("source", "doc_id", "n", F.length("text").alias("length"), F.round("ratio", 9).alias("ratio"))


@query("f45_difference_summary")
def _(t):
    """Lines added and taken away from each document to the next of its source."""
    pairs = V.successive(t("documents"), "source", "doc_id", "text")
    return V.with_changes(pairs, "text", "before").where("before is not null").select("source", "doc_id", "additions", "deletions", F.round("change_ratio", 9).alias("change_ratio"), "kind")


@query(
    "w5_places",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn IS NOT NULL",
)
def _(t):
    return V.numbered(t("conversations"), "conv_id", "turn")
