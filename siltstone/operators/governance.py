"""Personal data and audit operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Patterns of personal data.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?\d[\d ()-]{7,}\d",
}


def redact(text: Column) -> Column:
    for kind, pattern in PII.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED_{kind.upper()}]")
    return text


def _row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def chain(df: DataFrame, log: str, order: list[str], columns: list[str]) -> DataFrame:
    """Add row_hash and previous_hash within each log."""
    hashed = df.withColumn("row_hash", _row_hash(columns))
    return hashed.withColumn("previous_hash", F.coalesce(F.lag("row_hash").over(Window.partitionBy(log).orderBy(*order)), F.lit("")))


def verify_chain(df: DataFrame, log: str, order: list[str], columns: list[str]) -> DataFrame:
    """log, rows, broken: rows whose hash differs from their content, or whose previous_hash from the row before."""
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(log).orderBy(*order)), F.lit(""))
    bad = (F.col("row_hash") != _row_hash(columns)) | (F.col("previous_hash") != before)
    return df.withColumn("bad", bad.cast("long")).groupBy(log).agg(F.count(F.lit(1)).alias("rows"), F.sum("bad").alias("broken"))
