"""Structural chunks: runs of lines of one kind, under their headings, split and merged to a size that follows the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Kind and pattern of a line, the first that fits; lines of no kind are prose.
KINDS = [
    ("blank", r"^[ \t\r]*$"),
    ("heading", r"^(#{1,6} .*|[A-Z0-9][A-Z0-9 ,:&-]{3,60}|[^.!?]{1,60}:)$"),
    ("list", r"^[ \t]*([-*+]|[0-9]{1,3}[.)]) "),
    ("citation", r"^[ \t]*(\[[0-9]+\]|\([A-Z][a-z]+,? [0-9]{4}\))"),
    ("quote", r"^[ \t]*(>|\")"),
]
#: Kind of speech act and pattern within a chunk, the first that fits; the rest are statements.
ACTS = [
    ("question", r"[?]"),
    ("definition", r"(?i)\b(is defined as|means|refers to)\b"),
    ("conclusion", r"(?i)\b(therefore|thus|in conclusion)\b"),
    ("evidence", r"(?i)\b(shows?|according to|found that|results?)\b"),
]
#: Words that make a sentence a claim.
CLAIM = r"(?i)\b(is|are|was|were|shows?|proves?|must|will)\b"
#: Characters of a chunk at score 0; its share less at score -1 and more at score 1; sizes are multiples of STEP.
BASE, LESS, MORE, STEP = 512, 0.5, 0.3, 64


def _first(value: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.regexp_like(value, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """row, key, segment, kind, first_line, text: runs of lines of one kind, each heading its own; joined by line feeds they are the text.

    Null and empty texts have none. All within the row: flags of the lines, then the places where they change; each line is copied
    once, whatever its number. `row` tells rows of equal keys apart.
    """
    lines = F.split(text, "\n", -1)
    rows = df.where(F.length(text) > 0).select(F.monotonically_increasing_id().alias("row"), key, lines.alias("__l"), F.transform(lines, lambda x: _first(x, KINDS, "prose")).alias("__k"))
    change = lambda i: (i == 0) | (F.get("__k", i) != F.get("__k", i - 1)) | (F.get("__k", i) == "heading")
    rows = rows.withColumn("__s", F.filter(F.sequence(F.lit(0), F.size("__l") - 1), change))

    def piece(at: Column, n: Column) -> Column:
        end = F.coalesce(F.get("__s", n + 1), F.size("__l"))
        return F.struct(n.alias("segment"), F.get("__k", at).alias("kind"), at.alias("first_line"), F.array_join(F.slice("__l", at + 1, end - at), "\n").alias("text"))

    return rows.select("row", key, F.explode(F.transform("__s", piece)).alias("__p")).select("row", key, "__p.*")


def target(text: Column) -> Column:
    """Characters of a chunk for a text: fewer where its words repeat, more where they are all different."""
    words = F.filter(F.split(F.lower(text), "[ \t\r\n]+"), lambda w: w != "")
    score = 2.0 * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)) - 1
    size = BASE * (1 + F.when(score < 0, score * LESS).otherwise(score * MORE))
    return (F.floor(size / STEP) * STEP).cast("int")


def sizes() -> list[int]:
    low, high = int(BASE * (1 - LESS)) // STEP * STEP, int(BASE * (1 + MORE)) // STEP * STEP
    return list(range(low, high + 1, STEP))


def cut_pattern(size: int) -> str:
    """Pieces of at most `size` characters that end behind white space or with the text; a longer word is cut."""
    return rf"(?s).{{1,{size - 1}}}(?:[ \t\r\n]|\z)|.{{1,{size}}}"


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """row, key, chunk_index, kind, parent, start, size, act, claims, text: chunks that follow each other without gap or overlap.

    Segments longer than the text's target size are cut; shorter neighbours in one section are joined where they begin in the same
    cell of target-size characters, so that a chunk has less than two targets. kind is that of the chunk's first segment that is not
    blank; parent the index of the chunk with the section's heading (null before the first); claims the share of sentences with a
    claim. Line feeds between segments belong to the one before, so that the chunks' texts joined are the text.
    """
    sized = df.where(F.length(text) > 0).withColumn("__target", target(F.col(text)))
    rows = segments(sized.withColumn("__key", F.struct(F.col(key).alias("k"), F.col("__target").alias("t"))), "__key", text).select("row", F.col("__key.k").alias(key), F.col("__key.t").alias("target"), "segment", "kind", "text")
    order = Window.partitionBy("row").orderBy("segment")
    last = F.lead("segment").over(order).isNull()
    rows = rows.withColumn("text", F.when(last, F.col("text")).otherwise(F.concat("text", F.lit("\n"))))
    cut = F.array("text")
    for n in sizes():
        cut = F.when((F.col("target") == n) & (F.length("text") > n), F.regexp_extract_all("text", F.lit(cut_pattern(n)), F.lit(0))).otherwise(cut)
    pieces = rows.select("row", key, "target", "segment", "kind", F.posexplode(cut).alias("piece", "text")).withColumn("n", F.length("text")).where("n > 0")
    at = Window.partitionBy("row").orderBy("segment", "piece")
    pieces = pieces.withColumn("start", F.sum("n").over(at) - F.col("n")).withColumn("section", F.sum(((F.col("kind") == "heading") & (F.col("piece") == 0)).cast("int")).over(at))
    joined = pieces.groupBy("row", key, "section", F.floor(F.col("start") / F.col("target")).alias("cell")).agg(
        F.min("start").cast("long").alias("start"), F.sum("n").cast("long").alias("size"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("all"),
    )
    whole = F.array_join(F.transform("all", lambda x: x["text"]), "")
    first = F.get(F.filter("all", lambda x: x["kind"] != "blank"), F.lit(0))["kind"]
    out = joined.select("row", key, "section", "start", "size", F.coalesce(first, F.lit("blank")).alias("kind"), whole.alias("text"))
    place = Window.partitionBy("row").orderBy("start")
    out = out.withColumn("chunk_index", (F.row_number().over(place) - 1).cast("long"))
    # the section's first chunk begins with its heading; section 0 has none
    parent = F.when(F.col("section") > 0, F.min("chunk_index").over(Window.partitionBy("row", "section")))
    sentences = F.filter(F.split("text", "[.!?]+"), lambda s: F.trim(s) != "")
    claims = F.round(F.size(F.filter(sentences, lambda s: F.regexp_like(s, F.lit(CLAIM)))) / F.greatest(F.size(sentences), F.lit(1)), 6)
    return out.select("row", key, "chunk_index", "kind", parent.alias("parent"), "start", "size", _first(F.col("text"), ACTS, "statement").alias("act"), claims.alias("claims"), "text")
