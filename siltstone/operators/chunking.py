"""Row-expanding text operators."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def sentences(df: DataFrame, text: str, least: int) -> DataFrame:
    """The other columns, idx (counting dropped ones) and s: pieces between runs of .!?, trimmed of spaces, of `least` characters or more."""
    others = [c for c in df.columns if c != text]
    parts = df.select(*others, F.posexplode(F.split(text, "[.!?]+")).alias("idx", "s"))
    return parts.select(*others, F.col("idx").cast("long").alias("idx"), F.trim("s").alias("s")).where(F.length("s") >= least)


#: Texts that a task holds as Python strings at once, and characters of chunks after which it hands them on.
SLICE_ROWS, PIECE_CHARS = 64, 1 << 20


def _expand(df: DataFrame, key: str, text: str, cut, extra: str = ""):
    """One row for each (key, text) becomes rows of cut(text): (position, chunk), by Arrow batches."""

    def run(batches):
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string()]
            rows, held = [], 0

            def made(rows):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [key, "chunk_index", "chunk"])

            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for i, c in enumerate(cut(t or "")):
                        rows.append((k, i, c))
                        held += len(c)
                        if held >= PIECE_CHARS:
                            yield made(rows)
                            rows, held = [], 0
            if rows:
                yield made(rows)

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, chunk_index long, chunk string")


def sentence_chunks(df: DataFrame, key: str, text: str, most: int = 512, overlap: int = 50) -> DataFrame:
    """Whole sentences up to `most` words a chunk; a chunk begins with the last `overlap` words of the one before; longer sentences are sliced."""

    def cut(t: str):
        held: list[str] = []
        fresh = 0
        for s in re.split(r"(?<=[.!?])\s+", t):
            words = s.split()
            while words:
                room = most - len(held)
                if len(words) > room and fresh:
                    yield " ".join(held)
                    held, fresh = held[-overlap:] if overlap else [], 0
                    continue
                took, words = words[:room], words[room:]
                held += took
                fresh += len(took)
                if words:
                    yield " ".join(held)
                    held, fresh = held[-overlap:] if overlap else [], 0
        if fresh:
            yield " ".join(held)

    return _expand(df, key, text, cut)


def word_windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of `size` words that share `overlap` words; the last may be shorter, no text is lost."""

    def cut(t: str):
        w = t.split()
        for a in range(0, max(len(w) - overlap, 1), size - overlap):
            if w[a : a + size]:
                yield " ".join(w[a : a + size])

    return _expand(df, key, text, cut)


#: Level, characters of a chunk, characters shared with the one before.
LEVELS = [("document", 8000, 0), ("section", 2000, 200), ("passage", 512, 76), ("sentence", 128, 25)]


def _chunk(depth: int, step: int, size: int):
    return lambda i: F.struct(F.lit(depth).alias("level"), i.alias("chunk_index"), (i * step).alias("start"), F.lit(size).alias("most"))


def chunk_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, level, chunk_index, start, size: character ranges of four levels; parent ranges contain the child's start."""
    out = []
    for depth, (_, size, shared) in enumerate(LEVELS):
        step = size - shared
        last = F.greatest(F.ceil((F.length(text) - shared) / F.lit(step)) - 1, F.lit(0))
        out.append(F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), _chunk(depth, step, size)))
    rows = df.where(F.length(text) > 0).select(key, F.length(text).alias("__n"), F.explode(F.flatten(F.array(*out))).alias("c"))
    return rows.select(key, "c.level", "c.chunk_index", "c.start", F.least("c.most", F.col("__n") - F.col("c.start")).cast("long").alias("size"))


def chunk_texts(df: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """key, level, chunk_index, chunk: the texts of chunk_tree()'s ranges of one level, cut where the text lies."""
    _, size, shared = LEVELS[depth]
    last = F.greatest(F.ceil((F.length(text) - shared) / F.lit(size - shared)) - 1, F.lit(0)).cast("long")
    cut = lambda i: F.substring(F.col(text), (i * (size - shared) + 1).cast("int"), F.lit(size))
    rows = df.where(F.length(text) > 0).select(key, F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), last), cut)).alias("at", "chunk"))
    return rows.select(key, F.lit(depth).alias("level"), F.col("at").cast("long").alias("chunk_index"), "chunk")


def split_at(df: DataFrame, key: str, text: str, size: int, overlap: int, marks: list[str]) -> DataFrame:
    """key, chunk_index, chunk: at most `size` characters, cut after the last mark past the half (the first mark of the list
    that has one there), else at the size; a chunk begins `overlap` characters before the cut. Nothing follows the text's end."""

    def cut(t: str):
        start, n = 0, len(t)
        while start < n:
            end = min(start + size, n)
            if end < n:
                for m in marks:
                    at = t.rfind(m, start, end)
                    if at + len(m) - start > size // 2:
                        end = at + len(m)
                        break
            yield t[start:end]
            if end == n:
                return
            start = max(end - overlap, start + 1)

    return _expand(df, key, text, cut)


def merged_paragraphs(df: DataFrame, key: str, text: str, most: int = 200) -> DataFrame:
    """key, chunk_index, chunk: lines with a word, joined while their words together stay within `most`; a longer line is its own chunk."""

    def cut(t: str):
        held: list[str] = []
        words = 0
        for line in t.split("\n"):
            n = len([w for w in line.split(" ") if w])
            if n and held and words + n > most:
                yield "\n".join(held)
                held, words = [], 0
            if n:
                held.append(line)
                words += n
        if held:
            yield "\n".join(held)

    return _expand(df, key, text, cut)


def matches(df: DataFrame, key: str, text: str, pattern: str, around: int) -> DataFrame:
    """key, entity, start, end, context: every match with `around` characters on either side, in the JVM: what lies between the matches gives their places."""
    found = df.select(key, F.col(text).alias("__t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("__e"), F.split(text, pattern, -1).alias("__g"))
    # running lengths of gaps and matches before each match
    start = lambda i: F.aggregate(F.slice("__g", 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("__e", 1, i), F.lit(0), lambda a, e: a + F.length(e))
    rows = found.where(F.size("__e") > 0).select(key, "__t", F.explode(F.transform("__e", lambda e, i: F.struct(e.alias("e"), start(i).alias("at")))).alias("m"))
    at, end = F.col("m.at"), F.col("m.at") + F.length("m.e")
    first = F.greatest(at - around, F.lit(0))
    return rows.select(key, F.col("m.e").alias("entity"), at.cast("long").alias("start"), end.cast("long").alias("end"), F.substring(F.col("__t"), first + 1, end + around - first).alias("context"))
