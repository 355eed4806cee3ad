"""Structural chunks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import structure as S
from siltstone.registry import query


def _case(value: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"


#: Lines with their kinds, then segments with their line feeds, pieces and chunks.
SEGMENTS = f"""d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents WHERE length(text) > 0),
z AS (SELECT doc_id, l, 2.0e0 * len(list_distinct(w)) / greatest(len(w), 1) - 1 AS score FROM d),
t AS (SELECT doc_id, l, CAST(floor({S.BASE} * (1 + CASE WHEN score < 0 THEN score * {S.LESS}e0 ELSE score * {S.MORE}e0 END) / {S.STEP}) AS INT) * {S.STEP} AS target FROM z),
e AS (SELECT doc_id, target, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM t), k AS (SELECT *, {_case("x", S.KINDS, "prose")} AS kind FROM e),
c AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS segment FROM c),
s AS (SELECT doc_id, target, segment, any_value(kind) AS kind, min(i) AS first_line, string_agg(x, chr(10) ORDER BY i) AS text FROM g GROUP BY doc_id, target, segment)"""


@query("c14_structural_segments", f"WITH {SEGMENTS} SELECT doc_id, CAST(segment AS INT) AS segment, kind, CAST(first_line AS INT) AS first_line, md5(text) AS digest FROM s")
def _(t):
    return S.segments(t("documents"), "doc_id", "text").select("doc_id", "segment", "kind", "first_line", F.md5(F.col("text").cast("binary")).alias("digest"))


CUTS = " ".join(f"WHEN target = {n} AND length(y) > {n} THEN regexp_extract_all(y, '{S.cut_pattern(n)}')" for n in S.sizes())
CHUNKS = f"""WITH {SEGMENTS}, f AS (SELECT *, CASE WHEN lead(segment) OVER (PARTITION BY doc_id ORDER BY segment) IS NULL THEN text ELSE text || chr(10) END AS y FROM s),
p AS (SELECT *, CASE {CUTS} ELSE [y] END AS cut FROM f), q AS (SELECT doc_id, target, segment, kind, unnest(cut) AS v, generate_subscripts(cut, 1) AS piece FROM p),
a AS (SELECT *, sum(length(v)) OVER o - length(v) AS start, sum(CASE WHEN kind = 'heading' AND piece = 1 THEN 1 ELSE 0 END) OVER o AS section FROM q WHERE length(v) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY segment, piece)),
j AS (SELECT doc_id, section, CAST(floor(start * 1e0 / target) AS BIGINT) AS cell, min(start) AS start, sum(length(v)) AS size, string_agg(v, '' ORDER BY start) AS text, coalesce(arg_min(kind, start) FILTER (kind <> 'blank'), 'blank') AS kind FROM a GROUP BY doc_id, section, cell),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index FROM j),
h AS (SELECT *, list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '') AS ss FROM n)
SELECT doc_id, chunk_index, kind, CASE WHEN section > 0 THEN min(chunk_index) OVER (PARTITION BY doc_id, section) END AS parent, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size, {_case("text", S.ACTS, "statement")} AS act,
  round(len(list_filter(ss, lambda x: regexp_matches(x, '{S.CLAIM}'))) * 1e0 / greatest(len(ss), 1), 6) AS claims, md5(text) AS digest FROM h"""


@query("c9_discourse_chunks", CHUNKS)
def _(t):
    """Chunks by structure, cut and joined to a size that follows the text (also C11), with parents and speech acts."""
    made = S.chunks(t("documents"), "doc_id", "text")
    return made.select("doc_id", "chunk_index", "kind", "parent", "start", "size", "act", "claims", F.md5(F.col("text").cast("binary")).alias("digest"))
