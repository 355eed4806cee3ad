"""Identifiers and personal data in documents, with overlaps resolved and matches validated."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.patterns import FLAGS, HELD, IDENTIFIERS, PERSONAL
from siltstone.operators import matching as M
from siltstone.registry import query


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


PLAIN = "x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F°]', ' ', 'g') AS t FROM documents)"


@query(
    "f26_identifiers",
    f"WITH {PLAIN} SELECT doc_id, category, pattern, CAST(len(h) AS BIGINT) AS n, h[1] AS first, h[-1] AS last FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{n}' AS pattern, regexp_extract_all(t, {_quoted(FLAGS + p)}) AS h FROM x" for c, n, p in IDENTIFIERS)
    + ") y WHERE len(h) > 0",
)
def _(t):
    found = M.detected(t("documents"), "doc_id", "text", IDENTIFIERS, FLAGS, HELD)
    return found.select("doc_id", "category", "pattern", F.size("matches").cast("long").alias("n"), F.get("matches", F.lit(0)).alias("first"), F.element_at("matches", -1).alias("last"))


def _resolved_sql(patterns: list[tuple[str, str, str]]) -> str:
    """Matches of (kind, pattern, confidence as SQL over the match) with places and their number in the document; k: the last one kept after each."""
    every = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(t, {_quoted(p)}) AS e, string_split_regex(t, {_quoted(p)}) AS g FROM x" for k, p, _ in patterns)
    sure = " ".join(f"WHEN '{k}' THEN {c}" for k, _, c in patterns)
    return f"""WITH RECURSIVE {PLAIN}, f AS ({every}),
r AS (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM f), s AS (SELECT doc_id, kind, e[i] AS match, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(e[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS start FROM r),
m AS MATERIALIZED (SELECT *, CASE kind {sure} END AS confidence, start + length(match) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, start + length(match), kind) AS n FROM s),
k AS (SELECT doc_id, n, kind, confidence, match, start, stop, true AS fresh FROM m WHERE n = 1
  UNION ALL SELECT m.doc_id, m.n, CASE WHEN o THEN k.kind ELSE m.kind END, CASE WHEN o THEN k.confidence ELSE m.confidence END, CASE WHEN o THEN k.match ELSE m.match END, CASE WHEN o THEN k.start ELSE m.start END, CASE WHEN o THEN k.stop ELSE m.stop END, m.start >= k.stop
  FROM k JOIN m ON m.doc_id = k.doc_id AND m.n = k.n + 1, LATERAL (SELECT m.start < k.stop AND m.confidence <= k.confidence AS o) z)
"""


RESOLVED = _resolved_sql([(k, p, f"{c}e0") for k, p, c in PERSONAL])
KEPT = "SELECT doc_id, kind, start, stop AS \"end\", match, confidence FROM (SELECT *, lead(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM k) q WHERE next IS NULL OR next"
#: Kinds whose longer match wins.
BY_LENGTH = [("email", r"[\w.+-]+@[\w.-]+\.\w+", 1.0), ("number", r"\d[\d ()-]{5,}\d", 1.0), ("url", r"https?://\S+", 1.0)]


@query("n2_overlap_resolution", f"{_resolved_sql([(k, p, 'length(match)') for k, p, _ in BY_LENGTH])} SELECT doc_id, kind, start, \"end\" FROM ({KEPT}) w")
def _(t):
    """In order of start: a match that overlaps the last one kept replaces it if it is longer, else goes."""
    found = M.places(t("documents"), "doc_id", "text", BY_LENGTH).withColumn("confidence", F.length("match"))
    return M.resolved(found).select("doc_id", "kind", "start", "end")


@query("n2_resolved_matches", f"{RESOLVED} SELECT doc_id, kind, start, \"end\", match FROM ({KEPT}) w")
def _(t):
    return M.resolved(M.places(t("documents"), "doc_id", "text", PERSONAL)).select("doc_id", "kind", "start", "end", "match")


#: Digits from the right, every second one doubled.
LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) WHEN CAST(d[i] AS INT) > 4 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END)) % 10 = 0"


@query(
    "f29_validated_artefacts",
    f"""{RESOLVED}, v AS (SELECT *, regexp_replace(match, '[^0-9]', '', 'g') AS d FROM ({KEPT}) w WHERE confidence >= 0.5)
    SELECT doc_id, kind, match AS value, confidence, CASE kind WHEN 'card' THEN length(d) > 11 AND {LUHN} WHEN 'ip' THEN len(list_filter(string_split(match, '.'), lambda y: CAST(y AS INT) > 255)) = 0 ELSE true END AS valid FROM v""",
)
def _(t):
    """Matches of confidence 0.5 and more, cards checked by their digits and addresses by their parts."""
    kept = M.resolved(M.places(t("documents"), "doc_id", "text", PERSONAL)).where("confidence >= 0.5")
    valid = F.when(F.col("kind") == "card", M.digits_valid(F.col("match"))).when(F.col("kind") == "ip", M.octets_valid(F.col("match"))).otherwise(F.lit(True))
    return kept.select("doc_id", "kind", F.col("match").alias("value"), "confidence", valid.alias("valid"))
