"""Operators stated in SQL that both engines read: predicates, joins, aggregates, windows, scores and text rules.

Spark runs the text over the tables as DataFrames, so that filters and columns reach the scans and joins are Catalyst's; the
other engine runs it with its own names for the same functions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from siltstone.registry import query

#: Functions by the other engine's names.
NAMES = {"size": "len", "split": "string_split_regex", "explode": "unnest", "transform": "list_transform", "filter": "list_filter", "regexp_like": "regexp_matches", "array_join": "array_to_string", "struct": "row", "slice": "list_slice"}


def doubles(text: str) -> str:
    """Decimal literals as doubles, in either engine."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)


def other_text(text: str) -> str:
    out = re.sub(r"unix_micros\(cast\(([\w.]+) as timestamp\)\)", r"epoch_us(\1)", text)
    out = re.sub(r"\b(" + "|".join(NAMES) + r")\(", lambda m: NAMES[m[1]] + "(", out)
    return re.sub(r"\b(\w) -> ", r"lambda \1: ", out).replace("/*g*/", ", 'g'")


def places(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))


def other_sql(text: str) -> str:
    """The text as the other engine reads it."""
    return doubles(text).format(**{x: x for x in places(text)})


def frame(t, text: str):
    """The rows of SQL over {table} places."""
    frames = {x: t(x) for x in places(text)}
    return next(iter(frames.values())).sparkSession.sql(doubles(text), **frames)


def statement(name: str, text: str, other: str | None = None) -> None:
    """Register SQL over {table} places; `other` where the other engine needs a text of its own."""
    @query(name, other_sql(other or other_text(text)))
    def _(t):
        return frame(t, text)


# -- predicates ---------------------------------------------------------------------------------

statement("p4_entity_lookup", "SELECT c_custkey, c_name FROM {customer} WHERE contains(c_name, '7') AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50")
statement("p5_relation_lookup", "SELECT DISTINCT s_name, l_returnflag, p_name FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey WHERE contains(s_name, '1') AND l_returnflag = 'R' AND contains(p_name, 'ring')")
statement("p6_provenance_search", "SELECT doc_id FROM {documents} WHERE source IN ('src1', 'src6') AND lang = 'en' AND (contains(lower(text), 'thou') OR contains(lower(source), 'thou'))")
statement("p11_priority_band", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority BETWEEN '2' AND '4' AND o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'")
statement("p14_source_score_filter", "SELECT source, n, score FROM (SELECT source, count(*) AS n, round(avg(least(n_chars / 1000.0, 1.0)), 6) AS score FROM {documents} GROUP BY source) x WHERE score >= 0.5 ORDER BY score DESC, source LIMIT 12")

# -- joins --------------------------------------------------------------------------------------

WORDS = "array_distinct(filter(split(lower(text), '[^a-zàâçéèêëîïôûùüäöß]+'), x -> x <> ''))"
statement(
    "j4_word_overlap_pairs",
    f"""WITH w AS (SELECT item_id, explode({WORDS}) AS w FROM {{benchmark}}), n AS (SELECT item_id, count(*) AS n FROM w GROUP BY item_id),
    p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS both_ FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id)
    SELECT a, b, round(both_ * 1.0 / (x.n + y.n - both_), 6) AS sim FROM p JOIN n x ON a = x.item_id JOIN n y ON b = y.item_id WHERE both_ * 10 > (x.n + y.n - both_)""",
)
statement(
    "j7_cross_document_equi_join",
    "SELECT a.p_partkey AS a, b.p_partkey AS b, round(least(1.0, 0.8 + CASE WHEN a.p_brand = b.p_brand THEN 0.2 ELSE 0.0 END), 6) AS sim FROM {part} a JOIN {part} b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey",
)
statement(
    "j13_entity_products",
    """WITH e AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s, l_partkey AS p FROM {lineitem}),
    r AS (SELECT k, 's' AS kind, s AS x, o_custkey AS y, 0.5 AS conf FROM e JOIN {orders} ON k = o_orderkey UNION SELECT k, 'p', p, o_custkey, 0.4 FROM e JOIN {orders} ON k = o_orderkey)
    SELECT k, kind, x, y, conf FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conf DESC, kind, x) AS n FROM r) z WHERE n <= 5""",
)
statement(
    "j18_relevant_citations",
    f"""WITH s AS (SELECT conv_id, turn, {WORDS} AS w FROM {{conversations}}),
    p AS (SELECT a.conv_id, a.turn AS claim, b.turn AS citation, size(array_intersect(a.w, b.w)) AS shared FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn <> b.turn)
    SELECT conv_id, claim, citation, shared FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, claim ORDER BY citation) AS n FROM p WHERE shared >= 3) z WHERE n <= 5""",
)
statement(
    "j12_cross_language_pairs",
    """WITH g AS (SELECT DISTINCT lang, explode(array_distinct(filter(split(lower(text), '[^a-z]+'), x -> length(x) >= 3))) AS w FROM {documents} WHERE lang IS NOT NULL),
    n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang), p AS (SELECT a.lang AS a, b.lang AS b, count(*) AS both_ FROM g a JOIN g b ON a.w = b.w AND a.lang < b.lang GROUP BY a.lang, b.lang)
    SELECT a, b, both_, round(both_ * 1.0 / (x.n + y.n - both_), 6) AS sim FROM p JOIN n x ON a = x.lang JOIN n y ON b = y.lang""",
)

# -- aggregates -----------------------------------------------------------------------------------

statement(
    "a4_warehouse_stats",
    """WITH w AS (SELECT w, count(*) AS n FROM (SELECT explode(filter(split(lower(text), '[^a-z]+'), x -> length(x) >= 3)) AS w FROM {documents}) x GROUP BY w)
    SELECT 'source' AS kind, source AS name, count(*) AS n FROM {documents} GROUP BY source UNION ALL SELECT * FROM (SELECT 'word' AS kind, w AS name, n FROM w ORDER BY n DESC, w LIMIT 20) y""",
)
statement("a5_dataset_analysis", "SELECT 'text' AS name, count(*) AS n, count(text) AS present, CAST(sum(length(text)) AS BIGINT) AS chars FROM {documents} UNION ALL SELECT 'lang', count(*), count(lang), CAST(sum(length(lang)) AS BIGINT) FROM {documents} UNION ALL SELECT 'source', count(*), count(source), CAST(sum(length(source)) AS BIGINT) FROM {documents}")
statement("a6_document_store_stats", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(CAST(quality AS DOUBLE)), 6) AS quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source")
statement(
    "a8_metric_summary",
    "SELECT event_type, max_by(value, struct(ts, event_id)) AS last_value, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM {events} WHERE ts > (SELECT max(ts) FROM {events}) - INTERVAL 7 DAY GROUP BY event_type",
)
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
statement("a10_session_stats", f"SELECT {HOST} AS domain, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS size_, count(DISTINCT url) AS urls, round(avg(length(html)), 4) AS mean FROM {{pages}} GROUP BY {HOST}")
statement("a11_discovery_stats", "SELECT coalesce(nullif(lang, 'de'), 'unknown') AS category, count(*) AS n, count(DISTINCT source) AS sources, round(avg(n_chars), 4) AS mean FROM {documents} GROUP BY coalesce(nullif(lang, 'de'), 'unknown')")
statement("a12_source_breakdown", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
statement(
    "a14_pattern_summary",
    "SELECT l_returnflag, CASE WHEN l_discount > 0.07 THEN 'strong' WHEN l_discount > 0.03 THEN 'moderate' ELSE 'weak' END AS band, count(*) AS n, round(avg(l_tax), 6) AS mean, max(l_tax) AS high, count_if(l_tax > 0.05) AS over FROM {lineitem} GROUP BY l_returnflag, CASE WHEN l_discount > 0.07 THEN 'strong' WHEN l_discount > 0.03 THEN 'moderate' ELSE 'weak' END",
)
statement("a19_weekly_alerts", "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL 7 DAY AND value > 20 GROUP BY event_type")
statement("a20_audit_statistics", "SELECT event_type, CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM {events} GROUP BY event_type, CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'warning' ELSE 'info' END")
statement("a29_entity_type_counts", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM {conversations} GROUP BY role")
statement("a30_reporting_averages", "SELECT o_orderpriority, round(avg(n), 6) AS claims, round(avg(q), 6) AS citations, count_if(bad > 0) AS contradicted FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, count_if(l_returnflag = 'R') AS bad FROM {lineitem} GROUP BY l_orderkey) x JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
statement("a16_claim_graph_statistics", "WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM {lineitem}) SELECT l_returnflag, count(*) AS edges, count(DISTINCT l_orderkey) AS claims, count(DISTINCT l_suppkey) AS sources, round(count(*) * 1.0 / (count(DISTINCT l_orderkey) * count(DISTINCT l_suppkey)), 8) AS density FROM e GROUP BY l_returnflag")

# -- windows, sorts and sets ----------------------------------------------------------------------

statement(
    "w5_change_detection",
    """WITH s AS (SELECT conv_id, turn, substr(regexp_replace(text, '[^a-zA-Z ]', ''/*g*/), 1, 200) AS t FROM {conversations}), p AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
    SELECT conv_id, turn, round(1 - levenshtein(t, b) * 1.0 / greatest(length(t), length(b), 1), 6) AS sim FROM p WHERE b IS NOT NULL AND levenshtein(t, b) * 10 > greatest(length(t), length(b))""",
)
statement("w6_evolution_series", "SELECT y, n, round(n * 1.0 / lag(n) OVER (ORDER BY y), 6) AS ratio FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY year(o_orderdate)) x")
statement(
    "t5_important_relationships",
    "SELECT l_suppkey, l_partkey, score FROM (SELECT l_suppkey, l_partkey, round(0.4 * least(1.0, sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 10.0)) + 0.3 * least(1.0, count(*) / 5.0) + 0.3 * least(1.0, count(DISTINCT l_orderkey) / 10.0), 6) AS score FROM {lineitem} GROUP BY l_suppkey, l_partkey) x WHERE score > 0.5 ORDER BY score DESC, l_suppkey, l_partkey LIMIT 20",
)
statement("u3_distinct_by_identifier", "SELECT k, min(page_id) AS page_id FROM (SELECT nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS k, page_id FROM {pages}) x WHERE k IS NOT NULL GROUP BY k")
statement(
    "u4_distinct_sources_per_claim",
    """WITH f AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM {lineitem})
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS m FROM f WHERE n = 1) x WHERE m <= 4""",
)
statement("u7_first_per_document_id", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM {lineitem}) x WHERE n = 1")

# -- scalar rules ---------------------------------------------------------------------------------

statement("f7_domain_authority", f"SELECT page_id, CASE WHEN {HOST} LIKE '%.org' THEN 0.9 WHEN {HOST} LIKE 'm.%' THEN 0.63 WHEN contains({HOST}, '.com') THEN 0.72 ELSE 0.5 END AS authority FROM {{pages}}")
AGE = "((unix_micros(cast(ts as timestamp)) - 1704067200000000) / 86400000000.0)"
statement("f16_temporal_score", f"SELECT event_id, round(CASE WHEN {AGE} <= 10 THEN least(1.0, 1.5 * (1 - {AGE} / 30)) ELSE greatest(0.1, exp(-{AGE} / 365.0)) END * 0.5 + 0.25, 6) AS score FROM {{events}}")
HITS = lambda words: f"size(regexp_extract_all(lower(text), '{words}', 0))"
statement(
    "f17_intent_classifier",
    f"""SELECT conv_id, turn, a, b, c, CASE WHEN a >= b AND a >= c AND a > 0 THEN 'factual' WHEN b >= c AND b > 0 THEN 'comparative' WHEN c > 0 THEN 'procedural' ELSE 'none' END AS intent
    FROM (SELECT conv_id, turn, {HITS('wh[a-z]+|que|was')} AS a, {HITS('or |ou |oder')} AS b, {HITS('how|wie|to ')} AS c FROM {{conversations}}) x""",
)
statement("f20_entity_patterns", f"SELECT doc_id, {HITS('[a-z0-9_.]+@[a-z0-9.]+')} AS emails, {HITS('https?://[a-z0-9./]+')} AS urls, {HITS('[0-9][0-9][0-9][- ][0-9][0-9][0-9][0-9]')} AS phones, {HITS('[0-9a-f]{{32}}')} AS hashes FROM {{documents}}")
statement("f27_pattern_category", "SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') OR contains(p_type, 'TIN') THEN 'soft' WHEN contains(p_type, 'STEEL') THEN 'hard' WHEN contains(p_type, 'ECONOMY') THEN 'cheap' ELSE 'miscellaneous' END AS category FROM {part}")
CONF = f"least(1.0, greatest(0.1, 0.7 + 0.1 * {HITS('and|und|et')} - 0.2 * {HITS('[*#%]+')}))"
statement("f28_pattern_confidence", f"SELECT doc_id, round({CONF}, 6) AS confidence FROM {{documents}}")
statement("f29_artefacts", f"SELECT lang, count(*) AS n, round(avg({CONF}), 4) AS mean FROM {{documents}} WHERE {CONF} >= 0.5 GROUP BY lang")
#: Common words of a language, without letters beyond a-z.
COMMON = {"de": "der die und nicht mit", "en": "the and of with that", "es": "el los que por con", "fr": "le les et pas des"}
_SHARE = {k: " + ".join(f"CASE WHEN contains(' ' || lower(text) || ' ', ' {w} ') THEN 1 ELSE 0 END" for w in v.split()) for k, v in COMMON.items()}
statement(
    "f34_language_detection",
    "SELECT doc_id, de, en, es, fr, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'english' WHEN de >= en AND de >= es AND de >= fr THEN 'german' WHEN en >= es AND en >= fr THEN 'english' WHEN es >= fr THEN 'spanish' ELSE 'french' END AS language FROM (SELECT doc_id, "
    + ", ".join(f"{v} AS {k}" for k, v in _SHARE.items()) + " FROM {documents}) x",
)
KEYS = "slice(filter(regexp_extract_all(lower(text), '[a-z]+', 0), x -> length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'that', 'with')), 1, 20)"
statement("f41_query_keywords", f"SELECT item_id, array_join({KEYS}, ' ') AS words, size({KEYS}) AS n FROM {{benchmark}}")
N_WORDS = "greatest(size(filter(split(text, '[^a-zA-Z]+'), x -> x <> '')), 1)"
statement("f42_claim_density", f"SELECT doc_id, round(({HITS('[0-9]+')} + {HITS('that|dass|que')} + {HITS('[%]')}) * 1.0 / {N_WORDS}, 6) AS density FROM {{documents}}")
statement(
    "f44_speech_act",
    f"""SELECT conv_id, turn, CASE WHEN greatest(q, c, s) = 0 THEN 'statement' WHEN q >= c AND q >= s THEN 'question' WHEN c >= s THEN 'commitment' ELSE 'sequence' END AS act
    FROM (SELECT conv_id, turn, {HITS('[?]')} AS q, {HITS('will|werden|vais')} AS c, {HITS('then|dann|puis')} AS s FROM {{conversations}}) x""",
)
statement(
    "f45_line_diff",
    """WITH s AS (SELECT conv_id, turn, split(text, '[.]') AS a, lag(split(text, '[.]')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM {conversations})
    SELECT conv_id, turn, size(filter(a, x -> NOT array_contains(b, x))) AS additions, size(filter(b, x -> NOT array_contains(a, x))) AS deletions FROM s WHERE b IS NOT NULL""",
)

# -- chunks, budgets and quality --------------------------------------------------------------------

statement("c10_claims_per_hundred", f"SELECT doc_id, round(({HITS('that|dass|que')} + {HITS('[0-9]+')}) / greatest({N_WORDS} / 100.0, 1.0), 6) AS density FROM {{documents}}")
statement(
    "c18_source_budgets",
    "SELECT source, available, CAST(least(available, floor(20000 * priority / sum(priority) OVER ())) AS BIGINT) AS budget FROM (SELECT source, CAST(sum(floor(n_chars / 4)) AS BIGINT) AS available, count(*) AS priority FROM {documents} GROUP BY source) x",
)
statement("c20_compression_quality", "SELECT conv_id, round(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) * 1.0 / sum(length(text)), 6) AS tokens, round(avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END), 6) AS matches, count(DISTINCT role) AS roles FROM {conversations} GROUP BY conv_id")
statement("q6_semantic_coherence", "SELECT doc_id, count(*) AS sentences, round(greatest(0.0, 1 - coalesce((sum(n * n) - sum(n) * 1.0 * sum(n) / count(*)) / nullif(count(*) - 1, 0), 0.0) / 100.0), 3) AS coherence FROM (SELECT doc_id, size(split(s, '[ ]+')) AS n FROM (SELECT doc_id, explode(filter(split(text, '[.]'), x -> trim(x) <> '')) AS s FROM {documents}) y) z GROUP BY doc_id")
statement("q7_rigor_rules", "SELECT doc_id, CASE WHEN regexp_like(text, '[0-9]+ ?%') THEN 0.4 ELSE 0.0 END + CASE WHEN regexp_like(text, '[0-9][0-9]+') THEN 0.3 ELSE 0.0 END AS rigor, CASE WHEN regexp_like(lower(text), 'worthless|idiot|stupid') THEN 1 ELSE 0 END AS controversy FROM {documents}")
statement(
    "q14_linguistic_features",
    "SELECT doc_id, n, round(n * 1.0 / greatest(s, 1), 6) AS sentence_length, round(d * 1.0 / greatest(n, 1), 6) AS richness, round(c * 1.0 / greatest(n, 1), 6) AS complex_share FROM (SELECT doc_id, size(w) AS n, size(array_distinct(w)) AS d, size(filter(w, x -> length(x) > 6)) AS c, s FROM (SELECT doc_id, filter(split(lower(text), '[^a-z]+'), x -> x <> '') AS w, size(filter(split(text, '[.]'), x -> trim(x) <> '')) AS s FROM {documents}) y) z",
)

# -- fusion, duplicates and evaluation ---------------------------------------------------------------

RANKS = "r AS (SELECT l_suppkey AS q, l_partkey AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS b, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rel FROM {lineitem} GROUP BY l_suppkey, l_partkey)"
statement(
    "r7_rrf_k_optimisation",
    f"""WITH {RANKS}, k AS (SELECT explode(array(10, 30, 60, 100)) AS k), f AS (SELECT k, q, d, rel, row_number() OVER (PARTITION BY k, q ORDER BY round(1.0 / (k + a) + 1.0 / (k + b), 12) DESC, d) AS n FROM r CROSS JOIN k)
    SELECT k, round(avg(CASE WHEN n <= 10 THEN CAST(rel AS DOUBLE) END), 6) AS precision_at_10, round(sum(CASE WHEN n <= 10 THEN rel ELSE 0 END) * 1.0 / sum(rel), 6) AS recall_at_10 FROM f GROUP BY k""",
    other_text(f"""WITH {RANKS}, k AS (SELECT unnest([10, 30, 60, 100]) AS k), f AS (SELECT k, q, d, rel, row_number() OVER (PARTITION BY k, q ORDER BY round(1.0 / (k + a) + 1.0 / (k + b), 12) DESC, d) AS n FROM r CROSS JOIN k)
    SELECT k, round(avg(CASE WHEN n <= 10 THEN CAST(rel AS DOUBLE) END), 6) AS precision_at_10, round(sum(CASE WHEN n <= 10 THEN rel ELSE 0 END) * 1.0 / sum(rel), 6) AS recall_at_10 FROM f GROUP BY k"""),
)
statement("r9_fusion_distributions", "SELECT source, lang, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM {documents} GROUP BY source, lang")
DIFFER = " + ".join(f"CASE WHEN a.{c} <> b.{c} THEN 1 ELSE 0 END" for c in ("l_returnflag", "l_linestatus", "l_discount", "l_tax"))
statement("r13_diversity_ratio", f"SELECT a.l_orderkey, round(avg(CASE WHEN {DIFFER} >= 2 THEN 1.0 ELSE 0.0 END), 6) AS diversity FROM {{lineitem}} a JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey")
statement(
    "r19_ranking_features",
    f"SELECT d.doc_id, length(text) AS chars, {N_WORDS} AS words, {HITS('the')} AS hits, CASE WHEN contains(lower(text), 'the and') THEN 1 ELSE 0 END AS phrase, coalesce(quality, -1) AS label, round(1.0 / (60 + row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id)), 9) AS rank_score FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id",
)
statement(
    "d8_ranked_list_dedup",
    """WITH u AS (SELECT 1 AS src, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos, p_brand, md5(p_name || p_type) AS k FROM {part} UNION ALL SELECT 2, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey), p_brand, md5(p_name || p_type) FROM {part})
    SELECT p_brand, k, src, p_partkey, pos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, k ORDER BY pos, src, p_partkey) AS n FROM u) x WHERE n = 1""",
)
statement(
    "d9_dedup_metrics",
    """WITH d AS (SELECT doc_id, md5(text) AS k, concat(coalesce(lang, ''), '|', CAST(n_chars AS STRING)) AS g FROM {documents}), t AS (SELECT CAST(sum(n * (n - 1)) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM d GROUP BY k) x),
    p AS (SELECT CAST(sum(n * (n - 1)) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM d GROUP BY g) x), h AS (SELECT CAST(sum(n * (n - 1)) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM d GROUP BY k, g) x)
    SELECT h.pairs AS hits, round(h.pairs * 1.0 / p.pairs, 6) AS precision_, round(h.pairs * 1.0 / t.pairs, 6) AS recall FROM t CROSS JOIN p CROSS JOIN h""",
)
statement("e10_context_efficiency", "SELECT conv_id, round(sum(CASE WHEN role = 'user' THEN 1.0 ELSE 0.5 END) * 1000.0 / greatest(sum(floor(length(text) / 4)), 1), 6) AS per_thousand FROM {conversations} GROUP BY conv_id")
statement("e14_validation_gates", "SELECT user_id, count(*) >= 60 AS enough, max(value) < 200 AS bounded, count(DISTINCT event_type) = 5 AS complete, bool_and(value >= 0) AS positive, count(*) >= 60 AND max(value) < 200 AND count(DISTINCT event_type) = 5 AND bool_and(value >= 0) AS passed FROM {events} GROUP BY user_id")
statement("e15_domain_ratios", f"SELECT regexp_extract(url, '/(de|en|es|fr)/', 1) AS area, round(avg(CASE WHEN contains({HOST}, '.com') THEN 1.0 ELSE 0.0 END), 6) AS com_share, round(avg(CASE WHEN contains(lower(html), 'the ') THEN 1.0 ELSE 0.0 END), 6) AS word_share FROM {{pages}} GROUP BY regexp_extract(url, '/(de|en|es|fr)/', 1)")

# -- claims and graph --------------------------------------------------------------------------------

statement("k2_semantic_contradiction", "SELECT a.p_partkey AS a, b.p_partkey AS b, round((a.p_size - 25) / 25.0 * ((b.p_size - 25) / 25.0), 6) AS product FROM {part} a JOIN {part} b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE (a.p_size - 25) * (b.p_size - 25) < -0.3 * 625")
statement("k3_temporal_contradiction", "SELECT a.o_orderkey AS a, b.o_orderkey AS b, abs(year(a.o_orderdate) - year(b.o_orderdate)) AS years FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey WHERE year(a.o_orderdate) <> year(b.o_orderdate)")
statement("k9_disagreement_coverage", "SELECT l_partkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) + least(0.3, sum(CAST(l_quantity AS BIGINT)) / (count(*) * 200.0)), 6) AS coverage FROM {lineitem} GROUP BY l_partkey")
statement("k12_support_score", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, round(0.6 * CASE WHEN a.l_returnflag = b.l_returnflag THEN 1 ELSE 0 END + 0.4 * least(a.l_quantity, b.l_quantity) / greatest(a.l_quantity, b.l_quantity), 6) AS support FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
statement("k17_correlation_strength", "SELECT l_orderkey, l_linenumber, strength FROM (SELECT l_orderkey, l_linenumber, round((0.4 * l_discount * 10 + 0.3 * l_tax * 10 + 0.3 * l_quantity / 50.0) / (0.4 + 0.3 + 0.3), 6) AS strength FROM {lineitem}) x WHERE strength >= 0.5")
statement("k15_report_contradictions", "SELECT a.conv_id, a.turn AS a, b.turn AS b FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE (contains(lower(a.text), ' not ') OR contains(lower(a.text), ' nicht ') OR contains(lower(a.text), ' pas ')) <> (contains(lower(b.text), ' not ') OR contains(lower(b.text), ' nicht ') OR contains(lower(b.text), ' pas '))")
statement("g1_node_upsert", "SELECT user_id, last_type, mentions, sources FROM (SELECT user_id, max_by(event_type, struct(ts, event_id)) AS last_type, count(*) AS mentions, count(DISTINCT event_type) AS sources FROM {events} GROUP BY user_id) x")
statement("g2_edge_upsert", "SELECT l_suppkey, l_returnflag, l_partkey, count(*) AS seen, max(l_discount) AS confidence, max(l_orderkey) AS last_source FROM {lineitem} GROUP BY l_suppkey, l_returnflag, l_partkey")
statement("g13_pattern_relations", "SELECT doc_id, regexp_extract(lower(text), '([a-z]+) (and|of|und|et) ([a-z]+)', 1) AS subject, regexp_extract(lower(text), '([a-z]+) (and|of|und|et) ([a-z]+)', 2) AS kind, regexp_extract(lower(text), '([a-z]+) (and|of|und|et) ([a-z]+)', 3) AS object FROM {documents} WHERE regexp_like(lower(text), '([a-z]+) (and|of|und|et) ([a-z]+)')")
statement("g14_entity_extraction", "SELECT conv_id, entity, count(*) AS n FROM (SELECT conv_id, explode(regexp_extract_all(text, '[A-Z][a-z]+', 0)) AS entity FROM {conversations}) x GROUP BY conv_id, entity")
statement("g15_subgraph_relevance", "SELECT doc_id, (" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in "thou onen erle tion ung und que the der dass".split()) + ") / 10.0 AS relevance FROM {documents}")
statement("g19_relationship_typing", "SELECT l_orderkey, l_linenumber, CASE WHEN s_nationkey = c_nationkey THEN 'domestic' WHEN s_nationkey % 5 = c_nationkey % 5 THEN 'regional' WHEN l_returnflag = 'R' THEN 'disputed' ELSE 'foreign' END AS kind FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey")
CHAIN = "c AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM {orders} a JOIN {orders} b ON b.o_orderkey = a.o_orderkey + 1 AND a.o_orderpriority = b.o_orderpriority AND a.o_custkey <> b.o_custkey)"
statement(
    "g6_paths_between",
    f"WITH {CHAIN}, u AS (SELECT src, dst FROM c UNION SELECT dst, src FROM c) SELECT 1 AS hops, count(*) AS paths FROM u WHERE src = 1 AND dst = 7 UNION ALL SELECT 2, count(*) FROM u x JOIN u y ON x.dst = y.src WHERE x.src = 1 AND y.dst = 7 UNION ALL SELECT 3, count(*) FROM u x JOIN u y ON x.dst = y.src JOIN u z ON y.dst = z.src WHERE x.src = 1 AND z.dst = 7",
)

# -- streams at rest, governance, insights --------------------------------------------------------------

statement("x11_backoff", "SELECT user_id, failures, least(power(2.0, failures), 3600.0) AS wait FROM (SELECT user_id, count_if(event_type = 'error') AS failures FROM {events} GROUP BY user_id) x")
statement("x12_trailing_range", "SELECT e.user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high FROM {events} e JOIN (SELECT user_id, max(ts) AS newest FROM {events} GROUP BY user_id) l ON e.user_id = l.user_id WHERE ts >= newest - INTERVAL 1 DAY GROUP BY e.user_id")
NUMBER = "CAST(1000000000 + o_orderkey * 104729 AS STRING)"
statement(
    "n5_luhn", f"SELECT o_orderkey, luhn_check({NUMBER}) AS valid FROM {{orders}}",
    f"SELECT o_orderkey, list_sum(list_transform(range(0, length({NUMBER})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({NUMBER}, length({NUMBER}) - i, 1) AS INT) ELSE (CAST(substr({NUMBER}, length({NUMBER}) - i, 1) AS INT) * 2) % 10 + (CAST(substr({NUMBER}, length({NUMBER}) - i, 1) AS INT) * 2) // 10 END)) % 10 = 0 AS valid FROM {{orders}}",
)
statement("n9_provenance_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey")
statement("m2_findings_with_context", "SELECT doc_id, regexp_extract(text, '.{{0,40}}(worthless|idiot|stupid).{{0,40}}', 0) AS finding FROM {documents} WHERE regexp_like(text, '(worthless|idiot|stupid)')")
statement("m11_placeholder_redaction", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[a-zA-Z0-9_.]+@[a-zA-Z0-9.]+', '[REDACTED_EMAIL]'/*g*/), '[0-9][0-9][0-9][- ][0-9][0-9][0-9][0-9]', '[REDACTED_PHONE]'/*g*/)) AS h FROM {documents}")

# -- fuller forms --------------------------------------------------------------------------------------

#: Formats of the cascade: Spark's, the other engine's.
FORMATS = [("yyyy-MM-dd", "%Y-%m-%d"), ("dd/MM/yyyy", "%d/%m/%Y"), ("yyyyMMdd", "%Y%m%d"), ("dd.MM.yyyy", "%d.%m.%Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd MMM yyyy", "%d %b %Y"), ("MMM dd, yyyy", "%b %d, %Y"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("MM_dd_yyyy", "%m_%d_%Y")]
_made = lambda f: "CASE " + " ".join(f"WHEN o_orderkey % {len(FORMATS) + 1} = {i} THEN {f(i)}" for i in range(len(FORMATS))) + " ELSE 'no date' END"
statement(
    "f9_date_cascade_formats",
    "SELECT o_orderkey, cast(coalesce(" + ", ".join(f"try_to_timestamp(s, '{a}')" for a, _ in FORMATS) + ") as date) AS d FROM (SELECT o_orderkey, " + _made(lambda i: f"date_format(o_orderdate, '{FORMATS[i][0]}')") + " AS s FROM {orders}) x",
    "SELECT o_orderkey, CAST(coalesce(" + ", ".join(f"try_strptime(s, '{b}')" for _, b in FORMATS) + ") AS DATE) AS d FROM (SELECT o_orderkey, " + _made(lambda i: f"strftime(o_orderdate, '{FORMATS[i][1]}')") + " AS s FROM {orders}) x",
)
IDS = "CASE o_orderkey % 4 WHEN 0 THEN concat('see doi:10.', 1000 + o_orderkey % 9000, '/jour.', o_orderkey, ' there') WHEN 1 THEN concat('arXiv:2101.', 10000 + o_orderkey, 'v2') WHEN 2 THEN concat('PMID: ', o_orderkey * 7) ELSE 'none here 12' END"
statement(
    "f37_persistent_identifiers",
    f"SELECT o_orderkey, regexp_extract(s, '(10[.][0-9]{{{{4,9}}}}/[a-zA-Z0-9./_-]+)', 1) AS doi, regexp_extract(s, 'arXiv:([0-9]{{{{4}}}}[.][0-9]{{{{4,5}}}})', 1) AS arxiv, regexp_extract(s, 'PMID: ?([0-9]+)', 1) AS pmid FROM (SELECT o_orderkey, {IDS} AS s FROM {{orders}}) x",
)
statement("r2_rrf_with_priors", f"WITH {RANKS} SELECT q, d, round((0.7 / (60 + a) + 0.3 / (60 + b)) * (1 + 0.2 * p_size / 50.0 + CASE WHEN p_brand = 'Brand#1' THEN 0.1 ELSE 0.0 END), 9) AS score FROM r JOIN {{part}} ON d = p_partkey")
statement("r3_rrf_with_bonuses", f"WITH {RANKS} SELECT q, d, round(1.0 / (60 + a - 1) + 1.0 / (60 + b - 1) + CASE WHEN rel = 1 THEN 0.005 ELSE 0.0 END + 0.002 * p_size / 50.0, 9) AS score FROM r JOIN {{part}} ON d = p_partkey")
statement(
    "e4_binary_metrics",
    f"""WITH {RANKS}, i AS (SELECT q, sum(rel) AS total FROM r GROUP BY q), m AS (SELECT q, sum(CASE WHEN a <= 10 THEN rel / ln(a + 1) * ln(2) ELSE 0.0 END) AS dcg, sum(CASE WHEN a <= 10 THEN rel ELSE 0 END) AS hits, min(CASE WHEN rel = 1 THEN a END) AS first_hit FROM r GROUP BY q),
    g AS (SELECT i.q, sum(CASE WHEN a <= least(total, 10) THEN ln(2) / ln(a + 1) ELSE 0.0 END) AS ideal FROM r JOIN i ON r.q = i.q GROUP BY i.q)
    SELECT m.q, round(dcg / nullif(ideal, 0), 6) AS ndcg, round(hits * 1.0 / nullif(total, 0), 6) AS recall, round(coalesce(1.0 / first_hit, 0.0), 6) AS reciprocal_rank FROM m JOIN g ON m.q = g.q JOIN i ON m.q = i.q""",
)
statement(
    "a15_pattern_report",
    f"SELECT 'category' AS kind, CASE WHEN {HITS('[*#%]')} > 0 THEN 'symbols' WHEN {HITS('[0-9]')} > 0 THEN 'digits' ELSE 'plain' END AS name, count(*) AS n FROM {{documents}} GROUP BY CASE WHEN {HITS('[*#%]')} > 0 THEN 'symbols' WHEN {HITS('[0-9]')} > 0 THEN 'digits' ELSE 'plain' END UNION ALL SELECT 'confidence', CASE WHEN {CONF} >= 0.8 THEN 'high' WHEN {CONF} >= 0.5 THEN 'medium' ELSE 'low' END, count(*) FROM {{documents}} GROUP BY CASE WHEN {CONF} >= 0.8 THEN 'high' WHEN {CONF} >= 0.5 THEN 'medium' ELSE 'low' END",
)
statement(
    "a17_temporal_coverage",
    "SELECT event_type, n, days, round(days * 1.0 / span, 6) AS coverage, round(age / 86400000000.0, 4) AS mean_age FROM (SELECT event_type, count(*) AS n, count(DISTINCT cast(ts as date)) AS days, floor((max(unix_micros(cast(ts as timestamp))) - min(unix_micros(cast(ts as timestamp)))) / 86400000000.0) + 1 AS span, 1706659200000000 - avg(unix_micros(cast(ts as timestamp))) AS age FROM {events} GROUP BY event_type) x",
)
statement("a18_script_distribution", "SELECT lang, count(*) AS n, count_if(regexp_like(text, '[à-ÿ]')) AS accented, count_if(regexp_like(text, '[0-9]')) AS with_digits, count_if(NOT regexp_like(text, '[^a-zA-Z .,]')) AS plain FROM {documents} GROUP BY lang")
statement(
    "a22_weighted_overall_five",
    "SELECT user_id, round(0.3 * avg(least(value / 100.0, 1.0)) + 0.25 * avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) + 0.2 * avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) + 0.15 * (1 - avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)) + 0.1 * least(1.0, count(*) / 100.0), 6) AS overall FROM {events} GROUP BY user_id",
)
statement("a3_stats_by_source_type", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(doc_id) AS newest, round(avg(n_chars), 4) AS mean FROM {documents} GROUP BY source, lang")
statement("a9_security_summary", "SELECT 'type' AS kind, event_type AS name, count(*) AS n FROM {events} GROUP BY event_type UNION ALL SELECT 'last', CAST(event_id AS STRING), 1 FROM (SELECT event_id FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 10) x")
statement("m1_cost_per_claim", "SELECT o_orderpriority, o_orderkey, cost FROM (SELECT o_orderpriority, o_orderkey, cost, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cost DESC, o_orderkey) AS n FROM (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost FROM {lineitem} GROUP BY l_orderkey) x JOIN {orders} ON l_orderkey = o_orderkey) y WHERE n <= 10")
statement("w4_snapshot_significance", "SELECT user_id, event_id, CASE WHEN abs(value - b) > 50 THEN 'major' WHEN abs(value - b) > 10 THEN 'minor' ELSE 'none' END AS significance FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM {events}) x WHERE b IS NOT NULL")
#: Groups of opposites.
OPPOSITES = [("der", "die"), ("le", "la"), ("el", "los"), ("on", "in")]
_side = lambda c, w: f"contains(' ' || lower({c}.text) || ' ', ' {w} ')"
statement(
    "k1_antonym_contradiction",
    "SELECT a.conv_id, a.turn AS a, b.turn AS b, round(least(1.0, " + " + ".join(f"CASE WHEN {_side('a', x)} AND NOT {_side('a', y)} AND {_side('b', y)} AND NOT {_side('b', x)} THEN 0.3 ELSE 0.0 END" for p in OPPOSITES for x, y in (p, p[::-1]))
    + "), 6) AS score FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND a.turn < b.turn",
)
statement(
    "q1_priority_components",
    f"SELECT doc_id, round(0.15 * least(1.0, n_chars / 2000.0) + 0.15 * least(1.0, {HITS('the|und|que')} / 10.0) + 0.1 * CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0.0 END + 0.1 * least(1.0, {HITS('[.]')} / 20.0) + 0.1 * CASE WHEN source < 'src5' THEN 1.0 ELSE 0.5 END + 0.1 * least(1.0, {HITS('[0-9]')} / 5.0) + 0.1 * (1 - least(1.0, {HITS('[*#%|]')} / 10.0)) + 0.1 * least(1.0, {N_WORDS} / 300.0) + 0.05 * CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END + 0.05 * least(1.0, {HITS('[A-Z]')} / 10.0), 6) AS priority FROM {{documents}}",
)


#: Signatures: 128 permutations (a * h + b) mod 2^31 - 1 of 128-bit md5 values; the limbs of h fold by 2^32 = 2 modulo that prime.
PRIME = 2**31 - 1
_rng = np.random.RandomState(42)
PERM_A, PERM_B = _rng.randint(1, PRIME, 128).tolist(), _rng.randint(0, PRIME, 128).tolist()
GRAM_WORDS = "filter(split(lower(trim(text)), '[ \n\t\r]+'), x -> x <> '')"
GRAMS = "CASE WHEN size(w) >= 3 THEN array_distinct(transform(sequence(1, size(w) - 2), i -> concat_ws(' ', w[i - 1], w[i], w[i + 1]))) ELSE array(concat_ws(' ', w)) END"
_limb = lambda f: " + ".join(f"{k} * {f(1 + 8 * i)}" for i, k in enumerate((8, 4, 2, 1)))
GRAM_HASH = f"({_limb(lambda at: f'CAST(conv(substr(m, {at}, 8), 16, 10) AS BIGINT)')}) % {PRIME}"


def _minhash() -> None:
    rows = "WITH w AS (SELECT doc_id, {words} AS w FROM {{documents}}), s AS (SELECT doc_id, explode({grams}) AS g FROM w), m AS (SELECT doc_id, md5(g) AS m FROM s), h AS (SELECT doc_id, {hash} AS h FROM m) SELECT doc_id, {mins} FROM h GROUP BY doc_id"
    mins = ", ".join(f"min(({x} * h + {y}) % {PRIME}) AS h{i}" for i, (x, y) in enumerate(zip(PERM_A, PERM_B)))
    hashed = f"({_limb(lambda at: f"CAST('0x' || substr(m, {at}, 8) AS BIGINT)")}) % {PRIME}"
    other = rows.format(words=other_text(GRAM_WORDS), grams="CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE [array_to_string(w, ' ')] END", hash=hashed, mins=mins)

    @query("d2_minhash_signature", other_sql(other.replace("explode(", "unnest(")))
    def _(t):
        sig = signatures(t("documents"))
        return sig.select("doc_id", *[F.col("sig")[i].alias(f"h{i}") for i in range(128)])


def gram_hashes(digests: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all digests, where each row's begin, with the end): the four limbs of 16 bytes, folded modulo PRIME."""
    flat = digests.flatten()
    limbs = np.frombuffer(b"".join(flat.to_pylist()) if flat.offset or not len(flat) else flat.buffers()[2], ">u4", 4 * len(flat)).reshape(-1, 4).astype(np.int64)
    return limbs @ np.array([8, 4, 2, 1]) % PRIME, np.concatenate([[0], np.cumsum(pc.list_value_length(digests).to_numpy(zero_copy_only=False))])


def least_permuted(hashes: np.ndarray, step: int = 512) -> np.ndarray:
    """The least (a * h + b) % PRIME of all hashes for each permutation; PRIME is 2^31 - 1, so that shifts stand for the division."""
    a, b = np.array(PERM_A, dtype=np.int64)[:, None], np.array(PERM_B, dtype=np.int64)[:, None]
    out = np.full(len(PERM_A), PRIME, dtype=np.int64)
    for i in range(0, len(hashes), step):
        x = a * hashes[None, i : i + step]
        x += b
        for _ in range(2):  # at most 2^32, then at most PRIME + 1
            high = x >> 31
            x &= PRIME
            x += high
        x -= PRIME * (x >= PRIME)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def signatures(docs):
    """doc_id, sig of every document: digests of its word triples in the JVM, their least permuted values by Arrow batches."""
    digests = docs.selectExpr("doc_id", f"{GRAM_WORDS} AS w").selectExpr("doc_id", f"transform({GRAMS}, g -> unhex(md5(g))) AS m")

    def run(batches):
        for batch in batches:
            hashes, first = gram_hashes(batch.column(1))
            sig = [least_permuted(hashes[i:j]) for i, j in zip(first[:-1], first[1:])]
            flat = pa.array(np.concatenate(sig) if sig else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * 128), flat)], ["doc_id", "sig"])

    return digests.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, sig array<long>")


_minhash()

# -- parsing, planning and selection ---------------------------------------------------------------------

AGO = "CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey % 29, ' days ago') WHEN 1 THEN concat(o_orderkey % 7, ' weeks ago') WHEN 2 THEN concat(o_orderkey % 11, ' months ago') WHEN 3 THEN concat(o_orderkey % 13, ' years ago') ELSE 'some time ago' END"
statement(
    "f12_relative_dates",
    f"SELECT o_orderkey, try_cast(nullif(regexp_extract(s, '([0-9]+) [a-z]+ ago', 1), '') AS INT) * CASE regexp_extract(s, '[0-9]+ ([a-z]+)s ago', 1) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 END AS days FROM (SELECT o_orderkey, {AGO} AS s FROM {{orders}}) x",
)
_in = lambda words, w: " + ".join(f"CASE WHEN contains(lower(text), '{x}') THEN {w} ELSE 0.0 END" for x in words.split())
statement("f15_temporal_intent", f"SELECT conv_id, turn, round(least(1.0, {_in('neu plus de', '0.3')} + {_in('on en', '0.2')} + CASE WHEN regexp_like(text, '202[0-4]') THEN 0.5 ELSE 0.0 END), 6) AS intent FROM {{conversations}}")
statement("f18_search_parameters", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'que') THEN 128 WHEN contains(lower(text), 'und') THEN 96 ELSE 64 END * CASE WHEN turn > 2 THEN 2 ELSE 1 END AS limit_, round(greatest(0.3, 0.7 - 0.05 * turn), 6) AS threshold FROM {conversations}")
statement("x5_adaptive_batch_size", "SELECT event_id, greatest(1, 8 + CASE WHEN value > 85 THEN -2 WHEN value < 50 AND event_type <> 'error' THEN 1 ELSE 0 END) AS batch FROM {events}")
statement("r12_signature_near_duplicates", "SELECT k, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, md5(concat_ws(' ', array_join(slice(w, 1, 5), ' '), size(w) % 10, source)) AS k FROM (SELECT doc_id, source, filter(split(lower(text), '[^a-zà-ÿ]+'), x -> x <> '') AS w FROM {documents}) y) x GROUP BY k")
statement("r17_comparison_pairs", f"WITH {RANKS}, u AS (SELECT * FROM r WHERE a <= 10), v AS (SELECT * FROM r WHERE a <= 20) SELECT x.q, x.d AS a, y.d AS b FROM u x JOIN v y ON x.q = y.q AND x.a < y.a WHERE y.a <= 10 OR (x.a <= 5 AND y.a > 10)")
statement(
    "j5_claim_contradictions",
    """SELECT * FROM (SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, round(greatest(CASE WHEN a.l_returnflag = 'R' AND b.l_returnflag <> 'R' THEN 0.8 ELSE 0.0 END, CASE WHEN a.l_linestatus <> b.l_linestatus THEN 0.4 ELSE 0.0 END,
    abs(a.l_discount - b.l_discount) * 5, CASE WHEN a.l_suppkey = b.l_suppkey AND a.l_tax <> b.l_tax THEN 0.9 ELSE 0.0 END, abs(a.l_quantity - b.l_quantity) / greatest(a.l_quantity, b.l_quantity, 1.0) * 0.5), 6) AS confidence
    FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber) x WHERE confidence > 0.3""",
)
statement("k16_cross_claim_consistency", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, CASE WHEN abs(a.l_discount - b.l_discount) > 0.08 THEN 'high' ELSE 'medium' END AS severity FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_returnflag <> b.l_returnflag")
statement("z3_importance_scorer", "SELECT conv_id, turn, round(CASE role WHEN 'system' THEN 0.5 WHEN 'user' THEN 0.3 ELSE 0.2 END + 0.3 * least(1.0, length(text) / 500.0) + 0.2 / (turn + 1), 6) AS importance FROM {conversations}")
statement("z4_link_filter", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, explode(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM {pages}) x WHERE link LIKE '/%' AND length(link) > 3 GROUP BY page_id, link""")
statement("n7_json_redaction", """SELECT event_id, regexp_replace(props, '("(k|email)" *: *)("[^"]*"|[0-9.]+)', '$1"[REDACTED]"'/*g*/) AS props FROM {events}""", """SELECT event_id, regexp_replace(props, '("(k|email)" *: *)("[^"]*"|[0-9.]+)', '\\1"[REDACTED]"', 'g') AS props FROM {events}""")
statement("q12_risk_factors", f"SELECT doc_id, CASE WHEN n_chars < 300 THEN 1 ELSE 0 END + CASE WHEN {HITS('[*#%]')} > 3 THEN 1 ELSE 0 END + CASE WHEN lang IS NULL THEN 1 ELSE 0 END + CASE WHEN {HITS('!')} > 2 THEN 1 ELSE 0 END + CASE WHEN source >= 'src5' THEN 1 ELSE 0 END AS risks, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END + CASE WHEN {HITS('[.]')} > 10 THEN 1 ELSE 0 END AS positives FROM {{documents}}")
statement("m13_identifier_dedup", "SELECT id, min(event_id) AS event_id, count(*) AS n FROM (SELECT event_id, coalesce(nullif(get_json_object(props, '$.id'), ''), nullif(get_json_object(props, '$.k'), ''), event_type) AS id FROM {events}) x GROUP BY id", "SELECT id, min(event_id) AS event_id, count(*) AS n FROM (SELECT event_id, coalesce(nullif(json_extract_string(props, '$.id'), ''), nullif(json_extract_string(props, '$.k'), ''), event_type) AS id FROM {events}) x GROUP BY id")
