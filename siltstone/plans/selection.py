"""Ranks, counters, caches, correlations, claims and chunk rules stated in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import sparse as S
from siltstone.operators.relational import paired
from siltstone.plans.statements import HITS, HOST, RANKS, doubles, frame, other_sql, other_text, statement
from siltstone.registry import query

SENTENCES = "filter(split(text, '[.!?]+'), x -> length(trim(x)) >= 10)"
WORD_SET = "array_distinct(filter(split(lower({c}), '[^a-zà-ÿ]+'), x -> length(x) >= 3))"
MICROS = "unix_micros(cast(ts as timestamp))"


def with_positions(text: str) -> tuple[str, str]:
    """Both engines' texts, where POSITIONS[array] AS (i, s) in a select list gives one row an element, i from 0."""
    at = text.index("POSITIONS[")
    end = text.index("] AS (i, s)", at)
    array = text[at + len("POSITIONS[") : end]
    rest = text[end + len("] AS (i, s)") :]
    here = f"{text[:at]}posexplode({array}) AS (i, s){rest}"
    return here, other_text(f"{text[:at]}unnest(range(0, size({array}))) AS i, unnest({array}) AS s{rest}")


# -- ranks, counters and metrics -----------------------------------------------------------------------

statement("w1_rank_positions", "SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS from_one, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) - 1 AS from_zero FROM (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM {lineitem} GROUP BY l_suppkey, l_partkey) x")
_trailing = lambda s: f"count(*) OVER (PARTITION BY event_type ORDER BY {MICROS} RANGE BETWEEN {s * 1000000} PRECEDING AND CURRENT ROW)"
_last = f"{MICROS} - lag({MICROS}) OVER (PARTITION BY event_type ORDER BY ts, event_id)"
statement(
    "w17_request_counters",
    f"SELECT event_id, minute_, hour_, coalesce(hour_ > 12 OR (minute_ > 2 AND gap < 1000000), false) AS blocked FROM (SELECT event_id, {_trailing(60)} AS minute_, {_trailing(3600)} AS hour_, {_last} AS gap FROM {{events}}) x",
)
statement("f33_syllable_count", "SELECT item_id, w, greatest(1, size(regexp_extract_all(w, '[aeiouy]+', 0)) - CASE WHEN w LIKE '%e' THEN 1 ELSE 0 END) AS syllables FROM (SELECT item_id, explode(array_distinct(regexp_extract_all(lower(text), '[a-z]+', 0))) AS w FROM {benchmark}) x")
E12 = f"WITH {RANKS}, f AS (SELECT q, min(CASE WHEN rel = 1 THEN a END) AS first_hit, sum(rel) AS total FROM r GROUP BY q) SELECT k, r.q, round(sum(CASE WHEN a <= k THEN rel ELSE 0 END) * 1.0 / k, 6) AS precision_, round(sum(CASE WHEN a <= k THEN rel ELSE 0 END) * 1.0 / nullif(max(total), 0), 6) AS recall, round(coalesce(1.0 / max(first_hit), 0.0), 6) AS reciprocal_rank FROM r JOIN f ON r.q = f.q CROSS JOIN (SELECT explode(KS) AS k) x GROUP BY k, r.q"
statement("e12_multi_k_evaluation", E12.replace("KS", "array(1, 3, 5, 10, 20)"), other_text(E12.replace("KS", "[1, 3, 5, 10, 20]")))
statement(
    "r18_gated_rerank",
    """WITH s AS (SELECT l_orderkey, l_linenumber, round(0.3 * l_quantity / 50.0 + 0.7 * l_discount * 10 + 0.1 * l_tax * 10, 6) AS score, l_tax * 10 AS uncertainty FROM {lineitem}),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS n, count_if(uncertainty <= 0.25) OVER (PARTITION BY l_orderkey) AS sure FROM s)
    SELECT l_orderkey, l_linenumber, score FROM k WHERE uncertainty <= 0.25 OR (sure = 0 AND n <= 5)""",
)

# -- caches and contexts -------------------------------------------------------------------------------

statement(
    "v12_semantic_cache",
    f"""WITH q AS (SELECT conv_id, turn, md5(text) AS k, {WORD_SET.format(c='text')} AS w FROM {{conversations}}),
    p AS (SELECT a.conv_id, a.turn, a.k = b.k AS same, size(array_intersect(a.w, b.w)) / greatest(sqrt(size(a.w) * 1.0) * sqrt(size(b.w) * 1.0), 1.0) AS cosine FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn < a.turn),
    m AS (SELECT conv_id, turn, bool_or(same) AS same, max(cosine) AS cosine FROM p GROUP BY conv_id, turn)
    SELECT conv_id, turn, CASE WHEN same THEN 'exact' WHEN cosine >= 0.3 THEN 'near' ELSE 'miss' END AS found, round(cosine, 6) AS cosine FROM m""",
)
statement(
    "x7_progressive_context",
    """WITH w AS (SELECT conv_id, turn, explode(filter(split(lower(text), '[ \n]+'), x -> x <> '')) AS w FROM {conversations}), n AS (SELECT conv_id, turn, count(*) AS words FROM w GROUP BY conv_id, turn),
    f AS (SELECT conv_id, turn, count(*) AS fresh FROM (SELECT conv_id, w, min(turn) AS turn FROM w GROUP BY conv_id, w) x GROUP BY conv_id, turn),
    s AS (SELECT n.conv_id, n.turn, coalesce(fresh, 0) * 1.0 / words AS novelty, sum(coalesce(fresh, 0)) OVER (PARTITION BY n.conv_id ORDER BY n.turn) * 1.0 / sum(words) OVER (PARTITION BY n.conv_id ORDER BY n.turn) AS density FROM n LEFT JOIN f ON n.conv_id = f.conv_id AND n.turn = f.turn)
    SELECT conv_id, turn, round(density, 6) AS density, round(0.6 * novelty + 0.4 * density, 6) AS quality FROM s""",
)
statement(
    "x15_cache_eviction",
    """WITH c AS (SELECT user_id, event_type, count(*) AS hits, max(unix_micros(cast(ts as timestamp))) AS used, sum(CAST(round(value * 100) AS BIGINT)) AS bytes FROM {events} GROUP BY user_id, event_type),
    n AS (SELECT max(used) AS now_ FROM c), s AS (SELECT user_id, event_type, bytes, now_ - used > 172800000000 AS expired, round(0.4 * (now_ - used) / 86400000000.0 + 0.3 / hits + 0.3 * bytes / 100000.0, 6) AS score FROM c CROSS JOIN n)
    SELECT user_id, event_type, expired, score, expired OR sum(bytes) OVER (PARTITION BY user_id ORDER BY expired DESC, score DESC, event_type) <= 20000 AS evicted FROM s""",
)
statement(
    "p15_read_only_validation",
    """SELECT o_orderkey, contains(upper(s), 'MATCH') AND contains(upper(s), 'RETURN') AND NOT regexp_like(upper(s), '(^|[^A-Z])(DELETE|CREATE|SET|REMOVE|MERGE|DROP)([^A-Z]|$)') AS valid, CASE WHEN contains(upper(s), ' LIMIT ') THEN s ELSE concat(s, ' LIMIT 50') END AS query
    FROM (SELECT o_orderkey, concat('MATCH (n) WHERE n.id = ', o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' RETURN n' WHEN 1 THEN ' DELETE n RETURN n' WHEN 2 THEN ' RETURN n.created, n.offset LIMIT 5' ELSE '' END) AS s FROM {orders}) x""",
)

# -- correlations --------------------------------------------------------------------------------------

J11 = """WITH p AS (SELECT l_suppkey AS s, avg(l_discount) * 10 AS a, avg(l_quantity) / 50.0 AS b, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS c FROM {lineitem} GROUP BY l_suppkey),
    k AS (SELECT s_nationkey AS n, p.* FROM p JOIN {supplier} ON s_suppkey = s), w AS (SELECT DISTINCT l_suppkey AS s, p_brand, s_nationkey AS n FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey),
    z AS (SELECT s, count(*) AS brands FROM w GROUP BY s), i AS (SELECT x.s AS a, y.s AS b, count(*) AS both_ FROM w x JOIN w y ON x.n = y.n AND x.p_brand = y.p_brand AND x.s < y.s GROUP BY x.s, y.s)
    SELECT i.a, i.b, round(((3 - abs(x.a - y.a) - abs(x.b - y.b) - abs(x.c - y.c)) / 3.0 + both_ * 1.0 / (z1.brands + z2.brands - both_)) / 2.0, 6) AS sim
    FROM i JOIN k x ON x.s = i.a JOIN k y ON y.s = i.b JOIN z z1 ON z1.s = i.a JOIN z z2 ON z2.s = i.b WHERE ((3 - abs(x.a - y.a) - abs(x.b - y.b) - abs(x.c - y.c)) / 3.0 + both_ * 1.0 / (z1.brands + z2.brands - both_)) / 2.0 > 0.6"""
#: Brands that are bits of one number; others lie in arrays.
BITS = 63


@query("j11_similar_profiles", other_sql(other_text(J11)))
def _(t):
    """Pairs of suppliers of a nation by their profiles and the share of common brands; pairs are met and judged in one step, in blocks.

    The SQL counts a pair's common (nation, brand) rows: common nations times common brands, as a supplier has each of its brands in
    each of its nations. A pair of several common nations is judged in the smallest; rows of equal keys in supplier multiply pairs.
    """
    first = [r[0] for r in t("part").where("p_brand is not null").select("p_brand").distinct().orderBy("p_brand").limit(BITS).collect()]
    bits = t("part").sparkSession.createDataFrame([(x, 1 << i) for i, x in enumerate(first)], "brand string, bit long")
    parts = t("part").select("p_partkey", F.col("p_brand").alias("brand"))
    sold = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").select("s", "brand").distinct()
    owned = sold.join(F.broadcast(bits), "brand", "left").groupBy("s").agg(
        F.count(F.lit(1)).alias("brands"), F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("mask"), F.collect_set(F.when(F.col("bit").isNull(), F.col("brand"))).alias("rest")
    )
    means = frame(t, "SELECT l_suppkey AS s, avg(l_discount) * 10 AS a, avg(l_quantity) / 50.0 AS b, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS c FROM {lineitem} GROUP BY l_suppkey")
    places = frame(t, "SELECT s_suppkey AS s, count(*) AS copies, collect_set(s_nationkey) AS nations, max(CASE WHEN s_nationkey IS NULL THEN 1 ELSE 0 END) AS unknown FROM {supplier} GROUP BY s_suppkey")
    rows = means.join(owned, "s").join(places, "s").withColumn("z", F.col("brands") * (F.size("nations") + F.col("unknown")))
    rows = rows.withColumn("more", F.when(F.size("nations") > 1, F.col("nations"))).withColumn("n", F.explode("nations")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    met = paired(S.written(rows.select("n", "s", "a", "b", "c", "z", "mask", "rest", "more"), "profiles"), ["n"], "s")
    both = "x.more IS NOT NULL AND y.more IS NOT NULL"
    met = met.where(f"NOT ({both}) OR n = array_min(array_intersect(x.more, y.more))")
    common = "(bit_count(x.mask & y.mask) + CASE WHEN size(x.rest) = 0 OR size(y.rest) = 0 THEN 0 ELSE size(array_intersect(x.rest, y.rest)) END)"
    met = met.withColumn("both_", F.expr(f"{common} * CASE WHEN {both} THEN size(array_intersect(x.more, y.more)) ELSE 1 END")).where("both_ > 0")
    sim = F.expr(doubles("((3 - abs(x.a - y.a) - abs(x.b - y.b) - abs(x.c - y.c)) / 3.0 + both_ * 1.0 / (x.z + y.z - both_)) / 2.0"))
    return met.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b"), sim.alias("sim")).where("sim > 0.6").withColumn("sim", F.round("sim", 6))


statement("m14_metric_correlation", "SELECT event_type, round(corr(value, CAST(user_id AS DOUBLE)), 6) AS r, count(*) AS n FROM {events} GROUP BY event_type")
statement(
    "k19_entity_relationships",
    f"""WITH e AS (SELECT DISTINCT email FROM (SELECT explode(regexp_extract_all(lower(text), '[a-z0-9._]+@[a-z0-9.]+[a-z]', 0)) AS email FROM {{documents}}) x), d AS (SELECT DISTINCT regexp_extract({HOST}, '([a-z0-9]+[.][a-z]+)$', 1) AS domain FROM {{pages}})
    SELECT email, domain, 0.9 AS confidence FROM e JOIN d ON regexp_extract(email, '([a-z0-9]+[.][a-z]+)$', 1) = domain""",
)

# -- claims and chunks ---------------------------------------------------------------------------------

K7 = f"""WITH c AS (SELECT conv_id, turn, {WORD_SET.format(c='text')} AS w FROM {{conversations}} WHERE role = 'user'), e AS (SELECT conv_id, turn, POSITIONS[{SENTENCES}] AS (i, s) FROM {{conversations}} WHERE role = 'assistant'),
p AS (SELECT c.conv_id, c.turn AS claim, e.turn AS evidence, i, size(array_intersect(c.w, {WORD_SET.format(c='s')})) AS shared, CASE WHEN regexp_like(lower(s), ' (not|nicht|pas|no) ') THEN 'negation' WHEN regexp_like(lower(s), ' (but|aber|mais|pero|or|ou|und) ') THEN 'contrast' WHEN regexp_like(s, '[0-9]') THEN 'quantity' END AS family FROM c JOIN e ON c.conv_id = e.conv_id)
SELECT conv_id, claim, evidence, i, family, round(least(1.0, CASE family WHEN 'negation' THEN 0.6 WHEN 'contrast' THEN 0.5 ELSE 0.4 END + 0.05 * shared), 6) AS confidence FROM p WHERE shared >= 2 AND family IS NOT NULL"""
statement("k7_counter_evidence", *with_positions(K7))
K14 = f"""WITH q AS (SELECT conv_id, {WORD_SET.format(c='text')} AS q FROM {{conversations}} WHERE turn = 0), e AS (SELECT conv_id, turn, POSITIONS[filter(split(text, '[.!?]+'), x -> length(trim(x)) > 20)] AS (i, s) FROM {{conversations}} WHERE turn > 0),
w AS (SELECT e.conv_id, turn, i, {WORD_SET.format(c='s')} AS w, q FROM e JOIN q ON e.conv_id = q.conv_id), k AS (SELECT conv_id, turn, i, w FROM w WHERE size(w) > 0 AND size(array_intersect(w, q)) * 10 >= greatest(10, 3 * size(q))),
d AS (SELECT DISTINCT b.conv_id, b.turn, b.i FROM k a JOIN k b ON a.conv_id = b.conv_id AND (a.turn < b.turn OR (a.turn = b.turn AND a.i < b.i)) WHERE size(array_intersect(a.w, b.w)) * 10 > 8 * greatest(size(a.w), size(b.w)))
SELECT k.conv_id, k.turn, k.i, size(w) AS words FROM k LEFT JOIN d ON k.conv_id = d.conv_id AND k.turn = d.turn AND k.i = d.i WHERE d.conv_id IS NULL"""
statement("k14_claim_extraction", *with_positions(K14))
C14 = f"""SELECT doc_id, i, CASE WHEN trim(s) = '' THEN 'break' WHEN regexp_like(s, '^ *([-*#]|[0-9]+[.)])') THEN 'list' WHEN regexp_like(s, '@|https?:') THEN 'citation' WHEN length(s) < 60 AND NOT regexp_like(s, '[.!?]$') THEN 'heading' ELSE 'paragraph' END AS kind,
round(least(1.0, length(s) / 500.0) * 0.5 + CASE WHEN regexp_like(s, '[0-9]') THEN 0.2 ELSE 0.0 END, 6) AS salience FROM (SELECT doc_id, POSITIONS[split(text, '\n')] AS (i, s) FROM {{documents}}) x"""
statement("c14_line_chunks", *with_positions(C14))
statement(
    "c11_adaptive_target_size",
    f"SELECT doc_id, round(score, 6) AS score, CAST(round(512 * (1 + CASE WHEN score < 0 THEN 0.5 * score ELSE 0.3 * score END)) AS BIGINT) AS target FROM (SELECT doc_id, greatest(-1.0, least(1.0, 0.5 - {HITS('[0-9]')} * 10.0 / greatest(length(text), 1) - {HITS('[.!?]')} * 5.0 / greatest(length(text), 1))) AS score FROM {{documents}}) x",
)
statement(
    "c17_redundancy_penalty",
    f"""WITH s AS (SELECT conv_id, turn, {WORD_SET.format(c='text')} AS w FROM {{conversations}}), p AS (SELECT a.conv_id, a.turn, size(array_intersect(a.w, b.w)) * 1.0 / greatest(least(size(a.w), size(b.w)), 1) AS contained FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn <> b.turn)
    SELECT conv_id, turn, count_if(contained > 0.5) AS n, round(least(0.2 * count_if(contained > 0.5), 0.8), 6) AS penalty FROM p GROUP BY conv_id, turn""",
)
V9_TERMS = ("the", "und", "que", "that")
_tf = lambda w: f"size(filter(w, x -> x = '{w}'))"
statement(
    "v9_okapi_prefilter",
    f"""WITH w AS (SELECT doc_id, filter(regexp_extract_all(lower(concat(source, ' ', text)), '[a-z]+', 0), x -> length(x) > 2 AND x NOT IN ('and', 'for', 'with', 'der', 'die', 'les', 'est', 'los', 'con', 'por')) AS w FROM {{documents}}),
    c AS (SELECT doc_id, size(w) AS n, {', '.join(f'{_tf(x)} AS t{i}' for i, x in enumerate(V9_TERMS))} FROM w), s AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f'count_if(t{i} > 0) AS d{i}' for i in range(4))} FROM c)
    SELECT doc_id, score FROM (SELECT doc_id, round({' + '.join(f'ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * n / mean))' for i in range(4))}, 6) AS score FROM c CROSS JOIN s) x ORDER BY score DESC, doc_id LIMIT 100""",
)
