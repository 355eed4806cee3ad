"""More windows, budgets, evidence, quality and graph operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import text as X
from siltstone.operators import chunking as C
from siltstone.operators import graph as G
from siltstone.operators import relational as R
from siltstone.plans.graphs import N, _chain
from siltstone.plans.more import project
from siltstone.registry import query

SETS = r"s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations)"
JAC = "len(list_intersect(a.w, b.w)) * 1.0 / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)"


def _sets(t):
    return t("conversations").select("conv_id", "turn", X.word_set(F.col("text")).alias("w"))


@query("w7_novelty_last_10", f"WITH {SETS}, p AS (SELECT a.conv_id, a.turn, max({JAC}) AS m FROM s a LEFT JOIN s b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 10 GROUP BY 1, 2) SELECT conv_id, turn, round(greatest(0.1, 1 - coalesce(m, 0)), 6) AS novelty FROM p")
def _(t):
    # the ten rows before come by a window, not by a join
    last = F.collect_list(F.struct("turn", "w")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-10, -1))
    s = _sets(t).withColumn("last", F.filter(last, lambda p: p["turn"] >= F.col("turn") - 10))
    best = F.array_max(F.transform("last", lambda p: X.jaccard(F.col("w"), p["w"])))
    return s.select("conv_id", "turn", F.round(F.greatest(F.lit(0.1), 1 - F.coalesce(best, F.lit(0.0))), 6).alias("novelty"))


@query("k10_pair_contradiction", f"WITH {SETS} SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, round(0.4 * {JAC}, 6) AS score FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE {JAC} > 0.05")
def _(t):
    s = _sets(t)
    p = s.alias("a").join(s.alias("b"), F.expr("a.conv_id = b.conv_id and a.turn < b.turn"))
    j = X.jaccard(F.col("a.w"), F.col("b.w"))
    return p.where(j > 0.05).select("a.conv_id", F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), F.round(0.4 * j, 6).alias("score"))


@query("k13_evidence_binding", f"WITH {SETS}, p AS (SELECT a.conv_id, a.turn AS claim, b.turn AS evidence, {JAC} AS j FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, claim, evidence, round(j, 6) AS score FROM p WHERE j > 0.04")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = _sets(t).withColumn("next", F.lead(F.struct("turn", "w")).over(w)).where(F.col("next.turn") == F.col("turn") + 1)
    j = X.jaccard(F.col("w"), F.col("next.w"))
    return s.where(j > 0.04).select("conv_id", F.col("turn").alias("claim"), F.col("next.turn").alias("evidence"), F.round(j, 6).alias("score"))


@query("w10_truncating_budget", "SELECT conv_id, turn, CAST(least(c, 150 - (r - c)) AS BIGINT) AS tokens FROM (SELECT conv_id, turn, length(text) // 4 AS c, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r - c < 150 AND (r <= 150 OR 150 - (r - c) > 50)")
def _(t):
    c = t("conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("c"))
    c = c.withColumn("before", F.sum("c").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("c"))
    keep = (F.col("before") < 150) & ((F.col("before") + F.col("c") <= 150) | (150 - F.col("before") > 50))
    return c.where(keep).select("conv_id", "turn", F.least("c", 150 - F.col("before")).alias("tokens"))


@query("w11_per_source_budget", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars // 4) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r <= 2000")
def _(t):
    d = t("documents").select("source", "doc_id", "n_chars")
    return R.prefix_budget(d, ["source"], ["n_chars", "doc_id"], F.floor(F.col("n_chars") / 4), 2000).select("source", "doc_id")


GREEDY = """WITH RECURSIVE {rows}, s AS (SELECT k, n, id, c, c <= {budget} AS took, CASE WHEN c <= {budget} THEN c ELSE 0 END AS used FROM o WHERE n = 1
UNION ALL SELECT o.k, o.n, o.id, o.c, s.used + o.c <= {budget}, CASE WHEN s.used + o.c <= {budget} THEN s.used + o.c ELSE s.used END FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1)"""


@query("w12_dual_budget", GREEDY.format(rows="o AS (SELECT coalesce(lang, '-') || '|' || source AS k, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n, doc_id AS id, n_chars // 4 AS c FROM documents)", budget=2000) + ", " + GREEDY.format(rows="o2 AS (SELECT coalesce(lang, '-') AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, doc_id AS id, n_chars // 4 AS c FROM documents WHERE doc_id IN (SELECT id FROM s WHERE took))", budget=20000).replace("WITH RECURSIVE ", "").replace(" s AS", " s2 AS").replace("FROM o ", "FROM o2 ").replace("FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1", "FROM s2 JOIN o2 ON o2.k = s2.k AND o2.n = s2.n + 1").replace("SELECT o.k, o.n, o.id, o.c, s.used + o.c", "SELECT o2.k, o2.n, o2.id, o2.c, s2.used + o2.c").replace("WHEN s.used + o.c", "WHEN s2.used + o2.c").replace("THEN s.used + o.c ELSE s.used", "THEN s2.used + o2.c ELSE s2.used") + " SELECT lang, source, doc_id, CAST(n_chars // 4 AS BIGINT) AS cost FROM documents WHERE doc_id IN (SELECT id FROM s2 WHERE took)")
def _(t):
    """Rows that fit both the source's budget and the language's, each in order, others skipped."""
    d = t("documents").select("lang", "source", "doc_id", F.floor(F.col("n_chars") / 4).alias("cost"))
    one = R.greedy_budget(d, ["lang", "source"], "doc_id", "cost", 2000)
    return R.greedy_budget(one, ["lang"], "doc_id", "cost", 20_000)


@query("w15_source_timeline", "SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


ANCHOR = """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, ts, ts AS anchor FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, o.ts, CASE WHEN epoch_us(o.ts) - epoch_us(s.anchor) >= 86400000000 THEN o.ts ELSE s.anchor END FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)"""


def _anchored(t):
    return R.anchored(t("events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 86_400)


@query("p13_snapshot_gap", f"{ANCHOR} SELECT user_id, event_id FROM s WHERE ts = anchor")
def _(t):
    # kept: the first, and each that lies a day or more after the last kept one
    return _anchored(t).where("ts = anchor").select("user_id", "event_id")


@query("w13_merged_events", f"{ANCHOR} SELECT user_id, anchor, count(*) AS n, max(ts) AS last_ts FROM s GROUP BY user_id, anchor")
def _(t):
    return _anchored(t).groupBy("user_id", "anchor").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("w19_nearest_lower_depth", "SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND length(b.text) < length(a.text) GROUP BY 1, 2")
def _(t):
    return R.nearest_lower(t("conversations").select("conv_id", "turn", F.length("text").alias("depth")), "conv_id", "turn", "depth")


@query("a13_graph_type_histograms", "SELECT 'out' AS side, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'in', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def _(t):
    e = t("lineitem").select(F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("l_returnflag").alias("kind")), F.struct(F.lit("in").alias("side"), F.col("l_linestatus").alias("kind")))).alias("p"))
    return e.groupBy("p.side", "p.kind").agg(F.count("*").alias("n"))


@query("a28_diversity_ratio", "SELECT l_orderkey, round(count(DISTINCT l_suppkey) * 1.0 / count(*), 6) AS ratio FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.countDistinct("l_suppkey") / F.count("*"), 6).alias("ratio"))


@query("a31_moving_average", "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT user_id, n, value AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, 0.1 * o.value + 0.9 * r.ema FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, round(arg_max(ema, n), 6) AS ema FROM r GROUP BY user_id")
def _(t):
    # a weighted sum: 0.1 * 0.9^(rows after) each, the first row without the 0.1; weights below 1e-300 are zero
    w = Window.partitionBy("user_id")
    n = F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    e = t("events").select("user_id", "value", n.alias("after"), F.count(F.lit(1)).over(w).alias("of"))
    weight = F.pow(F.lit(0.9), F.col("after")) * F.when(F.col("after") + 1 == F.col("of"), 1.0).otherwise(0.1)
    return e.groupBy("user_id").agg(F.round(F.sum(weight * F.col("value")), 6).alias("ema"))


@query("v10_tfidf_top_terms", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM c GROUP BY w) SELECT doc_id, round(max(tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1)), 6) AS best FROM c JOIN d USING (w) GROUP BY doc_id")
def _(t):
    d = t("documents")
    c = d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    df = c.groupBy("w").agg(F.count("*").alias("df"))
    n = d.agg(F.count("*").alias("n"))
    s = c.join(df, "w").crossJoin(F.broadcast(n))
    return s.groupBy("doc_id").agg(F.round(F.max(F.col("tf") * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1)), 6).alias("best"))


@query("v18_vector_graph_union", "SELECT id, round(max(s), 6) AS score FROM (SELECT p_partkey AS id, 0.6 * p_size / 50.0 AS s FROM part UNION ALL SELECT l_partkey, 0.8 * 0.4 FROM lineitem WHERE l_quantity >= 49) GROUP BY id ORDER BY score DESC, id LIMIT 50")
def _(t):
    a = t("part").select(F.col("p_partkey").alias("id"), (0.6 * F.col("p_size") / 50.0).alias("s"))
    b = t("lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id"), F.lit(0.8 * 0.4).alias("s"))
    return a.unionByName(b).groupBy("id").agg(F.round(F.max("s"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("g7_component_statistics", f"WITH RECURSIVE {N}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node) SELECT root, count(*) AS size FROM c GROUP BY root")
def _(t):
    e = _chain(t)
    return G.connected(e).groupBy("root").agg(F.count("*").alias("size"))


PROPAGATION = f"WITH {N}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), l0 AS (SELECT DISTINCT a AS node, a AS c FROM u), " + ", ".join(
    f"v{i} AS (SELECT u.a AS node, l.c AS c, count(*) AS n FROM u JOIN l{i - 1} l ON l.node = u.b GROUP BY 1, 2), l{i} AS (SELECT node, arg_min(c, (-n, c)) AS c FROM v{i} GROUP BY node)" for i in range(1, 6)
) + " SELECT node, c AS community FROM l5"


@query("g9_label_propagation", PROPAGATION)
def _(t):
    return G.label_propagation(_chain(t), 5)


EMAIL = r"[\w.+-]+@[\w.-]+\.\w+"
# places by the gaps before each match
ENTITIES = rf"""WITH f AS (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS e, string_split_regex(text, '{EMAIL}') AS g FROM documents), r AS (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM f),
s AS (SELECT doc_id, text, e[i] AS entity, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(e[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM r)
SELECT doc_id, entity, start, start + length(entity) AS "end", substr(text, greatest(start - 50, 0) + 1, start + length(entity) + 50 - greatest(start - 50, 0)) AS context FROM s"""


@query("f25_entities_with_context", ENTITIES)
def _(t):
    return C.matches(t("documents"), "doc_id", "text", EMAIL, 50)


def _split_sql(size: int, overlap: int, marks: list[str]) -> str:
    """The same cuts, chunk after chunk, by recursion over (start, end)."""
    window = f"substr(text, a + 1, {size})"
    past = lambda m: f"({size} - strpos(reverse({window}), reverse({m})) + 1)"
    rules = " ".join(f"WHEN contains({window}, {m}) AND {past(m)} > {size // 2} THEN a + {past(m)}" for m in marks)
    end = f"CASE WHEN a + {size} >= length(text) THEN length(text) {rules} ELSE a + {size} END"
    return f"""WITH RECURSIVE s AS (SELECT doc_id, text, 0 AS i, CAST(0 AS BIGINT) AS a, CAST({end.replace('a + 1', '0 + 1').replace('a + ', '0 + ')} AS BIGINT) AS b FROM documents WHERE length(text) > 0
    UNION ALL SELECT doc_id, text, i + 1, a, CAST({end} AS BIGINT) FROM (SELECT doc_id, text, i, greatest(b - {overlap}, a + 1) AS a FROM s WHERE b < length(text)) x)"""


#: Level, characters, characters shared, marks in order of preference (and as SQL).
SPLITS = [("c5_section_split", 2000, 200, ["\n"], ["chr(10)"]), ("c6_passage_split", 512, 76, [". "], ["'. '"]), ("c8_recursive_splitter", 400, 40, ["\n", ". ", " "], ["chr(10)", "'. '", "' '"])]


def _register(name, size, overlap, marks, sql):
    @query(name, _split_sql(size, overlap, sql) + " SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, b - a AS chunk_size, length(text) AS original_length, md5(substr(text, a + 1, b - a)) AS h FROM s")
    def _(t):
        d = t("documents")
        chunks = C.split_at(d, "doc_id", "text", size, overlap, marks).withColumn("total_chunks", F.count("*").over(Window.partitionBy("doc_id")))
        return chunks.join(d.select("doc_id", F.length("text").cast("long").alias("original_length")), "doc_id").select("doc_id", "chunk_index", "total_chunks", F.length("chunk").cast("long").alias("chunk_size"), "original_length", F.md5(F.col("chunk").cast("binary")).alias("h"))


for _split in SPLITS:
    _register(*_split)


@query(
    "c13_merged_paragraphs",
    """WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, n, c FROM (SELECT doc_id, i, len(list_filter(string_split(s, ' '), lambda x: x <> '')) AS n, length(s) AS c FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS s FROM documents)) WHERE n > 0),
    r AS (SELECT doc_id, i, c, n AS held, 0 AS k FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, l.c, CASE WHEN held + l.n > 200 THEN l.n ELSE held + l.n END, CASE WHEN held + l.n > 200 THEN k + 1 ELSE k END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
    SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, CAST(sum(c) + count(*) - 1 AS BIGINT) AS chars, CAST(max(held) AS BIGINT) AS words FROM r GROUP BY doc_id, k""",
)
def _(t):
    c = C.merged_paragraphs(t("documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("chars"), F.size(F.filter(F.split("chunk", "[ \n]"), lambda x: x != "")).cast("long").alias("words"))


@query("c2_section_chunks", r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS sections FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("sections"))


@query("c15_salience_filter", r"SELECT doc_id, idx, score FROM (SELECT doc_id, i - 1 AS idx, round(0.6 * (CASE WHEN contains(lower(s), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(s), 'and') THEN 0.5 ELSE 0 END) + 0.4 * least(1.0, length(s) / 200.0), 6) AS score FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE score >= 0.5")
def _(t):
    p = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "s"))
    has = lambda w: F.when(F.contains(F.lower("s"), F.lit(w)), 0.5).otherwise(0.0)
    score = F.round(0.6 * (has("the") + has("and")) + 0.4 * F.least(F.lit(1.0), F.length("s") / 200.0), 6)
    return p.select("doc_id", F.col("idx").cast("long").alias("idx"), score.alias("score")).where("score >= 0.5")


@query("e7_citation_precision", f"WITH {SETS} SELECT a.conv_id, round(avg(CASE WHEN {JAC} > 0.04 THEN 1.0 ELSE 0 END), 6) AS precision_ FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY 1")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = _sets(t).withColumn("next", F.lead(F.struct("turn", "w")).over(w)).where(F.col("next.turn") == F.col("turn") + 1)
    return s.groupBy("conv_id").agg(F.round(F.avg((X.jaccard(F.col("w"), F.col("next.w")) > 0.04).cast("double")), 6).alias("precision_"))


@query("m10_threshold_compliance", "SELECT user_id, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0 END), 6) AS share, CASE WHEN avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0 END) >= 0.8 THEN 'passed' ELSE 'failed' END AS status FROM events GROUP BY user_id")
def _(t):
    share = F.avg((F.col("value") >= 10).cast("double"))
    return t("events").groupBy("user_id").agg(F.round(share, 6).alias("share"), F.when(share >= 0.8, "passed").otherwise("failed").alias("status"))


project("f9_date_cascade", "orders", "o_orderkey", "d", "cast(coalesce(try_to_timestamp(date_format(o_orderdate, 'dd/MM/yyyy'), 'yyyy-MM-dd'), try_to_timestamp(date_format(o_orderdate, 'dd/MM/yyyy'), 'dd/MM/yyyy')) as date)", "CAST(coalesce(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%Y-%m-%d'), try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')) AS DATE)")
project("f37_identifier_extraction", "pages", "page_id", "id", "regexp_extract(url, '([0-9]+)', 1)")
project("q9_content_metrics", "documents", "doc_id", "depth", "round(0.5 * least(1.0, length(text) / 3000.0) + 0.5 * (1 - length(replace(text, ' ', '')) * 1.0 / greatest(length(text), 1)), 6)")
project("q13_document_gate", "documents", "doc_id", "gate", "CASE WHEN n_chars >= 500 AND text NOT LIKE '%!!%' THEN 'keep' WHEN n_chars >= 100 THEN 'review' ELSE 'drop' END")
