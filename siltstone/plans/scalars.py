"""Scalar functions, chunking and redaction over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import text as X
from siltstone.operators import chunking, governance
from siltstone.registry import query

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
NURL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '^www\.', ''), '/+$', ''), '\?.*$', ''), '#.*$', '')"


@query("f1_normalize_url", f"SELECT page_id, {NURL} AS u FROM pages")
def _(t):
    return t("pages").select("page_id", X.normalize_url(F.col("url")).alias("u"))


@query("f2_normalize_text", f"SELECT doc_id, md5({NORM.format('text')}) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(X.normalize_text(F.col("text")).cast("binary")).alias("h"))


@query("f3_content_hash", f"SELECT page_id, md5({NURL} || '|' || {NORM.format('url')} || '|' || substr({NORM.format('html')}, 1, 500)) AS h FROM pages")
def _(t):
    return t("pages").select("page_id", X.content_hash(F.col("url"), F.col("url"), F.col("html")).alias("h"))


@query(
    "f4_char_trigram_jaccard",
    """WITH n AS (SELECT c_custkey, c_name AS x, 'Customer#0000' || (c_custkey * 7) AS y FROM customer), g AS (SELECT c_custkey, list_distinct([x[i:i+2] FOR i IN range(1, length(x) - 1)]) AS a, list_distinct([y[i:i+2] FOR i IN range(1, length(y) - 1)]) AS b FROM n)
    SELECT c_custkey, round(len(list_intersect(a, b)) * 1.0 / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS sim FROM g""",
)
def _(t):
    n = t("customer").select("c_custkey", F.col("c_name").alias("x"), F.concat(F.lit("Customer#0000"), (F.col("c_custkey") * 7).cast("string")).alias("y"))
    g = n.select("c_custkey", X.char_ngrams(F.col("x")).alias("a"), X.char_ngrams(F.col("y")).alias("b"))
    return g.select("c_custkey", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("sim"))


@query(
    "f5_word_set_jaccard",
    r"""WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations),
    p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
    SELECT conv_id, turn, round(len(list_intersect(w, b)) * 1.0 / nullif(len(list_distinct(list_concat(w, b))), 0), 6) AS sim FROM p WHERE b IS NOT NULL""",
)
def _(t):
    s = t("conversations").select("conv_id", "turn", X.word_set(F.col("text")).alias("w"))
    p = s.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return p.select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("b")), 6).alias("sim"))


@query(
    "u5_set_novelty",
    r"""WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations),
    p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
    SELECT conv_id, turn, round(CASE WHEN len(w) = 0 THEN 0 ELSE (len(w) - len(list_intersect(w, b))) * 1.0 / len(w) END, 6) AS novelty FROM p WHERE b IS NOT NULL""",
)
def _(t):
    s = t("conversations").select("conv_id", "turn", X.word_set(F.col("text")).alias("w"))
    p = s.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return p.select("conv_id", "turn", F.round(X.novelty(F.col("w"), F.col("b")), 6).alias("novelty"))


@query("f6_domain", "SELECT page_id, CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) <> '' THEN lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) ELSE 'unknown' END AS d FROM pages")
def _(t):
    return t("pages").select("page_id", X.domain(F.col("url")).alias("d"))


@query("f8_source_type_case", "SELECT page_id, CASE WHEN regexp_matches(u, 'edu|arxiv|journal') THEN 'academic' WHEN regexp_matches(u, 'gov') THEN 'government' WHEN contains(u, 'wiki') THEN 'wikipedia' WHEN contains(u, 'news') THEN 'news' ELSE 'unknown' END AS k FROM (SELECT page_id, replace(replace(replace(replace(lower(url), '/de/', '/wiki/'), '/en/', '/journal/'), '/fr/', '/news/'), '/es/', '/gov/') AS u FROM pages)")
def _(t):
    # the areas of the test urls stand for hosts of these kinds
    u = F.lower("url")
    for area, kind in (("/de/", "/wiki/"), ("/en/", "/journal/"), ("/fr/", "/news/"), ("/es/", "/gov/")):
        u = F.replace(u, F.lit(area), F.lit(kind))
    k = F.when(u.rlike("edu|arxiv|journal"), "academic").when(u.rlike("gov"), "government").when(F.contains(u, F.lit("wiki")), "wikipedia").when(F.contains(u, F.lit("news")), "news").otherwise("unknown")
    return t("pages").select("page_id", k.alias("k"))


@query("f10_date_extraction", r"SELECT o_orderkey, try_cast(regexp_extract('on ' || strftime(o_orderdate, '%Y-%m-%d'), '(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS d FROM orders")
def _(t):
    s = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", F.to_date(F.nullif(F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).alias("d"))


@query("f13_recency_decay", "SELECT o_orderkey, round(greatest(exp(-0.693 * date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') / 365.0), 0.5), 6) AS prior FROM orders")
def _(t):
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t("orders").select("o_orderkey", F.round(X.recency_decay(age), 6).alias("prior"))


@query("f14_recency_bonus", "SELECT o_orderkey, round(CASE WHEN a < 0 THEN 0 ELSE 1.5 * exp(-a / 365.0) END, 6) AS bonus FROM (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1997-01-01') AS a FROM orders)")
def _(t):
    age = F.datediff(F.lit("1997-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t("orders").select("o_orderkey", F.round(X.recency_bonus(age), 6).alias("bonus"))


@query("f19_html_to_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def _(t):
    return t("pages").select("page_id", F.md5(X.html_to_text(F.col("html")).cast("binary")).alias("h"))


@query("f23_deterministic_id", "SELECT p_partkey, substr(md5(lower(trim(p_name)) || ':' || p_brand), 1, 12) AS id FROM part")
def _(t):
    return t("part").select("p_partkey", X.deterministic_id(F.lower(F.trim("p_name")), F.col("p_brand")).alias("id"))


#: Public patterns.
PATTERNS = {"email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "hash": r"\b[a-f0-9]{32,64}\b", "url": r"https?://[^\s<>]+"}


@query("f26_pattern_detector", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{v}')) AS hit FROM documents" for k, v in PATTERNS.items()))
def _(t):
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(v), F.lit(0)).alias("hits")) for k, v in PATTERNS.items()])
    return t("documents").select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.kind", F.explode("p.hits").alias("hit"))


@query("f31_json_metadata", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "f32_flesch_readability",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '')) AS s FROM documents),
    v AS (SELECT doc_id, s, len(ws) AS n, CAST(list_sum(list_transform(ws, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN lower(x) LIKE '%e' THEN 1 ELSE 0 END, 1))) AS BIGINT) AS y FROM w)
    SELECT doc_id, round(CASE WHEN s = 0 OR n = 0 THEN 0 ELSE greatest(0, least(1, (206.835 - 1.015 * (n * 1.0 / s) - 84.6 * (y * 1.0 / n)) / 100)) END, 6) AS score FROM v""",
)
def _(t):
    d = t("documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("ws"), F.size(F.filter(F.split("text", "[.!?]+"), lambda x: F.trim(F.regexp_replace(x, r"^ +| +$", "")) != "")).alias("s"))
    v = d.select("doc_id", "s", F.size("ws").alias("n"), F.aggregate(F.transform("ws", X.syllables), F.lit(0), lambda a, b: a + b).alias("y"))
    return v.select("doc_id", F.round(X.flesch(F.col("s"), F.col("n"), F.col("y")), 6).alias("score"))


@query("f35_token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("f36_sigmoid_calibration", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-5 * (l_discount - 0.5))), 8) AS p FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(X.calibrated(F.col("l_discount")), 8).alias("p"))


@query("f38_number_unit", r"SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS value FROM documents")
def _(t):
    return t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).alias("value"))


@query("f39_keyword_sentiment", "SELECT doc_id, CASE WHEN p + n = 0 THEN 0.0 ELSE round((p - n) * 1.0 / (p + n), 6) END AS s FROM (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT AS p, contains(lower(text), 'que')::INT + contains(lower(text), 'los')::INT AS n FROM documents)")
def _(t):
    return t("documents").select("doc_id", F.round(X.sentiment(F.col("text"), ["the", "und"], ["que", "los"]), 6).alias("s"))


@query("f40_keyword_relevance", "SELECT doc_id, round(least(1.0, least(1.0, (length(l) - length(replace(l, 'the', ''))) / 3 / 5.0) + least(1.0, (length(l) - length(replace(l, 'que', ''))) / 3 / 5.0) / 2), 6) AS r FROM (SELECT doc_id, lower(text) AS l FROM documents)")
def _(t):
    return t("documents").select("doc_id", F.round(X.keyword_relevance(F.col("text"), ["the", "que"]), 6).alias("r"))


@query(
    "f21_simhash",
    r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))) AS w FROM documents), b AS (SELECT unnest(range(0, 64)) AS b),
    s AS (SELECT doc_id, b, sum(CASE WHEN (CAST('0x' || substr(md5(w), 1 + 8 * (b // 32), 8) AS BIGINT) >> (b % 32)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM w, b GROUP BY 1, 2)
    SELECT d.doc_id, string_agg(CASE WHEN coalesce(s, 0) > 0 THEN '1' ELSE '0' END, '' ORDER BY b.b) AS simhash FROM documents d CROSS JOIN b LEFT JOIN s ON s.doc_id = d.doc_id AND s.b = b.b GROUP BY d.doc_id""",
)
def _(t):
    return X.simhashes(t("documents"), "doc_id", X.word_set(F.col("text")))


@query("c7_sentence_split", r"SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, s FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, trim(unnest(p), ' ') AS s FROM (SELECT doc_id, string_split_regex(text, '[.!?]+') AS p FROM documents)) WHERE length(s) >= 10")
def _(t):
    return chunking.sentences(t("documents").select("doc_id", "text"), "text", 10)


@query("c1_sentence_chunks")
def _(t):
    return chunking.sentence_chunks(t("documents").select("doc_id", "text"), "doc_id", "text", 512, 50)


@query("c3_sliding_window", r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) > 200 THEN CAST(ceil((len(w) - 200) / 150.0) AS BIGINT) + 1 ELSE 1 END)) AS chunk_index FROM w WHERE len(w) > 0) SELECT doc_id, chunk_index, array_to_string(w[chunk_index * 150 + 1 : chunk_index * 150 + 200], ' ') AS chunk FROM s")
def _(t):
    return chunking.word_windows(t("documents").select("doc_id", "text"), "doc_id", "text", 200, 50)


@query(
    "c4_chunk_tree",
    """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), l AS (SELECT * FROM (VALUES (0, 8000, 0), (1, 2000, 200), (2, 512, 76), (3, 128, 25)) AS x(level, most, shared)),
    c AS (SELECT doc_id, n, level, most, most - shared AS step, unnest(range(0, CAST(greatest(ceil((n - shared) * 1.0 / (most - shared)) - 1, 0) AS BIGINT) + 1)) AS chunk_index FROM d, l)
    SELECT doc_id, level, chunk_index, chunk_index * step AS start, CAST(least(most, n - chunk_index * step) AS BIGINT) AS size FROM c""",
)
def _(t):
    return chunking.chunk_tree(t("documents").select("doc_id", "text"), "doc_id", "text")


@query("c19_weighted_source_budget", "SELECT source, CAST(floor(n * w / sum(n * w) OVER () * 100000) AS BIGINT) AS budget FROM (SELECT source, count(*) AS n, CASE WHEN source < 'src5' THEN 1.5 ELSE 1.0 END AS w FROM documents GROUP BY source)")
def _(t):
    g = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.col("n") * F.when(F.col("source") < "src5", 1.5).otherwise(1.0))
    return g.crossJoin(F.broadcast(g.agg(F.sum("x").alias("all")))).select("source", F.floor(F.col("x") / F.col("all") * 100000).alias("budget"))


@query("n1_pii_detection", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS emails, CAST(len(regexp_extract_all(text, '\+?\d[\d ()-]{7,}\d')) AS BIGINT) AS phones FROM documents")
def _(t):
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return t("documents").select("doc_id", n(governance.PII["email"]).alias("emails"), n(governance.PII["phone"]).alias("phones"))


@query("n3_redaction_placeholder", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'), '\+?\d[\d ()-]{7,}\d', '[REDACTED_PHONE]', 'g')) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(governance.redact(F.col("text")).cast("binary")).alias("h"))


@query("n4_masking", r"SELECT doc_id, e[1] || '***@' || string_split(e, '@')[-1] AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS e FROM documents)")
def _(t):
    e = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(governance.PII["email"]), F.lit(0))).alias("e"))
    return e.select("doc_id", X.mask_email(F.col("e")).alias("masked"))


@query("n6_salted_hash", "SELECT c_custkey, '[HASH:' || substr(sha256(c_name || 's1'), 1, 16) || ']' AS h FROM customer")
def _(t):
    return t("customer").select("c_custkey", X.salted_hash(F.col("c_name"), "s1").alias("h"))



@query("w16_hash_chain", "SELECT user_id AS log, count(*) AS rows, CAST(sum(CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM events GROUP BY user_id")
def _(t):
    chained = governance.chain(t("events").select("event_id", F.col("user_id").alias("log"), "ts", "event_type"), "log", ["ts", "event_id"], ["event_id", "event_type"])
    # one user's rows in ten have been changed since
    changed = F.when(F.pmod("event_id", F.lit(10)) == 3, F.lit("changed")).otherwise(F.col("event_type"))
    chained = chained.withColumn("event_type", changed)
    return governance.verify_chain(chained, "log", ["ts", "event_id"], ["event_id", "event_type"])
