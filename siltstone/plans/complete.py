"""Full forms of aggregates, graph statistics, redaction, chains and filters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import graph as G, networks as N, set_join as J
from siltstone.operators.relational import anchored, first_per, top_per
from siltstone.plans.graphs import N as CHAIN, _chain
from siltstone.registry import query
from siltstone.sources import keyed_table as K
from siltstone.sources.writers import shared_path

# -- graphs -------------------------------------------------------------------------------------

BOTH = f"{CHAIN}, u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(
    "g6_paths_up_to_three",
    f"""WITH {BOTH}, a AS (SELECT c_custkey AS a FROM customer WHERE contains(c_name, '77')), z AS (SELECT c_custkey AS b FROM customer WHERE contains(c_name, '88')),
    p AS (SELECT a, dst AS b, 1 AS hops FROM a JOIN u ON src = a UNION ALL SELECT a, y.dst, 2 FROM a JOIN u x ON x.src = a JOIN u y ON y.src = x.dst WHERE y.dst <> a
      UNION ALL SELECT a, z.dst, 3 FROM a JOIN u x ON x.src = a JOIN u y ON y.src = x.dst JOIN u z ON z.src = y.dst WHERE y.dst <> a AND z.dst <> x.dst)
    SELECT a, b, hops, count(*) AS paths FROM p JOIN z USING (b) WHERE a <> b GROUP BY a, b, hops""",
)
def _(t):
    """Undirected paths of one to three edges, none twice in a path, from the customers of one name part to those of another."""
    both = N.written(N.undirected(_chain(t)), "edges")
    ends = t("customer").where(F.contains("c_name", F.lit("88"))).select(F.col("c_custkey").alias("b"))
    step = lambda df, at: df.join(both.select(F.col("src").alias(at), F.col("dst").alias("next")), at)
    one = step(t("customer").where(F.contains("c_name", F.lit("77"))).select(F.col("c_custkey").alias("a"), F.col("c_custkey").alias("at")), "at").select("a", F.col("next").alias("x"))
    two = step(one, "x").where("next <> a").select("a", "x", F.col("next").alias("y"))
    three = step(two, "y").where("next <> x").select("a", F.col("next").alias("b"))
    every = one.select("a", F.col("x").alias("b"), F.lit(1).alias("hops")).union(two.select("a", "y", F.lit(2))).union(three.select("a", "b", F.lit(3)))
    return every.where("a <> b").join(ends, "b", "left_semi").groupBy("a", "b", "hops").agg(F.count(F.lit(1)).alias("paths"))


ROOTS = f"""WITH RECURSIVE {BOTH}, r AS (SELECT src AS node, src AS root FROM u UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.node WHERE r.root < u.dst),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), s AS (SELECT root, count(*) AS size FROM c GROUP BY root)"""


@query(
    "g7_component_summary",
    f"{ROOTS}, m AS (SELECT count(*) AS m FROM u WHERE src < dst) SELECT count(*) AS components, max(size) AS largest, CAST(sum(size) AS BIGINT) AS nodes, any_value(m) AS edges, round(2e0 * any_value(m) / (sum(size) * (sum(size) - 1)), 9) AS density FROM s, m",
)
def _(t):
    both = N.written(N.undirected(_chain(t)), "edges")
    sizes = G.connected(both).groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    edges = both.where("src < dst").agg(F.count(F.lit(1)).alias("edges"))
    one = sizes.agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.sum("size").alias("nodes")).crossJoin(edges)  # one row each
    return one.withColumn("density", F.round(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9))


@query(
    "g10_three_anomalies",
    f"""{ROOTS}, d AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY src), s2 AS (SELECT avg(degree) AS mean, stddev_pop(degree) AS sd FROM d)
    SELECT 'central' AS kind, node, degree AS value FROM d, s2 WHERE degree > mean + 2 * sd UNION ALL SELECT 'hub', node, degree FROM d, s2 WHERE degree > 3 * mean AND degree > 5 UNION ALL SELECT 'small_component', root, size FROM s WHERE size BETWEEN 3 AND 10""",
)
def _(t):
    """Degrees two deviations above the mean, degrees above three means and five, components of three to ten nodes."""
    both = N.written(N.undirected(_chain(t)), "edges")
    degree = N.written(both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "degrees")
    rated = degree.crossJoin(F.broadcast(degree.agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("sd"))))  # one row
    small = G.connected(both).groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size between 3 and 10")
    central = rated.where("degree > mean + 2 * sd").select(F.lit("central").alias("kind"), "node", F.col("degree").alias("value"))
    hub = rated.where("degree > 3 * mean and degree > 5").select(F.lit("hub").alias("kind"), "node", F.col("degree").alias("value"))
    return central.union(hub).union(small.select(F.lit("small_component"), "root", "size"))


# -- aggregates ---------------------------------------------------------------------------------


@query(
    "a24_split_contributions",
    """WITH c AS (SELECT DISTINCT l_partkey, l_returnflag || l_linestatus AS channel FROM lineitem), n AS (SELECT l_partkey, count(*) AS n FROM c GROUP BY l_partkey),
    p AS (SELECT p_partkey, p_retailprice AS score, n FROM part LEFT JOIN n ON l_partkey = p_partkey), s AS (SELECT coalesce(channel, 'unknown') AS channel, score / coalesce(n, 1) AS part FROM p LEFT JOIN c ON l_partkey = p_partkey)
    SELECT channel, round(sum(part), 4) AS score, round(sum(part) / (SELECT sum(score) FROM p), 8) AS share FROM s GROUP BY channel""",
)
def _(t):
    """A part's price split equally over the channels that hold it; parts of none are unknown."""
    held = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("channel")).groupBy("p_partkey").agg(F.collect_set("channel").alias("channels"))  # a few values
    parts = t("part").join(held, "p_partkey", "left")
    each = parts.select(F.explode(F.coalesce("channels", F.array(F.lit("unknown")))).alias("channel"), (F.col("p_retailprice") / F.coalesce(F.size("channels"), F.lit(1))).alias("part"))
    total = t("part").agg(F.sum("p_retailprice").alias("total"))
    return each.groupBy("channel").agg(F.sum("part").alias("sum")).crossJoin(F.broadcast(total)).select("channel", F.round("sum", 4).alias("score"), F.round(F.col("sum") / F.col("total"), 8).alias("share"))


@query(
    "a25_two_factor_mean",
    """WITH g AS (SELECT l_suppkey, l_partkey, max(l_discount) AS c, least(count(*) / 3e0, 1) * least(count(DISTINCT l_orderkey) / 2e0, 1) AS w FROM lineitem GROUP BY l_suppkey, l_partkey)
    SELECT l_suppkey, round(coalesce(sum(c * w) / nullif(sum(w), 0), 0), 9) AS mean FROM g GROUP BY l_suppkey""",
)
def _(t):
    """Confidence of a supplier's parts, weighted by the evidence (three rows count fully) and its sources (two orders do)."""
    w = F.least(F.count(F.lit(1)) / 3.0, F.lit(1.0)) * F.least(F.countDistinct("l_orderkey") / 2.0, F.lit(1.0))
    g = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("c"), w.alias("w"))
    return g.groupBy("l_suppkey").agg(F.round(F.coalesce(F.sum(F.col("c") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0)), F.lit(0.0)), 9).alias("mean"))


@query(
    "a26_merged_events",
    """SELECT user_id, event_type, arg_max(event_id, (value, event_id)) AS base, round(sum(epoch_us(ts) / 1e6 * value) / nullif(sum(value), 0), 0) AS at, array_to_string(list_sort(list_distinct(list(hour(ts)))), ',') AS hours, round(least(1.2e0 * avg(value / 400), 1), 9) AS confidence
    FROM events GROUP BY user_id, event_type""",
)
def _(t):
    """Events of a user and kind as one: the most confident one's row, the weighted time, the united hours, 1.2 times the mean confidence up to 1."""
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").groupBy("user_id", "event_type").agg(
        F.max_by("event_id", F.struct("value", "event_id")).alias("base"), F.round(F.sum(second * F.col("value")) / F.nullif(F.sum("value"), F.lit(0.0)), 0).alias("at"),
        F.array_join(F.array_sort(F.collect_set(F.hour("ts"))), ",").alias("hours"), F.round(F.least(1.2 * F.avg(F.col("value") / 400), F.lit(1.0)), 9).alias("confidence"),
    )


@query(
    "a27_merged_entities",
    """SELECT lower(trim(p_type)) || ' ' || p_size AS name, count(*) AS n, arg_max(p_partkey, (p_retailprice, p_partkey)) AS best, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS evidence, round(least(1, max(p_retailprice / 3000) + 0.1e0 * (count(*) - 1)), 9) AS confidence
    FROM part GROUP BY lower(trim(p_type)) || ' ' || p_size""",
)
def _(t):
    """Parts of one normalised name: the best row, the united brands as evidence, the highest confidence and a tenth more for each further row, up to 1."""
    name = F.concat_ws(" ", F.lower(F.trim("p_type")), F.col("p_size"))
    return t("part").groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("evidence"),
        F.round(F.least(F.lit(1.0), F.max(F.col("p_retailprice") / 3000) + 0.1 * (F.count(F.lit(1)) - 1)), 9).alias("confidence"),
    )


@query(
    "a14_correlation_patterns",
    """WITH g AS (SELECT l_suppkey, l_returnflag, l_linestatus, round(avg(l_discount) * 10, 9) AS s, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT 'strength' AS part, CASE WHEN s > 0.6 THEN 'strong' WHEN s > 0.4 THEN 'moderate' ELSE 'weak' END AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS top FROM g GROUP BY 1, 2
    UNION ALL SELECT 'dimension', l_returnflag, count_if(s > 0.5), round(avg(s), 9), max(s) FROM g GROUP BY l_returnflag
    UNION ALL SELECT 'pair', l_suppkey || ' ' || l_returnflag || l_linestatus, n, NULL, s FROM (SELECT *, row_number() OVER (ORDER BY s DESC, l_suppkey, l_returnflag, l_linestatus) AS r FROM g) WHERE r <= 5
    UNION ALL SELECT 'evidence', CAST(n // 50 * 50 AS VARCHAR), count(*), NULL, NULL FROM g GROUP BY n // 50""",
)
def _(t):
    """Bins of strength, figures of each dimension, the five strongest pairs and a histogram of their evidence."""
    g = N.written(t("lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount") * 10, 9).alias("s"), F.count(F.lit(1)).alias("n")), "pairs")
    none = F.lit(None).cast("double")
    bins = g.groupBy(F.when(F.col("s") > 0.6, "strong").when(F.col("s") > 0.4, "moderate").otherwise("weak").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("strength").alias("part"), "name", "n", none.alias("mean"), none.alias("top"))
    dims = g.groupBy("l_returnflag").agg(F.count_if(F.col("s") > 0.5).alias("n"), F.round(F.avg("s"), 9).alias("mean"), F.max("s").alias("top")).select(F.lit("dimension"), "l_returnflag", "n", "mean", "top")
    pairs = g.orderBy(F.desc("s"), "l_suppkey", "l_returnflag", "l_linestatus").limit(5).select(F.lit("pair"), F.concat("l_suppkey", F.lit(" "), "l_returnflag", "l_linestatus"), "n", none, "s")
    held = g.groupBy((F.floor(F.col("n") / 50) * 50).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("evidence"), "name", "n", none, none)
    return bins.union(dims).union(pairs).union(held)


# -- evaluation and filters ---------------------------------------------------------------------


@query(
    "e12_ndcg_per_k",
    """WITH r AS (SELECT l_suppkey AS q, l_partkey AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS n, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rel FROM lineitem GROUP BY l_suppkey, l_partkey),
    t AS (SELECT q, sum(rel) AS total FROM r GROUP BY q), k AS (SELECT unnest([1, 3, 5, 10, 20]) AS k), m AS (SELECT q, max(1e0 / n) FILTER (rel = 1) AS mrr FROM r GROUP BY q),
    s AS (SELECT k, q, sum(rel) AS hits, sum(rel / log2(n + 1)) AS dcg FROM r, k WHERE n <= k GROUP BY k, q), i AS (SELECT k, total, (SELECT sum(1 / log2(j + 1)) FROM range(1, CAST(least(k, total) AS BIGINT) + 1) x(j)) AS ideal FROM (SELECT DISTINCT k, total FROM k, t WHERE total > 0) y)
    SELECT s.k, round(avg(hits * 1e0 / s.k), 9) AS precision, round(avg(hits * 1e0 / t.total), 9) AS recall, round(avg(dcg / ideal), 9) AS ndcg, round(avg(coalesce(mrr, 0)), 9) AS mrr FROM s JOIN t USING (q) JOIN i ON i.k = s.k AND i.total = t.total JOIN m USING (q) GROUP BY s.k""",
)
def _(t):
    """Precision, recall and binary nDCG at 1, 3, 5, 10 and 20, and the reciprocal rank over the whole list, of suppliers with a relevant part."""
    rows = t("lineitem").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("d")).agg(F.sum("l_quantity").alias("amount"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("rel"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("amount"), "d")))
    gain = F.col("rel") / F.log2(F.col("n") + 1)
    at = lambda k, v: F.sum(F.when(F.col("n") <= k, v).otherwise(0)).alias
    ks = [1, 3, 5, 10, 20]
    own = ranked.groupBy("q").agg(F.sum("rel").alias("total"), F.max(F.when(F.col("rel") == 1, 1.0 / F.col("n"))).alias("mrr"), *[at(k, F.col("rel"))(f"h{k}") for k in ks], *[at(k, gain)(f"g{k}") for k in ks]).where("total > 0")
    each = own.select("total", "mrr", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col(f"g{k}").alias("dcg")) for k in ks])).alias("x")).select("total", "mrr", "x.*")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("k").cast("long"), F.col("total")).cast("int")), F.lit(0.0), lambda a, j: a + 1 / F.log2(j + 1))
    return each.groupBy("k").agg(F.round(F.avg(F.col("hits") / F.col("k")), 9).alias("precision"), F.round(F.avg(F.col("hits") / F.col("total")), 9).alias("recall"), F.round(F.avg(F.col("dcg") / ideal), 9).alias("ndcg"), F.round(F.avg(F.coalesce("mrr", F.lit(0.0))), 9).alias("mrr"))


GAP = 21_600


@query(
    "p13_snapshot_filter",
    f"""WITH RECURSIVE f AS (SELECT user_id, event_id, ts, md5(event_type || CAST(floor(value) AS VARCHAR)) AS digest FROM events WHERE event_type IN ('view', 'click', 'purchase') AND value >= 5 AND NOT regexp_matches(props, '"k": 1[0-9]}}')),
    d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, digest ORDER BY ts, event_id) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM d),
    k AS (SELECT user_id, event_id, ts, n, ts AS anchor FROM n WHERE n = 1 UNION ALL SELECT n.user_id, n.event_id, n.ts, n.n, CASE WHEN epoch_us(n.ts) - epoch_us(k.anchor) >= {GAP}000000 THEN n.ts ELSE k.anchor END FROM k JOIN n ON n.user_id = k.user_id AND n.n = k.n + 1)
    SELECT user_id, event_id FROM k WHERE ts = anchor""",
)
def _(t):
    """Snapshots of an allowed kind, size and address, the first of each content, and of those each that lies six hours after the last one kept."""
    kept = t("events").where(F.col("event_type").isin("view", "click", "purchase") & (F.col("value") >= 5) & ~F.col("props").rlike('"k": 1[0-9]}'))
    digest = F.md5(F.concat("event_type", F.floor("value").cast("string")).cast("binary"))
    first = first_per(kept.withColumn("digest", digest), ["user_id", "digest"], ["ts", "event_id"]).select("user_id", "ts", "event_id")
    return anchored(first, "user_id", "ts", "event_id", GAP).where("ts = anchor").select("user_id", "event_id")


# -- redaction, log and store -------------------------------------------------------------------

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(
    "n3_five_modes",
    f"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '{MAIL}') AS e, string_split_regex(text, '{MAIL}') AS g FROM documents WHERE regexp_matches(text, '{MAIL}')),
    m AS (SELECT doc_id, text, e, g, unnest(['mask', 'hash', 'placeholder', 'remove', 'anonymize']) AS mode FROM s),
    r AS (SELECT doc_id, mode, g, list_transform(e, lambda x: CASE mode WHEN 'mask' THEN x[1] || repeat('*', length(x) - 2) || x[-1] WHEN 'hash' THEN '[' || substr(sha256(x), 1, 8) || ']' WHEN 'placeholder' THEN '[EMAIL]' WHEN 'remove' THEN '' ELSE 'user' || substr(md5(x), 1, 4) || '@example.com' END) AS w FROM m)
    SELECT doc_id, mode, md5(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(w[i], '')), '')) AS digest, w[1] AS first FROM r""",
)
def _(t):
    """Mail addresses by each mode: masked but for both ends, hashed, as a placeholder, removed, or as another address; each match by its own value."""
    d = t("documents").where(F.regexp_like("text", F.lit(MAIL)))
    e, g = F.regexp_extract_all("text", F.lit(MAIL), F.lit(0)), F.split("text", MAIL, -1)
    ways = {
        "mask": lambda x: F.concat(F.left(x, F.lit(1)), F.repeat(F.lit("*"), F.length(x) - 2), F.right(x, F.lit(1))), "hash": lambda x: F.concat(F.lit("["), F.left(F.sha2(x, 256), F.lit(8)), F.lit("]")), "placeholder": lambda x: F.lit("[EMAIL]"),
        "remove": lambda x: F.lit(""), "anonymize": lambda x: F.concat(F.lit("user"), F.left(F.md5(x.cast("binary")), F.lit(4)), F.lit("@example.com")),
    }
    rows = d.select("doc_id", e.alias("e"), g.alias("g"))
    each = rows.select("doc_id", "g", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.transform("e", f).alias("w")) for m, f in ways.items()])).alias("x")).select("doc_id", "g", "x.*")
    whole = F.array_join(F.zip_with("g", "w", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return each.select("doc_id", "mode", F.md5(whole.cast("binary")).alias("digest"), F.get("w", F.lit(0)).alias("first"))


@query(
    "n8_damaged_log",
    """WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), h AS (SELECT *, md5(user_id || '|' || n || '|' || event_type) AS own FROM n), c AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY n), 'start') AS before FROM h),
    s AS (SELECT user_id, event_id, n, CASE WHEN event_id % 97 = 5 THEN 'changed' ELSE event_type END AS event_type, own, before FROM c WHERE event_id % 89 <> 7),
    v AS (SELECT *, own <> md5(user_id || '|' || n || '|' || event_type) AS altered, before <> coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY n), 'start') AS gap FROM s)
    SELECT user_id, count(*) AS rows, count_if(altered) AS altered, count_if(gap) AS gaps FROM v GROUP BY user_id""",
)
def _(t):
    """A log whose rows hold their own and the earlier row's hash; a rule then alters some rows and takes some away, and the check finds both."""
    order = Window.partitionBy("user_id").orderBy("n")
    numbered = t("events").select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    own = F.md5(F.concat_ws("|", "user_id", "n", "event_type").cast("binary"))
    log = numbered.withColumn("own", own).withColumn("before", F.coalesce(F.lag("own").over(order), F.lit("start")))
    stored = N.written(log.where("event_id % 89 <> 7").withColumn("event_type", F.when(F.expr("event_id % 97 = 5"), "changed").otherwise(F.col("event_type"))), "log")
    checked = stored.withColumn("altered", F.col("own") != own).withColumn("gap", F.col("before") != F.coalesce(F.lag("own").over(order), F.lit("start")))
    return checked.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("altered").alias("altered"), F.count_if("gap").alias("gaps"))


@query("s24_store_updates", "SELECT doc_id, CASE WHEN source = 'src2' THEN md5('second ' || text) ELSE md5(text) END AS content_hash, length(text) + CASE WHEN source = 'src2' THEN 7 ELSE 0 END AS chars FROM documents WHERE source IS DISTINCT FROM 'src3'")
def _(t):
    """Documents put into a store, those of one source updated, those of another deleted, the rest got back."""
    make = lambda d: d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"), F.length("text").cast("long").alias("chars"))
    d = t("documents")
    path = shared_path(d.sparkSession, "store")
    K.create(make(d), path, ["doc_id"], 16)
    K.merge(d.sparkSession, path, make(d.where("source = 'src2'").withColumn("text", F.concat(F.lit("second "), "text"))), ["doc_id"], K.replacing(["doc_id"], ["content_hash"]))
    K.merge(d.sparkSession, path, d.where("source = 'src3'").select("doc_id"), ["doc_id"], K.without(["doc_id"]))
    return K.read(d.sparkSession, path)


UNITS = r"(\d+(?:\.\d+)?) ?(%|kg|km|cm|mm|ms|GB|MB|USD|EUR|years|days|hours)"


@query("f38_numbers_with_units", f"WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{UNITS}')) AS hit, unnest(regexp_extract_all(text, '{UNITS}', 1)) AS value, unnest(regexp_extract_all(text, '{UNITS}', 2)) AS unit FROM documents) SELECT doc_id, unit, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 6) AS total FROM n GROUP BY doc_id, unit")
def _(t):
    pick = lambda i: F.regexp_extract_all("text", F.lit(UNITS), F.lit(i))
    rows = t("documents").select("doc_id", F.explode(F.arrays_zip(pick(1).alias("value"), pick(2).alias("unit"))).alias("x"))
    return rows.groupBy("doc_id", "x.unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x.value").cast("double")), 6).alias("total"))


#: Words that are no keywords.
STOP = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how", "its", "may", "new", "now", "old", "see", "two", "who", "boy", "did", "man", "put", "say", "she", "too", "use", "way", "will", "with"]


@query(
    "a21_fifty_keywords",
    f"""SELECT doc_id, w AS keyword, n FROM (SELECT doc_id, w, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w) AS r FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM documents)
    WHERE w NOT IN ({", ".join(f"'{w}'" for w in STOP)}) GROUP BY doc_id, w) WHERE r <= 50""",
)
def _(t):
    words = t("documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("keyword")).where(~F.col("keyword").isin(STOP))
    counted = words.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return top_per(counted, ["doc_id"], [F.desc("n"), "keyword"], 50, "__r").drop("__r")


# -- claims, quality and keywords ---------------------------------------------------------------


@query(
    "a16_claim_graph_summary",
    f"""{ROOTS}, x AS (SELECT DISTINCT src AS node FROM u), m AS (SELECT count(*) AS m FROM u WHERE src < dst), n AS (SELECT count(*) AS n FROM x)
    SELECT 'status' AS part, c_mktsegment AS name, count(*) * 1e0 AS value FROM x JOIN customer ON c_custkey = node GROUP BY c_mktsegment
    UNION ALL SELECT 'relation', least(a.c_mktsegment, b.c_mktsegment) || ' ' || greatest(a.c_mktsegment, b.c_mktsegment), count(*) FROM u JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst WHERE src < dst GROUP BY 2
    UNION ALL SELECT 'components', 'weak', count(*) FROM s UNION ALL SELECT 'density', '', round(2e0 * m / (n * (n - 1)), 9) FROM m, n""",
)
def _(t):
    """Counts of nodes by status and of edges by kind, weak components and density."""
    both = N.written(N.undirected(_chain(t)), "edges")
    kind = t("customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("s"))
    nodes = both.select(F.col("src").alias("node")).distinct()
    status = nodes.join(kind, "node").groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("status").alias("part"), F.col("s").alias("name"), "value")
    ends = both.where("src < dst").join(kind.toDF("src", "a"), "src").join(kind.toDF("dst", "b"), "dst").select(F.concat_ws(" ", F.least("a", "b"), F.greatest("a", "b")).alias("name"))
    relation = ends.groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("relation"), "name", "value")
    weak = G.connected(both).select("root").distinct().agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("components"), F.lit("weak"), "value")
    n, m = F.countDistinct("src"), F.count_if(F.col("src") < F.col("dst"))
    density = both.agg(F.round(2.0 * m / (n * (n - 1)), 9).alias("value")).select(F.lit("density"), F.lit(""), "value")
    return status.union(relation).union(weak).union(density)


@query(
    "m4_source_quality",
    """WITH d AS (SELECT source, lang, least(n_chars / 3000e0, 1) AS q FROM documents WHERE source IS NOT NULL) SELECT source, count(*) AS n, count(DISTINCT lang) AS types, round(avg(q), 9) AS mean, count_if(q > 0.7) AS high, count_if(q BETWEEN 0.4 AND 0.7) AS middle, count_if(q < 0.4) AS low FROM d GROUP BY source""",
)
def _(t):
    q = F.col("q")
    d = t("documents").where("source is not null").select("source", "lang", F.least(F.col("n_chars") / 3000.0, F.lit(1.0)).alias("q"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("types"), F.round(F.avg("q"), 9).alias("mean"), F.count_if(q > 0.7).alias("high"), F.count_if(q.between(0.4, 0.7)).alias("middle"), F.count_if(q < 0.4).alias("low"))


def _mean(value, when):
    """The mean of a double where a condition holds, from a sum of decimals: the same in any order of rows, so that thresholds decide alike.

    Groups with values that no decimal of 15 places holds (NaN, infinite, very large or fine), or whose sum none holds, have the sum of doubles.
    """
    held = F.when(when, value)
    near = held.try_cast("decimal(38,15)")
    exact = F.when(near.cast("double") == held, near)
    mean = F.when(F.count(exact) == F.count(held), F.try_sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0)))
    return F.coalesce(mean, F.avg(held))


@query(
    "m10_status_with_degradations",
    """WITH b AS (SELECT user_id, event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') AS b FROM events GROUP BY user_id, event_type),
    g AS (SELECT user_id, avg(CASE WHEN b >= 30 THEN 1e0 ELSE 0 END) AS share, count_if((b - a) / a < -0.05) AS degraded FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY user_id)
    SELECT user_id, round(share, 6) AS share, degraded, CASE WHEN share < 0.8 OR degraded > 1 THEN 'failed' WHEN degraded = 1 THEN 'degraded' ELSE 'passed' END AS status FROM g""",
)
def _(t):
    """Each user's kinds of event as metrics: the share over its threshold in the second half, and how many fell by more than a twentieth."""
    late = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    b = t("events").groupBy("user_id", "event_type").agg(_mean(F.col("value"), ~late).alias("a"), _mean(F.col("value"), late).alias("b")).where("a is not null and b is not null")
    # a fall from a mean of 0 is infinite
    fell = F.when(F.col("a") == 0, F.col("b") < 0).otherwise((F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0)) < -0.05)
    g = b.groupBy("user_id").agg(F.avg(F.when(F.col("b") >= 30, 1.0).otherwise(0.0)).alias("share"), F.count_if(fell).alias("degraded"))
    status = F.when((F.col("share") < 0.8) | (F.col("degraded") > 1), "failed").when(F.col("degraded") == 1, "degraded").otherwise("passed")
    return g.select("user_id", F.round("share", 6).alias("share"), "degraded", status.alias("status"))


@query(
    "q14_readability",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+'), lambda x: true) AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s FROM documents),
    f AS (SELECT doc_id, len(w) * 1e0 / s AS words, len(list_distinct(w)) * 1e0 / len(w) AS rich, len(list_filter(w, lambda x: length(x) > 6)) * 1e0 / len(w) AS complex, list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouyà-æè-ïò-öù-ü]+')), 1))) * 1e0 / len(w) AS syllables FROM w WHERE len(w) > 0),
    z AS (SELECT *, 206.835e0 - 1.015e0 * words - 84.6e0 * syllables AS flesch FROM f)
    SELECT doc_id, round(words, 6) AS sentence_length, round(rich, 6) AS richness, round(complex, 6) AS complex, round(flesch, 6) AS flesch, round((least(words / 25, 1) + rich + complex + least(greatest(flesch, 0), 100) / 100) / 4, 6) AS score FROM z""",
)
def _(t):
    """Sentence length, richness of words, share of long words, Flesch's reading ease over groups of vowels, and the mean of the four as shares."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))
    w = t("documents").select("doc_id", words.alias("w"), F.greatest(F.regexp_count("text", F.lit("[.!?]+")), F.lit(1)).alias("s")).where(F.size("w") > 0)
    n = F.size("w")
    parts = F.aggregate(F.transform("w", lambda x: F.greatest(F.regexp_count(x, F.lit("[aeiouyà-æè-ïò-öù-ü]+")), F.lit(1))), F.lit(0), lambda a, x: a + x)
    f = w.select("doc_id", (n / F.col("s")).alias("words"), (F.size(F.array_distinct("w")) / n).alias("rich"), (F.size(F.filter("w", lambda x: F.length(x) > 6)) / n).alias("complex"), (parts / n).alias("syllables"))
    z = f.withColumn("flesch", 206.835 - 1.015 * F.col("words") - 84.6 * F.col("syllables"))
    score = (F.least(F.col("words") / 25, F.lit(1.0)) + F.col("rich") + F.col("complex") + F.least(F.greatest("flesch", F.lit(0.0)), F.lit(100.0)) / 100) / 4
    return z.select("doc_id", *[F.round(c, 6).alias(a) for c, a in (("words", "sentence_length"), ("rich", "richness"), ("complex", "complex"), ("flesch", "flesch"), (score, "score"))])


@query(
    "d7_quality_representatives",
    """WITH q AS (SELECT doc_id, md5(text) AS h, 0.3e0 * least(n_chars / 2000e0, 1) + 0.3e0 * ((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (text <> '')::INT) / 3 + 0.2e0 * CASE WHEN source IN ('src1', 'src2', 'src3') THEN 1 ELSE 0.5e0 END + 0.2e0 * coalesce(quality, 0) AS q
      FROM documents LEFT JOIN (SELECT doc_id AS d, max(quality) AS quality FROM labels GROUP BY doc_id) ON d = doc_id WHERE text IS NOT NULL)
    SELECT h AS digest, count(*) AS copies, arg_max(doc_id, (q, -doc_id)) AS representative, round(max(q), 9) AS quality FROM q GROUP BY h HAVING count(*) > 1""",
)
def _(t):
    """Of equal texts the document of the highest quality: length, completeness, authority of the source and relevance by its label."""
    labels = t("labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    d = t("documents").where("text is not null").join(labels, "doc_id", "left")
    full = F.col("lang").isNotNull().cast("int") + F.col("source").isNotNull().cast("int") + (F.col("text") != "").cast("int")
    authority = F.when(F.col("source").isin("src1", "src2", "src3"), 1.0).otherwise(0.5)
    q = 0.3 * F.least(F.col("n_chars") / 2000.0, F.lit(1.0)) + 0.3 * full / 3 + 0.2 * authority + 0.2 * F.coalesce("label", F.lit(0))
    rows = d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), q.alias("q"))
    best = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max_by("doc_id", F.struct("q", -F.col("doc_id"))).alias("representative"), F.round(F.max("q"), 9).alias("quality"))
    return best.where("copies > 1")


@query(
    "f41_keywords_and_phrases",
    f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-záčďéěíňóřšťúůýž]{{3,}}'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in STOP)})) AS w FROM benchmark),
    k AS (SELECT item_id, list_concat(w, list_transform(range(1, len(w) // 2 + 1), lambda i: w[2 * i - 1] || '_' || w[2 * i])) AS k FROM w) SELECT item_id, array_to_string(k[:20], ' ') AS keywords, len(k) AS n FROM k""",
)
def _(t):
    """Words of three letters and more without stop words, then their pairs one after another, the first twenty."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-záčďéěíňóřšťúůýž]{3,}"), F.lit(0)), lambda w: ~w.isin(STOP))
    w = t("benchmark").select("item_id", words.alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    pairs = F.transform(F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws("_", F.get("w", 2 * i), F.get("w", 2 * i + 1)))
    k = w.select("item_id", F.concat("w", pairs).alias("k"))
    return k.select("item_id", F.array_join(F.slice("k", 1, 20), " ").alias("keywords"), F.size("k").cast("long").alias("n"))


ENDS = "list_distinct(list_concat(list_concat([coalesce(source, '')], w[:5]), w[-5:]))"


@query(
    "r12_signature_near_copies",
    f"""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, {ENDS} AS s FROM w WHERE len(w) > 0)
    SELECT doc_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id < a.doc_id AND 5 * len(list_intersect(a.s, b.s)) > 4 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))""",
)
def _(t):
    """Documents to which none with a smaller id is alike by more than 0.8 in source, first five and last five words."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    d = t("documents").select("doc_id", "source", words.alias("w")).where(F.size("w") > 0)
    ends = F.concat(F.array(F.coalesce("source", F.lit(""))), F.slice("w", 1, 5), F.reverse(F.slice(F.reverse("w"), 1, 5)))
    sets = J.written_sets(J.word_sets(d, "doc_id", ends))
    later = J.similar_sets(sets, J.Fraction(4, 5), strictly=True).select(F.greatest("a", "b").alias("id")).distinct()
    return sets.join(later, "id", "left_anti").select(F.col("id").alias("doc_id"))
