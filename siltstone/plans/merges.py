"""Keyed merges: documents with their keywords, nodes and edges of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import sparse as S
from siltstone.registry import query
from siltstone.sources import keyed_table as K
from siltstone.sources.writers import shared_path


def _keywords(docs):
    """doc_id, keyword, frequency: the 50 most frequent words of three letters and more."""
    return S.frequent_words(docs, "doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), 50)


KEYWORDS = """k AS (SELECT doc_id, count(*) AS keywords, sum(n) AS total FROM (SELECT doc_id, w, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w) AS r
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM d) GROUP BY doc_id, w) WHERE r <= 50 GROUP BY doc_id)"""


@query(
    "s23_document_merge",
    f"""WITH d AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'second' WHEN lang = 'de' THEN 'first' ELSE source END AS source, CASE WHEN lang = 'de' THEN 'new words here ' || text ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'es'), {KEYWORDS}
    SELECT d.doc_id, d.source, length(d.text) AS chars, coalesce(keywords, 0) AS keywords, CAST(coalesce(total, 0) AS BIGINT) AS total FROM d LEFT JOIN k USING (doc_id)""",
)
def _(t):
    """All documents, then German ones with new texts, then those of one source under a new name, then Spanish ones deleted; keywords follow."""
    docs = t("documents").select("doc_id", "source", "text", "lang")
    spark = docs.sparkSession
    path, words = shared_path(spark, "documents"), shared_path(spark, "keywords")
    K.create(docs, path, ["doc_id"], 32)
    K.create(_keywords(docs), words, ["doc_id"], 32)
    first = docs.where("lang = 'de'").withColumns({"source": F.lit("first"), "text": F.concat(F.lit("new words here "), "text")})
    K.merge(spark, path, first, ["doc_id"], K.replacing(["doc_id"], ["source"]))
    second = K.read(spark, path).join(S.sent(docs.where("source = 'src1'").select("doc_id").distinct()), "doc_id", "left_semi").withColumn("source", F.lit("second"))
    K.merge(spark, path, second, ["doc_id"], K.replacing(["doc_id"], ["source"]))
    K.merge(spark, words, S.written(_keywords(first), "keywords"), ["doc_id"], K.regrouped(["doc_id"]))
    gone = docs.where("lang = 'es'").select("doc_id")
    for table in (path, words):
        K.merge(spark, table, gone, ["doc_id"], K.without(["doc_id"]))
    kept = K.read(spark, words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("keywords"), F.sum("frequency").alias("total"))
    zero = F.lit(0).cast("long")
    sizes = K.read(spark, path).select("doc_id", "source", F.length("text").cast("long").alias("chars"))  # so that no text is joined
    return sizes.join(kept, "doc_id", "left").select("doc_id", "source", "chars", F.coalesce("keywords", zero).alias("keywords"), F.coalesce("total", zero).alias("total"))


def _halves(t):
    """Events before and from the middle of their time on."""
    e = t("events")
    middle = e.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("m")).first()["m"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.where(at < middle), e.where(at >= middle)


def _merged(t, name, keys, make, fold):
    first, second = _halves(t)
    spark = first.sparkSession
    path = shared_path(spark, name)
    K.create(make(first), path, keys, 32)
    K.merge(spark, path, make(second), keys, fold)
    return K.read(spark, path)


@query(
    "g1_node_merge",
    "SELECT user_id, count(*) AS mentions, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_type, count(DISTINCT event_type) AS sources FROM events GROUP BY user_id",
)
def _(t):
    """Nodes of the first half of the events, merged with those of the second: mentions add up, sources unite, the latest type stays."""
    at = F.struct("ts", "event_id")

    def make(e):
        return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("mentions"), F.max(at).alias("seen"), F.max_by("event_type", at).alias("last_type"), F.array_sort(F.collect_set("event_type")).alias("sources"))

    fold = K.summed(["user_id"], mentions=F.sum("mentions"), seen=F.max("seen"), last_type=F.max_by("last_type", "seen"), sources=F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))))
    return _merged(t, "nodes", ["user_id"], make, fold).select("user_id", "mentions", F.col("seen.ts").alias("last_seen"), "last_type", F.size("sources").cast("long").alias("sources"))


@query("g2_edge_merge", "SELECT user_id, event_type, count(*) AS seen, max(value) AS confidence, max(event_id) AS last_source FROM events GROUP BY user_id, event_type")
def _(t):
    """Edges of a user and a kind of event, merged from two halves."""
    def make(e):
        return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("seen"), F.max("value").alias("confidence"), F.max("event_id").alias("last_source"))

    fold = K.summed(["user_id", "event_type"], seen=F.sum("seen"), confidence=F.max("confidence"), last_source=F.max("last_source"))
    return _merged(t, "edges", ["user_id", "event_type"], make, fold)
