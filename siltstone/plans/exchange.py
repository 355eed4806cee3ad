"""Stages that write and read back: appends, crawled pages, exports, caches, streams through tables, and user functions over batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.operators import chunking, governance, retrieval as V
from siltstone.plans.retrieval import COS, _queries
from siltstone.registry import query
from siltstone.sources import readers, writers
from siltstone.streaming import streams as S


def _back(df, name: str):
    path = writers.shared_path(df.sparkSession, name)
    writers.write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


# -- sources and sinks -----------------------------------------------------------------------------------


@query("s5_table_appends", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = writers.shared_path(o.sparkSession, "appended")
    for status in ("F", "O", "P"):  # three chunks, one table, one schema
        writers.write_parquet(o.where(F.col("o_orderstatus") == status), path, mode="append")
    return o.sparkSession.read.schema(o.schema).parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s11_streaming_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    """Nested values are kept."""
    e = t("events").select("event_id", F.from_json("props", "k long").alias("props"))
    spark, path = e.sparkSession, writers.shared_path(e.sparkSession, "json")
    e.write.json(path)
    out = writers.shared_path(spark, "read")
    S.stage(spark.readStream.schema("event_id long, props struct<k: long>").json(path), out, writers.shared_path(spark, "at")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "props.k")


@query("s13_streaming_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def _(t):
    """Every column a string, as no types are inferred."""
    s = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    spark, path = s.sparkSession, writers.shared_path(s.sparkSession, "csv")
    s.write.option("header", True).option("sep", ";").csv(path)
    out = writers.shared_path(spark, "read")
    S.stage(spark.readStream.schema("s_suppkey string, s_name string, s_nationkey string").option("header", True).option("sep", ";").csv(path), out, writers.shared_path(spark, "at")).awaitTermination()
    return spark.read.parquet(out)


@query("s14_raw_scrape_sink", "SELECT url, length(html) AS chars, CAST(200 AS BIGINT) AS status FROM pages")
def _(t):
    """Raw rows with their metadata as a JSON string; a stream picks up the new files and hands them on."""
    p = t("pages").select("url", F.col("html").alias("content"), F.to_json(F.struct(F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"))).alias("metadata"))
    spark, path = p.sparkSession, writers.shared_path(p.sparkSession, "raw")
    writers.write_parquet(p, path)
    out = writers.shared_path(spark, "handed")
    S.stage(spark.readStream.schema(p.schema).parquet(path), out, writers.shared_path(spark, "at")).awaitTermination()
    return spark.read.parquet(out).select("url", F.length("content").cast("long").alias("chars"), F.get_json_object("metadata", "$.status_code").cast("long").alias("status"))


@query("s15_crawl_result_sink", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def _(t):
    """One partition a day; the filter reads the days asked for only."""
    e = t("events").select("event_id", F.to_date("ts").alias("day"))
    path = writers.shared_path(e.sparkSession, "crawl")
    writers.write_partitioned(e, path, ["day"])
    return e.sparkSession.read.parquet(path).where("day >= DATE '2024-01-10'").groupBy("day").agg(F.count("*").alias("n"))


@query("s20_warc_writer", "SELECT url, count(*) AS n, min(length(html)) AS shortest FROM pages GROUP BY url")
def _(t):
    """Members joined end to end are one archive a url; the parser finds every record again."""
    m = writers.archive_members(t("pages"))
    archives = m.groupBy("url").agg(F.array_join(F.transform(F.collect_list("member"), lambda b: F.hex(b)), "").alias("digits"))
    raw = _back(archives.select(F.col("url").alias("path"), F.unhex("digits").alias("content")), "archives")
    found = readers.warc_records(raw).select("url", F.length(F.decode("body", "UTF-8")).cast("long").alias("chars"))
    return found.groupBy("url").agg(F.count("*").alias("n"), F.min("chars").alias("shortest"))


_MD5 = "md5(text)"
_VECTOR = "[CAST('0x' || substr(m, 1 + 2 * i, 2) AS INT) / 255e0 FOR i IN range(16)]"


def _embedded(rows, text: str):
    """The fallback embedding: the 16 bytes of the md5 over 255, then zeros up to 384."""
    word = lambda i: F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1 + 8 * (i // 4), 8), 16, 10).cast("long")
    byte = lambda i: F.shiftright(word(i), 24 - 8 * (i % 4)).bitwiseAND(F.lit(255)).cast("double") / 255.0
    return F.concat(F.array(*[byte(i) for i in range(16)]), F.array_repeat(F.lit(0.0), 368))


@query("z6_embedding_function", f"SELECT item_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS head, CAST(384 AS BIGINT) AS size FROM (SELECT item_id, {_VECTOR} AS v FROM (SELECT item_id, {_MD5} AS m FROM benchmark))")
def _(t):
    v = t("benchmark").select("item_id", _embedded(t("benchmark"), "text").alias("v"))
    return v.select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(F.col("v")[0], 6).alias("head"), F.size("v").cast("long").alias("size"))


@query("s26_embedding_index", f"SELECT doc_id, level, chunk_index, round(list_sum({_VECTOR}), 6) AS total FROM (SELECT doc_id, 3 AS level, i AS chunk_index, md5(substr(text, i * 103 + 1, 128)) AS m FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 25) / 103e0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0))")
def _(t):
    """Sentence-size chunks of every text with their vectors, as a table."""
    c = chunking.chunk_texts(t("documents").select("doc_id", "text"), "doc_id", "text", 3)
    index = _back(c.select("doc_id", "level", "chunk_index", _embedded(c, "chunk").alias("v")), "index")

    def totals(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.round(v.sum(axis=1), 6))], ["doc_id", "level", "chunk_index", "total"])

    kinds = dict(index.dtypes)
    return index.select("doc_id", "level", "chunk_index", "v").mapInArrow(totals, f"doc_id {kinds['doc_id']}, level {kinds['level']}, chunk_index {kinds['chunk_index']}, total double")


@query("s32_graph_export", "SELECT 'part' AS kind, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem) UNION ALL SELECT 'supplier', count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem) UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def _(t):
    """Node and edge tables as JSON, read back."""
    e = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    nodes = e.select(F.lit("part").alias("kind"), F.col("l_partkey").alias("id")).union(e.select(F.lit("supplier"), "l_suppkey")).distinct()
    spark, path = e.sparkSession, writers.shared_path(e.sparkSession, "graph")
    writers.export(nodes, f"{path}/nodes", "json")
    writers.export(e, f"{path}/edges", "json")
    n = spark.read.schema("kind string, id long").json(f"{path}/nodes").groupBy("kind").agg(F.count("*").alias("n"))
    return n.union(spark.read.schema("l_partkey long, l_suppkey long").json(f"{path}/edges").select(F.lit("edge").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")))


@query("s33_claim_graph_round_trip", "SELECT o_orderkey AS claim, o_totalprice AS confidence, count(DISTINCT (l_linenumber, l_suppkey, l_partkey)) AS evidence, count(DISTINCT l_suppkey) AS sources FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    claims = t("orders").select(F.col("o_orderkey").alias("claim"), F.col("o_totalprice").alias("confidence"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("evidence")
    evidence = t("lineitem").select(key, F.col("l_suppkey").alias("source")).distinct()
    relations = t("lineitem").select(F.col("l_orderkey").alias("claim"), key).distinct()
    spark, path = claims.sparkSession, writers.shared_path(claims.sparkSession, "claims")
    back = []
    for name, df in (("claims", claims), ("evidence", evidence), ("relations", relations)):
        writers.export(df, f"{path}/{name}", "json")
        back.append(spark.read.schema(df.schema).json(f"{path}/{name}"))
    c, e, r = back
    return c.join(r, "claim").join(e, "evidence").groupBy("claim", "confidence").agg(F.count("*").alias("evidence"), F.countDistinct("source").alias("sources"))


@query("s34_sources_csv", "SELECT page_id, url, length(html) AS chars, page_id % 2 = 0 AS verified, url AS meta_url FROM pages")
def _(t):
    p = t("pages").select("page_id", "url", F.length("html").alias("chars"), (F.pmod("page_id", F.lit(2)) == 0).alias("verified"), F.struct(F.col("url").alias("from")).alias("metadata"))
    path = writers.shared_path(p.sparkSession, "sources")
    writers.export(p, path, "csv")
    back = p.sparkSession.read.option("header", True).option("escape", "\\").schema("page_id long, url string, chars long, verified boolean, metadata string").csv(path)
    return back.select("page_id", "url", "chars", "verified", F.get_json_object("metadata", "$.from").alias("meta_url"))


@query("s36_cache_table", "SELECT k, hits, chars FROM (SELECT sha256(text) AS k, count(*) AS hits, max(n_chars) AS chars FROM documents GROUP BY 1) WHERE chars >= 300")
def _(t):
    """Entries by key with access counts; expired ones are not found."""
    c = t("documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("k")).agg(F.count("*").alias("hits"), F.max("n_chars").alias("chars"))
    return _back(c.withColumn("expired", F.col("chars") < 300), "cache").where("NOT expired").drop("expired")


@query("s38_collection_schema", "SELECT vec_id AS id, 'label-' || label AS source, len(embedding) AS dim, round(embedding[1], 5) AS head FROM embeddings")
def _(t):
    """A collection of fixed types: id, source and float vectors, as batches are added."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("label-"), "label").alias("source"), F.col("embedding").cast("array<float>").alias("vector"))
    path = writers.shared_path(e.sparkSession, "collection")
    for i in range(2):
        writers.write_parquet(e.where(F.pmod("id", F.lit(2)) == i), path, mode="append")
    back = e.sparkSession.read.schema(e.schema).parquet(path)
    return back.select("id", "source", F.size("vector").cast("long").alias("dim"), F.round(F.col("vector")[0], 5).alias("head"))


# -- streams through tables --------------------------------------------------------------------------------


#: Files of a micro-batch for every task slot: what a batch costs the driver (offsets, log, commit) is shared by the work of all slots.
FILES_A_TASK = 8


@query("x1_micro_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    """Rows arrive in files of 4,000 and are flushed in batches of FILES_A_TASK files for every task slot, all of them at the end."""
    e = t("events").select("event_id", "event_type")
    spark, path, out = e.sparkSession, writers.shared_path(e.sparkSession, "arrived"), writers.shared_path(e.sparkSession, "flushed")
    e.write.option("maxRecordsPerFile", "4000").parquet(path)
    S.stage(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", str(FILES_A_TASK * spark.sparkContext.defaultParallelism)).parquet(path), out, writers.shared_path(spark, "at")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("x17_chained_stages", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE length(trim(text)) > 0 GROUP BY lang")
def _(t):
    """Raw, cleaned and aggregated tables; each stage streams the table before it."""
    d = t("documents").select("doc_id", "lang", "text")
    spark = d.sparkSession
    raw, clean = writers.shared_path(spark, "bronze"), writers.shared_path(spark, "silver")
    writers.write_parquet(d, raw)
    S.stage(spark.readStream.schema(d.schema).parquet(raw).where(F.length(F.trim("text")) > 0).withColumn("chars", F.length("text")), clean, writers.shared_path(spark, "at")).awaitTermination()
    return spark.read.parquet(clean).groupBy("lang").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"))


# -- user functions and batches ------------------------------------------------------------------------------


def _scored(frames):
    for pdf in frames:
        yield pd.DataFrame({"event_id": pdf["event_id"], "score": (pdf["value"] / 100.0).clip(upper=1.0).round(6)})


SCORED = "SELECT event_id, round(least(value / 100e0, 1e0), 6) AS score FROM events"


@query("z1_chunk_processor", SCORED)
def _(t):
    """A user's function over chunks of rows."""
    return t("events").select("event_id", "value").mapInPandas(_scored, "event_id long, score double")


@query("p2_batch_iteration", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def _(t):
    """Batches of rows, each reduced where it is read; no frame is collected."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"rows": [len(pdf)], "ids": [pdf["doc_id"].nunique()], "chars": [int(pdf["n_chars"].sum())]})

    b = t("documents").select("doc_id", "n_chars").mapInPandas(run, "rows long, ids long, chars long")
    return b.agg(*[F.sum(c).alias(c) for c in ("rows", "ids", "chars")])


@query("z5_expression_lists", "SELECT l_shipmode AS k, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1)")
def _(t):
    steps = [F.concat("l_returnflag", "l_linestatus").alias("k")]
    return t("lineitem").where(F.expr("l_quantity > 10")).groupBy(*steps).agg(*[F.count("*").alias("n")])


@query("z7_weighted_mean", "SELECT event_type, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS mean FROM events GROUP BY event_type")
def _(t):
    """An aggregate of a user's own as two sums, which combine before the shuffle; a grouped Python function would gather each group."""
    w = 1 + F.pmod("user_id", F.lit(3))
    return t("events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("mean"))


@query("n8_append_only_log", "SELECT user_id AS log, count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM events GROUP BY user_id")
def _(t):
    """Two appends to one table, chained by log; read back, every link holds."""
    e = t("events").select("event_id", F.col("user_id").alias("log"), "ts", "event_type")
    chained = governance.chain(e, "log", ["ts", "event_id"], ["event_id", "event_type"])
    path = writers.shared_path(e.sparkSession, "log")
    for late in (False, True):
        part = F.col("event_type") == "error"  # errors are flushed at once
        writers.write_parquet(chained.where(~part if late else part), path, mode="append")
    return governance.verify_chain(e.sparkSession.read.parquet(path), "log", ["ts", "event_id"], ["event_id", "event_type"])


_UNION = "SELECT query_id, key, score, rank, {n} AS source FROM (SELECT q.vec_id AS query_id, v.vec_id AS key, {cos} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {cos} DESC, v.vec_id) AS rank FROM embeddings v, {q} q WHERE q.vec_id % 50 = 0) WHERE rank <= 5"


@query("v16_expanded_retrieval", _UNION.format(n=1, cos=COS, q="embeddings") + " UNION ALL " + _UNION.format(n=2, cos=COS, q="(SELECT vec_id, list_reverse(embedding) AS embedding FROM embeddings)"))
def _(t):
    """Results of the query and of a second form of it, one after the other; both are kept."""
    q = _queries(t)
    both = [V.top_k(t("embeddings"), x, "vec_id", "embedding", 5).withColumn("source", F.lit(i)) for i, x in ((1, q), (2, q.withColumn("q", F.reverse("q"))))]
    return both[0].unionByName(both[1])
