"""Sources and sinks as queries: what is written to the shared folder and read back; and filtered vector searches."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import retrieval as V
from siltstone.operators.relational import first_per
from siltstone.plans.retrieval import COS, _queries
from siltstone.registry import query
from siltstone.sources import readers, writers


def _written(df, name: str, kind: str) -> str:
    path = f"{writers.shared_path(df.sparkSession, name)}.{kind}"
    writers.export(df, path, kind)
    return path


# -- scans -------------------------------------------------------------------------------------------


@query("s1_csv_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    s = t("supplier")
    return readers.scan(s.sparkSession, _written(s, "suppliers", "csv"), "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("s1_json_scan", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def _(t):
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return readers.scan(p.sparkSession, _written(p, "parts", "json"), "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")


PARTS = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"


@query("s2_partitioned_scan", f"{PARTS} WHERE l_returnflag = 'R' AND l_quantity > 40")
def _(t):
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")  # noqa: E741
    path = writers.shared_path(l.sparkSession, "lines")
    writers.write_partitioned(l, path, ["l_returnflag"])
    return readers.scan_partitioned(l.sparkSession, path, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], ["l_returnflag = 'R'", "l_quantity > 40"])


@query("s3_partitioned_sink", "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def _(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("y"))
    path = writers.shared_path(o.sparkSession, "orders")
    writers.write_partitioned(o, path, ["o_orderstatus", "y"])
    return o.sparkSession.read.parquet(path).groupBy("o_orderstatus", F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s4_batched_sink", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(t):
    e = t("events").select("event_id", "event_type", "value")
    path = writers.shared_path(e.sparkSession, "batches")
    e.write.option("maxRecordsPerFile", "1000").parquet(path)  # as a batch size: rows a file at most
    return e.sparkSession.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s6_writer_options", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def _(t):
    c = t("conversations")
    path = writers.shared_path(c.sparkSession, "conversations")
    writers.write_parquet(c, path, "zstd", 1 << 20)
    return c.sparkSession.read.parquet(path).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("s7_schema_discovery", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS x(name, kind)")
def _(t):
    n = t("nation")
    path = writers.shared_path(n.sparkSession, "nation")
    writers.write_parquet(n, path)
    return n.sparkSession.createDataFrame(list(readers.dataset_schema(n.sparkSession, path).items()), "name string, kind string")


@query("s8_sql_view", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    n = t("nation")
    path = writers.shared_path(n.sparkSession, "views")
    for name in ("nation", "customer"):
        writers.write_parquet(t(name), f"{path}/{name}.parquet")
    readers.register_views(n.sparkSession, path, ["nation", "customer"])
    return n.sparkSession.sql("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")


@query("s9_sql_over_folder", "SELECT s_nationkey, count(*) AS n, round(max(s_acctbal), 2) AS high FROM supplier WHERE s_acctbal > 100 GROUP BY s_nationkey")
def _(t):
    s = t("supplier")
    path = writers.shared_path(s.sparkSession, "folder")
    writers.write_parquet(s, f"{path}/supplier.parquet")
    # the table's name in a literal stays as it is: arguments are bound
    return readers.sql(s.sparkSession, path, "SELECT s_nationkey, count(*) AS n, round(max(s_acctbal), 2) AS high FROM supplier WHERE s_acctbal > :least AND s_name <> 'supplier' GROUP BY s_nationkey", ["supplier"], least=100)


@query("s10_ad_hoc_sql", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY p_brand")
def _(t):
    p = t("part")
    return p.sparkSession.sql("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM {part} GROUP BY p_brand", part=p)


@query("s12_lenient_json", "SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0")
def _(t):
    # one line in seven is broken, and dropped by the reader
    e = t("events").select("event_id", "event_type")
    line = F.when(F.pmod("event_id", F.lit(7)) == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = writers.shared_path(e.sparkSession, "lines")
    e.select(line.alias("value")).write.text(path)
    return readers.read_json_lenient(e.sparkSession, path, "event_id long, event_type string")


@query("s16_cdx_index", "SELECT url, CAST(200 + page_id % 2 * 104 AS VARCHAR) AS status, md5(html) AS digest FROM pages")
def _(t):
    p = t("pages").select("url", (200 + F.pmod("page_id", F.lit(2)) * 104).cast("string").alias("status"), F.md5(F.col("html").cast("binary")).alias("digest"))
    path = writers.shared_path(p.sparkSession, "cdx")
    p.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.cdx_index(p.sparkSession, path).select("url", "status", "digest")


@query("s17_warc_records", "SELECT url, CAST(200 AS INTEGER) AS status, md5(coalesce(html, '')) AS h FROM pages")
def _(t):
    # one member a line, in hexadecimal digits
    p = t("pages").select("url", "html")
    members = writers.archive_members(p)
    path = writers.shared_path(p.sparkSession, "warc")
    members.select(F.hex("member").alias("value")).write.text(path)
    raw = p.sparkSession.read.text(path).select(F.unhex("value").alias("content"))
    return readers.warc_records(raw.select(F.lit("archive").alias("path"), "content")).select("url", "status", F.md5("body").alias("h"))


@query("s18_wayback_rows", "SELECT event_id, ts FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events WHERE event_id % 5 <> 0)")
def _(t):
    # one row in five has a broken time, which the parser drops
    e = t("events")
    stamp = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("2024-broken")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    arrays = e.select(F.array(stamp, F.col("event_id").cast("string"), F.lit("200"), F.lit("text/html"), F.lit("10"), F.lit("d")).alias("value"))
    return readers.wayback_rows(arrays).select(F.col("original_url").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("s19_timemap_rows", "SELECT 'http://a.example/' || o_orderkey AS url, o_orderdate AS ts FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    o = t("orders")
    rel = F.when(F.col("o_orderstatus") == "P", "timegate").otherwise("memento")
    line = F.concat(F.lit("<http://a.example/"), F.col("o_orderkey").cast("string"), F.lit('>; rel="'), rel, F.lit('"; datetime="'), F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(' GMT"'))
    return readers.timemap_rows(o.select(line.alias("value"))).select("url", F.col("ts").cast("timestamp_ntz").alias("ts"))


# -- sinks -------------------------------------------------------------------------------------------


@query("s22_vector_upsert", "SELECT vec_id, label + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label FROM embeddings")
def _(t):
    e = t("embeddings").select("vec_id", "label", "embedding")
    new = e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    path = writers.shared_path(e.sparkSession, "vectors")
    writers.write_parquet(writers.upsert(e, new, ["vec_id"], [F.desc("label")]), path)
    return e.sparkSession.read.parquet(path).select("vec_id", "label")


@query("s23_document_upsert", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'updated' ELSE source END AS source FROM documents")
def _(t):
    d = t("documents").select("doc_id", "source", "n_chars")
    new = d.where("source = 'src1'").withColumn("source", F.lit("updated"))
    path = writers.shared_path(d.sparkSession, "documents")
    writers.write_parquet(writers.upsert(d, new.union(new), ["doc_id"], ["n_chars"]), path)
    return d.sparkSession.read.parquet(path).select("doc_id", "source")


@query("s24_document_store", "SELECT doc_id, md5(text) AS content_hash, length(text) AS chars FROM documents WHERE source <> 'src3'")
def _(t):
    d = t("documents")
    path = writers.shared_path(d.sparkSession, "store")
    writers.write_parquet(d.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("content_hash"), F.length("text").cast("long").alias("chars")), path)
    return d.sparkSession.read.parquet(path).where("source <> 'src3'").drop("source")


@query("s25_retention_delete", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def _(t):
    e = t("events").select("event_id", "ts")
    path = writers.shared_path(e.sparkSession, "retained")
    writers.write_parquet(writers.retain(e, "ts", F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), 10), path)
    return e.sparkSession.read.parquet(path)


@query("s27_filtered_feed", "SELECT doc_id, length(text) AS chars, source FROM documents WHERE text IS NOT NULL AND length(text) > 200")
def _(t):
    d = t("documents")
    path = writers.shared_path(d.sparkSession, "feed")
    writers.write_parquet(d.where(F.col("text").isNotNull() & (F.length("text") > 200)).select("doc_id", "text", "source"), path)
    return d.sparkSession.read.parquet(path).select("doc_id", F.length("text").cast("long").alias("chars"), "source")


@query("s28_csv_export_lists", "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS suppliers FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))
    flat = g.withColumn("suppliers", F.transform("suppliers", lambda x: x.cast("string")))
    return readers.scan(g.sparkSession, _written(flat, "entities", "csv"), "l_orderkey long, suppliers string")


@query("s29_claims_csv", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS evidence FROM lineitem")
def _(t):
    claims = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    rows = claims.select("l_orderkey", F.explode("lines").alias("l_linenumber"), F.size("lines").cast("long").alias("evidence"))
    return readers.scan(rows.sparkSession, _written(rows, "claims", "csv"), "l_orderkey long, l_linenumber int, evidence long")


@query("s30_export_formats", "SELECT n_nationkey, n_name, n_regionkey, k FROM nation, (VALUES ('parquet'), ('json'), ('csv')) AS x(k)")
def _(t):
    n = t("nation")
    out = None
    for kind in ("parquet", "json", "csv"):
        back = readers.scan(n.sparkSession, _written(n, "nation", kind), "n_nationkey int, n_name string, n_regionkey int").withColumn("k", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query("s31_metrics_export", "WITH l AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT a.event_type, n, mean, newest FROM (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type) a JOIN (SELECT event_type, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY n) AS newest FROM l WHERE n <= 10 GROUP BY event_type) b ON a.event_type = b.event_type")
def _(t):
    e = t("events").select("event_type", "value", "ts", "event_id")
    totals = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = e.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("r", F.round(F.col("value") * 100).cast("long").alias("v")))).alias("newest"))
    both = totals.join(last, "event_type").select("event_type", "n", "mean", F.array_join(F.transform("newest", lambda x: x["v"].cast("string")), ",").alias("newest"))
    return readers.scan(e.sparkSession, _written(both, "metrics", "json"), "event_type string, n long, mean double, newest string")


# -- filtered vector searches --------------------------------------------------------------------------

FOUND = "SELECT query_id, key, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS key, {cos} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {cos} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND {keep}) WHERE rank <= {k}"


@query("p8_metadata_filtered_search", FOUND.format(cos=COS, keep="v.label <= 3", k=5))
def _(t):
    return V.top_k(t("embeddings").where("label <= 3"), _queries(t), "vec_id", "embedding", 5)


@query("p9_id_set_filtered_search", FOUND.format(cos=COS, keep="v.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)", k=5))
def _(t):
    allowed = t("labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return V.top_k(t("embeddings").join(allowed, "vec_id", "left_semi"), _queries(t), "vec_id", "embedding", 5)


@query("v1_brute_force_top_k", FOUND.format(cos=COS, keep="v.vec_id <> q.vec_id", k=3))
def _(t):
    best = V.top_k(t("embeddings"), _queries(t), "vec_id", "embedding", 4).where("key <> query_id")
    return first_ranks(best, 3)


@query("v15_image_similarity", FOUND.format(cos=COS, keep="v.label <> 0", k=10))
def _(t):
    return V.top_k(t("embeddings").where("label <> 0"), _queries(t), "vec_id", "embedding", 10)


def first_ranks(found, k: int):
    """The first k of each query, ranked anew."""
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", again).where(F.col("rank") <= k)


@query("t1_sorted_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("s21_keep_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(t):
    return first_per(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")
