import gzip

from pyspark.sql import functions as F

from siltstone.sources import readers, writers
from siltstone.streaming import streams

SF = "/root/testdata/sf0.001"


def test_scans_and_sinks(spark, tmp_path):
    d = readers.scan(spark, f"{SF}/nation.parquet")
    writers.write_partitioned(d, str(tmp_path / "n"), ["n_regionkey"])
    back = readers.scan_partitioned(spark, str(tmp_path / "n"), ["n_name"], [F.col("n_regionkey") == 1])
    assert back.count() == d.where("n_regionkey = 1").count()
    assert "PartitionFilters: [isnotnull(n_regionkey" in back._jdf.queryExecution().toString()
    writers.export(d.withColumn("a", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "c.csv"), "csv")
    assert readers.scan(spark, str(tmp_path / "c.csv")).select("a").first()[0] == "x,y"
    try:
        readers.scan(spark, "x.xml")
        raise AssertionError
    except ValueError:
        pass
    n = readers.sql(spark, SF, "select count(*) as n from orders where o_totalprice > :p", ["orders"], p=1000).first().n
    assert n == spark.read.parquet(f"{SF}/orders.parquet").where("o_totalprice > 1000").count()


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, t int")
    got = sorted((r.id, r.v) for r in writers.upsert(old, new, ["id"], [F.desc("t")]).collect())
    assert got == [(1, "a"), (2, "d"), (3, "e")]


def test_lenient_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"url": "u", "timestamp": "20200101000000"}\nnot json\n')
    assert readers.cdx_index(spark, str(tmp_path / "x.json")).count() == 1


def test_archive_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    members = {r.url: bytes(r.member) for r in writers.archive_members(pages).collect()}
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members.values()))
    assert len(gzip.decompress((tmp_path / "a.warc.gz").read_bytes())) > 0
    got = {r.url: bytes(r.body).decode() for r in readers.read_warc(spark, str(tmp_path / "a.warc.gz")).collect()}
    assert got == {r.url: r.html for r in pages.collect() if r.url in members}


def test_streams(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    src = str(tmp_path / "in")
    rows = [("a", "2024-01-01 00:00:10", 1.0), ("a", "2024-01-01 00:00:50", 2.0), ("b", "2024-01-01 00:03:00", 3.0), ("a", "2024-01-01 00:00:10", 1.0)]
    spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = run(streams.windowed(read(), "ts", ["k"], [F.sum("v").alias("s")], "1 minute"), "w", "complete")
    assert sorted((r.k, r.s) for r in got) == [("a", 4.0), ("b", 3.0)]
    assert len(run(streams.deduplicate(read(), "ts", ["k", "v"]), "d", "append")) == 3
    got = run(streams.changes(read().select("k", F.col("v").cast("string").alias("c")), "k", "c"), "c", "append")
    assert max(r.version for r in got if r.k == "b") == 1
    q = streams.stage(read(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
