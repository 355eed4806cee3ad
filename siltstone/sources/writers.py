"""Sinks: nested partitions, writer options, export formats, keyed upserts and retention."""

from __future__ import annotations

import gzip
import io
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.operators.relational import first_per


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder in spark.checkpoint.dir, which the driver and all executors share."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """One tree of nested partitions; rows of one value are gathered first, so that files are few; AQE deals a large value over several tasks and files."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int = 128 << 20, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).option("parquet.block.size", str(row_group_bytes)).option("parquet.enable.dictionary", "true").parquet(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Parquet, JSON or CSV; in CSV arrays are joined by commas and times are ISO. Other kinds raise ValueError."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"no writer for {kind}")
    if kind == "csv":
        for c, t in df.dtypes:
            if t.startswith("array"):
                df = df.withColumn(c, F.concat_ws(",", c))
            elif t.startswith(("struct", "map")):
                df = df.withColumn(c, F.to_json(c))
    df.write.mode("errorifexists").option("header", "true").format(kind).save(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The old rows whose keys the new ones lack, and the last new row of each key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(first_per(new, keys, order))


def retain(df: DataFrame, ts: str, now, days: int) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def warc_bytes(url: str, date: str, status: int, headers: dict[str, str], body: bytes) -> bytes:
    http = f"HTTP/1.1 {status} OK\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + body
    top = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url + date)}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Type: application/http\r\nContent-Length: {len(http)}\r\n\r\n"
    return top.encode() + http + b"\r\n\r\n"


def archive_members(df: DataFrame) -> DataFrame:
    """url, member: each page (url, html) as one gzip member of an archive; members joined end to end are an archive file."""
    import pandas as pd

    def pack(url: str, html: str) -> bytes:
        out = io.BytesIO()
        with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z:
            z.write(warc_bytes(url or "", "2000-01-01T00:00:00Z", 200, {"Content-Type": "text/html"}, (html or "").encode()))
        return out.getvalue()

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"url": pdf["url"], "member": [pack(u, h) for u, h in zip(pdf["url"], pdf["html"])]})

    return df.select("url", "html").mapInPandas(run, "url string, member binary")
