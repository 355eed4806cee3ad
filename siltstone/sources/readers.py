"""Sources: files by suffix, partitioned Parquet with pushed filters, SQL views, archive indexes and archive records."""

from __future__ import annotations

import gzip
import io
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_KINDS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json"}


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A lazy frame by suffix: .parquet, .csv (with a header), .json (a record a line); others raise ValueError."""
    suffix = re.search(r"\.[a-z]+$", path.rstrip("/"))
    kind = _KINDS.get(suffix.group(0) if suffix else "")
    if kind is None:
        raise ValueError(f"no reader for {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.format(kind).load(path)


def scan_partitioned(spark: SparkSession, path: str, columns: list[str] | None = None, filters: list | None = None) -> DataFrame:
    """All Parquet files below path; filters first, then columns, so that both reach the scan and partitions are pruned."""
    df = spark.read.parquet(path)
    for f in filters or []:
        df = df.where(f)
    return df.select(*columns) if columns else df


def dataset_schema(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(spark.read.parquet(path).dtypes)


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """A temporary view for each table file of a folder."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def sql(spark: SparkSession, folder: str, text: str, names: list[str], **args) -> DataFrame:
    """SQL text over the folder's tables; arguments are bound, never pasted."""
    register_views(spark, folder, names)
    return spark.sql(text, args=args or None)


def read_json_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records a line; lines that do not parse are dropped."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(parsed.alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def cdx_index(spark: SparkSession, path: str) -> DataFrame:
    """Archive index lines (JSON) with url, timestamp, status, mime, length, digest."""
    return read_json_lenient(spark, path, "url string, timestamp string, status string, mime string, length string, digest string, filename string, offset string")


def wayback_rows(lines: DataFrame) -> DataFrame:
    """Rows of a header-first index given as arrays: header and rows without a valid 14-digit time are dropped."""
    names = ["timestamp", "original_url", "status", "mime", "length", "digest"]
    rows = lines.select(*[F.get("value", F.lit(i)).alias(n) for i, n in enumerate(names)])
    rows = rows.where(F.col("timestamp").rlike(r"^\d{14}$"))
    return rows.withColumn("ts", F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss"))).where("ts is not null")


def timemap_rows(lines: DataFrame) -> DataFrame:
    """url and ts of link-format lines with rel memento."""
    rows = lines.where(F.col("value").rlike(r'rel="[^"]*memento'))
    url, stamp = F.regexp_extract("value", r"<([^>]+)>", 1), F.regexp_extract("value", r'datetime="[A-Za-z]{3}, ([^"]+) GMT"', 1)
    return rows.select(url.alias("url"), F.try_to_timestamp(stamp, F.lit("dd MMM yyyy HH:mm:ss")).alias("ts")).where("ts is not null")


WARC_SCHEMA = "path string, offset long, kind string, record_id string, url string, date string, status int, headers string, body binary"


def _warc(stream):
    """(offset, header fields, content) of each record, one at a time; ends at the first that is cut off."""
    at = 0
    while (line := stream.readline()).startswith(b"WARC/"):
        lines = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line)
        if not line:
            return
        raw = b"".join(lines)
        head = dict(re.findall(r"(?m)^([A-Za-z-]+):[ \t]*(.*?)\r?$", raw.decode("utf-8", "replace")))
        head = {k.lower(): v for k, v in head.items()}
        size = int(head.get("content-length", 0))
        yield at, head, stream.read(size)
        stream.read(4)
        at += len(raw) + 2 + size + 4


#: Content bytes of one frame of records.
WARC_FRAME = 16 << 20


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of .warc and .warc.gz files; a file is one task's work, read in full by Spark's file source."""
    return warc_records(spark.read.format("binaryFile").load(path).select("path", "content"))


def warc_records(files: DataFrame) -> DataFrame:
    """One row for each record of (path, content): whole files, or their members."""

    names = [c.split()[0] for c in WARC_SCHEMA.split(", ")]

    def run(frames):
        for pdf in frames:
            rows, held = [], 0
            for name, content in zip(pdf["path"], pdf["content"]):
                stream = io.BytesIO(content)
                for at, head, body in _warc(gzip.GzipFile(fileobj=stream) if bytes(content[:2]) == b"\x1f\x8b" else stream):
                    status, headers = None, ""
                    if head.get("warc-type") == "response" and b"\r\n\r\n" in body:
                        top, body = body.split(b"\r\n\r\n", 1)
                        headers = top.decode("utf-8", "replace")
                        m = re.match(r"HTTP/\S+ (\d{3})", headers)
                        status = int(m[1]) if m else None
                    rows.append((name, at, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), status, headers, body))
                    held += len(body)
                    if held >= WARC_FRAME:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, WARC_SCHEMA)
