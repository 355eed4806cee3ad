"""Token ids in Parquet: list columns, dictionary-coded ids, delta-coded positions, small row groups, page indexes.

Files: one range of ascending doc_id each (nulls first, equal ids by text hash). Columns: doc_id, part (number of
the range), part_start (ids of the range before this document), n_tokens, tokens. A reader that wants lengths
reads no token page; one that wants a few documents skips row groups and pages by the statistics of doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.llm.common import slices
from siltstone.llm.tokens import encoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode each whole text, append end_id and write the files under path.

    A null text counts as empty and gives end_id alone; a null doc_id sorts first; repeated rows are all kept;
    other columns are not read; an empty table gives an empty folder of files. Texts are shuffled once, to
    their doc_id range, and encoded there in order.
    """

    def encode(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary)
        for batch in batches:
            for run in slices(batch, "text"):
                ids, counts = enc.encode(run.column("text"))
                ends = np.cumsum(counts)
                flat = np.insert(ids, ends, end_id).astype(np.int32)
                counts = counts + 1
                bounds = np.concatenate(([0], np.cumsum(counts)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + bounds[:-1]), pa.array(counts), lists],
                    ["doc_id", "part", "part_start", "n_tokens", "tokens"],
                )
                before += int(bounds[-1])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#part_start", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, part; token pages are not read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # one row for each range: as many as files
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return files.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "part")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id and tokens of documents low to high; the bounds reach the scan and skip row groups and pages."""
    files = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        files = files.where(F.col("doc_id") >= low)
    if high is not None:
        files = files.where(F.col("doc_id") <= high)
    return files.select("doc_id", "tokens")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def digest(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            bounds = tokens.offsets.to_numpy()
            flat = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "part", "part_start")] + [pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    read = files.mapInArrow(digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return read.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
