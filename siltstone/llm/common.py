"""Helpers shared by the operators: tables, scratch space and byte-level text arithmetic."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where the session names none and runs on one machine (tests), a temporary folder is made and set; on a cluster that
    is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


#: For plans that are run once: shuffle files go as soon as the execution ends; batches for workers end by bytes.
ONCE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings as given, until the end of the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, session: dict[str, str] | None = None, **options) -> DataFrame:
    """Write df once to shared storage and read it back, so that lineage ends at files that outlive executors.

    The shuffle files of the write go when it has ended. `session`: settings for the write alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, {**ONCE, **(session or {})}):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(hadoop).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the letters' case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


# -- texts of an Arrow batch as one byte array ---------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


#: Separator bytes of the word pattern [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of all maximal runs of non-separators; no run crosses two texts."""
    inside = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with avalanche (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a span beyond which BLAKE2b hashes it.
LONG_SPAN = 256
_ODD = np.uint64(0xD6E8FEB86659FD93)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time through a bijection with avalanche, or BLAKE2b for long spans.

    Each step mixes what came before, so that no texts collide by their arithmetic, as they do under a polynomial modulo
    2^64. Two seeds give 128 bits.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _ODD + np.uint64(seed * 2 + 1))
    if not len(sizes):
        return out
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), 0, (1,))
    long = np.flatnonzero(sizes > LONG_SPAN)
    live = np.arange(len(sizes)) if not len(long) else np.flatnonzero(sizes <= LONG_SPAN)
    done = 0
    while True:
        live = live[sizes[live] > done]
        if not len(live):
            break
        word = eight[starts[live] + done]
        left = sizes[live] - done
        part = left < 8
        word[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] * _ODD + word)
        done += 8
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _trim() -> None:
    """Give freed memory back to the machine: a worker outlives its tasks, and others share the executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """The batch in runs of rows of about `most` text bytes, so that working arrays stay small."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(a, b - a)
    _trim()


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all windows of k words in each text; a text of fewer words gives its whole sequence as one."""
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    n = len(words)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    full = np.zeros(n, np.uint64)
    for j in range(k):
        full = mix(full + padded[j : j + n] + np.uint64(j + 1))
    left = np.repeat(counts + first, counts) - np.arange(n)
    whole = left >= k
    hashes, docs = full[whole], doc[whole]
    for short in range(1, k):
        own = np.flatnonzero(counts == short)
        if len(own):
            h = np.full(len(own), short * 7919, np.uint64)
            for j in range(short):
                h = mix(h + words[first[own] + j] + np.uint64(j + 1))
            hashes, docs = np.concatenate((hashes, h)), np.concatenate((docs, own))
    return hashes, docs


def distinct_in(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) pairs in ascending order."""
    if len(docs) and (docs[1:] < docs[:-1]).any():
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    else:
        hashes = hashes.copy()
    heads = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(docs)]):
        hashes[a:b].sort()
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[keep], hashes[keep]
