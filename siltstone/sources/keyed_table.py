"""Tables that are merged by key: rows lie in buckets of the key's hash, a merge writes the touched buckets anew, a manifest says which files count.

Layout: schema/, data/version=<n>/bucket=<b>/ and manifest/version=<n>/ (a row for each bucket: the version that holds it). A merge
leaves all files as they are, writes the touched buckets under the next version, and the manifest last, in one file: readers see
the table before or after, never between, and a merge that fails has changed nothing. `vacuum` deletes what no reader needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.operators.relational import first_per
from siltstone.sources.writers import shared_path

#: New keys that a round of a merge sends to all tasks.
ROUND_KEYS = 1_000_000


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """bucket, held (the version of its files), version: of the latest version."""
    m = spark.read.schema("bucket int, held long, version long").parquet(f"{path}/manifest")
    last = m.agg(F.max("version")).first()[0]
    return m.where(F.col("version") == last)


def _commit(spark: SparkSession, path: str, rows: list[tuple], version: int) -> None:
    # one file, renamed into its place at the end of the job
    spark.createDataFrame(rows, "bucket int, held long").coalesce(1).write.parquet(f"{path}/manifest/version={version}")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows gathered by bucket, so that files are few; AQE splits large buckets over tasks."""
    return df.hint("rebalance", "bucket")


def _write(df: DataFrame, path: str, version: int, mode: str = "overwrite") -> None:
    """Empty buckets have no folder."""
    df.write.mode(mode).partitionBy("bucket").parquet(f"{path}/data/version={version}")


def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """A new table of df at path. Rows of equal keys are all kept; null keys are a key."""
    spark = df.sparkSession
    df.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    _write(_dealt(df.withColumn("bucket", _bucket(keys, buckets))), path, 0)
    _commit(spark, path, [(b, 0) for b in range(buckets)], 0)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _rows(spark: SparkSession, path: str, held: list[tuple[int, int]], schema) -> DataFrame:
    places = [p for b, v in held if _exists(spark, p := f"{path}/data/version={v}/bucket={b}")]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*places)


def _schema(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/schema").schema


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as the latest manifest has it."""
    return _rows(spark, path, [(r["bucket"], r["held"]) for r in _manifest(spark, path).collect()], _schema(spark, path))


def merge(spark: SparkSession, path: str, new: DataFrame, keys: list[str], fold: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Replace the touched buckets (those of new rows' keys) by fold(old rows of these buckets, new).

    fold sees old and new rows of a key together, both with their `bucket`, and gives rows of the table's columns. Buckets without a
    new row are not read. Rows are written by the task that fold leaves them in: it deals by bucket what it shuffles, and old rows
    stay where they were read. Buckets are merged in rounds of about ROUND_KEYS new keys. The driver holds the list of buckets alone.
    """
    held = {r["bucket"]: (r["held"], r["version"]) for r in _manifest(spark, path).collect()}
    number = _bucket(keys, len(held))
    new = new.withColumn("bucket", number)
    found = new.select("bucket", *keys).distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return
    version = next(iter(held.values()))[1] + 1
    schema = _schema(spark, path)
    rounds = _rounds(sorted((r["bucket"], r["n"]) for r in found))
    if len(rounds) > 1:  # made once for all rounds
        place = shared_path(spark, "merged")
        _dealt(new).write.partitionBy("bucket").parquet(place)
        new = spark.read.schema(new.schema).parquet(place)
    for i, some in enumerate(rounds):
        old = _rows(spark, path, [(b, held[b][0]) for b in some], schema).withColumn("bucket", number)
        out = fold(old, new.where(F.col("bucket").isin(some)) if len(rounds) > 1 else new)
        _write(out.select(*schema.names).withColumn("bucket", number), path, version, "append" if i else "overwrite")
    touched = {b for some in rounds for b in some}
    _commit(spark, path, [(b, version if b in touched else v) for b, (v, _) in held.items()], version)


def _rounds(found: list[tuple[int, int]]) -> list[list[int]]:
    """Buckets of (bucket, keys) in order, cut where a round would hold more than ROUND_KEYS keys."""
    out, total = [], 0
    for b, n in found:
        if not out or total + n > ROUND_KEYS:
            out.append([])
            total = 0
        out[-1].append(b)
        total += n
    return out


def _lacking(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys the new ones lack: a round's keys go to all tasks, the old rows are not shuffled. One bucket of more keys is."""
    mine = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return old.join(F.broadcast(mine) if mine.count() <= ROUND_KEYS else mine, _same(keys), "left_anti")


def replacing(keys: list[str], order: list):
    """Old rows whose keys the new ones lack, and the last new row of each key."""
    return lambda old, new: _lacking(old, new, keys).unionByName(_dealt(first_per(new, keys, order)))


def without(keys: list[str]):
    """Old rows whose keys the new ones lack."""
    return lambda old, new: _lacking(old, new, keys)


def regrouped(keys: list[str]):
    """Old rows whose keys the new ones lack, and all new rows: a key's rows are exchanged as a whole."""
    return lambda old, new: _lacking(old, new, keys).unionByName(_dealt(new))


def summed(keys: list[str], **aggregates):
    """One row a key from old and new rows by aggregates that can be taken again of their results."""
    return lambda old, new: _dealt(old.unionByName(new).groupBy(*keys).agg(F.min("bucket").alias("bucket"), *[a.alias(c) for c, a in aggregates.items()]))


def _same(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete folders that the latest manifest does not name; for use when no reader holds an older one."""
    held = {(r["bucket"], r["held"]) for r in _manifest(spark, path).collect()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for v in fs.listStatus(root):
        name = v.getPath().getName()
        if name.startswith("version="):
            for b in fs.listStatus(v.getPath()):
                bucket = b.getPath().getName()
                if bucket.startswith("bucket=") and (int(bucket[7:]), int(name[8:])) not in held and int(name[8:]) > 0:
                    fs.delete(b.getPath(), True)
