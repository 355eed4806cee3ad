"""An inverted file over vectors: cells learned by k-means, one partition folder a cell, searches that read the nearest cells alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.operators.relational import top_per

#: Rows that cells are learned from (those of the smallest key hashes) and rounds of k-means: what the driver holds does not grow.
SAMPLE_ROWS, ROUNDS = 20_000, 10
#: Query vectors sent to all tasks in one block; more are searched block by block.
QUERY_BLOCK = 1_000
#: Scores that a task holds at once: rows of a batch are taken in slices.
SCORES = 1 << 20


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors of this width without nulls inside; other rows are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    rows = np.flatnonzero(size == width)
    m = flat[first[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    ok = np.isfinite(m).all(axis=1)
    return rows[ok], m[ok]


def learn_cells(vectors: DataFrame, key: str, vector: str, cells: int | None = None) -> np.ndarray:
    """Unit centroids from a bounded sample; `cells` is a tenth of the rows plus one, 256 at most, unless given."""
    held = vectors.where(F.size(vector) > 0).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    if cells is None:
        cells = min(256, held.count() // 10 + 1)
    sample = held.orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS).toArrow()["v"]
    width = max(map(len, sample.to_pylist()), default=1)
    m = unit(matrix(sample, width)[1])
    centres = m[:cells].copy()
    for _ in range(ROUNDS):
        near = (m @ centres.T).argmax(axis=1) if len(m) else np.zeros(0, int)
        total = np.zeros_like(centres)
        np.add.at(total, near, m)
        used = np.bincount(near, minlength=len(centres)) > 0
        centres[used] = unit(total[used])
    return centres


def build(vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None) -> None:
    """Write a new index of all vectors below path: cells/ and vectors/cell=<n>/."""
    spark = vectors.sparkSession
    centres = learn_cells(vectors, key, vector, cells)
    table = pa.table({"cell": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/cells")
    add(vectors, key, vector, path)


def read_cells(spark: SparkSession, path: str) -> np.ndarray:
    got = spark.read.parquet(f"{path}/cells").orderBy("cell").select("centre").toArrow()["centre"].to_pylist()
    return np.array(got, dtype=float)


def add(vectors: DataFrame, key: str, vector: str, path: str) -> None:
    """Append vectors to their nearest cells. Null vectors and those of another width or with nulls are left out.

    Rows of a cell are gathered, a large cell over several tasks and files (AQE splits it by size).
    """
    centres = read_cells(vectors.sparkSession, path)

    def assign(batches):
        for batch in batches:
            rows, m = matrix(batch.column("vector"), centres.shape[1] if centres.ndim == 2 else 0)
            if len(rows):
                at = pa.array(rows)
                cell = (unit(m) @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("vector").take(at), pa.array(cell)], ["key", "vector", "cell"])

    kinds = dict(vectors.dtypes)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    rows.mapInArrow(assign, f"key {kinds[key]}, vector {kinds[vector]}, cell int").hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def scored(rows: DataFrame, ids: list, q: np.ndarray, probed: np.ndarray | None, k: int, threshold: float | None) -> DataFrame:
    """query_id, key, score of a task's best k rows for each query so far (more where they tie): one matrix product a slice of rows.

    rows: key, vector and, with `probed` (queries x cells, boolean), cell. Rows and queries of zeros have no cosine and are not found.
    """
    q = unit(q)
    asked = (q != 0).any(axis=1)

    step = max(SCORES // max(len(q), 1), 1)

    def run(batches):
        best = np.full((k, len(q)), -np.inf)  # the task's k greatest scores of each query so far
        for part in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            at, m = matrix(part.column("vector"), q.shape[1])
            keep = (m != 0).any(axis=1)
            at, m = at[keep], unit(m[keep])
            cells = part.column("cell").to_numpy(zero_copy_only=False)[at] if probed is not None else np.zeros(len(at), int)
            for c in np.unique(cells).tolist():
                own = np.flatnonzero(cells == c)
                who = np.flatnonzero(asked if probed is None else asked & probed[:, c])
                if not len(who):
                    continue
                s = np.round(m[own] @ q[who].T, 6)
                best[:, who] = np.partition(np.concatenate([best[:, who], s]), len(own), axis=0)[len(own) :]
                good = s >= best[:, who].min(axis=0)
                if threshold is not None:
                    good &= s >= threshold
                r, w = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in who[w].tolist()], pa.int64()), part.column("key").take(pa.array(at[own[r]])), pa.array(s[r, w])], ["query_id", "key", "score"])

    return rows.mapInArrow(run, f"query_id long, key {dict(rows.dtypes)['key']}, score double")


def blocks_of(queries: DataFrame):
    """(ids, matrix) of the queries (query_id, q), about QUERY_BLOCK at a time."""
    asked = queries.where("q is not null")
    blocks = max(-(-asked.count() // QUERY_BLOCK), 1)
    for i in range(blocks):
        got = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).select("query_id", "q").toArrow()
        width = max(map(len, got["q"].to_pylist()), default=0)
        rows, m = matrix(got["q"], width) if width else ([], np.zeros((0, 1)))
        ids = got["query_id"].to_pylist()
        yield [ids[r] for r in rows], m


def exact(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, key, score, rank: the k nearest by cosine of each query among all vectors; ties to the smaller key."""
    out = None
    for ids, q in blocks_of(queries):
        block = scored(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), ids, q, None, k, threshold)
        out = block if out is None else out.union(block)
    return top_per(out, ["query_id"], [F.desc("score"), "key"], k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None) -> DataFrame:
    """query_id, key, score, rank from the `probes` cells nearest to each query; all cells, and so exact, where None.

    Folders of cells that no query of a block probes are not read. Queries with the width of the index only.
    """
    centres = read_cells(spark, path)
    stored = spark.read.parquet(f"{path}/vectors")
    out = None
    for ids, q in blocks_of(queries):
        probed = np.ones((len(q), len(centres)), bool)
        if probes is not None and probes < len(centres) and len(q):
            probed[:] = False
            np.put_along_axis(probed, np.argsort(-(unit(q) @ centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
        cells = np.flatnonzero(probed.any(axis=0)).tolist()
        rows = stored if len(cells) == len(centres) else stored.where(F.col("cell").isin(cells))
        block = scored(rows.select("key", "vector", "cell"), ids, q, probed, k, threshold)
        out = block if out is None else out.union(block)
    return top_per(out, ["query_id"], [F.desc("score"), "key"], k)
