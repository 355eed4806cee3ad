"""Whitening of vectors by an exact scatter matrix in residue numbers.

Entries become integers, so that the scatter matrix of the centred vectors is a matrix of integers too. Each partition
multiplies residues modulo several primes in floating-point matrix products that are exact (residues below 2^20, blocks
of 4,096 rows: below 2^53), Spark adds the products, and the Chinese remainder theorem gives the whole numbers back. As
many primes are taken as the largest possible entry asks for. Only then are doubles made: the covariance is rounded once
and handed to eigh. The driver holds matrices of the vectors' length squared, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.vectors import lists, matrices, scaled, summed

#: Integers of an entry: floor(SCALE * c) + SHIFT; beyond MOST (2^53) they are held there.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 53
#: Rows of one exact product and the bound of the primes: PRIME_BELOW^2 * BLOCK < 2^53.
BLOCK, PRIME_BELOW = 4096, 1 << 20
LONG = (1 << 63) - 1


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_BELOW, as many as tell apart whole numbers from -bound to bound."""
    out, product, p = [], 1, PRIME_BELOW - 1  # one prime at least
    while product <= max(2 * bound, 1):
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The whole number nearest to 0 that has these residues."""
    product = math.prod(primes)
    x = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, primes)) % product
    return x - product if 2 * x > product else x


@dataclass
class Whitening:
    """A fitted whitening: length and number of the vectors, sums S, eigenvectors by falling eigenvalue, share of the trace."""

    length: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    solid: int  # components whose eigenvalue is above rounding
    spread: int  # bound of |n*x - S|

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, each difference rounded once."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors[:, : self.solid] / np.sqrt(self.values[: self.solid])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; null beyond a long."""
        if self.spread**2 * self.length <= LONG:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return [v if v <= LONG else None for v in (d * d).sum(axis=1).tolist()]


def integers(m: np.ndarray) -> np.ndarray:
    return scaled(m, SCALE, MOST) + SHIFT


def _moments(df: DataFrame, column: str) -> list:
    """(length, dimension, n, sum, low, high): integers' sums and ranges for each vector length."""

    def partial(batches):
        found = {}
        for batch in batches:
            for size, _, m in matrices(batch, column):
                x = integers(m)
                n, high, low, top, least = found.get(size, (0, 0, 0, x.max(axis=0), x.min(axis=0)))
                # two limbs, so that no partial sum leaves 64 bits
                found[size] = (n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0), np.maximum(top, x.max(axis=0)), np.minimum(least, x.min(axis=0)))
        for size, (n, high, low, top, least) in found.items():
            k = np.full(size, size)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k, np.arange(size), np.full(size, n), high, low, least, top)], ["size", "at", "n", "high", "low", "least", "top"])

    whole = F.col("high").cast("decimal(38,0)") * F.lit(1 << 26) + F.col("low")
    parts = df.select(column).mapInArrow(partial, "size long, at long, n long, high long, low long, least long, top long")
    out = parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(whole.cast("decimal(38,0)")).alias("s"), F.min("least").alias("least"), F.max("top").alias("top"))
    best = out.groupBy("size").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return out.where(F.col("size") == best["size"]).orderBy("at").collect() if best else []


def _scatter(df: DataFrame, column: str, size: int, n: int, sums: list[int], bound: int) -> list[list[int]]:
    """Sums over the rows of (n*x - S)(n*x - S)', exact."""
    primes = primes_for(bound)

    def partial(batches):
        total = [np.zeros((size, size), np.int64) for _ in primes]
        for batch in batches:
            for k, _, m in matrices(batch, column):
                if k != size:
                    continue
                x = integers(m)
                for i, p in enumerate(primes):
                    centred = ((n % p) * (x % p) - np.array([s % p for s in sums])) % p
                    for a in range(0, len(x), BLOCK):
                        r = centred[a : a + BLOCK].astype(np.float64)
                        total[i] = (total[i] + (r.T @ r).astype(np.int64)) % p
        rows = [(i, a, total[i][a, a:]) for i in range(len(primes)) for a in range(size)]
        flat, ends = np.concatenate([r[2] for r in rows]), np.cumsum([0] + [len(r[2]) for r in rows])
        column_of = lambda j: pa.array([r[j] for r in rows], pa.int32())
        yield pa.RecordBatch.from_arrays([column_of(0), column_of(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["prime", "i", "v"])

    got = summed(df.select(column).mapInArrow(partial, "prime int, i int, v array<long>"), ["prime", "i"]).toArrow()
    residues = np.zeros((len(primes), size, size), np.int64)
    i, a, b, v = (got[c].to_numpy() for c in ("prime", "i", "at", "v"))
    residues[i, a, a + b] = v
    out = [[0] * size for _ in range(size)]
    for a in range(size):
        for b in range(a, size):
            out[a][b] = out[b][a] = remaindered([int(r) % p for r, p in zip(residues[:, a, b], primes)], primes)
    return out


def fit(df: DataFrame, column: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all vectors that hold finite entries only; None where there is none."""
    moments = _moments(df, column)
    if not moments:
        return None
    size, n, sums = len(moments), moments[0]["n"], [int(r["s"]) for r in moments]
    spread = max(max(n * r["top"] - s, s - n * r["least"]) for r, s in zip(moments, sums))
    scatter = _scatter(df, column, size, n, sums, n * spread * spread)
    values, vectors = np.linalg.eigh(np.array([[v / n**3 for v in row] for row in scatter]))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    trace = sum(scatter[i][i] for i in range(size)) / n**3
    take = min(components, size)
    solid = int((values[:take] > np.finfo(float).eps * size * max(values[0], 0)).sum())
    explained = [float(max(e, 0) / trace) if trace else None for e in values[:take]]
    return Whitening(size, n, sums, (vectors * signs)[:, :take], values[:take], explained, solid, spread)


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all rows.

    The vectors are centred before they are projected, so that the products are of centred values; what the projection's
    rounding leaves of a mean is taken off.
    """
    if not model.solid:
        return None
    k = model.solid

    def partial(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            for size, _, m in matrices(batch, column):
                if size == model.length:
                    w = model.whitened(integers(m))
                    total[:k] += w.T @ w
                    total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), lists(total)], ["i", "v"])

    got = summed(df.select(column).mapInArrow(partial, "i int, v array<double>"), ["i"]).toArrow()
    total = np.zeros((k + 1, k))
    total[got["i"].to_numpy(), got["at"].to_numpy()] = got["v"].to_numpy()
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 32) -> DataFrame:
    """A row for each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out, as are vectors of another length than
    most have (of lengths equally frequent the longer counts). A null id is carried, repeated rows are each returned and
    counted, other columns are not read, a table without vectors gives no rows. A component whose eigenvalue is 0 but for
    rounding has whitened null (no scale makes its variance 1) and stays out of identity_error; where all vectors are
    equal, explained and identity_error are null. deviation is null beyond a long. Entries beyond 2^53 / 64 count as that.
    """
    schema = f"{id_column} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, column, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(df, model, column)
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    take = len(model.explained)

    def project(batches):
        for batch in batches:
            ids = batch.column(id_column)
            for size, rows, m in matrices(batch, column):
                if size != model.length:
                    continue
                x = integers(m)
                w = np.full((len(x), take), np.nan)
                w[:, : model.solid] = model.whitened(x)
                each = np.repeat(np.arange(len(x)), take)
                total = len(each)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows[each])),
                        pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(total, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(w.reshape(-1), mask=np.tile(np.arange(take) >= model.solid, len(x))),
                        pa.array(model.explained * len(x), pa.float64()),
                        pa.array([error] * total, pa.float64()),
                    ],
                    names,
                )

    return df.select(F.col(id_column).cast("long").alias(id_column), column).mapInArrow(project, schema)
