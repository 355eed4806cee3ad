"""Codes for vectors: consecutive parts, a codebook for each part position, learned by Lloyd rounds with Elkan's bounds.

Every part keeps an upper bound of the distance to its entry and one lower bound of the distance to every entry of its
codebook, in a table written to shared storage each round. After the entries have moved, bounds move by as much; an
entry is measured again only where the triangle inequality does not rule it out strictly. Measured distances are
integers, and ties between them go to the lower index. No row is shuffled: partitions send sums of their parts for each
entry, and the driver holds codebooks alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.common import fresh, materialize, release
from siltstone.llm.vectors import lists, matrices, scaled, summed

#: Integers of a component: floor(SCALE * x); beyond MOST they are held there, so that a vector's error fits a long.
SCALE, MOST = 256, 1 << 26
#: Bounds are kept in units of 1 / UNIT; lower bounds are rounded down, upper ones up. Lower bounds are one byte each and end at TOP.
UNIT, TOP = 1, 255


def below(squares: np.ndarray) -> np.ndarray:
    """A lower bound of the square roots, in units."""
    return np.minimum(np.floor(UNIT * np.sqrt(squares)), TOP).astype(np.uint8)


def above(squares: np.ndarray) -> np.ndarray:
    """An upper bound of the square roots, in units; a unit more where doubles round."""
    return (np.ceil(UNIT * np.sqrt(squares)) + (squares >= 1 << 40)).astype(np.int64)


def squares_to(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - entries[None, :, d]) ** 2
    return out


class Books:
    """Codebooks (parts x entries x dimensions) with what pruning needs: half distances between entries, and their moves."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3)
        self.half = np.floor(UNIT * np.sqrt(apart) / 2).astype(np.int64)  # parts x entries x entries
        other = self.half + np.where(np.eye(entries.shape[1], dtype=bool), np.int64(1) << 40, 0)
        self.nearest = other.min(axis=2)
        self.moves = None if before is None else above(((entries - before) ** 2).sum(axis=2))

    def first(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance, upper, lower) of each row with all distances measured."""
        d = squares_to(x, self.entries[part])
        code = d.argmin(axis=1)
        best = d[np.arange(len(x)), code]
        return code, best, above(best), below(d)

    def again(self, x: np.ndarray, part: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the last round's codes and bounds, and how many distances were measured."""
        entries, half, moves = self.entries[part], self.half[part], self.moves[part]
        upper = upper + moves[code]
        lower = np.maximum(lower.astype(np.int64) - moves, 0).astype(np.uint8)
        best = ((x - entries[code]) ** 2).sum(axis=1)
        tight = above(best)
        measured = len(x)
        # strictly nearer than half of the way to any other entry: nothing can be nearer or as near
        open_ = np.flatnonzero((upper >= self.nearest[part][code]) & (tight >= self.nearest[part][code]))
        upper = tight
        if len(open_):
            own, u = code[open_], upper[open_, None]
            ask = (u >= lower[open_]) & (u >= half[own])
            ask[np.arange(len(open_)), own] = False
            r, j = np.nonzero(ask)
            d = ((x[open_[r]] - entries[j]) ** 2).sum(axis=1)
            measured += len(d)
            lower[open_[r], j] = below(d)
            table = np.full(ask.shape, np.iinfo(np.int64).max)
            table[r, j] = d
            table[np.arange(len(open_)), own] = best[open_]
            code = code.copy()
            code[open_] = table.argmin(axis=1)  # the first of equal ones
            best[open_] = table.min(axis=1)
            upper[open_] = above(best[open_])
        lower[np.arange(len(x)), code] = below(best)
        return code, best, upper, lower, measured


STATE = "x array<int>, code binary, upper array<long>, lower binary, error long, measured long"


def _assigned(state: DataFrame, books: Books, carried: list[str], first: bool) -> DataFrame:
    """Rows with codes, bounds and errors under these codebooks."""
    parts, entries, width = books.entries.shape

    def assign(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(m, parts, width)
            if first:
                code, upper, lower = np.zeros((m, parts), np.uint8), np.zeros((m, parts), np.int64), np.zeros((m, parts, entries), np.uint8)
            else:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(m, parts).copy()
                upper = batch.column("upper").flatten().to_numpy(zero_copy_only=False).reshape(m, parts).copy()
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.uint8).reshape(m, parts, entries).copy()
            error, measured = np.zeros(m, np.int64), 0
            for p in range(parts):
                if first:
                    code[:, p], best, upper[:, p], lower[:, p] = books.first(x[:, p], p)
                    measured += m * entries
                else:
                    code[:, p], best, upper[:, p], lower[:, p], n = books.again(x[:, p], p, code[:, p].astype(np.int64), upper[:, p], lower[:, p])
                    measured += n
                error += best
            of = np.zeros(m, np.int64)
            of[0] = measured
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), batch.column("x"), pa.array([c.tobytes() for c in code]), lists(upper), pa.array([b.tobytes() for b in lower]), pa.array(error), pa.array(of)],
                [*carried, "x", "code", "upper", "lower", "error", "measured"],
            )

    schema = ", ".join([f"`{c}` {state.schema[c].dataType.simpleString()}" for c in carried] + [STATE])
    return state.mapInArrow(assign, schema)


def _moved(state: DataFrame, books: Books) -> Books:
    """Codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    parts, entries, width = books.entries.shape

    def partial(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            m = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(m, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(m, parts)
            for p in range(parts):
                total[p, :, width] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p, :, :width], code[:, p], x[:, p])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts, dtype=np.int32), entries)), pa.array(np.tile(np.arange(entries, dtype=np.int32), parts)), lists(total.reshape(-1, width + 1))], ["part", "entry", "v"])

    got = summed(state.select("x", "code").mapInArrow(partial, "part int, entry int, v array<long>"), ["part", "entry"]).toArrow()
    total = np.zeros((parts, entries, width + 1), np.int64)
    total[got["part"].to_numpy(), got["entry"].to_numpy(), got["at"].to_numpy()] = got["v"].to_numpy()
    counts = total[:, :, width:]
    return Books(np.where(counts > 0, total[:, :, :width] // np.maximum(counts, 1), books.entries), books.entries)


def encode(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): a row for each vector with id, label, code (binary, a byte a part), error, measured.

    Rows whose vector is null or holds null or non-finite components are left out, as are vectors of another length than
    most have (of lengths equally frequent the longer counts); where the parts do not divide the length, zeros fill the
    last. Codebooks start from the smallest ids, nulls last, equal ids by their vectors; with fewer vectors than entries
    they have as many entries as there are vectors. Null ids and labels are carried, repeated rows all count, other
    columns are not read, an empty table gives no rows and codebooks without entries. Components beyond 2^26 / 256 count
    as that. `measured` holds the distances of a batch in its first row.
    """
    spark = df.sparkSession
    if entries > 256:
        raise ValueError("a code is one byte a part: at most 256 entries")

    def whole(batches):
        for batch in batches:
            for _, rows, m in matrices(batch, column):
                x = scaled(m, SCALE, MOST).astype(np.int32)
                x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(id_column).take(at), batch.column(label).take(at), lists(x)], [id_column, label, "x"])

    carried = [id_column, label]
    source = df.select(F.col(id_column).cast("long").alias(id_column), label, column)
    schema = f"`{id_column}` long, `{label}` {df.schema[label].dataType.simpleString()}, x array<int>"
    kept = materialize(source.mapInArrow(whole, schema), "vectors", compression="zstd")
    size = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return kept.select(*carried, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("measured")), np.zeros((parts, 0, 0), np.int64)
    same = kept.where(F.size("x") == size["size"])
    start = same.orderBy(F.col(id_column).asc_nulls_last(), "x").limit(entries).select("x").toArrow()["x"].to_pylist()
    books = Books(np.array(start, dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2))
    state, last = same, kept
    for n in range(rounds):
        state = materialize(_assigned(state, books, carried, n == 0), "codes", compression="zstd")
        release(spark, last)
        last, books = state, _moved(state, books)
    done = materialize(_assigned(state, books, carried, rounds == 0).drop("x", "upper", "lower"), "coded")
    release(spark, last)
    return done, books.entries


def digests(coded: DataFrame, books: np.ndarray, id_column: str = "vec_id", label: str = "label") -> DataFrame:
    """id, code as hexadecimal text, error, the label's summed error (nulls are one label), and the codebooks' digest."""
    of, known = fresh(coded, "of_label"), fresh(coded, "known")
    sums = coded.groupBy(F.col(label).alias(of)).agg(F.sum("error").alias("label_error")).withColumn(known, F.lit(True))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    both = coded.join(sums, coded[label].eqNullSafe(sums[of]))
    return both.select(id_column, F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
