"""Best-fit packing of token pieces into sequences by exact complements.

Lengths are at most the capacity, so that the whole plan is made over a histogram of at most `capacity` counts,
however many documents there are: gaps are filled by single, pair and triple lengths that sum to them, many
sequences at a time under the counts left, and what remains goes best fit. Pieces then find their places by
their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm.common import materialize, slices
from siltstone.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each document's ids (with end_id); only longer documents are cut."""

    def cut(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for run in slices(batch, "text"):
                ids, counts = enc.encode(run.column("text"))
                flat = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = np.repeat(np.cumsum(counts) - counts, n) + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence in order, number of such sequences) for all counted pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []

    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    # the index: sum -> place among the lengths, largest first, of the first that may be the larger part of a pair (the
    # largest of a triple) with that sum. Counts only fall, so that a place once passed never holds again.
    lengths = np.flatnonzero(left)[::-1].tolist()
    left = left.tolist()
    pairs: dict[int, int] = {}
    triples: dict[int, int] = {}

    def pair(total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """The pair of the largest part with that sum, besides the lengths held already."""
        at, firm = pairs.get(total, 0), True
        while at < len(lengths):
            big = lengths[at]
            small = total - big
            if small > big:
                break
            if small > 0 and left[big] and left[small] and (big != small or left[big] > 1):
                if firm:
                    pairs[total], firm = at, False
                if left[big] > held.count(big) + (big == small) and left[small] > held.count(small):
                    return big, small
            at += 1
        if firm:
            pairs[total] = len(lengths)
        return None

    def fill(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if left[gap] > (gap == length):
            return (gap,)
        if (two := pair(gap, (length,))) is not None:
            return two
        at, firm = triples.get(gap, 0), True
        while at < len(lengths) and 3 * lengths[at] >= gap:
            first = lengths[at]
            if first < gap and left[first] > (first == length) and (two := pair(gap - first, (length, first))) is not None:
                return (first, *two)
            at += 1
            firm = firm and (first >= gap or not left[first] or pairs.get(gap - first, 0) == len(lengths))
            if firm:
                triples[gap] = at
        return None

    # exact complements, largest first: each step uses up a length or parts with one whole group
    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            found = fill(length)
            if found is None:
                break
            combo = (length, *found)
            times = min(left[x] // combo.count(x) for x in set(combo))
            for x in combo:
                left[x] -= times
            done.append((combo, times))
    # best fit, decreasing: groups of alike sequences by their gap
    open_: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, np.int64)

    def put(gap: int, combo: tuple[int, ...], times: int) -> None:
        open_.setdefault(gap, []).append([combo, times])
        gaps[gap] += times

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(gaps[length:] > 0)
            if len(fits):
                gap = length + int(fits[0])
                group = open_[gap][-1]
                each = gap // length
                times = min(group[1], -(-n // each))
                group[1] -= times
                gaps[gap] -= times
                if not group[1]:
                    open_[gap].pop()
                full, rest = divmod(min(n, times * each), each)
            else:
                each = capacity // length
                gap, group = capacity, [(), 0]
                full, rest = divmod(n, each)
                times = full + bool(rest)
            if full:
                put(gap - each * length, group[0] + (length,) * each, full)
            if rest:
                put(gap - rest * length, group[0] + (length,) * rest, 1)
            if times > full + bool(rest):
                put(gap, group[0], times - full - bool(rest))
            n -= full * each + rest
    done += [(combo, times) for groups in open_.values() for combo, times in groups if times]
    return done


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece of each document in its place.

    A null text counts as empty (end_id alone), a null doc_id is carried, repeated rows are packed each on its
    own, other columns are not read, an empty table gives no rows. To the driver go at most `capacity` counts;
    to the executors goes the plan, whose size the capacity bounds.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    total = sum(counts.values())
    rows, used = [], dict.fromkeys(counts, 0)
    sequence = 0
    for combo, times in plan(counts, capacity):
        at = 0
        for length in combo:
            rows.append((length, used[length], sequence, at))
            used[length] += times
            at += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast(table)

    # a rank among pieces of one length: salted, so that a common length is many groups
    salts = max(16, total // 100_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches):
        plan_ = sent.value
        keys = plan_[:, 0] * (1 << 48) + plan_[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start")] + [pa.array(length), batch.column("ids_crc32"), pa.array(plan_[at, 2] + rank - plan_[at, 1]), pa.array(plan_[at, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
