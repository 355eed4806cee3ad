"""Successive versions of texts: longest matching blocks, ratios, line differences and sampled series."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators.networks import written


def longest_block(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest run of equal elements of a[a0:a1] and b[b0:b1], the first in a, then in b.

    By a suffix automaton of b's range, so that time and space are linear whatever repeats.
    """
    step, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for at in range(b0, b1):
        c, cur = b[at], len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(at)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    best = (a0, b0, 0)
    state = n = 0
    for at in range(a0, a1):
        c = a[at]
        while state and c not in step[state]:
            state = link[state]
            n = length[state]
        if c in step[state]:
            state = step[state][c]
            n += 1
            if n > best[2]:
                best = (at - n + 1, first[state] - n + 1, n)
    return best


def blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """All matching blocks in order: the longest, then those before and behind it."""
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, n = longest_block(a, b, a0, a1, b0, b1) if a0 < a1 and b0 < b1 else (0, 0, 0)
        if n:
            out.append((i, j, n))
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(out)


def changes(a: list, b: list, around: int = 3) -> tuple[float, int, int, int]:
    """(ratio, additions, deletions, lines of a unified difference with `around` lines of context)."""
    same = [(0, 0, len(a))] if a == b else blocks(a, b)
    cuts, i, j = [], 0, 0
    for x, y, n in [*same, (len(a), len(b), 0)]:
        if i < x or j < y:
            cuts.append((i, x, j, y))
        i, j = x + n, y + n
    added, gone = sum(y1 - y0 for _, _, y0, y1 in cuts), sum(x1 - x0 for x0, x1, _, _ in cuts)
    lines, end = (2 if cuts else 0), None
    for k, (x0, x1, y0, y1) in enumerate(cuts):
        lines += (x1 - x0) + (y1 - y0)
        gap = x0 - end if end is not None else None
        if gap is not None and gap <= 2 * around:
            lines += gap  # one hunk with the one before
        else:
            lines += 1 + min(around, x0 if end is None else gap)
            if end is not None:
                lines += around
        end = x1
    if cuts:
        lines += min(around, len(a) - end)
    total = len(a) + len(b)
    return (2.0 * sum(n for _, _, n in same) / total if total else 1.0), added, gone, lines


def kind_of(added: int, gone: int) -> str:
    if added > 2 * gone:
        return "major_additions"
    if gone > 2 * added:
        return "major_deletions"
    return "content_modifications" if added and gone else "no_significant_change"


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, n: the place (from 1) of each row within its key; rows of a null order are left out.

    Rows are dealt by ranges of (key, order), so that a hot key lies in many tasks; counts of the ranges before give the rest.
    """
    # ties of equal order values lie in one range; the rank among them is the same for all engines only if order is unique
    dealt = written(df.where(F.col(order).isNotNull()).select(key, order).repartitionByRange(key, order).withColumn("__p", F.spark_partition_id()), "ranges")
    own = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__p").orderBy(order)))
    counts = dealt.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), (F.sum("__c").over(Window.partitionBy(key).orderBy("__p")) - F.col("__c")).alias("__b"))
    return own.join(before, F.col("__k").eqNullSafe(F.col(key)) & (F.col("__p") == F.col("__q"))).select(key, order, (F.col("__n") + F.col("__b")).cast("long").alias("n"))


def successive(df: DataFrame, key: str, order: str, text: str, every: Column | None = None) -> DataFrame:
    """key, order, n, text, before: each row with the text of the row before it in its key (null for the first).

    `every`: a whole number over n and total, the steps of a sample that begins with the first row; others are left out.
    Rows meet their predecessor by (key, place), which is unique, so that a hot key is no hot join key. order is unique in a key.
    """
    places = written(numbered(df, key, order), "places")
    if every is not None:
        totals = places.groupBy(key).agg(F.max("n").alias("total"))
        totals = totals.withColumnRenamed(key, "__k")
        stepped = places.join(totals, F.col("__k").eqNullSafe(F.col(key))).withColumn("__e", every)
        places = written(stepped.where(F.pmod(F.col("n") - 1, F.col("__e")) == 0).select(key, order, ((F.col("n") - 1) / F.col("__e") + 1).cast("long").alias("n")), "places")
    rows = df.select(key, order, text).join(places.select(F.col(key).alias("__k"), F.col(order).alias("__o"), "n"), F.col("__k").eqNullSafe(F.col(key)) & (F.col("__o") == F.col(order))).select(key, order, "n", text)
    earlier = rows.select(F.col(key).alias("__k"), (F.col("n") + 1).alias("__m"), F.col(text).alias("before"))
    return rows.join(earlier, F.col("__k").eqNullSafe(F.col(key)) & (F.col("n") == F.col("__m")), "left").select(key, order, "n", text, "before")


def with_changes(pairs: DataFrame, text: str, before: str, unit: str = "line") -> DataFrame:
    """The table with ratio, additions, deletions, change_ratio and kind of each text against the one before (all null without one).

    unit: line, word or character. Lines end at a line feed. change_ratio: changed lines over the lines of a unified difference.
    """
    split = {"line": lambda s: s.split("\n"), "word": str.split, "character": list}[unit]
    columns = pairs.columns

    def run(batches):
        for batch in batches:
            out = []
            for new, old in zip(batch.column(text).to_pylist(), batch.column(before).to_pylist()):
                if new is None or old is None:
                    out.append((None,) * 5)
                    continue
                share, added, gone, lines = changes(split(old), split(new))
                out.append((share, added, gone, (added + gone) / lines if lines else 0.0, kind_of(added, gone)))
            made = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(v, t) for v, t in zip(made, kinds))], [*columns, "ratio", "additions", "deletions", "change_ratio", "kind"])

    fields = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return pairs.mapInArrow(run, f"{fields}, ratio double, additions long, deletions long, change_ratio double, kind string")
