"""Relational operators: transform lists, keyed dedup, top-k per key, budgets, interval and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def transform(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Fold a list of {operation, params}: filter (equality), select, group_by, sort, with_columns; others are ignored."""
    for step in steps:
        kind, p = step["operation"], step.get("params", {})
        if kind == "filter":
            df = df.where(F.col(p["column"]) == F.lit(p["value"]))
        elif kind == "select":
            df = df.select(*p["columns"])
        elif kind == "group_by":
            df = df.groupBy(*p["by"]).agg(*[a if isinstance(a, Column) else F.expr(a) for a in p["aggs"]])
        elif kind == "sort":
            df = df.orderBy(F.desc(p["by"]) if p.get("desc") else F.asc(p["by"]))
        elif kind == "with_columns":
            df = df.withColumns({k: v if isinstance(v, Column) else F.expr(v) for k, v in p.items()})
    return df


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; a ranked filter, so that each task keeps one row of a key before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def prefix_budget(df: DataFrame, keys: list, order: list, cost: Column, budget: float) -> DataFrame:
    """Rows of each key while their running cost stays within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def greedy_budget(df: DataFrame, keys: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Rows taken in order where they still fit, others skipped; the state of a key is one number, whatever its rows."""

    def step(used, row):
        used = used or 0
        c = row[len(keys) + 1]
        fits = c is not None and used + c <= budget
        return (used + c if fits else used), (row if fits else None)

    kinds = dict(df.dtypes)
    columns = [*keys, order, cost, *[c for c in df.columns if c not in (*keys, order, cost)]]
    return _state_by_key(df.select(*columns), keys, [order], step, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _state_by_key(df: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """Rows of each key in order through step(state, row as a tuple) -> (state, output tuple or None), one row at a time.

    Rows are shuffled by the keys and sorted by Spark (spilling where a key is large); a task holds one batch and one state.
    """
    import pyarrow as pa

    columns = df.columns

    def run(batches):
        last, state = None, None
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in columns])
            out = []
            for row in rows:
                key = row[: len(keys)]
                if key != last:
                    last, state = key, None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], [f.name for f in arrow])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema))
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def nearest_lower(df: DataFrame, key: str, order: str, depth: str) -> DataFrame:
    """key, order, parent: for each row the nearest earlier row of its key with a lower depth, null for none; by a stack."""

    def step(stack, row):
        _, at, d = row
        stack = stack if stack is not None else []
        while stack and stack[-1][1] >= d:
            stack.pop()
        parent = stack[-1][0] if stack else None
        stack.append((at, d))
        return stack, (row[0], at, parent)

    kinds = dict(df.dtypes)
    return _state_by_key(df.select(key, order, depth), [key], [order], step, f"{key} {kinds[key]}, {order} {kinds[order]}, parent {kinds[order]}")


def anchored(df: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """key, ts, tie, anchor: in order of time a row that lies `seconds` or more after the anchor becomes the next anchor."""

    def step(anchor, row):
        at = row[1]
        if anchor is None or (at - anchor).total_seconds() >= seconds:
            anchor = at
        return anchor, (*row, anchor)

    kinds = dict(df.dtypes)
    return _state_by_key(df.select(key, ts, tie), [key], [ts, tie], step, f"{key} {kinds[key]}, {ts} {kinds[ts]}, {tie} {kinds[tie]}, anchor {kinds[ts]}")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: list[str]) -> DataFrame:
    """Each left row with the right row of its keys nearest in time (ties: earlier, then `tie`), by two fills over one ordered union.

    No pairs are made: both sides are shuffled once by the keys, and the nearest earlier and later right rows are filled in.
    """
    payload = F.struct(F.col(right_ts).alias("ts"), *[F.col(c) for c in right.columns if c not in (*keys, "ts")])
    r = right.select(*keys, F.col(right_ts).alias("__t"), payload.alias("__r"), F.lit(None).alias("__l"))
    lrow = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    l = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(None).alias("__r"), lrow.alias("__l"))  # noqa: E741
    both = l.unionByName(r.select(*keys, "__t", "__r", F.lit(None).cast(l.schema["__l"].dataType).alias("__l")))
    w = Window.partitionBy(*keys).orderBy("__t", F.col("__r").isNull(), *[F.col(f"__r.{c}") for c in tie])
    before = F.last("__r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the same order backwards, so that both fills run on
    back = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc(F.col("__r").isNull()), *[F.desc(F.col(f"__r.{c}")) for c in tie])
    after = F.last("__r", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    out = both.select(*keys, "__t", "__l", before.alias("__b"), after.alias("__a")).where("__l is not null")
    gap = lambda c: F.abs(F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros(F.col(f"{c}.ts").cast("timestamp")))
    pick = F.when(F.col("__a").isNull() | (gap("__b") <= gap("__a")), F.col("__b")).otherwise(F.col("__a"))
    return out.select(*keys, "__l.*", pick.alias("match"))


def within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs of rows of equal keys at most `seconds` apart: an equi-join on time cells, each right row in three cells."""
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    l = left.withColumn("__cell", cell(left_ts))  # noqa: E741
    r = right.withColumn("__cell", F.explode(F.array(*[cell(right_ts) + d for d in (-1, 0, 1)])))
    near = F.abs(F.unix_micros(F.col(left_ts).cast("timestamp")) - F.unix_micros(F.col(right_ts).cast("timestamp"))) <= seconds * 1_000_000
    return l.join(r, [*keys, "__cell"]).where(near).drop("__cell")


def paired(df: DataFrame, keys: list[str], row: str, block: int = 2_048) -> DataFrame:
    """keys, x, y: every two rows of equal keys whose `row` differs, once, as structs in no order.

    A key's rows are dealt into blocks of about `block` rows, and every two blocks meet in one place: a row is sent once for each
    block of its key, a task holds one block, and pairs are made in the task that judges them, never shuffled.
    """
    blocks = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__n"))
    tasks = blocks.agg(F.sum(F.col("__n") * (F.col("__n") + 1) / 2)).first()[0] or 0
    at = df.join(blocks, keys).select(*keys, F.struct(*df.columns).alias("__r"), "__n", F.pmod(F.xxhash64(row), "__n").cast("int").alias("__b"))
    x = at.select(*keys, F.col("__b").alias("__i"), F.explode(F.sequence(F.col("__b"), F.col("__n") - 1)).alias("__j"), F.col("__r").alias("x"))
    y = at.select(*keys, F.explode(F.sequence(F.lit(0), F.col("__b"))).alias("__i"), F.col("__b").alias("__j"), F.col("__r").alias("y"))
    # a number of tasks is asked for: the rows are few and their pairs are not, so that AQE would join them into one
    n = min(max(2 * int(tasks), 1), 2_000)
    met = x.repartition(n, *keys, "__i", "__j").join(y.repartition(n, *keys, "__i", "__j"), [*keys, "__i", "__j"])
    return met.where((F.col("__i") < F.col("__j")) | (F.col(f"x.{row}") < F.col(f"y.{row}"))).select(*keys, "x", "y")
