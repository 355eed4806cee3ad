"""Places of patterns in texts, and which of overlapping ones stay; all in JVM expressions and windows over the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ascii_only(text: Column) -> Column:
    """The text with every other character but the degree sign as one space: word borders are then the same for all engines, places stay."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x00-\\x7F°]", " ")


def detected(df: DataFrame, key: str, text: str, patterns: list[tuple[str, str, str]], flags: str = "", held: dict[str, str] | None = None) -> DataFrame:
    """key, category, pattern, matches: of each (category, name, pattern) that the text holds, all matches in order; one pass over the texts.

    `held`: by the pattern's name what every match of it holds, in lower case; texts without it are not searched for the pattern.
    """
    rows = df.select(key, ascii_only(F.col(text)).alias("__t")).withColumn("__l", F.lower("__t"))

    def matches(name: str, pattern: str) -> Column:
        every = F.regexp_extract_all("__t", F.lit(flags + pattern), F.lit(0))
        return F.when(F.contains("__l", F.lit(held[name])), every).otherwise(F.array().cast("array<string>")) if name in (held or {}) else every

    each = [F.struct(F.lit(c).alias("category"), F.lit(n).alias("pattern"), matches(n, p).alias("matches")) for c, n, p in patterns]
    return rows.select(key, F.explode(F.array(*each)).alias("m")).where(F.size("m.matches") > 0).select(key, "m.*")


def places(df: DataFrame, key: str, text: str, patterns: list[tuple[str, str, float]]) -> DataFrame:
    """row, key, kind, confidence, start, end, match for each match of each (kind, pattern, confidence).

    `row` tells rows of equal keys apart. What lies between matches gives their places, by running sums over the lengths alone:
    texts are neither shuffled nor walked twice, and time is linear in the matches.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), key, ascii_only(F.col(text)).alias("__t"))
    each = [
        F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.regexp_extract_all("__t", F.lit(p), F.lit(0)).alias("e"), F.transform(F.split("__t", p, -1), lambda g: F.length(g)).alias("g"))
        for k, p, c in patterns
    ]
    found = rows.select("row", key, F.explode(F.array(*each)).alias("m")).where(F.size("m.e") > 0)
    found = found.select("row", key, "m.kind", "m.confidence", F.posexplode(F.arrays_zip(F.col("m.e").alias("e"), F.slice("m.g", F.lit(1), F.size("m.e")).alias("g"))).alias("i", "z"))
    size = F.length("z.e")
    until = F.sum(F.col("z.g") + size).over(Window.partitionBy("row", "kind").orderBy("i"))
    return found.select("row", key, "kind", "confidence", (until - size).cast("long").alias("start"), until.cast("long").alias("end"), F.col("z.e").alias("match"))


def resolved(found: DataFrame) -> DataFrame:
    """The places without overlaps: in order of start (then end, kind) a match that overlaps the last one kept replaces it if its confidence is higher, else goes.

    Kept matches never overlap, so that the last one is all there is to look at. Runs of overlapping matches are independent of
    each other; only within one (a few matches) is there a fold.
    """
    columns = found.columns
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("__new", (far.isNull() | (F.col("start") >= far)).cast("int"))
    runs = opened.withColumn("__run", F.sum("__new").over(order))
    item = F.struct("start", "end", "kind", *[c for c in columns if c not in ("start", "end", "kind", "row")])
    lists = runs.groupBy("row", "__run").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def step(kept: Column, m: Column) -> Column:
        last = F.element_at(kept, -1)
        instead = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(m))
        return F.when(m["start"] >= last["end"], F.concat(kept, F.array(m))).when(m["confidence"] > last["confidence"], instead).otherwise(kept)

    kept = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.slice("all", F.lit(1), F.lit(1)), step))
    return lists.select("row", F.explode(kept).alias("m")).select("row", "m.*").select(*columns)


def digits_valid(digits: Column) -> Column:
    """Whether a number's digits pass the check sum of payment cards: every second digit from the right doubled, a multiple of ten."""
    d = F.transform(F.split(F.reverse(F.regexp_replace(digits, "[^0-9]", "")), ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))), F.lit(0), lambda a, x: a + x)
    return (F.size(d) > 11) & (total % 10 == 0)


def octets_valid(address: Column) -> Column:
    """Whether all parts of a dotted address are 255 at most."""
    return F.forall(F.split(address, r"\."), lambda x: x.cast("int") <= 255)
