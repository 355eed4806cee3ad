"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Words of a text become template words: numbers, units after numbers and names (capitalised words inside a sentence)
turn into typed placeholders, the rest loses case. Windows of K template words, and of K plain words, are hashed and
joined with those of the benchmark items. An item is in a document if SHARE of its plain windows are there,
or SHARE of its template windows with consistent slots: each value of the item stands for one value of the
document, in one occurrence at least. An occurrence is what lies at one distance from the item, at about one distance
(within half the item's length, so that words may be added or left out), or all matches together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import fresh

#: Words of a window, least share of an item's windows, literal words that a template window must have.
K, SHARE, LITERALS = 5, 0.8, 3
#: Benchmark windows up to which they are sent to all executors; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Units of measure that are slots after a number.
UNITS = "kg g mg lb oz km m cm mm mi ft in l ml s ms min h hr day days hour hours minute minutes second seconds week weeks year years percent dollars euros usd eur mph kmh gb mb kb tb"
NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\u0001-\u0003]+", " "), " "), lambda w: w != "")


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002\u0003", "   ")


def _raw(text: Column) -> Column:
    """Words with their case; a number with its separators is one word."""
    return _words(F.regexp_replace(_clean(text), r"(?<=\p{N})[.,:](?=\p{N})", ""))


def _canonical(text: Column) -> Column:
    """The text with placeholders; as many words as _raw gives."""
    t = F.regexp_replace(F.regexp_replace(_clean(text), r"(?<=\p{N})[.,:](?=\p{N})", ""), r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{L}*(?![\p{L}\p{N}])", NAME)
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])\p{N}+(?![\p{L}\p{N}])", NUMBER)
    return F.lower(F.regexp_replace(t, rf"(?i)(?<={NUMBER} )(?:{UNITS.replace(' ', '|')})(?![\p{{L}}\p{{N}}])", UNIT))


def _windows(words: Column, seed: int) -> Column:
    n = F.size(words)
    return F.when(n >= K, F.transform(F.sequence(F.lit(1), F.greatest(n - K + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, K), F.lit(seed)))).otherwise(F.array().cast("array<bigint>"))


def _has_slot(text: Column) -> Column:
    return F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(NAME))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), item_id, kind (plain or template), share, slot_share (of consistent values; null: plain) for each item in a document.

    Null and short texts hold nothing; items of fewer than K words, or null, are not looked for; repeated rows of docs (same
    doc_id and text) give one row for an item, a null doc_id is carried, of items with one id the windows are pooled; texts are
    read whole; either table may be empty; other columns are not read.
    """
    text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    bench = items.where("text is not null").select("item_id", "text")

    b = bench.select("item_id", F.transform(_raw(F.col("text")), lambda w: F.lower(w)).alias("plain"), _words(_canonical(F.col("text"))).alias("canon"), _has_slot(_canonical(F.col("text"))).alias("slots"))
    plain = b.select("item_id", F.lit("plain").alias("kind"), F.explode(_windows(F.col("plain"), 0)).alias("w"))
    rich = F.when(F.col("slots"), F.col("canon")).otherwise(F.array().cast("array<string>"))
    solid = lambda ws, i: F.size(F.filter(F.slice(ws, i + 1, K), lambda w: ~w.isin(NUMBER, UNIT, NAME))) >= LITERALS
    template = b.select("item_id", "canon", rich.alias("rich")).select("item_id", F.lit("template").alias("kind"), F.posexplode(_windows(F.col("rich"), 1)).alias("i", "w"), "canon").where(solid(F.col("canon"), F.col("i"))).select("item_id", "kind", "w")
    index = plain.union(template).distinct()
    size = index.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("of"))
    small = index.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda x: x)

    canon = _canonical(F.col("text"))
    have = text.select("doc_id", "h", F.transform(_raw(F.col("text")), lambda w: F.lower(w)).alias("plain"), canon.alias("c"))
    have = have.select("doc_id", "h", "plain", F.when(_has_slot(F.col("c")), _words(F.col("c"))).otherwise(F.array().cast("array<string>")).alias("canon"))
    have = have.select("doc_id", "h", _windows(F.col("plain"), 0).alias("a"), _windows(F.col("canon"), 1).alias("b"))
    # a template window without slots is a plain window, and the seed tells the kinds apart
    seen = have.select("doc_id", "h", F.explode(F.array_distinct(F.concat("a", "b"))).alias("w"))
    met = seen.join(hint(index), "w").groupBy("doc_id", "h", "item_id", "kind").agg(F.countDistinct("w").alias("n"))
    met = met.join(size, ["item_id", "kind"]).select("doc_id", "h", "item_id", "kind", (F.col("n") / F.col("of")).alias("share")).where(F.col("share") >= SHARE)
    best = met.groupBy("doc_id", "h", "item_id").pivot("kind", ["plain", "template"]).agg(F.max("share"))

    # slots, only where the template alone has matched
    open_ = best.where("plain is null")
    some = open_.select("doc_id", "h").distinct()
    again = text.alias("t").join(some.alias("o"), F.expr("t.doc_id <=> o.doc_id and t.h = o.h"), "left_semi").dropDuplicates(["doc_id", "h"])

    def values(frame: DataFrame, keys: list[str], raw: str) -> DataFrame:
        lined = frame.select(*keys, _raw(F.col("text")).alias("words"), _words(_canonical(F.col("text"))).alias("canon"))
        span = F.size("canon") - K + 1
        at = lined.select(*keys, "words", "canon", span.alias("span"), F.posexplode(_windows(F.col("canon"), 1)).alias("i", "w"))
        slot = F.transform(F.slice("canon", F.col("i") + 1, K), lambda c, j: F.when(c.isin(NUMBER, UNIT, NAME), F.lower(F.get(F.col("words"), F.col("i") + j))))
        return at.select(*keys, "w", F.col("i").alias(f"{raw}_at"), "span", solid(F.col("canon"), F.col("i")).alias("solid"), slot.alias(raw))

    pairs = values(again, ["doc_id", "h"], "own").drop("span", "solid").join(hint(values(bench, ["item_id"], "theirs")), "w")
    pairs = pairs.alias("p").join(open_.alias("o"), F.expr("p.doc_id <=> o.doc_id and p.h = o.h and p.item_id = o.item_id"), "left_semi")
    shift, half = F.col("own_at") - F.col("theirs_at"), F.greatest(F.ceil(F.col("span") / 2), F.lit(1))
    near = F.floor(shift / half)
    place = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    # two overlapping places of the item's length: one occurrence's matches are together in one of them
    places = F.array(place(0, F.lit(0)), place(1, shift), place(2, near), place(2, near - 1))
    met_at = pairs.select("doc_id", "h", "item_id", "w", "solid", "own", "theirs", F.explode(places).alias("place"))
    whole = met_at.where("solid").groupBy("doc_id", "h", "item_id", "place").agg(F.countDistinct("w").alias("n")).join(size.where("kind = 'template'"), "item_id")
    whole = whole.where((F.col("place.kind") == 0) | (F.col("n") / F.col("of") >= SHARE)).select("doc_id", "h", "item_id", "place")
    each = met_at.select("doc_id", "h", "item_id", "place", F.explode(F.arrays_zip("own", "theirs")).alias("z")).where("z.own is not null and z.theirs is not null")
    mapped = each.groupBy("doc_id", "h", "item_id", "place", F.col("z.theirs").alias("value")).agg(F.countDistinct("z.own").alias("n"))
    agreed = mapped.groupBy("doc_id", "h", "item_id", "place").agg(F.avg((F.col("n") == 1).cast("double")).alias("agreed"))
    agreed = agreed.alias("p").join(whole.alias("o"), F.expr("p.doc_id <=> o.doc_id and p.h = o.h and p.item_id = o.item_id and p.place = o.place"), "left_semi")
    agreed = agreed.groupBy("doc_id", "h", "item_id").agg(F.max("agreed").alias("agreed"))
    out = best.alias("x").join(agreed.alias("y"), F.expr("x.doc_id <=> y.doc_id and x.h = y.h and x.item_id = y.item_id"), "left")
    consistent = F.col("plain").isNotNull() | (F.coalesce("agreed", F.lit(1.0)) >= SHARE)
    return out.where(consistent).select(
        "x.doc_id", "x.h", "x.item_id", F.when(F.col("plain").isNotNull(), "plain").otherwise("template").alias("kind"), F.coalesce("plain", "template").alias("share"), F.when(F.col("plain").isNull(), F.coalesce("agreed", F.lit(1.0))).alias("slot_share")
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item.

    Null and empty texts hold none and stay; equal rows stay or go together; without items all rows stay; an empty table gives
    no rows.
    """
    i, h = fresh(docs, "i"), fresh(docs, "h")
    bad = find(docs, items).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad[i]) & (F.xxhash64(docs["text"]) == bad[h])
    return docs.join(bad, same, "left_anti")
