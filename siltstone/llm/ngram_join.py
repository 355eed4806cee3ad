"""Exact Jaccard self-join of word n-gram sets by T-occurrence search with DivideSkip.

Two sets of sizes n and m with Jaccard t or more share at least T = t/(1+t) * (n+m) shingles. A set's n - ceil(tn) + 1
rarest shingles index it; a pair must meet in at least T - max(ceil(tn), ceil(tm)) + 1 of these lists. Equal sets are one
class from the start.

Queries are the classes. For each, the lists are divided: of those that a partner must be met in k times, the k - 1
longest are set aside, the others are merged through a heap, and the partners found are looked up in the long ones by
binary search (_search). Pairs that reach the required count are verified by binary search of the smaller whole set in
the larger.

A group of m copies with small edits would give m^2 pairs. So a first search asks only for each list's most central
class (the text that others were edited from): each class takes one partner at most, that which it meets most often and
often enough. The components found are contracted, and lists of one component end. The second search takes all that is
left, by bands of set sizes, and skips the members of a query's own component, so that no link between components is lost.

Rare comes first by a table of at most HEAVY frequent shingles from counts over all documents; the order need
only be the same for all sets, so that the bound costs no result. Lists of frequent shingles are salted.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.common import distinct_in, fresh, lower_ascii, materialize, mix, release, shingle_hashes, slices, span_hashes, text_bytes, word_spans
from siltstone.llm.components import components, roots_of

#: Frequent shingles that are sent to executors, 16 bytes each.
HEAVY = 400_000
#: Shingles counted together in a task before counts of LOCAL or more are emitted.
COUNTED, LOCAL = 2_000_000, 4
#: Postings of a block of the last search; a task holds two.
BLOCK_ROWS = 400_000
#: Members of a list of a frequent shingle that share a salt, about.
SALTED = 5_000
#: Ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Fingerprints whose first 64 bits are alike and whose others differ; by chance there are none below 10^9 texts.
TWINS = 10_000
#: Bytes of a batch of pairs of sets in a worker.
PAIR_BYTES = 8 << 20
#: Bounds of the partner's size over the query's that are searched with a common required count.
STEPS = (1.0, 1.05, 1.11)


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, bounds, prints, others): the distinct shingles of each text in ascending order, and 128 bits for each set."""
    raw, offsets = text_bytes(column)
    low = lower_ascii(raw)
    starts, ends, words = word_spans(low, offsets)
    hashes, docs = shingle_hashes(span_hashes(low, starts, ends), words, k)
    docs, hashes = distinct_in(docs, hashes)
    bounds = np.searchsorted(docs, np.arange(len(words) + 1))
    out = []
    for key in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(key)), dtype=np.uint64)))
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return hashes, bounds, out[0], out[1]


def _named(prints: np.ndarray, others: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """64 bits that tell the classes apart: the first print, or both where the first alone does not."""
    return np.where(np.isin(prints, twins), prints ^ others, prints) if len(twins) else prints


def _scan(k: int):
    """Rows of class prints (kind 0: doc_id, h, size, prints) and of locally frequent shingles (kind 1: count, shingle)."""
    names = ["kind", "doc_id", "h", "n", "print", "other"]

    def run(batches):
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n = 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL
            values, counts = values[often].view(np.int64), counts[often].astype(np.int64)
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int8)), none, none, pa.array(counts), pa.array(values), none], names)

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds, prints, others = sets(part.column("text"), k)
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sizes), np.int8)), part.column("doc_id"), part.column("h"), pa.array(sizes), pa.array(prints.view(np.int64)), pa.array(others.view(np.int64))], names
                )
                new = np.array([not (p in seen or seen.add(p)) for p in prints.tolist()], bool)
                held.append(hashes[np.repeat(new, sizes)])
                n += len(held[-1])
                if n >= COUNTED:
                    yield flush()
                    held, n = [], 0
                    seen.clear()
        if held:
            yield flush()

    return run


def _prefixes(k: int, percent: int, sent):
    """Postings of the indexed shingles: shingle, salt (-1: the list is whole), print, size."""

    def run(batches):
        keys, counts, twins = sent.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds, prints, others = sets(part.column("text"), k)
                prints = _named(prints, others, twins)
                sizes = np.diff(bounds)
                if len(seen) > 1_000_000:
                    seen.clear()
                new = np.array([not (p in seen or seen.add(p)) for p in prints.tolist()], bool) & (sizes > 0)
                keep = np.repeat(new, sizes)
                doc = np.repeat(np.arange(len(sizes)), sizes)[keep]
                hashes = hashes[keep]
                often = np.zeros(len(hashes), np.int64)
                if len(keys) and len(hashes):
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    often = np.where(keys[at] == hashes, counts[at], 0)
                want = sizes - -(-percent * sizes // 100) + 1
                # hashes ascend within a text; only texts that lack enough rare ones are sorted by frequency
                rare = np.bincount(doc[often == 0], minlength=len(sizes)) >= want
                easy = np.flatnonzero((often == 0) & rare[doc])
                place = np.arange(len(easy)) - np.searchsorted(doc[easy], doc[easy])
                easy = easy[place < want[doc[easy]]]
                hard = np.flatnonzero(~rare[doc])
                hard = hard[np.lexsort((hashes[hard], often[hard], doc[hard]))]
                place = np.arange(len(hard)) - np.searchsorted(doc[hard], doc[hard])
                short = np.concatenate((easy, hard[place < want[doc[hard]]]))
                doc, hashes, often = doc[short], hashes[short], often[short]
                own = prints[doc]
                salts = 1 + often // SALTED
                salt = np.where(salts > 1, ((own >> np.uint64(7)).astype(np.int64) & 0x7FFFFFFF) % salts, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(sizes[doc].astype(np.int32))], ["shingle", "salt", "print", "n"]
                )

    return run


def _set_rows(k: int, twins: np.ndarray):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds, prints, others = sets(part.column("text"), k)
                prints = _named(prints, others, twins)
                if len(seen) > 1_000_000:
                    seen.clear()
                new = [i for i, p in enumerate(prints.tolist()) if not (p in seen or seen.add(p))]
                raw = hashes.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[new].view(np.int64)), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1][new].tolist(), bounds[1:][new].tolist())], pa.binary())], ["print", "members"]
                )

    return run


def _probe(percent: int):
    """Binary search of the smaller set's shingles in the larger; pairs of the required overlap stay."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(len(left), bool)
            for i in range(len(left)):
                x, y = np.frombuffer(left[i].as_buffer(), "<u8"), np.frombuffer(right[i].as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    shared = int((y[at] == x).sum())
                    keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def required(n, m, percent: int):
    """Lists of the index that sets of sizes n and m must meet in, at least; for numbers and arrays."""
    largest = np.maximum(n, m)
    return np.maximum(-(-percent * (n + m) // (100 + percent)) - (-(-percent * largest // 100) - 1), 1)


def _required(n: Column, m: Column, percent: int) -> Column:
    return F.greatest(F.ceil(F.lit(percent) * (n + m) / (100 + percent)) - F.ceil(F.lit(percent) * F.greatest(n, m) / 100) + 1, F.lit(1))


def _divide_skip(parts: list[list[int]], least: int) -> dict[int, int]:
    """Members met in `least` of the ascending lists or more, and how often: a heap merges the short lists, the long ones are probed."""
    if len(parts) < least:
        return {}
    parts.sort(key=len)
    short = parts[: len(parts) - least + 1]
    found: dict[int, int] = {}
    for x in short[0] if len(short) == 1 else heapq.merge(*short):
        found[x] = found.get(x, 0) + 1
    for place, part in enumerate(parts[len(short) :], len(short)):
        left = len(parts) - place - 1  # lists to come
        for x, met in list(found.items()):
            at = bisect_left(part, x)
            if at < len(part) and part[at] == x:
                found[x] = met + 1
            elif met + left < least:
                del found[x]
    return found


def _search(percent: int):
    """DivideSkip in one pair of blocks: partners of each class among larger ones of other components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
        names, first = np.unique(pdf["node"].to_numpy(), return_index=True)
        n, root, block, mask = (pdf[c].to_numpy(np.int64)[first] for c in ("n", "root", "block", "mask"))
        home = pdf["home"].to_numpy(bool)[first]
        # classes are numbered by size, so that ascending lists ascend in size
        rank = np.empty(len(names), np.int64)
        order = np.argsort(n, kind="stable")
        rank[order] = np.arange(len(names))
        which = rank[np.searchsorted(names, pdf["node"].to_numpy())]
        names, n, root, block, home = (names ^ mask)[order], n[order], root[order], block[order], home[order]
        lists, at = np.unique(pdf["list"].to_numpy(), return_inverse=True)
        by = np.lexsort((which, at))
        cuts = np.searchsorted(at[by], np.arange(len(lists) + 1))
        members = which[by]
        whole, rest, main = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = members[a:b]
            roots, counts = np.unique(root[part], return_counts=True)
            most = int(roots[counts.argmax()])
            whole.append(part.tolist())
            main.append(most)
            rest.append(part[root[part] != most].tolist())  # for queries of the list's largest component
        own = np.argsort(which, kind="stable")
        of, own_start = at[own].tolist(), np.searchsorted(which[own], np.arange(len(names) + 1)).tolist()
        out_a, out_b = [], []
        for i in range(len(names)):
            size, top = int(n[i]), int(np.searchsorted(n, int(n[i]) * 100 // percent, side="right"))
            edges = [i + 1, *(max(i + 1, min(top, int(np.searchsorted(n, size * s)))) for s in STEPS[1:]), top]
            mine = [rest[x] if main[x] == root[i] else whole[x] for x in of[own_start[i] : own_start[i + 1]]]
            mine = [x for x in mine if x and x[-1] > i]
            for low, high in zip(edges[:-1], edges[1:]):
                if low >= high or not mine:
                    continue
                parts = [y for x in mine if (y := x[bisect_left(x, low) : bisect_left(x, high)])]
                if not parts:
                    continue
                # the required count falls as the partner grows, but for rounding
                found = _divide_skip(parts, max(int(required(size, int(n[high - 1]), percent)) - 1, 1))
                if not found:
                    continue
                j, met = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
                across = block[j] == block[i] if left == right else block[j] != block[i]
                fits = across & (home[i] | home[j]) & (root[j] != root[i]) & (met >= required(size, n[j], percent))
                out_a.append(np.full(int(fits.sum()), names[i]))
                out_b.append(names[j[fits]])
        a, b = np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _block_search(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that may link, from the lists that hold several components.

    Sizes of a pair differ by a factor of at most 100/percent, so that classes are dealt to size bands of that width: band
    g holds the classes at home in it and, as guests, those of the next one; lists end where a band's part of them holds
    one component or no class at home. Within a band, classes that share lists, directly or through others, are one
    neighbourhood; all lists of a pair are in one. Small neighbourhoods share a task of about BLOCK_ROWS postings; a
    large one is cut into blocks of classes, and every two blocks meet in a task of their own, so that no task holds more
    than about two blocks.
    """
    spark = mixed.sparkSession
    # a little wider than the factor, so that rounding never parts a pair by two bands
    width = max(math.log(100 / percent), 0.05) * 1.001
    own = F.floor(F.ln("n") / F.lit(width)).cast("int")
    banded = mixed.select("shingle", "print", "n", "root", own.alias("own")).withColumn("band", F.explode(F.array("own", F.col("own") - 1)))
    banded = banded.withColumn("home", F.col("own") == F.col("band")).withColumn("mask", F.xxhash64("band"))
    # pre-aggregated, so that a long list is not one task's
    useful = banded.groupBy("shingle", "band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("home").alias("some"), F.min(F.col("print").bitwiseXOR(F.col("mask"))).alias("low"))
    useful = useful.where("r0 <> r1 and some").select("shingle", "band", "low")
    kept = banded.join(useful, ["shingle", "band"]).select(F.xxhash64("shingle", "band").alias("list"), F.col("print").bitwiseXOR(F.col("mask")).alias("node"), "mask", "n", "root", "home", "low")
    kept = materialize(kept, "banded")
    # neighbourhoods: each class hooks to the least class of its lists, then what still differs is settled between these
    first = roots_of(kept.groupBy("node").agg(F.min("low").alias("up")))
    hooked = kept.select("node", "low").distinct().join(first, "node")
    more = hooked.join(first.select(F.col("node").alias("low"), F.col("root").alias("b")), "low").select(F.col("root").alias("a"), "b").where("a <> b").distinct()
    second = components(more)
    near = first.select("node", F.col("root").alias("mid")).join(second.select(F.col("node").alias("mid"), F.col("root").alias("top")), "mid", "left").select("node", F.coalesce("top", "mid").alias("near"))
    placed = materialize(kept.drop("low").join(near, "node"), "placed")
    release(spark, kept)
    # only large neighbourhoods are named: one at most for BLOCK_ROWS postings
    large = materialize(placed.groupBy("near").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK_ROWS), "large")
    hint = F.broadcast if large.count() <= BROADCAST_IDS else (lambda x: x)
    tasks = F.greatest(F.ceil(F.lit(max(placed.count(), 1)) / BLOCK_ROWS), F.lit(spark.sparkContext.defaultParallelism))
    placed = placed.join(hint(large), "near", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("task", F.when(F.col("blocks") > 1, F.col("near")).otherwise(F.pmod(F.xxhash64("near"), tasks)))
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
    dealt = placed.select("task", "blocks", "list", "node", "mask", "n", "root", "home", "block", F.explode(ends).alias("e")).select("task", "blocks", "e.left", "e.right", "list", "node", "mask", "n", "root", "home", "block")
    return dealt.groupBy("task", "blocks", "left", "right").applyInPandas(_search(percent), "a long, b long")


def _linked(docs: DataFrame, ids: DataFrame, pairs: DataFrame, k: int, percent: int, twins: np.ndarray) -> DataFrame:
    """Those of a table of pairs (a, b) that are similar, written; only the documents of the classes in it are read whole."""
    spark = docs.sparkSession
    ends = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "print")
    wanted = ends.join(ids, "print").select(F.coalesce("first.doc_id", F.lit(0)).alias("i"), F.col("first.doc_id").isNull().alias("null"), F.col("first.h").alias("g"))
    wanted = materialize(wanted, "wanted")
    one = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    here = docs.join(one, (F.coalesce("doc_id", F.lit(0)) == F.col("i")) & (F.col("doc_id").isNull() == F.col("null")) & (F.col("h") == F.col("g")), "left_semi")
    # rows equal in id and text give one set, within a task and then across tasks; both joins read the one shuffle
    have = here.mapInArrow(_set_rows(k, twins), "print long, members binary").groupBy("print").agg(F.first("members").alias("members"))
    left = pairs.join(have.select(F.col("print").alias("a"), F.col("members").alias("left")), "a")
    right = pairs.select("b").distinct().join(have.select(F.col("print").alias("b"), F.col("members").alias("right")), "b")
    both = left.join(right, "b").select("a", "b", "left", "right")
    # two sets of a long text are megabytes: batches end by bytes, not by rows
    found = materialize(both.mapInArrow(_probe(percent), "a long, b long"), "links", {"spark.sql.execution.arrow.maxBytesPerBatch": str(PAIR_BYTES)})
    release(spark, wanted)
    return found


def _partners(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class the central class that it meets most often, where that is as often as a similar one requires.

    Asked for is each list's most central class; the parts of a salted list meet through theirs. The partner of a class
    is always the more central one (ties by hash), so that partners make a forest.
    """
    one = F.struct("central", F.xxhash64("print").alias("h"), "print", "n")
    asked = lists.withColumn("top", F.max(one).over(Window.partitionBy("shingle", "salt")))
    heads = asked.where("salt >= 0 and print = top.print").withColumn("top", F.max("top").over(Window.partitionBy("shingle")))
    rows = asked.select("print", "n", "top").union(heads.select("print", "n", "top")).where("print <> top.print")
    met = rows.groupBy("print", F.col("top.print").alias("partner"), "n", F.col("top.n").alias("m")).agg(F.count(F.lit(1)).alias("met"))
    met = met.where((F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("met") >= _required(F.col("n"), F.col("m"), percent)))
    return met.groupBy(F.col("print").alias("a")).agg(F.max_by("partner", F.struct("met", F.xxhash64("partner"))).alias("b"))


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, h, n_shingles, print; classes: print, root) of docs (doc_id, text, h); texts without words are in no class."""
    spark = docs.sparkSession
    scanned = materialize(docs.mapInArrow(_scan(k), "kind byte, doc_id long, h long, n long, print long, other long"), "prints")
    rows = scanned.where("kind = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), "print", "other")
    often = scanned.where("kind = 1").groupBy("print").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "print").limit(HEAVY).toArrow()
    keys, counts = often["print"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    solid = rows.where("n_shingles > 0")
    alike = [r[0] for r in solid.groupBy("print").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("print").limit(TWINS + 1).collect()]
    if len(alike) > TWINS:
        raise RuntimeError("fingerprints are not spread")
    twins = np.array(sorted(alike), np.int64).view(np.uint64)
    if alike:
        rows = rows.withColumn("print", F.when(F.col("print").isin(alike), F.col("print").bitwiseXOR(F.col("other"))).otherwise(F.col("print")))
    rows = rows.drop("other")
    ids = rows.where("n_shingles > 0").groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("first"))
    sent = spark.sparkContext.broadcast((keys[order], counts[order], twins))

    postings = docs.mapInArrow(_prefixes(k, percent, sent), "shingle long, salt int, print long, n int")
    by_list = Window.partitionBy("shingle", "salt")
    # lists of one class end here: most do; a part of a salted list may meet its other parts
    lists = postings.select("*", F.max("print").over(by_list).alias("high"), F.min("print").over(by_list).alias("low")).where("high <> low or salt >= 0").drop("high", "low")
    # a class that several tasks have met counts once
    lists = materialize(lists.groupBy("shingle", "salt", "print", "n").agg(F.lit(0).alias("z")).drop("z"), "lists")
    # a class is central if most of its lists are shared: the text that others were edited from comes first
    index = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    central = (F.count(F.lit(1)).over(Window.partitionBy("print")) / index).cast("float")
    bare, lists = lists, materialize(lists.withColumn("central", central), "lists")
    release(spark, bare)

    # most copies join here, by one partner each
    pairs = materialize(_partners(lists, percent), "pairs")
    links = _linked(docs, ids, pairs, k, percent, twins)
    tops = links.select("b").distinct().join(links.select(F.col("a").alias("b")), "b", "left_anti")
    stars = roots_of(links.select(F.col("a").alias("node"), F.col("b").alias("up")).union(tops.select("b", "b")))
    release(spark, pairs, links)
    placed = lists.drop("salt", "central").join(stars.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    several = placed.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("shingle")
    mixed = materialize(placed.join(several, "shingle", "left_semi"), "mixed")
    release(spark, lists)
    # whatever is left between components
    pairs = materialize(_block_search(mixed, percent), "pairs")
    release(spark, mixed)
    links = _linked(docs, ids, pairs, k, percent, twins)
    root = lambda at: stars.select(F.col("node").alias(at), F.col("root").alias(f"r{at}"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    rest = components(ends)
    release(spark, pairs, links)
    classes = ids.select("print").join(stars.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("mid"))
    classes = classes.join(rest.select(F.col("node").alias("mid"), F.col("root").alias("top")), "mid", "left").select("print", F.coalesce("top", "mid").alias("root"))
    return rows, classes


def _source(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"), F.xxhash64(column).alias("h"))


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and print for every row of docs.

    A set: the distinct k-word shingles of the text with A-Z in lower case, words parted by ASCII white space; with
    fewer words the whole sequence as one; null, empty and blank texts have none and link with nothing
    (component_id is their own doc_id). Rows with a null doc_id take part and count last for the smallest id;
    repeated rows are in one class; very long texts are whole; an empty table gives no rows; other columns are not read.
    """
    rows, classes = _classes(_source(docs, column), k, percent)
    full = rows.where("n_shingles > 0").join(classes, "print")
    named = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = full.join(named, "root").select("doc_id", "n_shingles", "component_id", "print")
    return full.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "print"))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs with one document of each group: that of the smallest doc_id (null ids last), ties by the text's hash.

    Documents without words stay; of rows equal in doc_id and text one stays. A row is known by its id and its text's hash,
    so that rows with a null id, and several texts under one id, are kept or dropped each by their own group.
    """
    solid = F.coalesce(F.col("text").rlike("[^ \\x09-\\x0D]"), F.lit(False))
    words, blank = docs.where(solid), docs.where(~solid)
    rows, classes = _classes(_source(words, "text"), k, percent)
    first = rows.join(classes, "print").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("first"))
    i, null, h = fresh(docs, "i"), fresh(docs, "null"), fresh(docs, "h")
    keys = [i, null, h]
    named = words.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), null: F.col("doc_id").isNull(), h: F.xxhash64("text")})
    firsts = first.select(F.coalesce("first.doc_id", F.lit(0)).alias(i), F.col("first.null").alias(null), F.col("first.h").alias(h))
    kept = named.join(firsts, keys, "left_semi").dropDuplicates(keys)
    return kept.select(docs.columns).unionByName(blank)
