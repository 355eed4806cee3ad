"""Longest-processing-time scheduling of groups onto shards.

Groups of one size are alike to the schedule, so that it runs over the histogram of sizes, largest first, and
says how many groups of each size a shard takes. k different sizes take k(k+1)/2 bytes at least, so that the
histogram of B bytes has at most sqrt(2B) rows: 14 million for 100 TB.
"""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm.common import materialize


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, first rank, number of groups) under LPT for (size, count) pairs; ties go to the lower shard.

    The heap hands out one group at a time while few are left; a long run of one size is handed out at once
    up to the level that all of it reaches, which gives the same counts.
    """
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, count in sorted(sizes, reverse=True):
        took = [0] * shards
        if count > 4 * shards and size > 0:
            loads = {s: load for load, s in heap}
            low, high = min(loads.values()), max(loads.values()) + size * (count + 1)

            def below(level: int, loads=loads, size=size) -> int:
                return sum(max(0, -(-(level - load) // size)) for load in loads.values())

            while low < high:  # the highest level whose groups are all handed out
                mid = (low + high + 1) // 2
                if below(mid) <= count:
                    low = mid
                else:
                    high = mid - 1
            for s, load in loads.items():
                took[s] = max(0, -(-(low - load) // size))
                loads[s] = load + took[s] * size
            heap = [(load, s) for s, load in loads.items()]
            heapq.heapify(heap)
            count -= sum(took)
        for _ in range(count):
            load, s = heap[0]
            took[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        first = 0
        for s, n in enumerate(took):
            if n:
                out.append((size, s, first, n))
                first += n
    return out


def lpt_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: equal texts together, shard bytes near equal.

    A document's size is the UTF-8 bytes of its text (null: none) plus 1, so that null and empty texts are
    groups of their own kinds with size 1 for each member. Groups are known by the text's 256-bit digest and
    pre-aggregated before the shuffle; ranks and slots are salted; the join that brings the shard back to the
    members is split by AQE where one group holds many of them. A null doc_id is carried, repeated rows each get a
    slot, an empty table gives no rows, other columns are not read. `law` is bytes and grown_shard null.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("digest"),
    )
    base = materialize(base, "sizes")  # texts are read and hashed once
    groups = base.groupBy("digest").agg(F.sum("size").alias("bytes"))
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(256)))
    cells = salted.groupBy("bytes", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = cells.groupBy("bytes").agg(F.sum("n").alias("n"))
    sent = histogram.toArrow()
    planned = schedule(list(zip(sent["bytes"].to_pylist(), sent["n"].to_pylist())), shards)
    plan = spark.createDataFrame(pa.Table.from_pandas(pd.DataFrame(planned, columns=["bytes", "shard", "first", "n"], dtype="int64"), preserve_index=False))
    plan = plan.select("bytes", F.col("shard").cast("int").alias("shard"), "first", "n")
    before = cells.select("bytes", "salt", (F.sum("n").over(Window.partitionBy("bytes").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bytes", "salt").orderBy("digest")) - 1
    ranked = salted.withColumn("own", own).join(before, ["bytes", "salt"]).select("digest", "bytes", (F.col("own") + F.col("before")).alias("rank"))
    placed = ranked.join(plan, "bytes").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    members = base.join(placed.select("digest", "shard"), "digest").select("doc_id", "size", "text_crc32", "shard")
    # slots: gapless in each shard, by salted buckets
    dealt = members.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(512)))
    filled = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = filled.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("place", place).join(ahead, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("ahead")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
