"""Merkle fixity audit of record archives.

A record's leaf hash binds its key and content. An ordered range of keys is a leaf of the tree: its hash is the
sum of its records' hashes lane by lane (a multiset hash, so that a range of any size is pre-aggregated and never
collected). Above, a node hashes its FANOUT children in order, up to one root. Two replicas are compared from the
roots down, through mismatching nodes only; records are compared in the mismatching ranges alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import materialize

FANOUT = 16


def manifest(records: DataFrame, key: str, content: list[str], span: int = 64) -> DataFrame:
    """key, slot (the key's range of `span` keys; null keys: a range of their own), digest and its four lanes, one row a record."""
    parts: list[Column] = []
    for c in content:
        text = F.col(c).cast("string")
        parts += [F.coalesce(F.octet_length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")), F.lit(";")]
    digest = F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(";"), *parts), 256)
    lanes = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"l{i}") for i in range(4)]
    slot = F.coalesce(F.floor(F.col(key) / F.lit(span)), F.lit(-(1 << 40))).cast("long")
    return records.select(F.col(key).alias("key"), slot.alias("slot"), digest.alias("digest")).select("key", "slot", "digest", *lanes)


def _parents(low: int, high: int) -> list[Column]:
    """The parent of a node at each level below the root of the nodes low to high; below and above zero meet at the root."""
    out = []
    while low != high:
        if (low, high) == (-1, 0):
            out.append(F.lit(0).cast("long"))
            break
        low, high = low // FANOUT, high // FANOUT
        out.append(F.floor(F.col("node") / F.lit(FANOUT)).cast("long"))
    return out


def tree(leaves: DataFrame, parents: list[Column], name: str) -> list[DataFrame]:
    """Levels from the ranges up to the root, each (node, hash); a level is about one FANOUT-th of the one below."""
    sums = leaves.groupBy(F.col("slot").alias("node")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(4)])
    out = [materialize(sums.select("node", F.sha2(F.concat_ws(",", "n", "l0", "l1", "l2", "l3"), 256).alias("hash")), name)]
    for parent in parents:
        # FANOUT children at most are gathered for a node
        level = out[-1].groupBy(parent.alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"))
        out.append(materialize(level.select(F.col("up").alias("node"), F.sha2(F.to_json("c"), 256).alias("hash")), name))
    return out


def audit(primary: DataFrame, replica: DataFrame, key: str, content: list[str], span: int = 64) -> DataFrame:
    """One row for each key whose records differ: key, slot, status, n_primary, n_replica, primary_digest, replica_digest.

    status: corrupt (as many records, another content), missing (fewer in the replica), extra (more). Records of one key
    are a multiset: repeated rows count; null keys are one key, null content differs from empty content; very long content is
    hashed whole; empty replicas and equal roots give no rows; columns other than key and content are not read.
    """
    a = materialize(manifest(primary, key, content, span), "manifest-primary")
    b = materialize(manifest(replica, key, content, span), "manifest-replica")
    low, high = a.select("slot").union(b.select("slot")).agg(F.min("slot"), F.max("slot")).first()
    parents = _parents(low or 0, high or 0)
    ta, tb = tree(a, parents, "tree-primary"), tree(b, parents, "tree-replica")
    bad = None
    for x, y, parent in zip(ta[::-1], tb[::-1], [None, *parents[::-1]]):
        if bad is not None:
            below = bad.withColumnRenamed("node", "parent")
            x = x.withColumn("parent", parent).join(below, "parent", "left_semi").drop("parent")
            y = y.withColumn("parent", parent).join(below, "parent", "left_semi").drop("parent")
        both = x.join(y.withColumnRenamed("hash", "other"), "node", "full_outer")
        bad = materialize(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("node"), "mismatch")
    slots = bad.withColumnRenamed("node", "slot")
    x = a.join(slots, "slot", "left_semi").select("key", "slot", "digest", F.lit(1).alias("p"), F.lit(0).alias("r"))
    y = b.join(slots, "slot", "left_semi").select("key", "slot", "digest", F.lit(0).alias("p"), F.lit(1).alias("r"))
    each = x.union(y).groupBy("key", "slot", "digest").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    keys = each.groupBy("key", "slot").agg(
        F.sum("p").alias("n_primary"), F.sum("r").alias("n_replica"), F.max((F.col("p") != F.col("r")).cast("int")).alias("differs"),
        F.min(F.when(F.col("p") > F.col("r"), F.col("digest"))).alias("primary_digest"), F.min(F.when(F.col("r") > F.col("p"), F.col("digest"))).alias("replica_digest"),
    )
    status = F.when(F.col("n_primary") > F.col("n_replica"), "missing").when(F.col("n_primary") < F.col("n_replica"), "extra").otherwise("corrupt")
    return keys.where("differs = 1").select("key", "slot", status.alias("status"), "n_primary", "n_replica", "primary_digest", "replica_digest")
