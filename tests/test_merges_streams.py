"""Keyed tables and stateful streams: untouched buckets, failed merges, restarts, forgotten keys."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.sources import keyed_table as K
from siltstone.streaming import counters as C


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for n in names if n.startswith("part-")}


def test_two_merges_leave_other_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"v{i}") for i in range(200)] + [(None, "none")]
    K.create(spark.createDataFrame(rows, "k long, v string"), path, ["k"], 16)
    state = dict(rows)
    rng = random.Random(5)
    for turn in range(2):
        before = files(path)
        new = [(k, f"t{turn}-{k}") for k in rng.sample(range(300), 3)] + ([(None, "again")] if turn else [])
        new += new[:1]
        K.merge(spark, path, spark.createDataFrame(new, "k long, v string"), ["k"], K.replacing(["k"], ["v"]))
        state.update(new)
        after = files(path)
        assert all(after[f] == t for f, t in before.items())  # nothing is written in place
        touched = {os.path.basename(os.path.dirname(f)) for f in after if f not in before}
        want = {f"bucket={r['bucket']}" for r in spark.createDataFrame(new, "k long, v string").select(K._bucket(["k"], 16)).distinct().collect()}
        assert touched == want
        got = [(r["k"], r["v"]) for r in K.read(spark, path).collect()]
        assert Counter(got) == Counter(state.items())
    K.merge(spark, path, spark.createDataFrame([(5,), (None,)], "k long"), ["k"], K.without(["k"]))
    K.merge(spark, path, spark.createDataFrame([], "k long"), ["k"], K.without(["k"]))
    del state[5], state[None]
    K.vacuum(spark, path)
    assert Counter((r["k"], r["v"]) for r in K.read(spark, path).collect()) == Counter(state.items())


def test_a_failed_merge_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    K.create(spark.createDataFrame([(1, 1), (2, 1)], "k long, n long"), path, ["k"], 4)

    def broken(old, new):
        return K.replacing(["k"], ["n"])(old, new).withColumn("n", F.raise_error(F.lit("no")).cast("long"))

    new = spark.createDataFrame([(1, 9)], "k long, n long")
    with pytest.raises(Exception, match="no"):
        K.merge(spark, path, new, ["k"], broken)
    assert sorted((r["k"], r["n"]) for r in K.read(spark, path).collect()) == [(1, 1), (2, 1)]
    K.merge(spark, path, new, ["k"], K.summed(["k"], n=F.sum("n")))  # over what the failure left behind
    assert sorted((r["k"], r["n"]) for r in K.read(spark, path).collect()) == [(1, 10), (2, 1)]


def test_empty_table_and_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    K.create(spark.createDataFrame([], "k long, w string"), path, ["k"], 4)
    assert K.read(spark, path).count() == 0
    for rows in ([(1, "a"), (1, "b")], [(1, "c"), (2, "d"), (2, "e")]):
        K.merge(spark, path, spark.createDataFrame(rows, "k long, w string"), ["k"], K.regrouped(["k"]))
    assert sorted((r["k"], r["w"]) for r in K.read(spark, path).collect()) == [(1, "c"), (2, "d"), (2, "e")]


def test_counters_over_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.randrange(20_000), i, rng.choice("ab")) for i in range(200))
    rows += [(30_000, 900, "a"), (200_000, 901, "a"), (200_030, 902, "a")]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    before = {k: spark.conf.get(k, None) for k in C.STATE_STORE}
    for k, v in C.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for low, high in ((0, 5_000), (5_000, 5_100), (5_100, 40_000), (40_000, 10**9)):
            part = [(k, i, s) for s, i, k in rows if low <= s < high]
            spark.createDataFrame(part, "k string, i long, s long").select("k", "i", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(src)
            stream = C.sliding_counts(spark.readStream.schema("k string, i long, ts timestamp").parquet(src), "k", "i", "ts")
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(200)
            last = q.lastProgress
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {r["i"]: (r["n_60"], r["n_3600"]) for r in spark.read.parquet(out).collect()}
    count = lambda k, s, span: sum(kk == k and s - span <= x <= s for x, _, kk in rows)
    assert got == {i: (count(k, s, 60), count(k, s, 3600)) for s, i, k in rows}
    assert last["stateOperators"][0]["numRowsTotal"] < 40  # b's seconds and a's old ones are gone
