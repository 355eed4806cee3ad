"""Places of patterns and the resolution of overlaps, against Python's own."""

import random
import re

from pyspark.sql import functions as F

from siltstone.functions.patterns import FLAGS, IDENTIFIERS, PERSONAL
from siltstone.operators import matching as M


def plain(t):
    return re.sub("[^\x00-\x7f°]", " ", t or "")


def test_places_and_resolution(spark):
    rng = random.Random(6)
    parts = ["a.b@c.org", "1.2.3.4", "https://x.org/a?b=1", "4111 1111 1111 1111", "4111111111111112", "+49 170 1234567", "123-45-6789", "word", "é", "\U0001f600", "DE12 3456 7890 1234", "host.example", "12345678", "\n", "999.1.1.1"]
    texts = [rng.choice(["", " ", ","]).join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)] + ["", None, "1.2.3.4 " * 300]
    rows = [(i % 140, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    found = M.places(df, "k", "t", PERSONAL)
    want, kept = [], []
    for k, t in rows:
        own = [(m.start(), m.end(), kind, c, m[0]) for kind, p, c in PERSONAL for m in re.finditer(p, plain(t), re.ASCII)]
        want += [(k, *m) for m in own]
        out = []
        for m in sorted(own):
            if not out or m[0] >= out[-1][1]:
                out.append(m)
            elif m[3] > out[-1][3]:
                out[-1] = m
        kept += [(k, *m) for m in out]
    columns = ["k", "start", "end", "kind", "confidence", "match"]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(want)
    assert sorted(tuple(r[c] for c in columns) for r in M.resolved(found).collect()) == sorted(kept)


def test_identifiers_and_validators(spark):
    text = "Mail a.b@protonmail.com, wallet 1BoatSLRHtKNngkdXEeobR76b53LETtpyT and 0x" + "aB" * 20 + " at 48.2, 16.37 " + "ab" * 16 + " " + "q2" * 8 + ".onion"
    got = {r["pattern"]: r["matches"] for r in M.detected(spark.createDataFrame([(1, text), (2, None)], "k long, t string"), "k", "t", IDENTIFIERS, FLAGS).collect()}
    want = {n: [m[0] for m in re.finditer(FLAGS + p, text, re.ASCII)] for _, n, p in IDENTIFIERS}
    assert got == {n: m for n, m in want.items() if m}
    assert {"email_protonmail", "bitcoin_address", "ethereum_address", "md5_hash", "onion_v2"} <= set(got)
    rows = [("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False), ("5500-0000-0000-0004", True), ("0", False)]
    df = spark.createDataFrame(rows, "d string, w boolean").select(M.digits_valid(F.col("d")).alias("g"), "w")
    assert all(r["g"] == r["w"] for r in df.collect())
