"""Structural chunks: exact cover, sizes, kinds and parents against a plain walk over the lines."""

import random
import re

from siltstone.operators import structure as S


def kind(line):
    for name, p in S.KINDS:
        if re.search(p.replace("$", r"\Z"), line):
            return name
    return "prose"


def test_segments_and_chunks(spark):
    rng = random.Random(4)
    parts = ["# Title", "SOME HEADING", "Note:", "- item", "12. item", "> quoted", "[3] Source", "", "  ", "Plain words " * 9, "word " * 300, "x" * 1500, "It is so. Is it? It must be.", "\tTab é \U0001f600 end"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "\n\n", "one", "#\n" * 400, "a b c " * 2000]
    rows = [(i % 63, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, t string")
    by = {}
    for r in S.segments(df, "k", "t").collect():
        by.setdefault((r["k"], r["row"]), []).append((r["segment"], r["kind"], r["first_line"], r["text"]))
    want = []
    for k, t in rows:
        if t:
            out = []
            for i, line in enumerate(t.split("\n")):
                if out and out[-1][0] == kind(line) != "heading":
                    out[-1][2].append(line)
                else:
                    out.append((kind(line), i, [line]))
            want.append((k, [(n, a, i, "\n".join(x)) for n, (a, i, x) in enumerate(out)]))
    assert sorted((k, sorted(v)) for (k, _), v in by.items()) == sorted(want)
    made = {}
    for r in S.chunks(df, "k", "t").collect():
        made.setdefault((r["k"], r["row"]), []).append(r)
    covered = []
    for (k, _), own in made.items():
        own.sort(key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["size"] == len(r["text"]) > 0
            at += r["size"]
            assert r["size"] < 2 * max(S.sizes())
            assert (r["kind"] == "heading") <= (r["parent"] == r["chunk_index"])
            assert r["parent"] is None or (r["parent"] <= r["chunk_index"] and kind(own[r["parent"]]["text"].split("\n")[0]) == "heading")
        covered.append((k, "".join(r["text"] for r in own)))
    assert sorted(covered) == sorted((k, t) for k, t in rows if t)
