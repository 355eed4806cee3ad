"""Operators against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import components, decontaminate, langid, licenses, merkle, ngram_join, queries, rules, toxicity
from siltstone.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, h long, label int, shard int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, langs[n] if langs else None, "s", 1, "k", 2, 3, 4) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def near_copies(seed, base_words=60, groups=6, copies=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(25)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(base_words)]
        if rng.random() < 0.5:
            base[10:35] = passage
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    return texts


def brute_components(texts, k=4, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


ODD = [None, "", "  \n", "One", "one", "a b c", "A  B\tC", "x " * 5000, "the same four words", "the same four words"]


@pytest.mark.parametrize("seed,rows", [(1, 100_000), (2, 60)])
def test_ngram_join_is_exact(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    texts = near_copies(seed) + ODD
    got = {r.doc_id: r for r in ngram_join.similar_components(frame(spark, texts)).collect()}
    sizes, roots = brute_components(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots


def test_ngram_join_of_salted_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALTED", 2)
    texts = []
    for g in range(24):
        passage = " ".join(f"p{g}x{i}" for i in range(40))
        # the passage is frequent, but is in the short lists of the two short texts only
        texts += [f"{passage} {' '.join(f'u{g}x{c}x{i}' for i in range(300))}" for c in range(4)]
        texts += [f"{passage} left{g}", f"{passage} right{g}"]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(frame(spark, texts)).collect()}
    _, roots = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == roots


def test_keep_one(spark):
    texts = near_copies(3, groups=2) + ODD
    docs = frame(spark, texts)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    sizes, roots = brute_components(texts)
    want = sorted({r for r, s in zip(roots, sizes) if s} | {i for i, s in enumerate(sizes) if not s})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_components(spark):
    edges = [(9, 4), (4, 2), (2, 7), (30, 31), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in (9, 4, 2, 7)} == {2} and got[31] == 30 and got[140] == 100 and 5 not in got


@pytest.mark.parametrize("f", [
    lambda d: ngram_join.similar_components(d), lambda d: langid.identify(d), lambda d: licenses.scan(d), lambda d: rules.apply_rules(d, []),
    lambda d: decontaminate.find(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: toxicity.score(d, d.select("doc_id", F.lit(1).alias("toxic"))),
    lambda d: merkle.audit(d, d, "doc_id", ["text"]), lambda d: langid.keep_known(d), lambda d: toxicity.keep_clean(d, d.select("doc_id", F.lit(1).alias("toxic"))),
])
def test_empty_tables(spark, f):
    assert f(frame(spark, [])).count() == 0


def test_merkle(spark):
    a = [(i, f"t{i}") for i in range(3000)] + [(None, "n"), (5, "twin"), (7, None)]
    b = [(i, f"t{i}") for i in range(3000) if i not in (17, 900)] + [(None, "m"), (5, "twin"), (7, ""), (4000, "new")]
    b = [(i, "T40" if i == 40 else t) for i, t in b]
    x, y = (spark.createDataFrame(r, "k long, t string") for r in (a, b))
    got = {(r.key, r.status) for r in merkle.audit(x, y, "k", ["t"]).collect()}
    assert got == {(17, "missing"), (900, "missing"), (None, "corrupt"), (7, "corrupt"), (4000, "extra"), (40, "corrupt")}
    assert merkle.audit(x, x, "k", ["t"]).count() == 0


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_licenses_base(spark):
    texts = ["CC BY cc-by, cc by", None, "", "...", "This work is licensed under the GNU General Public License, version 3.", "All rights\nReserved. x All Rights Reserved", "generalpublic license", "ccby cc  by é cc by",
             "Licensed under the Apache License, Version 2.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "cc by " * 3000, "rights all reserved license"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), t
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "apache-2.0" in got[8].labels and "mit" in got[9].labels and got[11].labels == ""


def brute_licences(texts):
    """Labels and score of each text: all places of all templates' rare words, cell by cell."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for t in texts]
    df = Counter(w for ws in split for w in set(ws))
    out = []
    for ws in split:
        base, spans = {lab for p, lab in PHRASES.items() if f" {p} " in f" {' '.join(ws)} "}, set()
        for t, (label, words, must) in enumerate(licenses.TEMPLATES):
            if f" {must} " not in f" {' '.join(ws)} ":
                continue
            tw = words.split()
            others = sorted(set(tw) - set(must.split()), key=lambda w: (df[w], w))
            asked = [w for w in others if w in ws][: licenses.LOOKED_UP]
            need = max(min(4, len(others)), -(-len(asked) // 2))
            for grid in (0, licenses.DRIFT // 2):
                cells = defaultdict(list)
                for at, w in enumerate(ws):
                    if w in asked:
                        for i, x in enumerate(tw):
                            if x == w:
                                cells[(at - i + grid) // licenses.DRIFT].append((w, at - i))
                for met in cells.values():
                    agree = len({w for w, _ in met})
                    low, high = max(min(s for _, s in met), 0), max(s for _, s in met) + len(tw)
                    if agree >= need and f" {must} " in f" {' '.join(ws[low:high])} ":
                        spans.add((t, label, len(tw), low, high, agree / len(asked)))
        kept = [s for s in spans if not any(o[2] > s[2] and o[3] <= s[3] and o[4] >= s[4] for o in spans)]
        out.append((",".join(sorted(base | {s[1] for s in kept})), 1.0 if base else max((s[5] for s in kept), default=0.0)))
    return out


def test_licences_against_all_places(spark):
    rng = random.Random(11)
    fill = ["alpha", "beta", "the", "of", "license", "software", "and", "is", "hereby", "source", "version", "2", "0", "public", "under"]
    texts = ["The prize is hereby granted to Anna.", "We do not use the Apache License here, nor source and binary forms.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "mit license", None, "",
             "\u212aernel licensed under the MIT LICENSE\u0130", "licensed under\n\n * the Apache\n * License, Version 2.0 and released under the MIT license"]
    for _, words, _ in licenses.TEMPLATES:
        for edits in (0, 1, 2, 5):
            w = words.split()
            for _ in range(edits):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [rng.choice(fill)] * rng.randrange(3)
            around = [[rng.choice(fill) for _ in range(rng.randrange(60))] for _ in range(2)]
            texts.append("\n".join(" ".join(part) for part in (around[0], w, around[1])))
        texts.append(f"{words}. {rng.choice(licenses.TEMPLATES)[1]}")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(frame(spark, texts)).collect()}
    want = brute_licences(texts)
    assert {i: g for i, g in got.items() if g != (want[i][0], round(want[i][1], 9))} == {}
    assert [got[i][0] for i in range(4)] == ["", "", "apache-2.0", "mit"] and got[8][0] == "apache-2.0,mit"
    full = {label: i for i, (label, _, _) in enumerate(licenses.TEMPLATES)}
    for label in ("mit", "isc", "0bsd", "zlib", "bsd"):
        assert got[9 + 5 * full[label]][0] == label  # the whole template is itself and none of its parts


def test_licence_words_in_many_files(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License"] * 60 + ["plain words"] * 120
    # more licence words than are looked up for one template, and rarer ones
    texts.append("affero redistribution noncommercial eclipse mozilla lesser artistic unencumbered attribution universal dedication " + texts[0])
    texts += [f"the license of the apache under version {i}" for i in range(60)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == ("apache-2.0" if "Apache License" in t else "mit" if "MIT License" in t else ""), t
        assert (got[i][1] > 0) == (got[i][0] != "")
    alone = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, texts[:2])).collect()}
    assert alone[0] == got[0]


def test_rule_counts_and_learning(spark):
    texts = [r.text for r in table(spark, SF, "documents").select("text").collect()] + ODD + ["x\nx\n\n\nx", "a b c d e a b c d e", "\x0b\n \n", "é é\ré #*"]
    got = {r.doc_id: r for r in rules.apply_rules(frame(spark, texts), []).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), failed, not failed)
    rng = random.Random(5)
    x = pd.DataFrame({"a": [rng.random() for _ in range(900)], "b": [rng.random() for _ in range(900)]})
    bad = ((x.a > 0.7) & (x.b <= 0.4)).to_numpy()
    found = rules.learn(x, bad)
    hit = pd.concat([pd.Series(rules._covers(r, x)) for r in found], axis=1).any(axis=1)
    assert (hit == bad).mean() > 0.97


def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "lang").join(langid.identify(docs), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    odd = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, [None, "", "123 ...", "the the the"], langs=[None, "en", None, None]), langid.fit(docs)).collect()}
    assert [odd[i] for i in range(3)] == ["und"] * 3 and odd[3] != "und"


@pytest.mark.parametrize("block", [3, 16, 256])
def test_suffix_automaton_phrases(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        data = bytes(rng.choice(b"abcd ") for _ in range(rng.choice([5, 50, 600])))
        texts = [bytes(rng.choice(b"abcd x") for _ in range(rng.choice([0, 1, 7, 300, 900]))) for _ in range(4)]
        texts.append((data * 4)[rng.randrange(5) :] + texts[0])
        want = []
        for text in texts:
            n, i = 0, 0
            while i < len(text):
                j = i
                while j < len(text) and text[i : j + 1] in data:
                    j += 1
                i = max(j, i + 1)
                n += 1
            want.append(n)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        assert langid.phrases(np.frombuffer(b"".join(texts), np.uint8), bounds, langid.suffix_automaton(data)).tolist() == want


def test_models_do_not_depend_on_partitions(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    a, b = (langid.fit(docs.repartition(n)) for n in (1, 7))
    assert a.keys() == b.keys() and all((a[k][1] == b[k][1]).all() for k in a)
    a, b = (toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 7))
    assert a.lexicon.terms == b.lexicon.terms and (a.weights == b.weights).all()
    assert rules.fit(docs.repartition(1), labels) == rules.fit(docs.repartition(7), labels)


def test_language_of_short_texts(spark):
    rng = random.Random(4)
    en = "the and of with that this from they have been would there their which about could other".split()
    fr = "les des est pas que pour dans sur avec plus tout nous vous elle cette leur aussi".split()
    texts = [" ".join(rng.choice(fr) for _ in range(5)) for _ in range(60)] + [" ".join(rng.choice(en) for _ in range(80)) for _ in range(60)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, texts, langs=["fr"] * 60 + ["en"] * 60)).collect()}
    assert sum(got[i] == ("fr" if i < 60 else "en") for i in range(120)) >= 117
    many = [f"text of language number {i} and more" for i in range(200)]
    assert len(langid.fit(frame(spark, many, ids=[3 * i for i in range(200)], langs=[f"l{i % 100}" for i in range(200)]))) > 64


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_hashes_of_swapped_words(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    row = rules.apply_rules(frame(spark, [f"{a}\n{b}\n{a}"]), []).collect()[0]
    assert row.n_dup_lines == 1
    got = [r.component_id for r in ngram_join.similar_components(frame(spark, [a, b, a])).orderBy("doc_id").collect()]
    assert got == [0, 1, 0]


def test_twin_prints_are_told_apart():
    import numpy as np

    u = lambda *x: np.array(x, np.uint64)
    assert ngram_join._named(u(1, 1, 2), u(5, 6, 7), u(1)).tolist() == [1 ^ 5, 1 ^ 6, 2]
    assert ngram_join._named(u(1, 1, 2), u(5, 6, 7), u()).tolist() == [1, 1, 2]


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 2_000)
    texts = near_copies(21, base_words=120, groups=2, copies=300)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(frame(spark, texts)).collect()}
    _, roots = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == roots


def test_divide_skip():
    rng = random.Random(8)
    for _ in range(300):
        parts = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))]
        least = rng.randrange(1, 6)
        counts = Counter(x for p in parts for x in p)
        assert {x: n for x, n in ngram_join._divide_skip(list(parts), least).items() if n >= least} == {x: n for x, n in counts.items() if n >= least}


def test_keep_one_without_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    near = base.replace("w40", "other")
    docs = frame(spark, [base, near, "a text of its own kind here", near, "quite something else again today"], ids=[None, 5, None, None, 5])
    kept = sorted((r.doc_id is None, r.text) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted([(False, near), (True, "a text of its own kind here"), (False, "quite something else again today")])


def test_models_without_both_labels(spark):
    docs = frame(spark, ["some words of a text that is long enough for all of it", "other words"])
    for value in (0, 1):
        labels = spark.createDataFrame([(0, value, value), (1, value, value)], "doc_id long, toxic int, quality int")
        assert [r.predicted for r in toxicity.score(docs, labels).collect()] == [0, 0]
        assert rules.fit(docs, labels) == [] or value == 0
    assert decontaminate.find(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    one = merkle.audit(docs, docs.limit(0), "doc_id", ["text"]).collect()
    assert {r.status for r in one} == {"missing"} and len(one) == 2


def test_decontamination_with_clashing_names(spark):
    docs = frame(spark, ["one two three four five six seven eight", "clean"]).withColumnRenamed("source", "i").withColumn("__id", F.lit(1))
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    precision, recall = hits / max(sum(r.predicted for r in got), 1), hits / max(sum(r.toxic for r in got), 1)
    print(f"precision {precision:.2f}, recall {recall:.2f}")
    assert recall >= 0.85 and precision >= 0.7


def test_toxicity(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sop", "vil") for c in ("da", "ne", "po")]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["grumbold", "snarkel"])
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = ["you grumbold", "you grumbald", "ka lo", "", None, 'he said "grumbold" was said']
    docs = frame(spark, texts + probe)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in got.items())
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    assert [got[400 + i].predicted for i in range(6)] == [1, 1, 0, 0, 0, 0]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_levenshtein_lookup_is_exact():
    terms = [(b"idiot", False, 1), (b"pathetic", False, 2), (b"lowe", True, 0), (b"lostra", True, 1)]
    lex = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row

    rng = random.Random(2)
    for _ in range(400):
        t = bytearray(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = bytes(rng.choices(b"abiot", k=rng.randrange(2)))
        word = bytes(t)
        want = [min(row) if stem else row[-1] for term, stem, _ in terms for row in [distance(term, word)]]
        ok = [d for d, (_, _, edits) in zip(want, terms) if d <= edits]
        assert lex.lookup(word)[0] == (min(ok) if ok else -1), word


def test_decontamination(spark):
    item = "A train leaves Paris at 30 km per hour and Alice walks 12 m while the quiet old baker counts seven loaves of fresh bread"
    other = item.replace("30", "45").replace("Paris", "Berlin").replace("12", "7").replace("Alice", "Bob")
    mixed = "he said to Carl and Dora that the quiet old baker counts seven loaves"
    texts = ["intro words here\n" + item + "\nand more", item.upper(), other, mixed, None, "", "short", ("filler text " * 3000) + item]
    items = spark.createDataFrame([(1, item, 0), (2, "too short", 0), (3, None, 0)], "item_id long, text string, h int")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.find(docs, items).collect()}
    assert got == {(0, 1): "plain", (1, 1): "plain", (2, 1): "template", (7, 1): "plain"}
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_decontamination_of_repeated_items(spark):
    item = "A train leaves Paris at 30 km per hour and Alice walks 12 m while the quiet old baker counts seven loaves of fresh bread"
    variant = lambda *v: item.replace("30", v[0]).replace("Paris", v[1]).replace("12", v[2]).replace("Alice", v[3])
    one, two = variant("45", "Berlin", "7", "Bob"), variant("80", "Rome", "9", "Eve")
    added = two.replace("while the quiet", "while just then the quiet")
    double = "the first box holds 5 red apples and the second box holds 5 green pears today"
    texts = [
        f"{one}. {two}.",
        f"{one} {two} {variant('1', 'Oslo', '2', 'Tom')}",
        one + " filler words" * 300 + " and so Maria at 99 km per hour and Zoe walks 4 m while the others rest",
        f"{one} {added}",
        double.replace("5 red", "6 red").replace("5 green", "7 green"),
        " ".join(double.replace("5 red", f"{n} red").replace("5 green", f"{n + 1} green") for n in (6, 16)),
        " ".join(double.replace("5", n) for n in ("6", "16")),
    ]
    items = spark.createDataFrame([(1, item), (2, double)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.find(frame(spark, texts), items).collect()}
    assert got == {(0, 1): "template", (1, 1): "template", (2, 1): "template", (3, 1): "template", (6, 2): "template"}


def test_decontamination_against_brute_force(spark):
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    index = defaultdict(set)
    sizes = {}
    for r in bench.collect():
        sizes[r.item_id] = len(grams(r.text))
        for g in grams(r.text):
            index[g].add(r.item_id)
    want = set()
    for r in docs.select("doc_id", "text").collect():
        n = Counter(i for g in grams(r.text) for i in index.get(g, ()))
        want |= {(r.doc_id, i) for i, c in n.items() if c >= 0.8 * sizes[i]}
    assert want and got == want


def test_pipeline_near_copies(spark):
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(words), " ".join([*words[:25], "other", *words[26:]]), "quite another text of its own"] + near_copies(5, groups=3)
    _, roots = brute_components(texts, 5, 80)
    assert roots[1] == 0 and brute_components(texts)[1][1] == 1
    kept = P.drop_near_copies(spark, frame(spark, texts), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def pipeline_tables(spark, folder, documents):
    documents.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_against_its_stages(spark, tmp_path):
    """Each stage's decision by brute force, over documents that tell 5 words and 80 % from 4 words and 85 %."""
    import corpus_pipeline as P

    docs = table(spark, SF, "documents")
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    copies = [" ".join(words), " ".join([*words[:25], "other", *words[26:]]), " ".join([*words[:20], "more", *words[21:40], "kinds", *words[41:]])]
    extra = [(10_000 + i, t, "en", "s", len(t or "")) for i, t in enumerate([*copies, "12 34 !!", "", None, *near_copies(9, groups=4)])]
    whole = docs.union(spark.createDataFrame(extra, docs.schema))
    folder = pipeline_tables(spark, tmp_path / "t", whole)
    texts = {r.doc_id: r.text for r in whole.collect()}
    toxic = {r.doc_id for r in queries.op9_toxicity(spark, folder).collect() if r.predicted}
    assert not toxic  # too few labels here to learn a term from: nothing may go
    known = sorted(i for i, t in texts.items() if i not in toxic and re.search(r"[^\W\d_]", t or ""))
    assert not {10_003, 10_004, 10_005} & set(known) and {10_000, 10_001} <= set(known)
    _, roots = brute_components([texts[i] for i in known], 5, 80)
    _, other = brute_components([texts[i] for i in known])
    assert roots != other
    firsts = {known[r] for r in roots}
    leaks = {r.doc_id for r in queries.op3_decontaminate(spark, folder).collect()}
    out = P.run(spark, folder).collect()
    assert {r.doc_id for r in out} == firsts - leaks
    # the packed pieces are the documents' ids whole, in sequences of 4,096 at most, as few as their sum allows but for a few
    lengths, filled = defaultdict(int), defaultdict(list)
    for r in out:
        lengths[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    alone = {r.doc_id: r.n_tokens for r in queries.op4_token_files(spark, folder).collect()}
    assert dict(lengths) == {i: alone[i] for i in firsts - leaks}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= -(-sum(lengths.values()) // 4096) + 3


def test_pipeline_over_nothing(spark, tmp_path):
    import corpus_pipeline as P

    docs = table(spark, SF, "documents")
    assert P.run(spark, pipeline_tables(spark, tmp_path / "t", docs.limit(0))).count() == 0
    assert decontaminate.keep_clean(docs, table(spark, SF, "benchmark").limit(0)).count() == docs.count()
