"""Licence scan by a positional rare-token index, in DataFrame functions only.

Notices and grants of public licences are templates, indexed word by word with positions. A file's words of highest IDF (over
all files) among a template's are looked up, those of its mandatory phrase left out; their postings meet where word place minus
template place agree within a few words. Where half of them agree, four at least, the template is located, and its mandatory
phrase is verified inside the located span (files without the phrase anywhere are never looked up). A located template inside
the span of a longer one is part of that. Three base phrases are found everywhere besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import materialize

#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, words of the template, mandatory phrase. Texts are notices and grants of public licences.
TEMPLATES = [
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "with or without fee is hereby granted the software is provided"),
    ("afl", "licensed under the academic free license version 3 0", "academic free license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("artistic", "the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "source and binary forms"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "bsd style license"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "to any person or organization obtaining"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("ms-pl", "this software is licensed under the microsoft public license ms pl", "microsoft public license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "open font license"),
    ("psf", "this license agreement is between the python software foundation psf and the individual or organization", "python software foundation"),
    ("reserved", "copyright c all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
]
#: Rarest words of a template and file that are looked up; share and least number of them that must agree (all, where a template
#: has fewer besides its phrase); words that places may differ by.
LOOKED_UP, SHARE, LEAST, DRIFT = 10, 0.5, 4, 8
#: Words of one cell of places; spans that one covers lie in its cell or the next.
CELL = 256

VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ranked(df: dict[str, int]) -> list[list[str]]:
    """Of each template the words outside its phrase, highest IDF (fewest files) first, ties by word."""
    return [sorted(set(t.split()) - set(must.split()), key=lambda w: (df.get(w, 0), w)) for _, t, must in TEMPLATES]


def _plain(text: Column) -> Column:
    """The words, A-Z lowered, with one space before, between and after; one space alone for none."""
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.coalesce(F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" "))), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    Null and blank texts have no words, no places and empty labels; without base places first_word and last_word are
    null. A null doc_id is carried; repeated rows get equal answers; texts are read whole; an empty table gives no rows;
    other columns are not read. score: 1 with a base place, else the share of a located template's looked-up words that
    agree, for the best template, 0 without a label.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("h2"), _plain(F.col("text")).alias("s"))
    # files of each licence word, over all files: at most as many rows as the templates have words
    held = rows.select(F.explode(F.array_intersect(F.split("s", " "), _list(VOCABULARY))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    df = {r["w"]: r["df"] for r in held.collect()}
    rare = ranked(df)

    n_words = (_spaces(F.col("s")) - 1).alias("n_words")
    base = rows.select("doc_id", "h", "h2", "s", F.greatest(n_words, F.lit(0)).cast("long").alias("n_words"))
    places, firsts, lasts, named = [], [], [], []
    for phrase, label in BASE.items():
        there = F.contains("s", F.lit(f" {phrase} "))
        parts = F.when(there, F.split("s", f" {phrase}(?= )", -1))
        places.append(F.when(there, F.size(parts) - 1).otherwise(0))
        firsts.append(F.when(there, _spaces(F.element_at(parts, 1))))
        lasts.append(F.when(there, F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        named.append(F.when(there, F.lit(label)))
    base = base.select(
        "doc_id", "h", "h2", "n_words",
        (places[0] + places[1] + places[2]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*named)).alias("base"),
        F.array_compact(F.array(*[F.when(F.contains("s", F.lit(f" {must} ")), F.lit(t)) for t, (_, _, must) in enumerate(TEMPLATES)])).alias("open"), "s",
    )
    base = base.withColumn("s", F.when(F.size("open") > 0, F.col("s")))
    base = materialize(base, "licences")  # texts stay only where a mandatory phrase stands

    spark = docs.sparkSession
    # of fixed size: words with their places in the templates
    listed = [(w, t, i, len(words.split()), min(LEAST, len(rare[t]))) for t, (_, words, _) in enumerate(TEMPLATES) for i, w in enumerate(words.split()) if w in rare[t]]
    postings = F.broadcast(spark.createDataFrame(listed, "w string, template int, place int, n int, least int"))
    named_ = F.broadcast(spark.createDataFrame([(t, label, f" {must} ") for t, (label, _, must) in enumerate(TEMPLATES)], "template int, label string, must string"))
    words = F.split(F.trim("s"), " ")
    some = base.where("s is not null").select("doc_id", "h", "h2", "open", words.alias("words"), F.array_intersect(words, _list(VOCABULARY)).alias("known"))
    # the words looked up for each template that is open
    asked = F.array(*[F.when(F.array_contains("open", t), F.slice(F.array_intersect(_list(r), F.col("known")), 1, LOOKED_UP)) for t, r in enumerate(rare)])
    some = some.withColumn("asked", asked).withColumn("every", F.array_distinct(F.flatten(F.array_compact("asked"))))
    found = some.select("doc_id", "h", "h2", "asked", "every", F.posexplode("words").alias("at", "w")).where(F.array_contains("every", F.col("w")))
    found = found.join(postings, "w").withColumn("own", F.get("asked", F.col("template"))).where(F.array_contains("own", F.col("w")))
    # places agree within DRIFT words: two grids of cells, so that no agreement is cut by a border
    shift = F.col("at") - F.col("place")
    grids = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((shift + g) / DRIFT).alias("cell")) for g in (0, DRIFT // 2)]))
    of = F.size("own")
    met = found.select("doc_id", "h", "h2", "template", "w", "n", F.greatest("least", F.ceil(of * SHARE).cast("int")).alias("need"), of.alias("of"), shift.alias("shift"), grids.alias("g"))
    met = met.groupBy("doc_id", "h", "h2", "template", "g").agg(F.countDistinct("w").alias("agree"), F.min("shift").alias("low"), F.max(F.col("shift") + F.col("n")).alias("high"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("of").alias("of"))
    spans = met.where("agree >= need").join(named_, "template").select("doc_id", "h", "h2", "template", "label", "must", "n", F.greatest("low", F.lit(0)).alias("low"), "high", (F.col("agree") / F.col("of")).alias("share"))
    same = F.expr("x.doc_id <=> y.doc_id and x.h = y.h and x.h2 = y.h2")
    texts = some.select("doc_id", "h", "h2", "words").distinct()
    inside = F.concat(F.lit(" "), F.array_join(F.slice("words", F.col("low") + 1, F.col("high") - F.col("low")), " "), F.lit(" "))
    spans = spans.alias("x").join(texts.alias("y"), same).where(F.contains(inside, F.col("must"))).select("x.*").distinct()
    spans = materialize(spans, "spans")
    # a span that lies within a longer template's is part of that
    longer = spans.select("doc_id", "h", "h2", F.col("n").alias("n2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.array(F.floor(F.col("low") / CELL), F.floor(F.col("low") / CELL) + 1)).alias("c"))
    own = spans.withColumn("c", F.floor(F.col("low") / CELL))
    within = F.expr("x.doc_id <=> y.doc_id and x.h = y.h and x.h2 = y.h2 and x.c = y.c and x.n < y.n2 and x.low >= y.low2 and x.high <= y.high2")
    kept = own.alias("x").join(longer.alias("y"), within, "left_anti")
    met = kept.groupBy("doc_id", "h", "h2").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    out = base.drop("s", "open").alias("x").join(met.alias("y"), same, "left")
    every = F.array_sort(F.array_distinct(F.concat("x.base", F.coalesce("y.more", F.array().cast("array<string>")))))
    return out.select(
        "x.doc_id", "x.n_words", "x.n_base", "x.first_word", "x.last_word", F.array_join(F.array_sort("x.base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.when(F.col("x.n_base") > 0, 1.0).otherwise(F.least(F.coalesce("y.share", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
