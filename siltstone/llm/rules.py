"""Quality rules: text statistics and a decision list learned from labels by sequential covering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import SPACES, shingle_hashes, slices, span_hashes, text_bytes, word_spans

#: The bounded sample of labelled rows that rules are learned from, those of the smallest id hashes.
SAMPLE_ROWS = 20_000
#: Conditions of a rule, rules of a list, thresholds tried for a statistic, least precision of a rule on the pruning rows.
CONDITIONS, RULES, THRESHOLDS, PRECISION = 4, 12, 24, 0.9

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_top"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINES = np.zeros(256, bool)
_LINES[10] = True
_UPPER, _DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?;:.,")] = True
#: Statistics that rules may test, as Spark SQL over the counts.
STATISTICS = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "top_share": "n_top / greatest(n_words, 1)",
}


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text; all 0 for a null text."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1

    def within(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])

    starts, ends, words = word_spans(raw, offsets)
    out = {"n_words": words, "word_chars": within(~SPACES[raw] & ((raw & 0xC0) != 0x80)), "n_symbols": within(_SYMBOL[raw])}
    # lines with a word, equal to an earlier one
    a, b, lines = word_spans(raw, offsets, _LINES)
    solid = np.concatenate(([0], np.cumsum(~SPACES[raw])))
    doc = np.repeat(np.arange(n), lines)
    has = solid[b] > solid[a]
    h, d = span_hashes(raw, a, b)[has], doc[has]
    order = np.lexsort((h, d))
    same = (d[order][1:] == d[order][:-1]) & (h[order][1:] == h[order][:-1])
    out["n_dup_lines"] = np.bincount(d[order][1:][same], minlength=n)
    out["n_lines"] = np.bincount(d, minlength=n)
    # words in five-word windows found twice or more
    hashes = span_hashes(raw, starts, ends)
    windows, wdoc = shingle_hashes(hashes, np.where(words >= 5, words, 0), 5) if (words >= 5).all() else _windows(hashes, words)
    first = np.cumsum(words) - words
    place = np.arange(len(wdoc)) - np.searchsorted(wdoc, wdoc) + first[wdoc]
    order = np.lexsort((windows, wdoc))
    sd, sw = wdoc[order], windows[order]
    twin = np.zeros(len(order), bool)
    if len(order) > 1:
        eq = (sd[1:] == sd[:-1]) & (sw[1:] == sw[:-1])
        twin[1:] |= eq
        twin[:-1] |= eq
    at = place[order[twin]]
    cover = np.zeros(len(hashes) + 6, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    covered = np.cumsum(cover)[: len(hashes)] > 0
    word_doc = np.repeat(np.arange(n), words)
    out["n_repeat_words"] = np.bincount(word_doc[covered], minlength=n)
    order = np.lexsort((hashes, word_doc))
    sd, sw = word_doc[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (sd[1:] != sd[:-1]) | (sw[1:] != sw[:-1])
    heads = np.flatnonzero(new)
    out["n_distinct"] = np.bincount(sd[heads], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, sd[heads], np.diff(np.append(heads, len(sd))))
    out["n_top"] = top
    out |= {"n_upper": within(_UPPER[raw]), "n_digits": within(_DIGIT[raw]), "n_marks": within(_MARK[raw])}
    return {k: np.asarray(out[k], np.int64) for k in COUNTS}


def _windows(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of five words of the texts that have five."""
    long = words >= 5
    keep = np.repeat(long, words)
    windows, doc = shingle_hashes(hashes[keep], words[long], 5)
    return windows, np.flatnonzero(long)[doc]


def statistics(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The columns `carried` and the COUNTS of column text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts = counts_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + [pa.array(counts[c]) for c in COUNTS], carried + COUNTS)

    kinds = dict(docs.dtypes)
    return docs.select(*carried, "text").mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in carried] + [f"{c} long" for c in COUNTS]))


Rule = list[tuple[str, str, float]]  # (statistic, <= or >, threshold), all of which must hold


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, value in rule:
        out &= (x[name].to_numpy() <= value) if sign == "<=" else (x[name].to_numpy() > value)
    return out


def learn(x: pd.DataFrame, bad: np.ndarray) -> list[Rule]:
    """Rules, in order, each for rows that are bad: grown by FOIL gain on two thirds of the rows, pruned on the rest."""
    prune_on = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    cuts = {c: np.unique(np.quantile(x[c], np.linspace(0, 1, THRESHOLDS))) for c in x.columns} if len(x) else {}
    columns = {c: x[c].to_numpy() for c in x.columns}
    while len(rules) < RULES:
        inside = left & ~prune_on
        rule: Rule = []
        while len(rule) < CONDITIONS:
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for c, values in cuts.items():
                v = columns[c][inside]
                b = bad[inside]
                for t in values.tolist():
                    low = v <= t
                    for sign, m in (("<=", low), (">", ~low)):
                        p, n = (m & b).sum(), (m & ~b).sum()
                        if p >= 3:
                            g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                            if g > gain:
                                best, gain = (c, sign, float(t)), g
            if best is None:
                break
            rule.append(best)
            inside &= _covers([best], x)
        if not rule:
            break

        def worth(r: Rule) -> float:
            m = _covers(r, x) & left & prune_on
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = _covers(rule, x) & left & prune_on
        if not m.any() or (m & bad).sum() < PRECISION * m.sum():
            break
        rules.append([_centred(c, columns) for c in rule])
        left &= ~_covers(rule, x)
        if not (left & bad).any():
            break
    return rules


def _centred(condition: tuple[str, str, float], columns: dict[str, np.ndarray]) -> tuple[str, str, float]:
    """The condition with its threshold midway between the two values that it parts."""
    name, sign, value = condition
    v = columns[name]
    above, below = v[v > value], v[v <= value]
    return (name, sign, float((above.min() + below.max()) / 2)) if len(above) and len(below) else condition


def rules_column(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1, or 0: one ordered conditional expression over the COUNTS."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = None
        for name, sign, value in rule:
            c = F.expr(STATISTICS[name])
            one = (c <= F.lit(value)) if sign == "<=" else (c > F.lit(value))
            test = one if test is None else test & one
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))  # SAMPLE_ROWS rows at most
    rows = statistics(docs.select("doc_id", "text").join(picked, "doc_id"), ["doc_id", "quality"])
    frame = rows.selectExpr("doc_id", "quality", *[f"{e} as {c}" for c, e in STATISTICS.items()]).toPandas()
    frame = frame.sort_values(["doc_id", *STATISTICS]).reset_index(drop=True)
    frame = frame.iloc[np.random.default_rng(7).permutation(len(frame))].reset_index(drop=True)
    return learn(frame[list(STATISTICS)].astype(float), (frame["quality"] == 0).to_numpy())


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, rule (0: none) and kept for each row of docs.

    A null text counts as without words and is not kept; a null doc_id is carried; repeated rows get equal answers; without
    labels of both kinds there is no rule and the base decides; an empty table gives no rows; other columns are not read.
    """
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.withColumn("base_failed", failed).withColumn("rule", rules_column(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
