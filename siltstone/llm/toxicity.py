"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon (whole words and stems) is learned from labelled rows. A word within the distance that its term's
length allows counts as a hit. Hits inside quotation marks or beside reporting words count for less. A logistic
model over the hits gives the score. Distances are over UTF-8 bytes with A-Z lowered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.common import distinct_in, lower_ascii, materialize, shingle_hashes, slices, span_hashes, text_bytes, word_spans
from siltstone.llm.langid import held_out

#: The bounded sample of labelled rows: most rows of either label, those of the smallest id hashes.
SAMPLE_ROWS = 3_000
#: Most lexicon terms, and the least share of toxic sample rows that hold a term.
TERMS, LEAST_SHARE = 500, 0.01
#: Bytes before and after a hit that are searched for quotation.
WINDOW = 48
QUOTED = 0.25
_MARKS = re.compile("[\"“”„«»]".encode())
_CUES = re.compile(rb"\b(said|says|quoted?|wrote|called|word|term|insult)\b")

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[97:123] = False
_SEPARATORS[65:91] = False
_SEPARATORS[48:58] = False
_SEPARATORS[[0x40, 0x24]] = False  # @ $
_SEPARATORS[128:] = False


def allowed(term: bytes) -> int:
    """Edits that a term's length allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """Terms (bytes, stem, edits) in a trie; a stem matches every word that it begins."""

    def __init__(self, terms: list[tuple[bytes, bool, int]]):
        self.terms = terms
        self.most = max((d for _, _, d in terms), default=0)
        self.root: dict = {}
        for i, (term, stem, edits) in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault(-1, []).append((i, stem, edits))
        self.lookup = lru_cache(200_000)(self._lookup)

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def _lookup(self, word: bytes) -> tuple[int, int]:
        """(least distance, its term) among terms within their edits, or (-1, -1).

        The automaton of the word runs down the trie: its state at a node is the row of edit distances.
        """
        best = (-1, -1)
        width = len(word) + 1
        stack = [(self.root, list(range(width)), 0)]
        while stack:
            node, row, depth = stack.pop()
            for i, stem, edits in node.get(-1, ()):
                d = min(row) if stem else row[-1]
                if d <= edits and (best[0] < 0 or d < best[0]):
                    best = (d, i)
            for c, below in node.items():
                if c == -1:
                    continue
                new = [depth + 1]
                for j in range(1, width):
                    new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c)))
                if min(new) <= self.most:
                    stack.append((below, new, depth + 1))
        return best

    def candidates(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which spans may match: with d edits one of d + 1 parts of a term stands whole, moved by d at most."""
        padded = np.concatenate((raw, np.zeros(16, np.uint8)))
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        eight = np.ascontiguousarray(view[starts]).view("<u8").reshape(-1) if len(starts) else np.zeros(0, np.uint64)
        sizes = ends - starts
        out = np.zeros(len(starts), bool)
        cache: dict[int, np.ndarray] = {0: eight}
        for term, stem, d in self.terms:
            fits = sizes >= len(term) - d
            if not stem:
                fits &= sizes <= len(term) + d
            at = np.flatnonzero(fits & ~out)
            if not len(at):
                continue
            cuts = [round(i * len(term) / (d + 1)) for i in range(d + 2)]
            for a, b in zip(cuts, cuts[1:]):
                piece = term[a:b][:8]
                mask = np.uint64((1 << (8 * len(piece))) - 1)
                want = np.uint64(int.from_bytes(piece, "little"))
                for o in range(max(0, a - d), a + d + 1):
                    if o not in cache:
                        cache[o] = np.ascontiguousarray(view[np.minimum(starts + o, len(raw))]).view("<u8").reshape(-1)
                    out[at] |= ((cache[o][at] & mask) == want) & (o + len(piece) <= sizes[at])
        return out


def found(column: pa.Array, lexicon: Lexicon) -> list[tuple[int, int, int, bool]]:
    """(text number, distance, term, quoted) of each hit."""
    raw, offsets = text_bytes(column)
    low = lower_ascii(raw)
    starts, ends, _ = word_spans(low, offsets, _SEPARATORS)
    out = []
    if not len(starts) or not lexicon.terms:
        return out
    words, first, inverse = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    which = np.zeros(len(words), np.int64)
    for u in np.flatnonzero(lexicon.candidates(low, starts[first], ends[first])).tolist():
        i = first[u]
        which[u] = lexicon.lookup(low[starts[i] : ends[i]].tobytes())[0] + 1
    at = np.flatnonzero(which[inverse])
    doc = np.searchsorted(offsets, starts[at], side="right") - 1
    for i, d in zip(at.tolist(), doc.tolist()):
        a, b = int(starts[i]), int(ends[i])
        distance, term = lexicon.lookup(low[a:b].tobytes())
        before = low[max(a - WINDOW, int(offsets[d])) : a].tobytes()
        after = low[b : min(b + WINDOW, int(offsets[d + 1]))].tobytes()
        quoted = (len(_MARKS.findall(before)) % 2 == 1 and _MARKS.search(after) is not None) or _CUES.search(before) is not None
        out.append((d, distance, term, quoted))
    return out


def hits(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """For each text the weight of its hits: exact and misspelled, quoted ones for QUOTED each. Shape (texts, 2)."""
    out = np.zeros((len(column), 2))
    for d, distance, _, quoted in found(column, lexicon):
        out[d, 0 if distance == 0 else 1] += QUOTED if quoted else 1.0
    return out


def _seen_terms(lexicon: Lexicon):
    """Number and least distance of each term that a clean text misspells, once for each text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                clean = part.filter(pa.compute.equal(part.column("toxic"), 0))
                seen: dict[tuple[int, int], int] = {}
                for d, distance, term, _ in found(clean.column("text"), lexicon):
                    if distance:
                        seen[d, term] = min(distance, seen.get((d, term), distance))
                yield pa.RecordBatch.from_arrays([pa.array([t for _, t in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["term", "distance"])

    return run


def calibrated(terms: list[tuple[bytes, bool]], sample: DataFrame, n_clean: int) -> Lexicon:
    """The lexicon with each term's edits lowered until its misspellings are rare in clean sample texts; one pass counts each distance."""
    edits = [allowed(t) for t, _ in terms]
    widest = Lexicon([(t, s, d) for (t, s), d in zip(terms, edits)])
    seen = sample.mapInArrow(_seen_terms(widest), "term long, distance long").groupBy("term", "distance").count().collect()  # 2 * TERMS rows at most
    counts = {(r["term"], r["distance"]): r["count"] for r in seen}
    for i, d in enumerate(edits):
        while d and sum(counts.get((i, x), 0) for x in range(1, d + 1)) > max(1, 0.001 * n_clean):
            d -= 1
        edits[i] = d
    return Lexicon([(t, s, d) for (t, s), d in zip(terms, edits)])


def _hit_rows(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = hits(part.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), part.column("toxic")], ["exact", "near", "toxic"])

    return run


def _terms(batches):
    """Label and term for the distinct terms of each sample text: words whole, and stems of 4 to 8 letters (with a *)."""
    for batch in batches:
        for part in slices(batch, "text"):
            counted: dict[str, list[int]] = {}
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                found = set(re.findall(r"[^\W\d_]{3,}", (text or "").lower()))
                found |= {w[:n] + "*" for w in found for n in range(4, 9) if len(w) >= n}
                for t in found:
                    counted.setdefault(t, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array([c[0] for c in counted.values()], pa.int64()), pa.array([c[1] for c in counted.values()], pa.int64())], ["term", "clean", "toxic"])


def _marks(batches):
    """doc_id with one hash of the text's shingles: the smallest, alike for most near copies."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = text_bytes(part.column("text"))
            low = lower_ascii(raw)
            starts, ends, words = word_spans(low, offsets)
            docs, hashes = distinct_in(*shingle_hashes(span_hashes(low, starts, ends), words, 5)[::-1])
            first = np.searchsorted(docs, np.arange(len(words)))
            mark = np.zeros(len(words), np.int64)
            has = words > 0
            mark[has] = hashes[np.minimum(first[has], max(len(hashes) - 1, 0))].view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("toxic"), pa.array(mark)], ["doc_id", "text", "toxic", "mark"])


def evidence(toxic: int, clean: int, share: float) -> float:
    """Minus the logarithm of the chance (its bound) that so many of a term's rows are toxic by themselves, where `share` of all are."""
    p = toxic / (toxic + clean)
    if p <= share:
        return 0.0
    return (toxic + clean) * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def choose_terms(rows: list[tuple[str, int, int]], n_clean: int, n_toxic: int) -> list[tuple[bytes, bool]]:
    """Terms that mark toxic rows: frequent there, rare in clean ones; of stems and words with one count the longest, and none that a chosen stem covers."""
    good = {}
    for term, clean, toxic in rows:
        a, b = toxic / max(n_toxic, 1), (clean + 0.5) / max(n_clean, 1)
        if toxic >= max(4, LEAST_SHARE * n_toxic) and a > 20 * b:
            good[term] = toxic
    kept: dict[str, int] = {}
    # longest first: a stem goes if one longer term has nearly all of its rows
    for term in sorted(good, key=lambda t: (-len(t.rstrip("*")), t.endswith("*"), t)):
        body = term.rstrip("*")
        if not any(x.startswith(body) and n >= 0.97 * good[term] for x, n in kept.items()):
            kept[term] = good[term]
    out = []
    for term in sorted(kept, key=lambda t: (len(t.rstrip("*")), t)):
        body = term.rstrip("*")
        if not any(stem and body.startswith(x) for x, stem in out):
            out.append((body, term.endswith("*")))
    out.sort(key=lambda x: -kept[x[0] + "*" * x[1]])
    return [(b.encode(), s) for b, s in out[:TERMS]]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a balanced ridge logistic regression by Newton steps; the first is the intercept."""
    x = np.column_stack((np.ones(len(x)), x))
    n1 = max(y.sum(), 1)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / max(len(y) - n1, 1)) * len(y)
    w = np.zeros(x.shape[1])
    pull = ridge * len(y) * np.array([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - pull * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return w


def _strength(x: np.ndarray) -> np.ndarray:
    """From 0 for no hit to 1 for many; the first unquoted hit is most of it."""
    return 1 - np.exp(-x)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, column: pa.Array) -> np.ndarray:
        z = _strength(hits(column, self.lexicon)) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, modulo: int = 5, out: int = 0) -> Model:
    """A lexicon and weights from at most SAMPLE_ROWS labelled rows of either label that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), modulo, out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    take = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for t in (0, 1)]
    picked = F.broadcast(take[0].union(take[1]))  # 2 * SAMPLE_ROWS rows at most
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(picked, "doc_id")
    # one row for each group of near copies, that of the smallest id hash, so that a copied text's words are not taken for terms
    order = F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    marked = sample.mapInArrow(_marks, "doc_id long, text string, toxic int, mark long").groupBy("mark", "toxic").agg(F.min_by("text", order).alias("text"))
    # the sample is written once; its texts stay off the driver
    frame = materialize(marked.select("text", "toxic").repartition(8), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in frame.groupBy("toxic").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_toxic or not n_clean:
        return Model(Lexicon([]), np.array([-3.0, 0.0, 0.0]))
    terms = frame.mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    terms = materialize(terms, "toxic-terms")
    rows = terms.where(F.col("toxic") >= max(4, LEAST_SHARE * n_toxic)).where(F.col("toxic") / n_toxic > 20 * (F.col("clean") + 0.5) / n_clean).orderBy("term").collect()
    least = np.log(max(terms.count(), 1))
    rows = [r for r in rows if evidence(r.toxic, r.clean, n_toxic / (n_toxic + n_clean)) > least]
    lexicon = calibrated(choose_terms([(r.term, r.clean, r.toxic) for r in rows], n_clean, n_toxic), frame, n_clean)
    if not lexicon.terms:
        return Model(lexicon, np.array([-3.0, 0.0, 0.0]))
    x = frame.mapInArrow(_hit_rows(lexicon), "exact double, near double, toxic int").groupBy("exact", "near", "toxic").count().toPandas().sort_values(["toxic", "exact", "near"])  # a row for each kind of sample row
    x = x.loc[x.index.repeat(x["count"])]
    weights = _logistic(_strength(x[["exact", "near"]].to_numpy()), x["toxic"].to_numpy(float))
    # a misspelling that calibration left in is nearly as telling as the term itself
    weights[2] = max(weights[2], 0.9 * weights[1])
    return Model(lexicon, weights)


def score(docs: DataFrame, labels: DataFrame, modulo: int = 5, out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts get the score of a text without hits. Without labels of both kinds, or where they are too few to
    learn a term from, every score is below 0.5. A
    null id is not held out and not learned from; repeated rows get equal scores; of several labels of one id the
    highest counts; long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulo, out))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = sent.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulo, out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below 0.5.

    Null and empty texts have no hits and stay; repeated rows stay or go together; without labels that a term can be learned
    from all rows stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(sent.value.score(part.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
