"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton holds labelled text. A document is parsed greedily into the longest
phrases that the automaton knows; the language needing the fewest phrases for the bytes parsed wins. The
automata run over bytes with A-Z and Latin capitals lowered and anything but letters as one gap. All texts of a run
are cut into blocks of BLOCK bytes and all blocks step together, so that a long text is many lanes; then the phrase that
crosses into a block is followed until it meets a phrase start that the block has found by itself, so that the count is
that of the whole text's parse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm.common import slices, text_bytes

#: Bytes of text to an automaton, most bytes from one text, and labelled rows of a language considered: the bounded sample.
TRAIN_BYTES, TRAIN_CUT, TRAIN_ROWS = 40_000, 10_000, 500
#: Languages beyond which each gets fewer bytes, down to LEAST_BYTES, so that what is broadcast (about 170 bytes a byte of text: 27 MB for four languages) is bounded.
LANGUAGES, LEAST_BYTES = 64, 500
BLOCK = 256
#: Bytes a phrase below which a text is in none of the languages.
LEAST_PHRASE = 2.0


def held_out(doc_id, of: int, at: int):
    """crc32 of the id's decimal text modulo `of` equals `at`; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == at, F.lit(False))


def normal_bytes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, one gap byte (0x20) for each run of ASCII other than letters, and the new bounds of the texts."""
    out = raw.copy()
    upper = (raw >= 65) & (raw <= 90)
    out[upper] += 32
    if len(raw) > 1:
        latin = np.concatenate(([False], raw[:-1] == 0xC3)) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        out[latin] += 0x20
    gap = (out < 97) | ((out > 122) & (out < 128))
    out[gap] = 0x20
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = ~(gap[1:] & gap[:-1])
        keep[offsets[:-1][np.diff(offsets) > 0]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def suffix_automaton(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte value, transitions[state, class] with -1 for none) of all substrings of data."""
    used = sorted(set(data))
    kinds = np.full(256, len(used), np.int32)
    kinds[used] = np.arange(len(used))
    moves = np.full((2 * len(data) + 1, len(used) + 1), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    for c in kinds[np.frombuffer(data, np.uint8)].tolist():
        cur = len(link)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and moves[p, c] < 0:
            moves[p, c] = cur
            p = link[p]
        if p != -1:
            q = int(moves[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(link)
                moves[twin] = moves[q]
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p, c] == q:
                    moves[p, c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return kinds, moves[: len(link)].copy()


def phrases(raw: np.ndarray, bounds: np.ndarray, automaton: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Phrases of the greedy parse of each text; a byte that the automaton does not know is a phrase of its own."""
    kinds, table = automaton
    width, unknown = table.shape[1], len(table)  # `unknown`: after such a byte any other starts a phrase
    flat = np.concatenate((table.reshape(-1), np.full(width, -1, np.int32)))
    root = np.where(table[0] < 0, unknown, table[0]).astype(np.int32)
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = bounds[doc] + number * BLOCK
    length = np.minimum(BLOCK, bounds[doc + 1] - start)
    symbols = kinds[raw]
    begins = np.zeros(len(raw) + 1, bool)  # phrase starts of the blocks' own parses
    begins[start] = True
    # all blocks, as if a phrase began with each
    order = np.argsort(-length, kind="stable")
    at = start[order]
    lanes = np.searchsorted(-length[order], -np.arange(1, BLOCK + 1), side="right")  # blocks with more than j bytes
    state = root[symbols[at]] if len(at) else np.zeros(0, np.int32)
    for j in range(1, BLOCK):
        n = int(lanes[j])
        if not n:
            break
        c = symbols[at[:n] + j]
        to = flat[state[:n] * width + c]
        dead = np.flatnonzero(to < 0)
        if len(dead):
            begins[at[dead] + j] = True
            to[dead] = root[c[dead]]
        state[:n] = to
    last = np.empty(len(start), np.int32)
    last[order] = state
    before = np.concatenate(([0], np.cumsum(begins)))
    count = before[start + length] - before[start]
    alone = last.copy()  # how each block ends by itself: also once its parse has met the other
    # each block again with the phrase that comes into it, until both parses have a start in common
    todo = np.flatnonzero(number > 0)
    while len(todo):
        state, ended = last[todo - 1], alone[todo]
        own = np.zeros(len(todo), np.int64)
        live = np.arange(len(todo))
        for j in range(BLOCK):
            place = start[todo[live]] + j
            c = symbols[place]
            to = flat[state[live] * width + c]
            dead = to < 0
            to[dead] = root[c[dead]]
            met = dead & begins[place]
            done = live[met]
            own[done] += before[start[todo[done]] + length[todo[done]]] - before[place[met]]
            own[live[dead & ~met]] += 1
            state[live] = to
            over = ~met & (j + 1 == length[todo[live]])
            ended[live[over]] = to[over]
            live = live[~met & ~over]
            if not len(live):
                break
        count[todo] = own
        changed = todo[ended != last[todo]]
        last[todo] = ended
        # a block that no start in common has ended hands another state on
        after = changed + 1
        after = after[after < len(start)]
        todo = after[number[after] > 0]
    return np.bincount(doc, weights=count, minlength=len(sizes)).astype(np.int64)


def fit(docs: DataFrame, modulo: int = 3, out: int = 1) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """An automaton for each language, from the first TRAIN_CUT characters of labelled rows of it until TRAIN_BYTES are full.

    Rows come in the order of their id hashes, those of 200 to TRAIN_CUT bytes before shorter and longer ones; any text with
    a word can be learned from, so that a language of short texts gets an automaton too. Equal texts count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulo, out) & (F.octet_length("text") > 0))
    size = F.octet_length("text")
    keyed = rows.select("lang", "doc_id", F.xxhash64("text").alias("h"), F.least(size, F.lit(TRAIN_CUT)).alias("size"), (~size.between(200, TRAIN_CUT)).alias("odd"), F.xxhash64("doc_id").alias("o"))
    some = keyed.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("odd", "o", "doc_id", "h"))).where(F.col("n") <= TRAIN_ROWS)
    once = some.withColumn("twin", F.row_number().over(Window.partitionBy("lang", "h").orderBy("n"))).where("twin = 1")
    full = F.sum("size").over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    # about TRAIN_BYTES and one text of a language
    picked = once.withColumn("full", F.coalesce(full, F.lit(0))).where(F.col("full") < TRAIN_BYTES).select("lang", "doc_id", "h", "n")
    texts = docs.select("lang", "doc_id", F.substring("text", 1, TRAIN_CUT).alias("cut"), F.xxhash64("text").alias("h")).join(F.broadcast(picked), ["lang", "doc_id", "h"])
    table = texts.groupBy("lang", "n").agg(F.first("cut").alias("cut")).toArrow().sort_by([("lang", "ascending"), ("n", "ascending")])
    languages = table["lang"].to_pylist()
    each = max(LEAST_BYTES, TRAIN_BYTES * LANGUAGES // max(len(set(languages)), LANGUAGES))
    held: dict[str, bytes] = {}
    for lang, cut in zip(languages, table["cut"].to_pylist()):
        part = normal_bytes(*text_bytes(pa.array([cut], pa.string())))[0].tobytes()
        if part.strip() and len(held.get(lang, b"")) < each:
            held[lang] = (held[lang] + b" " + part if lang in held else part)[:each]
    return {lang: suffix_automaton(data) for lang, data in sorted(held.items())}


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))[offsets]
    other = np.concatenate(([0], np.cumsum(raw >= 128)))[offsets]
    found = np.diff(total) > 0
    for i in np.flatnonzero(~found & (np.diff(other) > 0)).tolist():
        found[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict_arrays(column: pa.Array, models: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, score from 0 to 1, bytes a phrase of the winner) of each text."""
    raw, offsets = text_bytes(column)
    letters = _has_letter(raw, offsets)
    data, bounds = normal_bytes(raw, offsets)
    sizes = np.diff(bounds)
    names = list(models)
    if not names or not len(sizes):
        return ["und"] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
    rates = np.stack([phrases(data, bounds, models[x]) for x in names]).astype(float) / np.maximum(sizes, 1)
    best = rates.argmin(axis=0)
    low = rates[best, np.arange(len(sizes))]
    others = np.where(np.arange(len(names))[:, None] == best, np.inf, rates).min(axis=0) if len(names) > 1 else np.full(len(sizes), 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.clip(1 - 0.5 * low / np.maximum(others, 1e-9), 0, 1)
    fits = np.where(low > 0, 1 / np.maximum(low, 1e-9), 0)
    return [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())], np.where(letters, score, 0.0), np.where(letters, fits, 0.0)


def identify(docs: DataFrame, models: dict | None = None, modulo: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    `und` with score 0 for a text that is null or has no letter, or where nothing could be learned. Equal rates go to the
    language first in order. Null ids are never learned from and not held out; repeated rows get equal answers; long
    texts are parsed whole; an empty table gives no rows; columns besides doc_id, text and lang are not read.
    """
    spark = docs.sparkSession
    models = fit(docs, modulo, out) if models is None else models
    sent = spark.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                names, score, _ = predict_arrays(part.column("text"), sent.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulo, out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a learned language.

    Rejected: texts without letters (und; null and empty ones among them) and texts that no automaton parses in phrases of
    LEAST_PHRASE bytes on average. Repeated rows stay or go together; where no row has a language nothing is learned and no row
    stays; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                names, _, fits = predict_arrays(part.column("text"), sent.value)
                yield part.filter(pa.array([n != "und" and f >= LEAST_PHRASE for n, f in zip(names, fits.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
