"""Scalar text, url, date and hash functions as column expressions; all but simhashes() stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def normalize_url(url: Column) -> Column:
    """Lower case, then without scheme, www., one trailing run of /, query and fragment, in that order."""
    out = F.lower(url)
    for pattern in (r"^https?://", r"^www\.", r"/+$", r"\?.*$", r"#.*$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def normalize_text(text: Column) -> Column:
    """Lower case, other than word characters and white space to spaces, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def content_hash(url: Column, title: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("|", normalize_url(url), normalize_text(title), F.substring(normalize_text(content), 1, 500)).cast("binary"))


def word_set(text: Column) -> Column:
    """Distinct lower-case words parted by white space; none for a null or blank text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of characters of `text`, which should be a plain column."""
    size = F.length(text) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def novelty(new: Column, old: Column) -> Column:
    """Share of the new set that the old one lacks."""
    return F.when(F.size(new) == 0, 0.0).otherwise(F.size(F.array_except(new, old)) / F.size(new))


def domain(url: Column, source: Column | None = None) -> Column:
    """Host of the url with its port, else the source if it has a dot, else unknown."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    other = F.lit("unknown") if source is None else F.when(F.contains(source, F.lit(".")), F.lower(source)).otherwise("unknown")
    return F.when(F.coalesce(host, F.lit("")) != "", host).otherwise(other)


def html_to_text(html: Column) -> Column:
    """Script and style bodies dropped, tags to spaces, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def syllables(word: Column) -> Column:
    """Vowel groups, one less for a final e, one at least."""
    groups = F.size(F.regexp_extract_all(F.lower(word), F.lit("[aeiouy]+"), F.lit(0)))
    return F.greatest(groups - F.when(F.lower(word).endswith("e"), 1).otherwise(0), F.lit(1))


def flesch(sentences: Column, words: Column, syllable_count: Column) -> Column:
    """Reading ease from 0 to 1; 0 without words or sentences."""
    value = (206.835 - 1.015 * (words / sentences) - 84.6 * (syllable_count / words)) / 100
    return F.when((sentences == 0) | (words == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def calibrated(score: Column) -> Column:
    return 1 / (1 + F.exp(-5 * (score - 0.5)))


def recency_decay(age_days: Column, half_life: float = 365.0, floor: float = 0.5, undated: float = 0.8) -> Column:
    return F.when(age_days.isNull(), undated).otherwise(F.greatest(F.exp(-0.693 * age_days / half_life), F.lit(floor)))


def recency_bonus(age_days: Column) -> Column:
    return F.when(age_days.isNull() | (age_days < 0), 0.0).otherwise(1.5 * F.exp(-age_days / 365))


def keyword_relevance(text: Column, keywords: list[str]) -> Column:
    """Sum over keywords i of 1/(i+1) times min(1, occurrences/5), at most 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for i, k in enumerate(keywords):
        n = (F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)
        total = total + F.least(F.lit(1.0), n / 5) / (i + 1)
    return F.least(F.lit(1.0), total)


def sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    low = F.lower(text)
    p = sum((F.contains(low, F.lit(w)).cast("int") for w in positive), F.lit(0))
    n = sum((F.contains(low, F.lit(w)).cast("int") for w in negative), F.lit(0))
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def deterministic_id(form: Column, label: Column, size: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws(":", form, label).cast("binary")), 1, size)


def salted_hash(text: Column, salt: str) -> Column:
    return F.concat(F.lit("[HASH:"), F.substring(F.sha2(F.concat(text, F.lit(salt)), 256), 1, 16), F.lit("]"))


def mask_email(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring_index(value, "@", -1))


def simhash(tokens: Column, bits: int = 64) -> Column:
    """Sign of the summed token-hash bits, as a bit string, 32 bits of md5 at a time; `tokens` should be a plain column."""
    parts = []
    for at in range(0, bits, 32):
        hashes = F.transform(tokens, _md5_word(1 + at // 4))
        signs = F.transform(
            F.sequence(F.lit(0), F.lit(min(31, bits - at - 1))),
            _bit_sum(hashes),
        )
        parts.append(F.array_join(F.transform(signs, lambda s: F.when(s > 0, "1").otherwise("0")), ""))
    return F.concat(*parts)


def simhashes(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, simhash: as simhash() of 64 bits, the bits of a batch's hashes summed at once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = part.column(1).to_pylist()
                n = np.array([len(h) // 8 for h in hashes])
                # each half is a big-endian number, its lowest bit first
                octets = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 2, 4)[:, :, ::-1].reshape(-1, 8)
                ones = np.zeros((len(n), 64), np.int64)
                if len(octets):
                    some = np.flatnonzero(n)
                    ones[some] = np.add.reduceat(np.unpackbits(octets, axis=1, bitorder="little"), (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
                text = np.where(2 * ones > n[:, None], ord("1"), ord("0")).astype(np.uint8).tobytes().decode()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text[i : i + 64] for i in range(0, len(text), 64)], pa.string())], [key, "simhash"])

    hashes = F.unhex(F.array_join(F.transform(tokens, lambda t: F.substring(F.md5(t.cast("binary")), 1, 16)), ""))
    return df.select(key, hashes.alias("h")).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, simhash string")


def _md5_word(at: int):
    return lambda t: F.conv(F.substring(F.md5(t.cast("binary")), at, 8), 16, 10).cast("long")


def _bit_sum(hashes: Column):
    return lambda b: F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.call_function("getbit", h, b) == 1, 1).otherwise(-1))
