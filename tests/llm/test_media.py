"""Lossless WebP: round trips of every transform and code, and texts through the media column."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from siltstone.llm import media, queries, webp
from siltstone.llm.common import table

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)


def pictures():
    grad = (np.add.outer(np.arange(40), np.arange(50)) * 3 & 255).astype(np.uint32)
    smooth = (0xFF000000 | grad << 16 | (grad // 2) << 8 | (255 - grad)).astype(np.uint32)
    noise = RNG.integers(0, 2**32, (37, 29), dtype=np.uint32)
    return {"smooth": smooth, "noise": noise, "row": smooth[:1], "column": noise[:, :1], "pixel": noise[:1, :1]}


def blocks(px, size, high):
    h, w = px.shape
    return RNG.integers(0, high, (-(-h >> size) * 1, -(-w >> size) * 1)).astype(np.uint32)


def round_trip(px, *args, **named):
    file = webp.encode(px, *args, **named)
    assert file[:4] == b"RIFF" and len(file) % 2 == 0
    one = webp.decode_batch(webp.chunks(file))
    many = webp.decode_batch(webp.chunks(file) * (webp.FEW + 1))  # in step
    assert all(got.shape == px.shape and (got == px).all() for got in one + many)
    return len(file)


@pytest.mark.parametrize("name", ["smooth", "noise", "row", "column", "pixel"])
def test_transforms(name):
    px = pictures()[name]
    round_trip(px)
    round_trip(px, cache=5)
    round_trip(px, [(webp.GREEN,)])
    for mode in range(14):
        round_trip(px, [(webp.PREDICTOR, 9, np.full((1, 1), webp.BLACK | mode << 8, np.uint32))], cache=3)
    mixed = webp.BLACK | blocks(px, 2, 14) << 8
    round_trip(px, [(webp.PREDICTOR, 2, mixed.astype(np.uint32))])
    shifts = (webp.BLACK | blocks(px, 3, 1 << 24)).astype(np.uint32)
    round_trip(px, [(webp.CROSS, 3, shifts), (webp.GREEN,), (webp.PREDICTOR, 9, np.full((1, 1), webp.BLACK | 11 << 8, np.uint32))])
    round_trip(px, blocks=(3, blocks(px, 3, 3)))


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    pal = RNG.integers(0, 2**32, colours, dtype=np.uint32)
    px = pal[RNG.integers(0, colours, (20, 33))]
    round_trip(px, [(webp.PALETTE,)], cache=4)
    if colours > 2:  # a predictor over the packed numbers
        modes = np.full((1, 1), webp.BLACK | 1 << 8, np.uint32)
        round_trip(px, [(webp.PALETTE,), (webp.PREDICTOR, 9, modes)])


def test_copies_and_long_runs():
    px = np.full((100, 100), 0xFF010203, np.uint32)
    assert round_trip(px) < 80
    rows = RNG.integers(0, 2**32, (5, 64), dtype=np.uint32)
    assert round_trip(np.tile(rows, (20, 1))) < 5 * 64 * 4 * 2
    assert webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and len(webp.NEAR) == 120


def test_short_distance_codes_and_broken_files():
    # one literal, then a copy by the distance code of the pixel before
    out = webp.lead(9, 1)
    out.put(0, 1)
    lengths = np.zeros(280, np.int64)
    lengths[[7, 256 + 7]] = 1
    out.put(0, 2)
    webp.put_code(out, lengths)
    for s in (1, 2, 255):
        one = np.zeros(256, np.int64)
        one[s] = 1
        webp.put_code(out, one)
    two = np.zeros(40, np.int64)
    two[[1, 0]] = 1
    webp.put_code(out, two)
    out.put(0, 1)  # literal
    out.put(1, 1)  # copy: prefix 7 has 2 extra bits, 13 to 16
    out.put(0, 2)
    out.put(1, 1)  # distance code 2: one pixel to the left
    data = out.value.to_bytes((out.n + 7) // 8, "little")
    assert webp.decode_batch([data])[0].tolist() == [[0xFF010702] * 9]
    for bad in (b"GIF89a", b"RIFF\x04\0\0\0WEBP", webp.wrap(data)[:30]):
        with pytest.raises(ValueError):
            webp.chunks(bad)
    with pytest.raises(ValueError):
        webp.decode_batch([data[:8]])


def test_code_lengths_are_complete_and_bounded():
    rng = random.Random(4)
    for _ in range(40):
        w = [rng.choice([0, 1, 1, 2**i]) for i in range(rng.choice([2, 3, 30, 40]))]
        n = webp.code_lengths(np.array(w), 12)
        used = n[n > 0]
        assert (n > 0).sum() == sum(x > 0 for x in w)
        assert len(used) < 2 or (used.max() <= 12 and sum(2.0**-k for k in used.tolist()) == 1)


TEXTS = ["", None, "a", "ab " * 300, "é" * 96, "x" * 191, "x" * 192, "x" * 193, "The quick brown fox.\n" * 80, "".join(chr(33 + i * 7 % 90) for i in range(5000)), "Ünïcödé \U0001f600 " * 9, ""]


def expected(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_media_column(spark):
    rng = random.Random(8)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma", "7", "\n"]) + str(rng.randrange(99)) for _ in range(rng.randrange(900))) for _ in range(120)]
    rows = [(i if i else None, t, "m", 5) for i, t in enumerate(texts)] + [(3, TEXTS[3], "m", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int").repartition(3)
    got = media.digests(media.with_media(docs)).collect()
    assert sorted((r["doc_id"] or 0, *r[1:5]) for r in got) == sorted((r[0] or 0, *expected(r[1])) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())  # equal texts, equal values, whatever stands beside them


def test_every_form_occurs():
    forms = {media.DEALT[zlib.crc32(media.payload_of((t or "").encode())) % 4] for t in TEXTS}
    assert forms == {media.PLAIN, media.PREDICTED, media.CROSSED}
    assert len(webp.read_header(webp.chunks(media.images_of([media.payload_of(b"")])[0])[0]).transforms) == 1


def test_texts_of_more_than_one_image():
    whole = media.payload_of(b"a few words " * 280_000)
    texts = ["a few words " * 280_000]
    import pyarrow as pa

    file = media.stored(pa.array(texts))[0]
    images = media.read_images([file])[0]
    assert len(images) == 2 and b"".join(webp.bytes_of(p)[..., 2::-1].tobytes() for p in images) == whole


def test_pixels(spark):
    docs = spark.createDataFrame([(1, "two rows" * 30), (2, None)], "doc_id long, text string")
    got = media.with_pixels(media.with_media(docs)).collect()
    for r in got:
        p = r["pixels"][0]
        rgba = np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"], 4)
        assert rgba[..., :3].tobytes() == media.payload_of(("two rows" * 30 if r["doc_id"] == 1 else "").encode()) and (rgba[..., 3] == 255).all()
    empty = spark.createDataFrame([(1, None)], "k int, media binary")
    assert media.with_pixels(empty).first()["pixels"] == []


def test_query_and_empty_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = queries.op13_media_columns(spark, SF).collect()
    assert sorted(r[:5] for r in got) == sorted((d["doc_id"], *expected(d["text"])) for d in docs)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert media.digests(media.with_media(none)).count() == 0
