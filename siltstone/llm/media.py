"""Texts as lossless WebP images and back: a binary media column, its pixel arrays, and features of what was read.

A text's bytes, filled up with spaces to a positive multiple of 192, are rows of 64 pixels of red, green and blue; images
have at most 16,383 rows, so that a longer text is several files one after another. Payloads of at most 16 colours are
palette images. The others are dealt by the CRC of their bytes to plain, predictor and cross-colour form, so that each way of
reading is used by the data. All use copies, a colour cache and prefix codes: their own where they are long, shared ones
where a header of their own would weigh more.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import webp
from siltstone.llm.common import slices, text_bytes

#: Pixels of a row, rows of an image, bits of the colour cache, rows from which an image has codes of its own.
WIDTH, ROWS, CACHE, OWN_ROWS = 64, webp.MOST_SIDE - 1, 9, 192
ROW_BYTES = 3 * WIDTH
PLAIN, PREDICTED, CROSSED, PALETTED = 0, 1, 2, 3
#: Form by the CRC of the payload modulo 4.
DEALT = (PLAIN, PLAIN, PREDICTED, CROSSED)
#: Cross-colour: green to red and to blue, red to blue, in 32nds.
SHIFTS = np.array([32, 16, 16, 255], np.uint8)
#: Text bytes that are worked on together.
GROUP_BYTES = 8 << 20


def _shared() -> list[webp.Book]:
    """Codes for short images by form: of texts (letters often, other bytes seldom), of differences (small ones often)."""
    text = np.full(256, 0.05)
    text[32:127] = 0.4
    text[97:123] = 3.0
    text[list(b"aeinorst")] = 6.0
    text[32] = 16.0
    v = np.arange(256)
    steps = 1.0 / (4 + np.minimum(v, 256 - v))
    books = []
    for w, hits, opaque in ((text, 0.5, 255), (steps, 0.05, 0), (steps, 0.05, 255)):  # differences of alpha are 0
        other = w.sum()
        first = np.concatenate((w, np.full(webp.LENGTHS, 0.004 * other), np.full(1 << CACHE, hits * other / (1 << CACHE))))
        solid = np.zeros(256)
        solid[opaque] = 1
        books.append([first, w, w, solid, np.full(webp.DISTANCES, 1.0)])
    return [webp.Book.of(b, 12) for b in books]


_books: list[webp.Book] = []


def _residuals(px: np.ndarray, sizes: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """Pixels under each image's transform."""
    out = px.copy()
    of = np.repeat(forms, sizes)
    at = np.flatnonzero(of == PREDICTED)
    if len(at):
        place = at - np.repeat(np.cumsum(sizes) - sizes, sizes)[at]
        # the row above; in the first row the pixel before, and black before the first
        want = np.where(place >= WIDTH, px[np.maximum(at - WIDTH, 0)], np.where(place > 0, px[np.maximum(at - 1, 0)], np.uint32(webp.BLACK)))
        out[at] = webp.pixels_of(webp.bytes_of(px[at]) - webp.bytes_of(want))
    at = np.flatnonzero(of == CROSSED)
    if len(at):
        out[at] = webp._cross(px[at].reshape(1, -1), 0, np.broadcast_to(webp.pixels_of(SHIFTS[None]), (1, len(at))), False).reshape(-1)
    return out


def _head(rows: int, form: int, book: webp.Book) -> webp.Out:
    out = webp.lead(WIDTH, rows)
    if form != PLAIN:
        table = np.full((-(-rows >> 9), 1), webp.BLACK | 2 << 8, np.uint32) if form == PREDICTED else np.full((-(-rows >> 9), 1), webp.pixels_of(SHIFTS[None])[0], np.uint32)
        out.put(1, 1)
        out.put(webp.PREDICTOR if form == PREDICTED else webp.CROSS, 2)
        out.put(7, 3)
        webp.put_image(out, table, 0, False)
    out.put(0, 1)
    own = book.header(CACHE)
    out.put(own.value, own.n)
    return out


_heads: dict[tuple, webp.Out] = {}


def images_of(payloads: list[bytes]) -> list[bytes]:
    """WebP files of payloads of whole rows; each depends on its payload alone."""
    if not _books:
        _books.extend(_shared())
    out: list[bytes | None] = [None] * len(payloads)
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3)
    px = raw[:, 0].astype(np.uint32) << 16 | raw[:, 1].astype(np.uint32) << 8 | raw[:, 2] | np.uint32(webp.BLACK)
    sizes = np.array([len(p) // 3 for p in payloads])
    starts = np.cumsum(sizes) - sizes
    forms = np.array([DEALT[zlib.crc32(p) % 4] for p in payloads])
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        if len(np.unique(px[a : a + WIDTH])) <= 16 and len(np.unique(px[a : a + n])) <= 16:
            forms[i] = PALETTED
            out[i] = webp.encode(px[a : a + n].reshape(-1, WIDTH), [(webp.PALETTE,)])
    rest = np.flatnonzero(forms != PALETTED)
    if not len(rest):
        return out
    px, sizes, forms = px[np.repeat(forms != PALETTED, sizes)], sizes[rest], forms[rest]
    t = webp.tokenize(_residuals(px, sizes, forms), sizes, CACHE)
    books, book_of, heads = list(_books), forms.copy(), []
    bounds = np.searchsorted(t.image, np.arange(len(rest) + 1))
    for i, (rows, form) in enumerate(zip((sizes // WIDTH).tolist(), forms.tolist())):
        if rows >= OWN_ROWS:
            own = slice(bounds[i], bounds[i + 1])
            book_of[i] = len(books)
            books.append(webp.Book.of(webp.counted(webp.Tokens(t.image[own], t.symbol[own], t.pixel[own], t.copy[own], t.distance[own]), CACHE)))
            heads.append(_head(rows, form, books[-1]))
            continue
        if (rows, form) not in _heads:
            _heads[rows, form] = _head(rows, form, books[form])
        heads.append(_heads[rows, form])
    for i, data in zip(rest.tolist(), webp.emit(t, book_of, books, heads)):
        out[i] = webp.wrap(data)
    return out


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW_BYTES or (0 if text else ROW_BYTES))


def stored(texts: pa.Array):
    """(first text, its media column) of runs of texts; a text's images are made in groups of GROUP_BYTES."""
    raw, offsets = text_bytes(texts)
    pending: list[bytes] = []
    owners: list[int] = []
    done: dict[int, list[bytes]] = {}
    held = 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        whole = payload_of(raw[a:b].tobytes())
        for at in range(0, len(whole), ROWS * ROW_BYTES):
            pending.append(whole[at : at + ROWS * ROW_BYTES])
            owners.append(i)
            held += len(pending[-1])
            if held >= GROUP_BYTES:
                for o, f in zip(owners, images_of(pending)):
                    done.setdefault(o, []).append(f)
                pending, owners, held = [], [], 0
    if pending:
        for o, f in zip(owners, images_of(pending)):
            done.setdefault(o, []).append(f)
    return [b"".join(done[i]) for i in range(len(offsets) - 1)]


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of the text), media: the text as WebP files, one after another.

    A null text counts as empty, which is one row of spaces; equal texts have equal media; null ids and repeated rows are
    kept; other columns are not read; an empty table gives no rows.
    """

    def store(batches):
        for batch in batches:
            for run in slices(batch, "text", GROUP_BYTES):
                texts = run.column("text")
                _, offsets = text_bytes(texts)
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(np.diff(offsets)), pa.array(stored(texts), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def read_images(media: list[bytes | None]) -> list[list[np.ndarray]]:
    """The pixel arrays (height x width, 0xAARRGGBB) of each row's files, all rows in step; none for a null."""
    files, owners = [], []
    for i, m in enumerate(media):
        own = webp.chunks(m) if m else []
        files += own
        owners += [i] * len(own)
    out: list[list[np.ndarray]] = [[] for _ in media]
    for i, px in zip(owners, webp.decode_batch(files)):
        out[i].append(px)
    return out


def with_pixels(images: DataFrame, column: str = "media") -> DataFrame:
    """The table with `pixels`: a list of (width, height, data) for each file in the column, data as 4 bytes a pixel (R, G, B, A).

    A null or empty value gives an empty list; what is no lossless WebP file raises ValueError. A column named pixels is replaced.
    """
    kept = [c for c in images.columns if c != "pixels"]

    def read(batches):
        for batch in batches:
            for run in _runs(batch, column):
                rows = [[{"width": p.shape[1], "height": p.shape[0], "data": webp.bytes_of(p)[..., [2, 1, 0, 3]].tobytes()} for p in own] for own in read_images(run.column(column).to_pylist())]
                kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in kept), pa.array(rows, kind)], [*kept, "pixels"])

    fields = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in kept)
    return images.select(kept).mapInArrow(read, f"{fields}, pixels array<struct<width:int,height:int,data:binary>>")


def _runs(batch: pa.RecordBatch, column: str):
    return slices(batch, column, GROUP_BYTES)


def digests(images: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media digests and a feature, from the media column as it is read."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches):
        for batch in batches:
            for run in _runs(batch, "media"):
                media = run.column("media").to_pylist()
                rows = []
                for own in read_images(media):
                    payload = b"".join(webp.bytes_of(p)[..., 2::-1].tobytes() for p in own)
                    seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    feature = f"{sum(len(p) for p in own)}x{WIDTH} distinct={int((seen > 0).sum())} mean={int((seen * np.arange(256)).sum()) // max(len(payload), 1)}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature))
                yield pa.RecordBatch.from_arrays(
                    [
                        run.column("doc_id"),
                        run.column("n_bytes"),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([len(m) for m in media], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                        pa.array([r[3] for r in rows], pa.string()),
                    ],
                    names,
                )

    return images.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
