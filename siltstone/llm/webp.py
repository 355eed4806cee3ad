"""Lossless WebP images (RFC 9649): decoding of whole batches of images, and writing.

Reading: headers, prefix codes and sub-images are read image by image. The pixels of all images of a batch are then decoded
in step, one pixel of each image at a time, as array operations over the images; the few longest are finished one by one.
Transforms are inverted by array operations where a row allows it.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
#: Fixed values of the format: order of code length codes; the colour cache's multiplier; literals and length codes of the first alphabet.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
BLACK = 0xFF000000
#: Near pixels with a short distance code: up to 7 rows above, 7 to the right and 8 to the left, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
MOST_SIDE, MOST_COPY = 1 << 14, 4096
#: Images still running below which each is finished on its own.
FEW = 40


# -- prefix codes ---------------------------------------------------------------------------

_reversed: dict[int, np.ndarray] = {}


def reversal(bits: int) -> np.ndarray:
    """Numbers of so many bits with their bits in reverse order."""
    if bits not in _reversed:
        r = np.zeros(1, np.int64)
        for _ in range(bits):
            r = np.concatenate((2 * r, 2 * r + 1))
        _reversed[bits] = r
    return _reversed[bits]


def lookup_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits): symbol * 16 + code length for each value of the next bits; one symbol alone takes no bits."""
    used = np.flatnonzero(lengths)
    if not len(used):
        return np.zeros(1, np.int32), 0
    if len(used) == 1:
        return np.array([used[0] << 4], np.int32), 0
    by = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[by].astype(np.int64)
    bits = int(size[-1])
    spans = 1 << (bits - size)
    if spans.sum() != 1 << bits:
        raise ValueError("a prefix code is not complete")
    return np.repeat((by << 4 | size).astype(np.int32), spans)[reversal(bits)], bits


def code_lengths(weights: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; symbols of weight 0 have none. Weights are halved until the code fits."""
    weights = np.asarray(weights, dtype=np.float64)
    used = np.flatnonzero(weights > 0).tolist()
    out = np.zeros(len(weights), np.int64)
    if len(used) == 1:
        out[used[0]] = 1
    floor = 0.0
    while len(used) > 1:
        heap = [(max(weights[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        out[:] = 0
        while len(heap) > 1:
            a, i, x = heapq.heappop(heap)
            b, j, y = heapq.heappop(heap)
            for s in x + y:
                out[s] += 1
            heapq.heappush(heap, (a + b, min(i, j), x + y))
        if out.max() <= most:
            break
        floor = 2 * floor or float(weights[used].sum()) / (1 << most)
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        code, last = 0, 0
        for s in used[np.argsort(lengths[used], kind="stable")].tolist():
            n = int(lengths[s])
            code <<= n - last
            last = n
            out[s] = reversal(n)[code]
            code += 1
    return out


# -- reading --------------------------------------------------------------------------------


class Bits:
    def __init__(self, data, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > 8 * len(self.data):
            raise ValueError("an image ends too early")
        return (int.from_bytes(self.data[a >> 3 : (self.at + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)


def read_code(bits: Bits, alphabet: int) -> tuple[np.ndarray, int]:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lookup_table(lengths)
    own = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    table, width = lookup_table(own)
    left = alphabet
    if bits.read(1):
        n = 2 + 2 * bits.read(3)
        left = 2 + bits.read(n)
    mask, at, last = (1 << width) - 1, 0, 8
    while at < alphabet and left:
        left -= 1
        e = int(table[bits.peek() & mask])
        bits.at += e & 15
        s = e >> 4
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + n > alphabet:
            raise ValueError("code lengths run over")
        lengths[at : at + n] = value
        at += n
    return lookup_table(lengths)


@dataclass
class Coded:
    """An entropy-coded image before its pixels: size, colour cache, groups of five codes, and which group holds where."""

    width: int
    height: int
    cache: int = 0
    block: int = 0
    where: np.ndarray | None = None
    groups: list = field(default_factory=list)
    at: int = 0  # bit of the first pixel


#: Codes read lately, by their first 56 bits: (bits, their value, cache, codes). Writers repeat codes.
_known: dict[tuple, tuple] = {}


def read_coded(bits: Bits, width: int, height: int, main: bool) -> Coded:
    start, key = bits.at, (main, bits.peek() & ((1 << 56) - 1))
    if key in _known:
        n, value, cache, groups = _known[key]
        if (int.from_bytes(bits.data[start >> 3 : (start + n + 7) >> 3], "little") >> (start & 7)) & ((1 << n) - 1) == value:
            bits.at += n
            return Coded(width, height, cache, 0, None, groups, bits.at)
    out = Coded(width, height)
    if bits.read(1):
        out.cache = bits.read(4)
        if not 1 <= out.cache <= 11:
            raise ValueError("a colour cache of this size is not allowed")
    n = 1
    if main and bits.read(1):
        out.block = bits.read(3) + 2
        more = (1 << out.block) - 1
        out.where = (read_pixels(bits, (width + more) >> out.block, (height + more) >> out.block) >> 8) & 0xFFFF
        n = int(out.where.max()) + 1
    for _ in range(n):
        first = LITERALS + LENGTHS + (1 << out.cache if out.cache else 0)
        out.groups.append([read_code(bits, a) for a in (first, 256, 256, 256, DISTANCES)])
    out.at = bits.at
    if out.where is None:
        if len(_known) >= 256:
            _known.clear()
        n = out.at - start
        _known[key] = (n, (int.from_bytes(bits.data[start >> 3 : (out.at + 7) >> 3], "little") >> (start & 7)) & ((1 << n) - 1), out.cache, out.groups)
    return out


def read_pixels(bits: Bits, width: int, height: int) -> np.ndarray:
    """A sub-image."""
    coded = read_coded(bits, width, height, False)
    out = np.zeros(width * height, np.uint32)
    bits.at = finish(bits.data, coded, out, 0, coded.at, 0, 0, None)
    return out.reshape(height, width)


def near_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def finish(data, coded: Coded, out: np.ndarray, at: int, bit: int, left: int, distance: int, cache) -> int:
    """Decode pixels from number `at` on, one by one; the bit behind the last."""
    total, width, shift = coded.width * coded.height, coded.width, 32 - coded.cache
    px = out[:at].tolist()
    if coded.cache:
        cache = [0] * (1 << coded.cache) if cache is None else cache.tolist()
    groups = [[(t.tolist(), (1 << n) - 1) for t, n in g] for g in coded.groups]
    (green, gm), (red, rm), (blue, bm), (alpha, am), (dist, dm) = groups[0]
    while at < total or left:
        if left:
            n = min(left, total - at)
            for _ in range(n):
                v = px[at - distance]
                px.append(v)
                at += 1
                if coded.cache:
                    cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
            left = 0
            continue
        if coded.where is not None:
            y, x = divmod(at, width)
            (green, gm), (red, rm), (blue, bm), (alpha, am), (dist, dm) = groups[coded.where[y >> coded.block, x >> coded.block]]
        w = int.from_bytes(data[bit >> 3 : (bit >> 3) + 10], "little") >> (bit & 7)
        e = green[w & gm]
        n = e & 15
        s = e >> 4
        if s < LITERALS:
            e = red[(w >> n) & rm]
            n += e & 15
            f = blue[(w >> n) & bm]
            n += f & 15
            a = alpha[(w >> n) & am]
            bit += n + (a & 15)
            v = (a >> 4) << 24 | (e >> 4) << 16 | s << 8 | f >> 4
        elif s < LITERALS + LENGTHS:
            w >>= n
            bit += n
            got = []
            for k in (s - LITERALS, None):
                if k is None:
                    e = dist[w & dm]
                    k = e >> 4
                    w >>= e & 15
                    bit += e & 15
                if k < 4:
                    got.append(k + 1)
                else:
                    extra = (k - 2) >> 1
                    got.append(((2 + (k & 1)) << extra) + (w & ((1 << extra) - 1)) + 1)
                    w >>= extra
                    bit += extra
            left, distance = got[0], near_distance(got[1], width)
            if distance > at:
                raise ValueError("a copy starts before the image")
            continue
        else:
            bit += n
            v = cache[s - LITERALS - LENGTHS]
        px.append(v)
        at += 1
        if coded.cache:
            cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
    if bit > 8 * len(data):
        raise ValueError("an image ends too early")
    out[:] = px
    return bit


@dataclass
class Image:
    width: int
    height: int
    transforms: list
    coded: Coded


def read_header(data: bytes) -> Image:
    """Size, transforms and codes of the data of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, packed = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(t[0] == kind for t in transforms):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            transforms.append((kind, packed, size, read_pixels(bits, (packed + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _add_up(read_pixels(bits, n, 1), 1).reshape(-1)
            fold = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, packed, fold, table))
            packed = (packed + (1 << fold) - 1) >> fold
        else:
            transforms.append((kind, packed))
    return Image(width, height, transforms, read_coded(bits, packed, height, True))


def chunks(data: bytes) -> list[bytes]:
    """The image data of the WebP files that stand one after another in data."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        whole, size = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<I", data, at + 16)[0]
        if at + 8 + whole > len(data) or size + 12 > whole:
            raise ValueError("a file ends too early")
        out.append(data[at + 20 : at + 20 + size])
        at += 8 + whole + (whole & 1)
    return out


def decode_batch(files: list[bytes]) -> list[np.ndarray]:
    """Pixels (height x width, 0xAARRGGBB) of VP8L data, all images in step."""
    images = [read_header(f) for f in files]
    order = sorted(range(len(files)), key=lambda i: -images[i].coded.width * images[i].coded.height)
    coded = [images[i].coded for i in order]
    n = len(coded)
    if not n:
        return []
    sizes = np.array([c.width * c.height for c in coded], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    # codes of all groups in one table; groups that images share stand once
    tables, places, offset, group_of, lists_of = [], [], 0, {}, []
    for c in coded:
        mine = []
        for g in c.groups:
            if id(g) not in group_of:
                group_of[id(g)] = len(places)
                row = []
                for t, width in g:
                    row += [offset, (1 << width) - 1]
                    tables.append(t)
                    offset += len(t)
                places.append(row)
            mine.append(group_of[id(g)])
        lists_of.append(mine)
    table, place = np.concatenate(tables), np.array(places, dtype=np.int64).T.copy()
    group = np.array([m[0] for m in lists_of])
    meta = np.array([c.where is not None for c in coded])
    body = np.frombuffer(b"".join(files[i] for i in order) + bytes(16), np.uint8)
    words = np.ndarray(len(body) - 8, "<u8", body, 0, (1,))
    lead = np.cumsum([0] + [len(files[i]) for i in order[:-1]]) * 8
    pos = lead + np.array([c.at for c in coded])
    left, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    bits = np.array([c.cache for c in coded])
    cached = bits.any()
    slots = np.where(bits > 0, 1 << bits, 1)
    cell = np.cumsum(slots) - slots
    cache = np.zeros(int(slots.sum()), np.uint32)
    shift = np.where(bits > 0, 32 - bits, 32).astype(np.uint64)
    width = np.array([c.width for c in coded])
    near = np.array(NEAR)
    longest = int(sizes[0])
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    one = np.uint64(1)

    def ahead(p):
        return words[p >> 3] >> (p & 7).astype(np.uint64)

    def symbol(w, g, k):
        return table[place[2 * k][g] + (w & place[2 * k + 1][g].astype(np.uint64)).astype(np.int64)]

    def value_of(prefix, w):
        """(value, bits taken) of length and distance prefixes."""
        extra = np.maximum((prefix - 2) >> 1, 0)
        more = (w & ((one << extra.astype(np.uint64)) - one)).astype(np.int64)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), extra

    t = 0
    while t < longest:
        k = int(running[t])
        if k < FEW:
            break
        go = np.flatnonzero(left[:k] == 0)
        px = np.zeros(k, np.uint32)
        if len(go):
            p = pos[go]
            g = group[go]
            if meta[:k].any():
                for i in np.flatnonzero(meta[go]).tolist():
                    c = coded[go[i]]
                    y, x = divmod(t, c.width)
                    g[i] = lists_of[go[i]][c.where[y >> c.block, x >> c.block]]
            e = symbol(ahead(p), g, 0)
            s = e >> 4
            p += e & 15
            lit = np.flatnonzero(s < LITERALS)
            if len(lit):
                q, h = p[lit], g[lit]
                w = ahead(q)
                r = symbol(w, h, 1)
                took = r & 15
                b = symbol(w >> took.astype(np.uint64), h, 2)
                took = took + (b & 15)
                a = symbol(w >> took.astype(np.uint64), h, 3)
                px[go[lit]] = (a >> 4).astype(np.uint32) << 24 | (r >> 4).astype(np.uint32) << 16 | s[lit].astype(np.uint32) << 8 | (b >> 4).astype(np.uint32)
                p[lit] = q + took + (a & 15)
            if len(lit) < len(go):
                cop = np.flatnonzero((s >= LITERALS) & (s < LITERALS + LENGTHS))
                if len(cop):
                    at = go[cop]
                    q = p[cop]
                    w = ahead(q)
                    n_copy, extra = value_of((s[cop] - LITERALS).astype(np.int64), w)
                    q = q + extra
                    w = w >> extra.astype(np.uint64)
                    d = symbol(w, g[cop], 4)
                    q = q + (d & 15)
                    code, extra = value_of((d >> 4).astype(np.int64), w >> (d & 15).astype(np.uint64))
                    pair = near[np.minimum(code, len(near)) - 1]
                    far = np.where(code > len(near), code - len(near), np.maximum(1, pair[:, 0] + pair[:, 1] * width[at]))
                    if (far > t).any():
                        raise ValueError("a copy starts before the image")
                    p[cop] = q + extra
                    left[at], distance[at] = n_copy, far
                if len(lit) + len(cop) < len(go):
                    hit = np.flatnonzero(s >= LITERALS + LENGTHS)
                    at = go[hit]
                    px[at] = cache[cell[at] + s[hit] - (LITERALS + LENGTHS)]
            pos[go] = p
        here = starts[:k] + t
        if len(go) < k or left[:k].any():
            cop = np.flatnonzero(left[:k])
            px[cop] = out[here[cop] - distance[cop]]
            left[cop] -= 1
        out[here] = px
        if cached:
            key = (px.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> shift[:k]
            cache[cell[:k] + key.astype(np.int64)] = px
        t += 1
    for i in range(int(running[t]) if t < longest else 0):
        c, a = coded[i], int(starts[i])
        own = cache[cell[i] : cell[i] + slots[i]] if c.cache else None
        finish(files[order[i]], c, out[a : a + int(sizes[i])], t, int(pos[i] - lead[i]), int(left[i]), int(distance[i]), own)
    done = [None] * n
    for k, i in enumerate(order):
        if t >= sizes[k] and pos[k] - lead[k] > 8 * len(files[i]):
            raise ValueError("an image ends too early")
        done[i] = invert(out[starts[k] : starts[k] + sizes[k]].reshape(coded[k].height, coded[k].width), images[i])
    return done


# -- transforms -----------------------------------------------------------------------------


def bytes_of(px: np.ndarray) -> np.ndarray:
    """Pixels with a last axis of blue, green, red, alpha."""
    return np.ascontiguousarray(px, "<u4").view(np.uint8).reshape(*px.shape, 4)


def pixels_of(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b).view("<u4").reshape(b.shape[:-1])


def _add_up(px: np.ndarray, axis: int) -> np.ndarray:
    return pixels_of(np.cumsum(bytes_of(px), axis=axis, dtype=np.uint8))


def _average(a, b):
    return (a + b) >> 1


def predict(mode: int, left, top, right, corner):
    """The prediction of a pixel from the pixels left, above, above right and above left (channels as integers)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=-1, keepdims=True) < np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        half = mean - corner
        return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    return np.array([0, 0, 0, 255])


#: Modes that look at the row above alone.
ROWWISE = (0, 2, 3, 4, 8, 9)


def _unpredict(px: np.ndarray, size: int, modes: np.ndarray) -> np.ndarray:
    b = bytes_of(px).astype(np.int64)
    height, width = px.shape
    b[0, 0, 3] += 255
    b[0] = np.cumsum(b[0], axis=0) & 255
    kinds = (modes >> 8) & 15
    if height > 1 and (kinds == 2).all():
        return pixels_of(np.cumsum(b.astype(np.uint8), axis=0, dtype=np.uint8))
    for y in range(1, height):
        own, above = b[y], b[y - 1]
        own[0] = (own[0] + above[0]) & 255
        kind = np.repeat(kinds[y >> size], 1 << size)[:width]
        # the pixel behind the last of the row above is the first of this row
        right = np.concatenate((above[1:], own[:1]))
        for mode in np.unique(kind[1:]).tolist():
            if mode in ROWWISE:
                at = np.flatnonzero(kind == mode)
                at = at[at > 0]
                own[at] = (own[at] + predict(mode, None, above[at], right[at], above[at - 1])) & 255
        for x in np.flatnonzero(~np.isin(kind, ROWWISE)).tolist():
            if x:
                own[x] = (own[x] + predict(int(kind[x]), own[x - 1], above[x], right[x], above[x - 1])) & 255
    return pixels_of(b.astype(np.uint8))


def _shifts(size: int, table: np.ndarray, shape) -> list[np.ndarray]:
    """Signed multipliers of each pixel: green to red, green to blue, red to blue."""
    whole = np.repeat(np.repeat(table, 1 << size, axis=0), 1 << size, axis=1)[: shape[0], : shape[1]]
    return [bytes_of(whole)[..., c].astype(np.int8).astype(np.int64) for c in (0, 1, 2)]


def _cross(px: np.ndarray, size: int, table: np.ndarray, back: bool) -> np.ndarray:
    b = bytes_of(px).copy()
    to_red, to_blue, red_to_blue = _shifts(size, table, px.shape)
    green, red = b[..., 1].view(np.int8).astype(np.int64), b[..., 2].copy()
    sign = 1 if back else -1
    new = (red.astype(np.int64) + sign * (to_red * green >> 5)).astype(np.uint8)
    true_red = (new if back else red).view(np.int8).astype(np.int64)
    b[..., 2] = new
    b[..., 0] = (b[..., 0] + sign * ((to_blue * green >> 5) + (red_to_blue * true_red >> 5))).astype(np.uint8)
    return pixels_of(b)


def _green(px: np.ndarray, back: bool) -> np.ndarray:
    b = bytes_of(px).copy()
    for c in (0, 2):
        b[..., c] = b[..., c] + b[..., 1] if back else b[..., c] - b[..., 1]
    return pixels_of(b)


def invert(px: np.ndarray, image: Image) -> np.ndarray:
    for kind, width, *rest in reversed(image.transforms):
        if kind == PREDICTOR:
            px = _unpredict(px, *rest)
        elif kind == CROSS:
            px = _cross(px, *rest, True)
        elif kind == GREEN:
            px = _green(px, True)
        else:
            fold, table = rest
            index = (px >> 8) & 255
            if fold:
                each = 8 >> fold
                index = ((index[:, :, None] >> (each * np.arange(1 << fold, dtype=np.uint32))) & ((1 << each) - 1)).reshape(len(px), -1)[:, :width]
            px = np.concatenate((table, np.zeros(256, np.uint32)))[index]
    return px


# -- writing --------------------------------------------------------------------------------


class Out:
    """Bits, first lowest, as (value, number of bits) pairs."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += int(n)


def put_code(out: Out, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 2 and (not used or used[0] < 256):
        s = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(s > 1, 1)
        out.put(s, 8 if s > 1 else 1)
        return
    runs, i, lengths = [], 0, lengths.tolist()
    end = used[-1] + 1
    while i < end:
        j = i
        while j < end and lengths[j] == lengths[i]:
            j += 1
        if lengths[i]:
            runs.append((lengths[i], 0, 0))
            i += 1
            while j - i >= 3:
                n = min(6, j - i)
                runs.append((16, n - 3, 2))
                i += n
        else:
            while j - i >= 3:
                n = min(138, j - i)
                runs.append((18, n - 11, 7) if n > 10 else (17, n - 3, 3))
                i += n
        while i < j:
            runs.append((lengths[i], 0, 0))
            i += 1
    own = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    if (own > 0).sum() == 1:
        own[1 if own[0] else 0] = 1  # so that the code takes bits, as every reader expects
    codes = codes_of(own)
    out.put(0, 1)
    last = max(i for i in range(19) if own[LENGTH_ORDER[i]] or i < 4)
    out.put(last - 3, 4)
    for i in range(last + 1):
        out.put(own[LENGTH_ORDER[i]], 3)
    # so many code lengths are stated, the rest are 0
    runs += [(0, 0, 0)] * (2 - len(runs)) if own[0] else []
    if len(runs) >= 2:
        n = max((len(runs) - 2).bit_length(), 2)
        n += n & 1
        out.put(1, 1)
        out.put((n - 2) // 2, 3)
        out.put(len(runs) - 2, n)
    else:
        out.put(0, 1)
    for s, extra, n in runs:
        out.put(codes[s], own[s])
        out.put(extra, n)


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra value, extra bits) of lengths or distance codes from 1 on."""
    v = np.asarray(values, dtype=np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    second = (v >> np.maximum(high - 1, 0)) & 1
    prefix = np.where(v < 2, v, 2 * high + second)
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return prefix, v & ((np.int64(1) << extra) - 1), extra


@dataclass
class Tokens:
    """The symbols of images one after another: for each, the image, the first alphabet's symbol, and a pixel or a copy."""

    image: np.ndarray
    symbol: np.ndarray
    pixel: np.ndarray
    copy: np.ndarray
    distance: np.ndarray


def tokenize(px: np.ndarray, sizes: np.ndarray, cache: int, copies: bool = True) -> Tokens:
    """Symbols of the images in px: copies of what stands in the same image, cached colours, else literals.

    A copy starts where four pixels have stood before; runs of pixels at one distance are one copy.
    """
    n = len(px)
    image = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)[image] if n else np.zeros(0, np.int64)
    place = np.arange(n)
    start, length = np.zeros(n, bool), np.zeros(n, np.int64)
    distance = np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    if copies and n > 4:
        p = px.astype(np.uint64)
        key = np.zeros(n, np.uint64)
        key[: n - 3] = ((p[:-3] * np.uint64(0x9E3779B97F4A7C15) + p[1:-2]) * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:-1]) * np.uint64(0x165667B19E3779F9) + p[3:]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + image.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        at, earlier = order[1:][same], order[:-1][same]
        real = (at + 4 <= ends[at]) & (image[at] == image[earlier]) & (earlier < at)
        at, earlier = at[real], earlier[real]
        for j in range(4):  # a key may be shared by chance
            real = px[at + j] == px[earlier + j]
            at, earlier = at[real], earlier[real]
        distance[at] = at - earlier
        follows = np.zeros(n, bool)
        follows[1:] = (distance[1:] > 0) & (distance[1:] == distance[:-1]) & (image[1:] == image[:-1])
        head = np.flatnonzero((distance > 0) & ~follows)
        run = np.diff(np.concatenate((head, [n])))
        known = np.concatenate(([0], np.cumsum(distance > 0)))
        run = np.minimum(run, known[head + run] - known[head]) + 3
        # a run ends where the next begins; short rests are left to literals
        run = np.minimum(run, np.concatenate((head[1:], [n])) - head)
        keep = run >= 3
        head, run = head[keep], run[keep]
        # at most MOST_COPY pixels each
        parts = -(-run // MOST_COPY)
        each = np.repeat(np.arange(len(head)), parts)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = head[each] + nth * MOST_COPY
        start[first] = True
        length[first] = np.minimum(run[each] - nth * MOST_COPY, MOST_COPY)
        distance[first] = distance[head[each]]
        cover = np.zeros(n + 1, np.int64)
        cover[head] += 1
        np.subtract.at(cover, head + run, 1)
        inside = np.cumsum(cover)[:n] > 0
    symbol = ((px >> 8) & 255).astype(np.int64)
    if cache and n:
        slot = ((px.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache)).astype(np.int64)
        order = np.argsort(image << cache | slot, kind="stable")
        a, b = order[1:], order[:-1]
        hit = (image[a] == image[b]) & (slot[a] == slot[b]) & (px[a] == px[b])
        symbol[a[hit]] = LITERALS + LENGTHS + slot[a[hit]]
    take = start | ~inside
    if start.any():
        symbol[start] = LITERALS + prefix_of(length[start])[0]
    at = place[take]
    return Tokens(image[at], symbol[at], px[at], length[at] * start[at], distance[at])


@dataclass
class Book:
    """Lengths and codes of the five alphabets, of one image or of many."""

    lengths: list[np.ndarray]
    codes: list[np.ndarray]

    @staticmethod
    def of(weights: list[np.ndarray], most: int = 15) -> Book:
        lengths = [code_lengths(w, most) for w in weights]
        return Book(lengths, [codes_of(n) for n in lengths])

    def header(self, cache: int, main: bool = True) -> Out:
        out = Out()
        out.put(cache > 0, 1)
        if cache:
            out.put(cache, 4)
        if main:
            out.put(0, 1)
        for n in self.lengths:
            put_code(out, n)
        return out

    def taken(self, alphabet: int) -> np.ndarray:
        """Bits of each symbol: none where a symbol stands alone."""
        n = self.lengths[alphabet]
        return n if (n > 0).sum() > 1 else np.zeros_like(n)


def counted(t: Tokens, cache: int) -> list[np.ndarray]:
    """How often each symbol of the five alphabets occurs."""
    lit = t.pixel[t.symbol < LITERALS]
    alphabets = [np.bincount(t.symbol, minlength=LITERALS + LENGTHS + (1 << cache if cache else 0))]
    alphabets += [np.bincount((lit >> s) & 255, minlength=256) for s in (16, 0, 24)]
    return alphabets + [np.bincount(prefix_of(t.distance[t.copy > 0] + len(NEAR))[0], minlength=DISTANCES)]


def emit(t: Tokens, book_of: np.ndarray, books: list[Book], heads: list[Out]) -> list[bytes]:
    """The bytes of each image: its head, then its tokens in its book's codes."""
    own = book_of[t.image]
    size = [np.stack([b.taken(k) for b in books]) for k in range(5)]
    code = [np.stack([b.codes[k] for b in books]) for k in range(5)]
    value, n = code[0][own, t.symbol].astype(np.uint64), size[0][own, t.symbol].copy()

    def more(at, v, bits):
        value[at] |= v.astype(np.uint64) << n[at].astype(np.uint64)
        n[at] += bits

    lit = np.flatnonzero(t.symbol < LITERALS)
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        s = (t.pixel[lit] >> shift) & 255
        more(lit, code[k][own[lit], s], size[k][own[lit], s])
    cop = np.flatnonzero(t.copy > 0)
    if len(cop):
        _, extra, bits = prefix_of(t.copy[cop])
        more(cop, extra, bits)
        s, extra, bits = prefix_of(t.distance[cop] + len(NEAR))
        more(cop, code[4][own[cop], s], size[4][own[cop], s])
        more(cop, extra, bits)
    # bits of an image: whole bytes, head first
    images = len(heads)
    head = np.array([h.n for h in heads], dtype=np.int64)
    inner = np.bincount(t.image, weights=n, minlength=images).astype(np.int64)
    whole = (head + inner + 7) // 8
    base = (np.cumsum(whole) - whole) * 8
    before = np.cumsum(n) - n
    first = np.concatenate(([0], np.cumsum(inner)))[:-1]
    at = base[t.image] + head[t.image] + before - first[t.image]
    words = np.zeros(int(whole.sum()) // 8 + 3, np.uint64)
    low = (at & 63).astype(np.uint64)
    over = np.where(low > 0, value >> ((np.uint64(64) - low) & np.uint64(63)), np.uint64(0))
    if len(at):
        cell = at >> 6
        cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        words[cell[cut]] |= np.bitwise_or.reduceat(value << low, cut)
        words[cell[cut] + 1] |= np.bitwise_or.reduceat(over, cut)
    raw = words.astype("<u8", copy=False).tobytes()
    out = []
    for a, size_, h in zip((base // 8).tolist(), whole.tolist(), heads):
        cut = (h.n + 7) // 8
        lead = (h.value | raw[a + cut - 1] << 8 * (cut - 1) if h.n & 7 else h.value).to_bytes(cut, "little")
        out.append(lead + raw[a + cut : a + size_])
    return out


def lead(width: int, height: int) -> Out:
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def wrap(data: bytes) -> bytes:
    """A WebP file of VP8L data."""
    pad = len(data) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(data) + pad) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + bytes(pad)


def put_image(out: Out, px: np.ndarray, cache: int = 0, copies: bool = True, main: bool = False) -> None:
    """An entropy-coded image with codes of its own."""
    flat = np.ascontiguousarray(px, np.uint32).reshape(-1)
    t = tokenize(flat, np.array([len(flat)]), cache, copies)
    book = Book.of(counted(t, cache))
    head = book.header(cache, main)
    data = emit(t, np.zeros(1, np.int64), [book], [head])[0]
    total = head.n + int(np.sum(_bits(t, book)))
    out.put(int.from_bytes(data, "little"), total)


def _bits(t: Tokens, book: Book) -> np.ndarray:
    n = book.taken(0)[t.symbol].copy()
    lit, cop = t.symbol < LITERALS, t.copy > 0
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        n[lit] += book.taken(k)[(t.pixel[lit] >> shift) & 255]
    s, _, extra = prefix_of(t.distance[cop] + len(NEAR))
    n[cop] += prefix_of(t.copy[cop])[2] + book.taken(4)[s] + extra
    return n


def put_transform(out: Out, px: np.ndarray, kind: int, size: int = 9, table: np.ndarray | None = None) -> np.ndarray:
    """State a transform and return the pixels under it. `table`: predictor modes or cross-colour multipliers by block."""
    out.put(1, 1)
    out.put(kind, 2)
    height, width = px.shape
    if kind == GREEN:
        return _green(px, False)
    if kind == PALETTE:
        colours, index = np.unique(px, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette holds 256 colours at most")
        out.put(len(colours) - 1, 8)
        steps = bytes_of(colours).copy()
        steps[1:] -= bytes_of(colours)[:-1]
        put_image(out, pixels_of(steps).reshape(1, -1))
        fold = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index = np.pad(index.reshape(px.shape), ((0, 0), (0, -width % (1 << fold)))).reshape(height, -1, 1 << fold)
        packed = (index << ((8 >> fold) * np.arange(1 << fold))).sum(axis=2)
        return (np.uint32(BLACK) | (packed.astype(np.uint32) << 8)).astype(np.uint32)
    out.put(size - 2, 3)
    put_image(out, table)
    if kind == CROSS:
        return _cross(px, size, table, False)
    b = bytes_of(px).astype(np.int64)
    kinds = np.repeat(np.repeat((table >> 8) & 15, 1 << size, axis=0), 1 << size, axis=1)[:height, :width]
    want = np.zeros_like(b)
    want[0, 0] = [0, 0, 0, 255]
    want[0, 1:] = b[0, :-1]
    for y in range(1, height):
        want[y, 0] = b[y - 1, 0]
        right = np.concatenate((b[y - 1, 1:], b[y, :1]))
        for mode in np.unique(kinds[y]).tolist():
            at = np.flatnonzero(kinds[y] == mode)
            at = at[at > 0]
            want[y, at] = predict(mode, b[y, at - 1], b[y - 1, at], right[at], b[y - 1, at - 1])
    return pixels_of(((b - want) & 255).astype(np.uint8))


def encode(px: np.ndarray, transforms: list[tuple] = (), cache: int = 0, copies: bool = True, blocks: tuple[int, np.ndarray] | None = None) -> bytes:
    """A WebP file of pixels (height x width, 0xAARRGGBB). `transforms`: arguments of put_transform in writing order."""
    height, width = px.shape
    out = lead(width, height)
    for t in transforms:
        px = put_transform(out, px, *t)
    out.put(0, 1)
    if blocks is None:
        put_image(out, px, cache, copies, True)
    else:
        _put_blocks(out, px, *blocks)
    return wrap(out.value.to_bytes((out.n + 7) // 8, "little"))


def _put_blocks(out: Out, px: np.ndarray, size: int, where: np.ndarray) -> None:
    """Pixels as literals, each block under the codes of its group."""
    out.put(0, 1)
    out.put(1, 1)
    out.put(size - 2, 3)
    put_image(out, (np.uint32(BLACK) | (where.astype(np.uint32) << 8)).astype(np.uint32))
    height, width = px.shape
    of = np.repeat(np.repeat(where, 1 << size, axis=0), 1 << size, axis=1)[:height, :width].reshape(-1)
    flat = px.reshape(-1)
    books = []
    for g in range(int(where.max()) + 1):
        books.append(Book.of(counted(tokenize(flat[of == g], np.array([(of == g).sum()]), 0, False), 0)))
        for n in books[-1].lengths:
            put_code(out, n)
    for v, g in zip(flat.tolist(), of.tolist()):
        for k, s in enumerate(((v >> 8) & 255, (v >> 16) & 255, v & 255, v >> 24)):
            out.put(books[g].codes[k][s], int(books[g].taken(k)[s]))
