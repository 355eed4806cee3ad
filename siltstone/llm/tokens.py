"""Token ids of whole texts by a public vocabulary file, remembered word by word.

The vocabulary file drops case and white space and never merges over white space or from letters into
marks, so that the ids of a text are the ids of its pieces one after the other. Pieces repeat far more often
than texts do: each process keeps the ids of up to MEMO pieces, all of them made by the tokenizers library,
under a 64-bit hash of the piece, with the piece's bytes. A text with a piece whose bytes are others than those kept
under its hash goes to the library whole, as do texts that hold the start of a special token.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from siltstone.llm.common import LONG_SPAN, lower_ascii, span_hashes, text_bytes

#: Pieces, and their bytes, that a process remembers before it starts anew; bounds memory, not results.
MEMO, MEMO_BYTES = 800_000, 24 << 20
#: Pieces that go to the library at once.
LEARNED = 20_000
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[0x2C, 0x2E]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)  # of each key: its number in starts and sizes
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.bytes = np.zeros(1 << 20, np.uint8)  # of all pieces, by slot
        self.at = np.zeros(1, np.int64)  # bounds of the pieces in bytes

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each piece's, number of each piece's). Pieces that are one word to the library go in one call, parted by word ends."""
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        single = [i for i, p in enumerate(pieces) if p.isalpha() and (p.isascii() or max(p) < "ɐ" and unicodedata.is_normalized("NFC", p))]
        parts, used, rest = [], 0, np.ones(len(pieces), bool)
        for a in range(0, len(single), 4000):
            block = single[a : a + 4000]
            ids = np.array(self.library.encode_batch_fast([" ".join([pieces[i] for i in block])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(block) and ends[-1] == len(ids):
                rest[block] = False
                sizes[block] = np.diff(ends, prepend=0)
                starts[block] = used + ends - sizes[block]
                parts.append(ids)
                used += len(ids)
        left = np.flatnonzero(rest).tolist()
        for i, e in zip(left, self.library.encode_batch_fast([pieces[i] for i in left], add_special_tokens=False)):
            parts.append(np.array(e.ids, np.uint32))
            starts[i], sizes[i] = used, len(e.ids)
            used += len(e.ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), starts, sizes

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        ids, starts, sizes = self._library([p.decode("utf-8", "replace") for p in raw])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        top = int(self.at[-1])
        while top + len(joined) + 8 > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros(len(self.bytes), np.uint8)))
        self.bytes[top : top + len(joined)] = joined
        self.at = np.concatenate((self.at, top + np.cumsum([len(p) for p in raw])))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate((self.starts, self.used + starts))
        self.sizes = np.concatenate((self.sizes, sizes))
        slots = np.arange(len(self.starts) - len(keys), len(self.starts))
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)

    def _others(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which spans are not the pieces kept in their slots: sizes and all bytes are compared."""
        a, b = self.at[slots], self.at[slots + 1]
        sizes = ends - starts
        wrong = b - a != sizes
        x = np.ndarray(len(low) + 1, "<u8", np.concatenate((low, np.zeros(8, np.uint8))), 0, (1,))
        y = np.ndarray(max(len(self.bytes) - 7, 1), "<u8", self.bytes, 0, (1,))
        live = np.flatnonzero(~wrong)
        for i in live[sizes[live] > LONG_SPAN].tolist():
            wrong[i] = not np.array_equal(low[starts[i] : ends[i]], self.bytes[a[i] : b[i]])
        live = live[sizes[live] <= LONG_SPAN]
        done = 0
        while len(live := live[sizes[live] > done]):
            left = sizes[live] - done
            # the last eight bytes of kept pieces may overlap the next piece, so that both sides are masked
            mask = np.full(len(live), 0xFFFFFFFFFFFFFFFF, np.uint64)
            part = left < 8
            mask[part] = (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
            differ = (x[starts[live] + done] ^ y[a[live] + done]) & mask != 0
            wrong[live[differ]] = True
            live = live[~differ]
            done += 8
        return wrong

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); a null text has none."""
        raw, offsets = text_bytes(column)
        n = len(offsets) - 1
        special = set()
        if len(raw) > 1:
            hits = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))  # <|
            special = set((np.searchsorted(offsets, hits, side="right") - 1).tolist())
        low = lower_ascii(raw)
        inside = ~_GAPS[low]
        opens = inside.copy()
        if len(low):
            opens[1:] &= ~inside[:-1] | (_LETTER[low[:-1]] & _MARK[low[1:]])
        heads = offsets[:-1][np.diff(offsets) > 0]
        opens[heads] = inside[heads]
        starts = np.flatnonzero(opens)
        # a piece ends at the next gap, the next piece or its text's end
        gaps = np.flatnonzero(~inside)
        limit = np.full(len(starts), len(low), np.int64)
        if len(gaps):
            at = np.searchsorted(gaps, starts)
            has = at < len(gaps)
            limit[has] = gaps[at[has]]
        if len(starts):
            limit[:-1] = np.minimum(limit[:-1], starts[1:])
            limit = np.minimum(limit, offsets[np.searchsorted(offsets, starts, side="right")])
        words = np.diff(np.searchsorted(starts, offsets))
        hashes = span_hashes(low, starts, limit)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO or self.at[-1] > MEMO_BYTES:
            self._empty()
        _, known = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            buffer = low.tobytes()
            for some in np.array_split(new, -(-len(new) // LEARNED)):
                self._learn(keys[some], [buffer[a:b] for a, b in zip(starts[first[some]].tolist(), limit[first[some]].tolist())])
        at, _ = self._find(keys)
        slots = self.slot[at][inverse] if len(keys) else np.zeros(0, np.int64)
        wrong = self._others(low, starts, limit, slots) if len(keys) else np.zeros(0, bool)
        special |= set((np.searchsorted(offsets, starts[wrong], side="right") - 1).tolist())
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[slots] - (ends - sizes), sizes)]
        bounds = np.concatenate((np.zeros(1, np.int64), ends))[np.concatenate((np.zeros(1, np.int64), np.cumsum(words)))]
        counts = np.diff(bounds)
        if special:
            parts = np.split(ids, bounds[1:-1])
            for d in special:
                parts[d] = self.whole(bytes(raw[offsets[d] : offsets[d + 1]]).decode("utf-8", "replace"))
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts if n else np.zeros(0, np.int64)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
