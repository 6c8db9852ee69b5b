"""Words of many texts at once, by whole-array steps over the bytes of a batch; for texts whose characters lie below U+0100.

The words are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` in the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, DIGIT, OTHER = range(4)
#: Words up to so many bytes are compared as two whole numbers.
SHORT = 16


def _kind(c: str) -> int:
    return LETTER if c.isalpha() else DIGIT if c.isnumeric() else SPACE if c.isspace() else OTHER


#: Kinds of ASCII bytes, and of the second bytes after C2 and C3.
_ASCII = np.array([_kind(chr(i)) if i < 0x80 else OTHER for i in range(256)], np.uint8)
_AFTER = {lead: np.array([_kind(chr((lead & 3) << 6 | i & 0x3F)) for i in range(256)], np.uint8) for lead in (0xC2, 0xC3)}
_LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)
#: Bytes that no text here may hold: leads of characters from U+0100 on, and separators whose kind differs between libraries (the latter are also U+0085 and U+00A0).
_STRANGE = np.array([i >= 0xC4 or 0x1C <= i <= 0x1F for i in range(256)])


class Batch:
    """``data``: the bytes of texts laid end to end; ``bounds``: where they begin, and the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        n, self.bounds = len(data), bounds
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        kinds, lower = _ASCII[data], _LOWER[data]
        strange = _STRANGE[data]
        for lead in (0xC2, 0xC3):
            at = np.flatnonzero(data == lead)
            second = padded[at + 1]
            kinds[at] = kinds[np.minimum(at + 1, n - 1)] = _AFTER[lead][second]
            if lead == 0xC2:
                strange[at] |= (second == 0x85) | (second == 0xA0)
            else:
                capital = at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1
                lower[capital] += 0x20
        strange |= (data == 0x3C) & (padded[1 : n + 1] == 0x7C)  # "<|", as special tokens begin
        seen = np.concatenate([[0], np.cumsum(strange)])
        #: Which texts are to be parted otherwise.
        self.strange = seen[bounds[1:]] > seen[bounds[:-1]]
        first = np.zeros(n + 4, bool)
        first[bounds[:-1]] = True
        edge = first.copy()
        edge[1:n] |= kinds[1:] != kinds[:-1]
        edge[:n] |= (kinds == DIGIT) & (data & 0xC0 != 0x80)
        self._contractions(lower, kinds, first, edge)
        starts = np.flatnonzero(edge[:n])
        ends = np.append(starts[1:], n)
        word = kinds[starts] != SPACE
        text = np.searchsorted(bounds, starts, "right") - 1
        word &= ~self.strange[np.minimum(text, len(bounds) - 2)]
        self.starts, self.ends, self.lower = starts[word], ends[word], lower

    @staticmethod
    def _contractions(lower: np.ndarray, kinds: np.ndarray, first: np.ndarray, edge: np.ndarray) -> None:
        """An apostrophe that begins a word takes the letters of a contraction with it."""
        n = len(lower)
        at = np.flatnonzero((lower == 0x27) & edge[:n])
        at = at[at + 1 < n]
        at = at[(kinds[at + 1] == LETTER) & ~first[at + 1]]
        one = lower[at + 1]
        two = np.where((at + 2 < n) & ~first[at + 2], lower[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, letters in ((at[short], 1), (at[long], 2)):
            edge[found + 1] = False
            edge[found + 1 + letters] = True

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its size, its first eight bytes and the next eight as whole numbers, and one number mixed of these."""
        starts, sizes, n = self.starts, self.ends - self.starts, len(self.lower)
        padded = np.concatenate([self.lower, np.zeros(SHORT, np.uint8)])
        # A whole number at every byte.
        low = np.ndarray((n,), "<u8", padded, 0, (1,))[starts] & _MASK[np.minimum(sizes, 8)]
        high = np.ndarray((n,), "<u8", padded, 8, (1,))[starts] & _MASK[np.clip(sizes - 8, 0, 8)]
        with np.errstate(over="ignore"):
            return sizes, low, high, low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Encoded:
    """The codes of words, kept as arrays for up to about ``most`` words, the most used ones; ``encode`` gives those of one word as bytes of the type ``kind``."""

    def __init__(self, encode: Callable[[str], bytes], kind: str, most: int) -> None:
        self.encode, self.most, self.width = encode, most, np.dtype(kind).itemsize
        self.ids = np.zeros(0, kind)
        self.key, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))
        self.size, self.first, self.count, self.used = (np.zeros(0, np.int64) for _ in range(4))

    def _grow(self, words: list[str], key: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        found = [self.encode(w) for w in words]
        count = np.array([len(x) // self.width for x in found], np.int64)
        self.first = np.concatenate([self.first, len(self.ids) + count.cumsum() - count])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.ids.dtype)])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        for name, more in (("key", key), ("low", low), ("high", high), ("size", size), ("count", count)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def _shrink(self) -> None:
        """Only the more used half stays."""
        kept = np.sort(np.argpartition(-self.used, self.most // 2)[: self.most // 2])
        count = self.count[kept]
        self.ids = self.ids[np.arange(count.sum()) + np.repeat(self.first[kept] - (count.cumsum() - count), count)]
        self.first = count.cumsum() - count
        self.used = self.used[kept] // 2
        for name in ("key", "low", "high", "size", "count"):
            setattr(self, name, getattr(self, name)[kept])

    def __call__(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """The codes of a batch's words, end to end, and how many each word has."""
        if len(self.key) > self.most:
            self._shrink()
        size, low, high, key = batch.keys()
        same = lambda a, b: (low[a] == self.low[b]) & (high[a] == self.high[b]) & (size[a] == self.size[b])
        at = pc.index_in(pa.array(key), value_set=pa.array(self.key)).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero((at < 0) & (size <= SHORT))
        raw = batch.lower.tobytes()
        word = lambda i: raw[batch.starts[i] : batch.ends[i]].decode()
        if len(new):
            codes = pa.array(key[new]).dictionary_encode().indices.to_numpy().astype(np.int64)
            first = np.zeros(int(codes.max()) + 1, np.int64)
            first[codes[::-1]] = new[::-1]
            at[new] = len(self.key) + codes
            self._grow([word(i) for i in first.tolist()], key[first], low[first], high[first], size[first])
        # Long words, and those whose number is another word's, are encoded one by one.
        every = np.arange(len(at))
        alone = np.flatnonzero((size > SHORT) | (at < 0) | ~same(every, np.maximum(at, 0))) if len(self.key) else every
        ids, firsts, counts = self.ids, self.first[np.maximum(at, 0)] if len(self.key) else np.zeros(len(at), np.int64), self.count[np.maximum(at, 0)] if len(self.key) else np.zeros(len(at), np.int64)
        self.used += np.bincount(np.delete(at, alone), minlength=len(self.key))
        if len(alone):
            found = [self.encode(word(i)) for i in alone.tolist()]
            own = np.array([len(x) // self.width for x in found], np.int64)
            firsts[alone], counts[alone] = len(ids) + own.cumsum() - own, own
            ids = np.concatenate([ids, np.frombuffer(b"".join(found), ids.dtype)])
        begins = counts.cumsum() - counts
        return ids[np.arange(counts.sum()) + np.repeat(firsts - begins, counts)], counts
