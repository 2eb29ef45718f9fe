"""Vectorised word and shingle hashes over Arrow string arrays.

A word is a maximal run of ASCII letters, digits and non-ASCII characters,
with A-Z lower-cased.  The code works on the UTF-8 bytes of a whole block of
texts at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix (public domain), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


BYTE_VALUE = stream(256, 1)
STEP = U64(0x9E3779B97F4A7C15)


def blocks(arr: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string array of about ``max_bytes`` each (one text at least),
    with the index of their first row; nulls become empty texts."""
    arr = arr.fill_null("") if arr.null_count else arr
    off = offsets(arr)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield i, arr.slice(i, j - i)
        i = j


def offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array without nulls."""
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = offsets(arr)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of a block of texts: ``start``/``end`` (byte places in the block),
    ``hash`` (64 bit) and ``first`` (first word of each text; one more at the end)."""

    def __init__(self, arr: pa.Array):
        data, off = raw(arr)
        self.data, self.off = data, off
        word = IS_WORD[data]
        n = len(data)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = off[1:-1][off[1:-1] < n]
        begins[inner] = word[inner]  # a word ends where its text ends
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = inner[inner > 0] - 1
        ends[inner] = word[inner]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hash(LOWER[data[word]])

    def _hash(self, low: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """Hashes of the words, about ``step`` bytes at a time to bound the memory."""
        size = self.end - self.start
        out = np.zeros(len(size), U64)
        if not len(size):
            return out
        begin = np.cumsum(size) - size
        power = np.cumprod(np.full(int(size.max()), STEP | U64(1), U64))
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + step)))
            at, n = begin[i:j] - begin[i], size[i:j]
            part = low[begin[i]:begin[j - 1] + n[-1]]
            place = np.arange(len(part)) - np.repeat(at, n)
            out[i:j] = mix(np.add.reduceat(BYTE_VALUE[part] * power[place], at) + n.astype(U64))
            i = j
        return out

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, i: int, k: int) -> np.ndarray:
        """Distinct hashes of the ``k``-word runs of text ``i``, sorted; a text of
        fewer words, but not none, has one shingle of all its words."""
        return np.unique(runs(self.hash[self.first[i]:self.first[i + 1]], k))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` items of ``h`` (of all items if there are fewer)."""
    if not len(h):
        return np.zeros(0, U64)
    k = min(k, len(h))
    c = stream(k, 2) | U64(1)
    out = h[:len(h) - k + 1] * c[0]
    for j in range(1, k):
        out = out + h[j:len(h) - k + 1 + j] * c[j]
    return mix(out + U64(k))


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary Arrow array whose item ``i`` is the bytes of ``data[bounds[i]:bounds[i + 1]]``."""
    place = (np.asarray(bounds, np.int64) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(place) - 1, [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data))])
