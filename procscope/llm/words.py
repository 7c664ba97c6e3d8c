"""Words of many texts at once, on the bytes of an Arrow column.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses those bytes inside a
longer character, so the words are those of the text. Everything is numpy over one slice of texts
of about ``SLICE`` bytes; a single longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
R = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 4096)
        inverse = np.uint64(pow(int(R), -1, 1 << 64))
        tables = []
        for base in (R, inverse):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            tables.append(np.multiply.accumulate(a))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 0x20, data).astype(np.uint8)


BREAK_TABLE = np.zeros(256, bool)
BREAK_TABLE[list(BREAKS)] = True
#: Everything but ASCII letters, digits and the bytes of longer characters.
PUNCTUATION_TABLE = np.array(
    [not (chr(b).isalnum() if b < 128 else True) for b in range(256)], bool
)


class Words:
    """Words of one slice. ``first[i]`` is the first word of text ``i``; ``first[-1]`` the count."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BREAK_TABLE):
        self.data, self.offsets = data, offsets
        inside = ~breaks[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        at = offsets[1:-1]
        at = at[(at > 0) & (at < len(data))]  # a text ends where the next begins
        opens[at] = inside[at]
        closes[at - 1] = inside[at - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hash = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if self._hash is None:
            n = len(self.data)
            power, inverse = _power_table(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
            h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
            length = (self.ends - self.starts).astype(np.uint64)
            self._hash = mix(h ^ (length * np.uint64(0xD6E8FEB86659FD93)))
        return self._hash


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes; shorter by ``n - 1``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * R + h[i : i + m]
    return mix(out)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """As ``ngrams`` for large ``n``: cost does not grow with it."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_table(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[n:] - total[:m]) * inverse[:m])


def runs(h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of ``h[first:stop]`` for each pair of places."""
    power, inverse = _power_table(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    length = (stop - first).astype(np.uint64)
    return mix((total[stop] - total[first]) * inverse[first] ^ length * np.uint64(0xD6E8FEB86659FD93))


def give_back() -> None:
    """Return to the system what is free here: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(
    texts: pa.Array, size: int = SLICE
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from the slice's start). Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
