"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a slice of documents at once. A slice
holds about CHUNK bytes, so the 8-byte temporaries stay within tens of
megabytes; a longer document makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

_TABLE = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if _POWERS.get("up", np.empty(0)).size < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Docs(NamedTuple):
    """A slice of documents: rows first..last, their bytes, and offsets into them."""

    first: int
    last: int
    data: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first


def slices(texts: pa.Array, chunk: int = CHUNK, most: int = 4096) -> Iterator[Docs]:
    """The documents of a string column in slices of about chunk bytes and at most `most` rows; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1
        last = min(max(last, first + 1), first + most, len(texts))
        yield Docs(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    """Words of a slice: byte spans, a 64-bit hash each, and each document's offset among them."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.at.size - 1), np.diff(self.at))


def spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at document ends."""
    if not mask.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(mask.size + 1, dtype=bool)
    edge[at] = True
    begin, close = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:-1]
    close[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(close) + 1


def hash_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes."""
    up, down = _powers(values.size + 1)
    sums = np.zeros(values.size + 1, dtype=np.uint64)
    np.cumsum(_TABLE[values] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(docs: Docs) -> Words:
    start, end = spans(WORD[docs.data], docs.at)
    return Words(start, end, hash_spans(LOWER[docs.data], start, end), np.searchsorted(start, docs.at))


_GRAM = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; runs over document ends too, so mask those."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _GRAM[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _GRAM[j]
    return mix(out + np.uint64(k))


def gram_spans(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-grams that lie within a document, and each document's offset among them."""
    counts = np.maximum(np.diff(at) - k + 1, 0)
    to = np.concatenate([[0], np.cumsum(counts)])
    where = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], counts)
    return where, to


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values in each document's range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[at[1:]] - total[at[:-1]]


def maxima(values: np.ndarray, at: np.ndarray, empty: float = 0) -> np.ndarray:
    """Maximum of values in each document's range."""
    out = np.full(at.size - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(at[1:] > at[:-1])
    if some.size:
        out[some] = np.maximum.reduceat(values, at[some])
    return out


def codepoints(docs: Docs) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice (A-Z and Latin-1 capitals lower-cased), and each document's offset among them."""
    data = docs.data
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    cp = b.copy()
    for least, mask, extra in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        rows = np.flatnonzero(b >= least)
        if not rows.size:
            break
        value = b[rows] & mask
        for j in range(1, extra + 1):
            value = (value << 6) | (padded[lead[rows] + j] & 0x3F)
        cp[rows] = value
    capital = ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7))
    cp[capital] += 32
    return cp, np.searchsorted(lead, docs.at)
