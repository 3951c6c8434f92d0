"""Weighted MinHash of word-shingle multisets by hierarchical Poisson processes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from plumbline.llm.vectors import Docs, gram_spans, grams, mix, words

#: Registers of a signature, and how they make bands: at a similarity of 0.8 all 32 bands of 4 miss once in 10**7.
REGISTERS, BANDS = 128, 32
ROWS = REGISTERS // BANDS
#: Words in a shingle; a text of fewer words, but some, is one shingle.
SHINGLE = 5
#: Points drawn at once.
POINTS = 8192

_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Bags(NamedTuple):
    """Multisets of shingles: element hashes with counts, ordered by document and hash, and offsets."""

    hash: np.ndarray
    count: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.at.size - 1), np.diff(self.at))


def shingles(docs: Docs, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in document order, repeats included, and offsets."""
    w = words(docs)
    where, to = gram_spans(w.at, size)
    out = grams(w.hash, size)[where] if where.size else np.empty(0, np.uint64)
    n = np.diff(w.at)
    short = np.flatnonzero((n > 0) & (n < size))
    if short.size:
        whole = np.zeros(short.size, np.uint64)
        for k in range(1, size):
            rows = np.flatnonzero(n[short] == k)
            if rows.size:
                whole[rows] = grams(w.hash, k)[w.at[short[rows]]]
        out = np.insert(out, to[short], whole)
        to = to + np.concatenate([[0], np.cumsum((n > 0) & (n < size))])
    return out, to


def bags(docs: Docs, size: int = SHINGLE) -> Bags:
    hashes, to = shingles(docs, size)
    doc = np.repeat(np.arange(docs.n), np.diff(to))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if hashes.size else np.empty(0, np.int64)
    return Bags(hashes[first], np.diff(np.append(first, hashes.size)), np.searchsorted(first, to))


def identity(b: Bags) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each multiset, for equal multisets equal."""
    out = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D)):
        each = mix(b.hash * salt + b.count.astype(np.uint64) * _STEP)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        out.append(mix(total[b.at[1:]] - total[b.at[:-1]]))
    return out[0], out[1]


def signatures(b: Bags) -> np.ndarray:
    """REGISTERS minima for each multiset (infinite without elements).

    Each element has a Poisson process on the plane of time and weight; a point
    counts for a multiset if its weight is below the element's count there. The
    plane is cut into strips of weight [0, 1), [1, 2), [2, 4), [4, 8) and so on,
    each with a process of its own, so only strips below a count are visited and
    equal elements see equal points whatever their counts. A point falls into one
    register at random and lowers its minimum; an element is done when its next
    point is later than all its document's minima. Two registers agree with the
    probability of the weighted Jaccard similarity. A multiset's minima are the
    same to the last bit whatever others are signed with it.
    """
    n = b.at.size - 1
    minima = np.full((n, REGISTERS), np.inf)
    flat = minima.ravel()
    strips = 1 + np.ceil(np.log2(b.count)).astype(np.int64) if b.count.size else np.empty(0, np.int64)
    row = np.repeat(np.arange(b.hash.size), strips)
    level = np.arange(row.size) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(b.hash[row] + level.astype(np.uint64) * _SALT)
    doc, weight, time = b.doc[row], b.count[row].astype(np.float64), np.zeros(row.size)
    step = 0
    while row.size:
        k = max(1, POINTS // row.size)
        for first in range(0, row.size, max(POINTS * 8, 1)):
            part = slice(first, first + POINTS * 8)
            point = mix(seed[part, None] + np.arange(step + 1, step + k + 1, dtype=np.uint64) * _STEP)
            u = ((point >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            # Added one after another from the time reached, so that rounding doesn't depend on how many are drawn at once.
            times = np.cumsum(np.concatenate([time[part, None], -np.log(u) / width[part, None]], axis=1), axis=1)[:, 1:]
            point = mix(point ^ _SALT)
            height = low[part, None] + width[part, None] * ((point >> np.uint64(12)).astype(np.float64) / 2.0**52)
            register = doc[part, None] * REGISTERS + (point & np.uint64(REGISTERS - 1)).astype(np.int64)
            use = (height < weight[part, None]) & (times < flat[register])
            np.minimum.at(flat, register[use], times[use])
            time[part] = times[:, -1]
        step += k
        keep = time < minima.max(axis=1)[doc]
        row, seed, doc, weight, time, low, width = (v[keep] for v in (row, seed, doc, weight, time, low, width))
    return minima


def bands(minima: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys for each signature."""
    bits = minima.view(np.uint64).reshape(len(minima), BANDS, ROWS)
    out = np.zeros((len(minima), BANDS), np.uint64)
    for j in range(ROWS):
        out = mix(out * _STEP + bits[:, :, j])
    return mix(out + np.arange(BANDS, dtype=np.uint64) * _SALT)


def elements(docs: Docs, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each multiset as a set: the k-th copy of a shingle is an element of its own. Values and offsets."""
    b = bags(docs, size)
    copy = np.arange(int(b.count.sum())) - np.repeat(np.cumsum(b.count) - b.count, b.count)
    ends = np.concatenate([[0], np.cumsum(b.count)])
    return mix(np.repeat(b.hash, b.count) + copy.astype(np.uint64) * _STEP), ends[b.at]


def similarities(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the k-th set on the left and the k-th on the right, for all k; 0 if both are empty."""
    n, a, b = left_at.size - 1, np.diff(left_at), np.diff(right_at)
    pair = np.concatenate([np.repeat(np.arange(n), a), np.repeat(np.arange(n), b)])
    value = np.concatenate([left, right])
    order = np.lexsort((value, pair))
    pair, value = pair[order], value[order]
    equal = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
    shared = np.bincount(pair[1:][equal], minlength=n)
    return shared / np.maximum(a + b - shared, 1)


def registers(minima: np.ndarray) -> np.ndarray:
    """16 bits of each register, to compare signatures by."""
    return (mix(minima.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def pick(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of values that belong to rows, one after another, and their offsets."""
    size = (at[1:] - at[:-1])[rows]
    to = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(to[-1]) + np.repeat(at[rows] - to[:-1], size)], to
