"""Simple-8b: integers packed into 64-bit words.

The high 4 bits of a word select how many values its low 60 bits hold, each of
the same width. A value of over 60 bits is an escape: selector 15, then the
value in a word of its own. Encoding and decoding are vectorised but for the
walk from word to word.
"""

from __future__ import annotations

import numpy as np

#: Selector -> (values in a word, bits of each).
LAYOUT = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 15
_COUNT = np.array([0, *(c for c, _ in LAYOUT.values()), 1])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    bits = np.ones(values.size, dtype=np.uint8)
    for shift in range(1, 64):
        more = values >> np.uint64(shift)
        if not more.any():
            break
        bits += more != 0
    return bits


def encode(ids: np.ndarray) -> np.ndarray:
    """The words that hold the ids; the number of ids is kept elsewhere."""
    values = np.ascontiguousarray(ids, dtype=np.uint64)
    n = values.size
    if not n:
        return np.empty(0, np.uint64)
    bits = _widths(values)
    # The selector with most values that fits, at each position; the last word may be filled up with zeros.
    selector = np.full(n, ESCAPE, dtype=np.uint8)
    selector[bits <= 60] = 14
    least = int(bits.min())
    window, width = bits, 1  # maximum over the next `width` values
    for s in range(13, 0, -1):
        count, most = LAYOUT[s]
        if most < least:
            break
        while width < count:
            step = min(width, count - width)
            ahead = np.zeros(n, np.uint8)
            ahead[: n - step] = window[step:] if step < n else 0
            window = np.maximum(window, ahead)
            width += step
        fits = window <= most
        if not fits.any():  # then no longer run of narrower values fits either
            break
        selector[fits] = s
    leap = _COUNT[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += leap[i]
    at = np.array(starts)
    chosen = selector[at]
    escaped = chosen == ESCAPE
    place = np.arange(at.size) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    words = np.zeros(at.size + int(escaped.sum()), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[rows]] = np.uint64(ESCAPE << 60)
            words[place[rows] + 1] = values[at[rows]]
            continue
        count, most = LAYOUT[int(s)]
        word = np.full(rows.size, int(s) << 60, dtype=np.uint64)
        for j in range(count):
            word |= padded[at[rows] + j] << np.uint64(j * most)
        words[place[rows]] = word
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the words."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    if (selector == ESCAPE).any() or (selector == 0).any():  # the words after an escape hold plain values
        plain = np.zeros(words.size, dtype=bool)
        for i in np.flatnonzero(selector == ESCAPE):
            if not plain[i]:
                plain[i + 1] = True
        place = np.flatnonzero(~plain)
    else:
        place = np.arange(words.size)
    selector = selector[place]
    to = np.concatenate([[0], np.cumsum(_COUNT[selector])])
    out = np.zeros(max(int(to[-1]), n), dtype=np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[to[rows]] = words[place[rows] + 1]
            continue
        count, most = LAYOUT[int(s)]
        mask, word = np.uint64((1 << most) - 1), words[place[rows]]
        for j in range(count):
            out[to[rows] + j] = (word >> np.uint64(j * most)) & mask
    return out[:n]
