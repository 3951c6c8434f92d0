"""Byte-level BPE through pre-tokens, vectorised.

A byte-level BPE never merges across pre-tokens, so a text's ids are the ids of
its pre-tokens in a row. A slice of documents is split into pre-tokens with
array operations; pre-tokens that the offline proof or a bounded memory knows
are looked up by hash, and only the rest goes through the tokenizers library.
Texts with characters whose class the Unicode versions differ about, or with a
special token's string, go through the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from plumbline.llm.vectors import Docs, hash_spans, slices

#: The split pattern of byte-level BPE, and the code points whose
#: classes are settled in every Unicode version in use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = ((0x0000, 0x052F), (0x0620, 0x06D3), (0x2010, 0x205E), (0x20A0, 0x20AC), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))

#: A vocabulary file is broadcast whole; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Slots of a worker's memory of pre-tokens, and the most ids of one that a slot holds.
SLOTS, WIDTH = 1 << 20, 10
#: Bytes of text encoded at once; small, as an executor may keep more workers than cores.
CHUNK = 1 << 17
#: Strings of the vocabulary proved at once.
PROVED = 2048
LETTER, NUMBER, OTHER, SPACE, UNSETTLED = range(5)


def read_vocabulary(path: str) -> str:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


def whole_tokens(vocabulary: str) -> dict[str, int]:
    """The strings of the vocabulary that, as a pre-token, encode to one id.

    This is the offline proof: each string is split and encoded on its own, and
    only those that stay one pre-token and one id are kept.
    """
    tokenizer = Tokenizer.from_str(vocabulary)
    pattern = regex.compile(PATTERN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    out: dict[str, int] = {}
    for first in range(0, tokenizer.get_vocab_size(), PROVED):
        ids = range(first, min(first + PROVED, tokenizer.get_vocab_size()))
        texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
        texts = [t for t in dict.fromkeys(texts) if t and "\ufffd" not in t and t not in special and pattern.findall(t) == [t]]
        encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        out |= {t: e.ids[0] for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1}
    return out


def proved_vocabulary(spark: SparkSession, path: str) -> tuple[str, pa.Array, pa.Array]:
    """What the encoders need: the vocabulary file's text, and the strings that are whole tokens with their ids.

    The proof runs in a task of its own, so the driver never holds a tokenizer;
    it gets at most a row for each string of a file of bounded size.
    """
    vocabulary = read_vocabulary(path)
    shared = spark.sparkContext.broadcast(vocabulary)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            whole = whole_tokens(shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([*whole], pa.string()), pa.array([*whole.values()], pa.int64())], names=["text", "id"])

    found = spark.range(0, 1, 1, 1).mapInArrow(prove, "text string, id long").toArrow().combine_chunks()
    shared.destroy()
    return vocabulary, pa.array(found["text"].combine_chunks()), pa.array(found["id"].combine_chunks())


def _classes() -> np.ndarray:
    """Class of each code point below 0x10000; from there on none is settled."""
    table = np.full(0x10001, UNSETTLED, dtype=np.uint8)
    for first, last in SETTLED:
        run = "".join(map(chr, range(first, last + 1)))
        table[first : last + 1] = OTHER
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            table[[first + m.start() for m in regex.finditer(pattern, run)]] = kind
    return table


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, 0x10000 for all beyond, and the byte each begins at."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[lead].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2)):
        rows = np.flatnonzero((data[lead] >= least) & (data[lead] < (least >> 1 | 0x80 | least)))
        value = cp[rows] & mask
        for j in range(1, more + 1):
            value = value << 6 | padded[lead[rows] + j] & 0x3F
        cp[rows] = value
    cp[data[lead] >= 0xF0] = 0x10000
    return cp, lead


def boundaries(docs: Docs, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens start, each document's offset among them, and which documents are unsettled."""
    cp, lead = _points(docs.data)
    kind = classes[cp]
    begin = np.searchsorted(lead, docs.at)  # each document's first character
    n = cp.size
    odd = np.zeros(docs.n, dtype=bool)
    if unsettled := np.flatnonzero(kind == UNSETTLED).tolist():
        odd[np.searchsorted(begin, unsettled, "right") - 1] = True
    edge = np.zeros(n + 1, dtype=bool)
    edge[begin] = True
    edge[n] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # White space before something else gives up its last character, which joins what follows if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n]) if n else np.empty(0, np.int64)
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # A contraction begins where a run of other characters begins with an apostrophe.
    quote = np.flatnonzero(start[:n] & (cp == 39))
    if quote.size:
        ahead = np.concatenate([cp, np.zeros(3, cp.dtype)])
        free = np.concatenate([~edge, np.zeros(3, bool)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        near = free[quote + 1]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        long = near & free[quote + 2] & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        for rows, size in ((quote[short], 2), (quote[long], 3)):
            start[rows + 1] = False
            after = rows + size
            start[after] |= True
    start = np.flatnonzero(start[:n])
    return np.append(lead, docs.data.size)[start], np.searchsorted(start, begin), odd


class Memory(NamedTuple):
    """A direct-mapped table: what a pre-token is, and its ids. Of two in a slot the later stays."""

    key: np.ndarray
    check: np.ndarray
    count: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, slots: int, width: int, ids: int) -> Memory:
        kind = np.uint16 if ids <= 1 << 16 else np.uint32
        return cls(np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.uint8), np.zeros((slots, width), kind))

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (key & np.uint64(self.key.size - 1)).astype(np.int64)
        return slot, (self.key[slot] == key) & (self.check[slot] == check)

    def put(self, key: np.ndarray, check: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Remember spans whose ids stand in flat one after another; those too long for a slot are left out."""
        base, short = np.cumsum(size) - size, np.flatnonzero(size <= self.ids.shape[1])
        slot, one = np.unique((key[short] & np.uint64(self.key.size - 1)).astype(np.int64), return_index=True)
        rows = short[one]
        self.key[slot], self.check[slot], self.count[slot] = key[rows], check[rows], size[rows]
        for j in range(self.ids.shape[1]):
            more = size[rows] > j
            slot, rows = slot[more], rows[more]
            self.ids[slot, j] = flat[base[rows] + j]


def _identity(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each span: a hash of it, and its first 8 bytes with its length. Up to 8 bytes they are exact."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[start].view(np.uint64)[:, 0]
    size = end - start
    first = np.where(size < 8, first & ((np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1)), first)
    return hash_spans(data, start, end), first ^ (size.astype(np.uint64) << np.uint64(56)) ^ (size.astype(np.uint64) << np.uint64(17))


class Encoder:
    """Ids of texts; one per worker and vocabulary. Its memory is of fixed size."""

    def __init__(self, vocabulary: str, texts: pa.Array, ids: pa.Array) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = regex.compile(b"|".join(regex.escape(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.classes = _classes()
        n = self.tokenizer.get_vocab_size()
        self.whole, self.seen = Memory.of(1 << 18, 1, n), Memory.of(SLOTS, WIDTH, n)
        if len(texts):
            (docs,) = slices(texts, 1 << 62, len(texts))
            self.whole.put(*_identity(docs.data, docs.at[:-1], docs.at[1:]), np.asarray(ids, np.uint32), np.ones(len(texts), np.int64))

    def slice(self, docs: Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slice of documents, each document's offset among them, and its number of whole tokens."""
        start, at, odd = boundaries(docs, self.classes)
        for hit in self.special.finditer(docs.data.tobytes()):
            odd[np.searchsorted(docs.at, hit.start(), "right") - 1] = True
        end = np.append(start[1:], docs.data.size)
        key, check = _identity(docs.data, start, end)
        slot, known = self.whole.find(key, check)
        n = np.where(known, 1, 0)
        whole = np.bincount(np.repeat(np.arange(docs.n), np.diff(at)), weights=known, minlength=docs.n).astype(np.int64)
        rest = np.flatnonzero(~known)
        place, seen = self.seen.find(key[rest], check[rest])
        n[rest[seen]] = self.seen.count[place[seen]]
        new = rest[~seen]
        _, one, which = np.unique(key[new], return_index=True, return_inverse=True)
        text = docs.data.tobytes()
        spans = zip(start[new[one]].tolist(), end[new[one]].tolist(), strict=True)
        fresh = [e.ids for e in self.tokenizer.encode_batch_fast([text[a:b].decode() for a, b in spans], add_special_tokens=False)]
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        flat = np.fromiter(chain.from_iterable(fresh), np.uint32, int(sizes.sum()))
        n[new] = sizes[which]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = np.empty(int(to[-1]), dtype=np.uint32)
        ids[to[:-1][known]] = self.whole.ids[slot[known], 0]
        old, place = rest[seen], place[seen]
        first = to[old]
        for j in range(WIDTH):
            more = self.seen.count[place] > j
            first, place = first[more], place[more]
            ids[first + j] = self.seen.ids[place, j]
        if new.size:
            base, size = np.cumsum(sizes) - sizes, n[new]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ids[np.repeat(to[new], size) + step] = flat[np.repeat(base[which], size) + step]
            self.seen.put(key[new[one]], check[new[one]], flat, sizes)
        at = to[at]
        if odd.any():
            parts = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
            for i in np.flatnonzero(odd):
                parts[i] = np.array(self.tokenizer.encode(text[docs.at[i] : docs.at[i + 1]].decode(), add_special_tokens=False).ids, dtype=np.uint32)
                whole[i] = 0
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([p.size for p in parts])])
        return ids, at, whole

    def texts(self, column: pa.Array, chunk: int = CHUNK):
        """(first row, last row, ids, offsets, whole tokens) for the slices of a string column."""
        for docs in slices(column, chunk):
            yield docs.first, docs.last, *self.slice(docs)


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: str, texts: pa.Array, ids: pa.Array) -> Encoder:
    """The worker's encoder for this vocabulary and its whole tokens."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, texts, ids)
    return _ENCODERS[key]
