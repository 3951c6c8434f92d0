"""Benchmark passages in documents by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.scratch import map_arrow, store
from plumbline.llm.vectors import LOWER, Docs, Words, gram_spans, grams, slices, spans, words

#: A shared span of GRAM + WINDOW - 1 words has a fingerprint in common, so SPAN words are never missed.
SPAN, GRAM = 10, 6
WINDOW = SPAN - GRAM + 1
#: Bytes of benchmark text that one pass looks for; a larger benchmark takes several. Its index takes about 7 bytes
#: for each (35 a word: 7 of text, 4 of offset, 20 of window, 4 of fingerprint) and SIEVE bytes, in each worker.
BLOCK_BYTES = 16 << 20
SIEVE = 1 << 22
#: Windows compared byte by byte at once.
COMPARED = 1 << 14


def fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the winnowed grams: the smallest (last of equals) of each WINDOW grams in a text.

    Texts of SPAN words or more have all their windows covered; others none.
    """
    gram = grams(hashes, GRAM)
    n = gram.size - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low, pick = gram[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW):
        lower = gram[j : j + n] <= low
        low = np.where(lower, gram[j : j + n], low)
        pick[lower] = j
    inside = np.zeros(n, dtype=bool)  # windows that lie within one text
    for a, b in zip(at[:-1], at[1:], strict=True):
        inside[a : max(a, b - SPAN + 1)] = True
    chosen = np.zeros(gram.size, dtype=bool)
    chosen[(np.arange(n) + pick)[inside]] = True
    return np.flatnonzero(chosen)


def joined(docs: Docs, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased words one after another with a blank behind each, and where each begins (and the end)."""
    size = w.end - w.start
    start = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(start[-1]), 32, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start[:-1], size) + step] = LOWER[docs.data[np.repeat(w.start, size) + step]]
    return out, start


class Text:
    """Words as one run of bytes, so that a window of words is a range of it."""

    def __init__(self, data: np.ndarray, start: np.ndarray) -> None:
        self.data, self.start = data, start

    def same(self, at: np.ndarray, other: Text, there: np.ndarray, k: int) -> np.ndarray:
        """Whether the k words at each place are those at the place in the other text, compared byte by byte."""
        out = np.zeros(at.size, dtype=bool)
        for first in range(0, at.size, COMPARED):
            p, q = at[first : first + COMPARED], there[first : first + COMPARED]
            size = self.start[p + k] - self.start[p]
            equal = np.flatnonzero(size == other.start[q + k] - other.start[q])
            p, q, size = self.start[p[equal]], other.start[q[equal]], size[equal]
            ends = np.cumsum(size)
            step = np.arange(int(size.sum())) - np.repeat(ends - size, size)
            differ = self.data[np.repeat(p, size) + step] != other.data[np.repeat(q, size) + step]
            total = np.concatenate([[0], np.cumsum(differ)])
            out[first + equal] = total[ends] == total[ends - size]
        return out


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A table over the low bits of hashes: False where no key has them."""
    sieve = np.zeros(SIEVE, dtype=bool)
    sieve[(keys & np.uint64(SIEVE - 1)).astype(np.int64)] = True
    return sieve


class Windows:
    """The different windows of k words of a block: hash, one place of each, and the items that have it."""

    def __init__(self, k: int, text: Text, place: np.ndarray, hashes: np.ndarray, item: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        place, hashes, item = place[order], hashes[order], item[order]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        head = place[np.maximum.accumulate(np.where(first, np.arange(place.size), 0))]
        # Windows of one hash and other words stand for themselves.
        first |= ~text.same(place, text, head, k)
        of = np.cumsum(first) - 1
        pair = np.unique(np.stack([of, item]), axis=1)
        self.k, self.hash, self.place = k, hashes[first], place[first].astype(np.int32)
        self.item, self.at = pair[1].astype(np.int32), np.searchsorted(pair[0], np.arange(self.hash.size + 1)).astype(np.int32)

    def find(self, hashes: np.ndarray, at: np.ndarray, text: Text, own: Text) -> tuple[np.ndarray, np.ndarray]:
        """Of places in a text with the hashes of their windows, those whose window is here, and its number."""
        low, high = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        found, which, step = [at[:0]], [low[:0]], 0
        while (some := np.flatnonzero(low + step < high)).size:  # nearly always once
            window = low[some] + step
            hit = text.same(at[some], own, self.place[window], self.k)
            found.append(at[some[hit]])
            which.append(window[hit])
            step += 1
        return np.concatenate(found), np.concatenate(which)


class Index:
    """A bounded block of benchmark texts as flat arrays: fingerprints, and windows to verify what they find."""

    def __init__(self, names: pa.Array, texts: pa.Array) -> None:
        self.names = sorted({n for n in names.to_pylist() if n is not None})
        number = {n: i for i, n in enumerate(self.names)}
        of = np.array([number.get(n, -1) for n in names.to_pylist()], dtype=np.int64)  # -1: an item without an id
        hashes, parts, starts, at, base = [], [], [], [np.zeros(1, np.int64)], 0
        for docs in slices(texts):
            w = words(docs)
            data, start = joined(docs, w)
            hashes.append(w.hash)
            parts.append(data)
            starts.append(start[:-1] + base)
            at.append(w.at[1:] + at[-1][-1])
            base += data.size
        empty = np.empty(0, np.uint64)
        hashes, at = np.concatenate([empty, *hashes]), np.concatenate(at)
        self.text = Text(np.concatenate([np.empty(0, np.uint8), *parts]), np.concatenate([*starts, [base]]).astype(np.int64))
        size = np.diff(at)
        self.windows: list[Windows] = []
        for k in range(1, SPAN + 1):
            some = np.flatnonzero(size == k if k < SPAN else size >= SPAN)
            if some.size:
                where, to = gram_spans(at, k)
                item = np.repeat(np.arange(size.size), np.diff(to))
                mine = np.isin(item, some)
                self.windows.append(Windows(k, self.text, where[mine], grams(hashes, k)[where[mine]], of[item[mine]]))
        self.fingerprints = np.unique(grams(hashes, GRAM)[fingerprints(hashes, at)]) if hashes.size >= GRAM else empty
        self.sieves = {w.k: _sieve(self.fingerprints if w.k == SPAN else w.hash) for w in self.windows}

    def _places(self, window: Windows, w: Words, gram: np.ndarray) -> np.ndarray:
        """Where in a slice a window may stand: around shared fingerprints, or at the hash of a short item."""
        keys = gram if window.k < SPAN else grams(w.hash, GRAM)
        near = np.flatnonzero(self.sieves[window.k][(keys & np.uint64(SIEVE - 1)).astype(np.int64)])
        if window.k < SPAN or not near.size:
            return near
        # Only around possible hits is it worth winnowing. Each shared window holds a fingerprint of both sides.
        near = np.intersect1d(near, fingerprints(w.hash, w.at), assume_unique=True)
        at = np.minimum(np.searchsorted(self.fingerprints, keys[near]), self.fingerprints.size - 1)
        near = near[self.fingerprints[at] == keys[near]]
        return np.unique(near[:, None] - np.arange(WINDOW))

    def match(self, docs: Docs) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of a slice, which of them are hit, and the pairs (document, item) found."""
        w = words(docs)
        cover = np.zeros(w.hash.size + 1, np.int64)
        pairs, own = [np.empty((2, 0), np.int64)], None
        for window in self.windows:
            gram = grams(w.hash, window.k)
            at = self._places(window, w, gram)
            at = at[(at >= 0) & (at < gram.size)]
            doc = np.searchsorted(w.at, at, "right") - 1
            inside = at + window.k <= w.at[doc + 1]
            at = at[inside]
            if not at.size:
                continue
            if own is None:
                own = Text(*joined(docs, w))
            at, which = window.find(gram[at], at, own, self.text)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window.k, -1)
            # Each window once for each document, however often it stands there.
            doc, which = np.unique(np.stack([np.searchsorted(w.at, at, "right") - 1, which]), axis=1)
            n = window.at[which + 1] - window.at[which]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.stack([np.repeat(doc, n), window.item[np.repeat(window.at[which], n) + step]]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return w, np.cumsum(cover[:-1]) > 0, pairs[:, pairs[1] >= 0]


_FOUND = T.StructType().add("n_words", T.LongType()).add("spans", T.ArrayType(T.ArrayType(T.LongType()))).add("items", T.ArrayType(T.StringType()))


def _blocks(benchmark: DataFrame, text: str, item_id: str, block_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of the benchmark in blocks of about block_bytes, fetched one at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).toArrow().combine_chunks()
        yield pa.array(part["id"].combine_chunks()), pa.array(part["text"].combine_chunks())


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs, and a struct `found`: n_words, spans of words hit, ids of items found.

    A window is SPAN consecutive words of an item, or the whole item if it has
    fewer but some; windows that occur in a document hit their words there.
    Null, empty and wordless texts have no hits; long ones are searched whole.
    An item without an id hits words like any other but is in no list of ids;
    items without text are left out; repeated items count once; an empty table
    on either side gives no hits. Columns of docs named like a result are kept
    apart by the struct.

    The benchmark is broadcast in blocks of about block_bytes (an item is never
    split), and every worker holds the index of one block at a time: a further
    block is looked for in a job of its own, over the stored results of the one
    before. Nothing is shuffled.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(None).cast(_FOUND).alias("found"))
    schema, place = out.schema, docs.columns.index(text)
    for k, block in enumerate(_blocks(benchmark, item_text, item_id, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = map_arrow(store(out, "passages") if k else out, _matcher(shared, place), schema)
    return out


_INDEX: list = [None, None]  # the worker's last block, and its index


def _old_spans(before: pa.Array, w: Words, hit: np.ndarray) -> dict[int, list[str]]:
    """Add the words that earlier blocks hit; returns the items that these found in each document."""
    items = {}
    for i, old in enumerate(before if before.null_count < len(before) else ()):
        if old.is_valid:
            for a, b in old["spans"].as_py():
                hit[w.at[i] + a : w.at[i] + b] = True
            if found := old["items"].as_py():
                items[i] = found
    return items


def _matcher(shared, place: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _INDEX[0] is not shared.value:
            _INDEX[:] = None, None
            _INDEX[:] = shared.value, Index(*shared.value)
        index = _INDEX[1]
        names = np.array(index.names, dtype=object)
        for batch in batches:
            for docs in slices(batch.column(0).field(place)):
                before = batch.column(1).slice(docs.first, docs.n)
                w, hit, (doc, item) = index.match(docs)
                more = _old_spans(before, w, hit)
                begin, end = spans(hit, w.at)
                at = np.searchsorted(begin, w.at)
                base = np.repeat(w.at[:-1], np.diff(at))
                ends = np.stack([begin - base, end - base], axis=1).ravel()
                pair = pa.ListArray.from_arrays(pa.array(np.arange(0, ends.size + 1, 2, dtype=np.int32)), pa.array(ends.astype(np.int64)))
                items = [list(x) for x in np.split(names[item], np.searchsorted(doc, np.arange(1, docs.n)))] if docs.n else []
                for i, old in more.items():
                    items[i] = sorted({*old, *items[i]})
                columns = [pa.array(np.diff(w.at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pair), pa.array(items, pa.list_(pa.string()))]
                found = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, before.type, strict=True)], fields=list(before.type))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(docs.first, docs.n), found], names=["row", "found"])

    return match


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs, repeated ones too.

    items_sha256 is over the ids of items found, sorted as strings and joined by
    commas; without any it is that of the empty string. See find_passages.
    """
    found = find_passages(docs.select(F.col(options.pop("doc_id", "doc_id")).alias("doc_id"), F.col(options.pop("text", "text")).alias("text")), benchmark, **options)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def digest(ids: list[str]) -> str:
    """items_sha256 of a list of ids, for tests and callers without Spark."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept whatever their names, in which no benchmark window occurs.

    Null, empty and wordless texts stay, long ones are searched whole, repeated
    rows share one fate, an empty table gives an empty one; see find_passages.
    """
    return find_passages(docs, benchmark, **options).where(F.size("found.spans") == 0).select("row.*")
