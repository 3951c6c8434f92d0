"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.scratch import map_arrow
from plumbline.llm.vectors import Docs, codepoints, slices, sums

#: Documents that training uses (about; never more than twice as many), by the smallest hashes of their texts; a fifth of them calibrate.
SAMPLE_ROWS = 6_000
#: Languages that can be learned, the most frequent; and n-gram counts that training holds at most.
MOST_LANGUAGES, MOST_COUNTS = 256, 1 << 24
ORDERS, SLOTS = (1, 2, 3), 1 << 16
#: Follow-the-regularised-leader: step, its smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
EPOCHS, BATCH = 4, 64
#: Term frequencies are shares of a document's n-grams, times this.
SCALE = 30.0


def ngrams(docs: Docs) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all character n-grams within each document, ordered by document, and each document's offset."""
    cp, at = codepoints(docs)
    size = np.diff(at)
    counts = np.stack([np.maximum(size - n + 1, 0) for n in ORDERS])
    to = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    out = np.empty(int(to[-1]), dtype=np.int32)
    begin = to[:-1].copy()
    for n, count in zip(ORDERS, counts, strict=True):
        h = cp.astype(np.uint32) * np.uint32(0x9E3779B1)
        for j in range(1, n):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + cp[j:] * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) + np.uint32(n)
        h ^= h >> np.uint32(16)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(begin, count) + step] = (h[np.repeat(at[:-1], count) + step] & np.uint32(SLOTS - 1)).astype(np.int32)
        begin += count
    return out, to


def has_letter(docs: Docs) -> np.ndarray:
    """Whether each document has a letter."""
    ascii_letter = ((docs.data | 32) >= 97) & ((docs.data | 32) <= 122)
    found = sums(ascii_letter, docs.at) > 0
    for i in np.flatnonzero(~found & (sums(docs.data >= 128, docs.at) > 0)):
        found[i] = any(c.isalpha() for c in docs.data[docs.at[i] : docs.at[i + 1]].tobytes().decode())
    return found


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each slot occurs, over all rows; SLOTS numbers at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch.column(0)):
                slot, to = ngrams(part)
                for a in range(0, part.n, 32):
                    seen = np.zeros((min(32, part.n - a), SLOTS), dtype=bool)
                    b = a + seen.shape[0]
                    seen[np.repeat(np.arange(seen.shape[0]), np.diff(to[a : b + 1])), slot[to[a] : to[b]]] = True
                    total += seen.sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, SLOTS)), pa.array(np.append(total[some], n))], names=["slot", "n"])

    rows = map_arrow(docs.select(text), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out[:SLOTS], int(out[SLOTS])


class Model:
    """Weights by slot and class, with the inverse document frequencies folded in."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.classes, self.weights, self.bias, self.temperature = classes, weights.astype(np.float32), bias, 1.0

    def logits(self, docs: Docs) -> np.ndarray:
        slot, to = ngrams(docs)
        total = np.stack([sums(np.ascontiguousarray(self.weights[:, k])[slot], to) for k in range(len(self.classes))], axis=1)
        return SCALE * total / np.maximum(np.diff(to), 1)[:, None] + self.bias

    def predict(self, docs: Docs) -> tuple[list[str], np.ndarray]:
        p = _softmax(self.logits(docs) / self.temperature)
        best, letter = p.argmax(axis=1), has_letter(docs)
        names = [self.classes[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
        return names, np.where(letter, p[np.arange(len(p)), best], 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that follow from the accumulated gradients: zero within L1, shrunk by L2."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def counts(docs: Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's different slots in ascending order, how often each occurs, and each document's offset among them."""
    slot, to = ngrams(docs)
    key, n = np.unique(np.repeat(np.arange(docs.n, dtype=np.int64), np.diff(to)) * SLOTS + slot, return_counts=True)
    return (key % SLOTS).astype(np.int32), n.astype(np.int32), np.searchsorted(key, np.arange(docs.n + 1, dtype=np.int64) * SLOTS)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: list[str], idf: np.ndarray) -> Model:
    """Train by minibatches on four fifths of the rows (slots, counts); the rest sets the temperature."""
    rows = [(at, (SCALE * n / max(int(n.sum()), 1) * idf[at]).astype(np.float32)) for at, n in rows]
    k = len(classes)
    z, n = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))
    held = np.arange(len(rows)) % 5 == 0
    learn = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(learn)
        for first in range(0, order.size, BATCH):
            batch = order[first : first + BATCH]
            sizes = [rows[i][0].size + 1 for i in batch]
            slot = np.concatenate([np.append(rows[i][0], SLOTS) for i in batch])
            value = np.concatenate([np.append(rows[i][1], np.float32(1)) for i in batch])
            doc = np.repeat(np.arange(batch.size), sizes)
            used, which = np.unique(slot, return_inverse=True)
            w = _leader(z[used], n[used])
            at = np.concatenate([[0], np.cumsum(sizes)])
            p = _softmax(np.stack([sums(value * w[which, c], at) for c in range(k)], axis=1))
            p[np.arange(batch.size), y[batch]] -= 1
            g = np.stack([np.bincount(which, value * p[doc, c], used.size) for c in range(k)], axis=1)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - sigma * w
            n[used] += g * g
    w = _leader(z, n)
    model = Model(classes, w[:SLOTS] * idf[:, None], w[SLOTS])
    if held.any() and k > 1:
        logits = np.stack([rows[i][1] @ w[rows[i][0]] + w[SLOTS] for i in np.flatnonzero(held)])
        losses = {t: -np.log(_softmax(logits / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 121)}
        model.temperature = min(losses, key=losses.get)
    return model


def _trainer(idf: np.ndarray, most_rows: int):
    """Fit in one task on rows (lang, slots, counts) in their order, as far as they fit into MOST_COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, held = [], [], 0
        for batch in batches:
            slots, n = batch.column(1), batch.column(2)
            for i, name in enumerate(batch.column(0).to_pylist()):
                pair = np.asarray(slots[i].values), np.asarray(n[i].values)
                held += pair[0].size
                if held <= MOST_COUNTS and len(rows) < most_rows:
                    rows.append((pair[0].copy(), pair[1].copy()))
                    names.append(name)
        if rows:
            classes = sorted(set(names))
            place = {c: i for i, c in enumerate(classes)}
            model = fit(rows, np.array([place[c] for c in names]), classes, idf)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of docs: document frequencies from all of them, weights from a bounded sample.

    Half of the sample is dealt evenly over the languages and half by their
    numbers of rows, so a rare language is learned whatever the table's size.
    Rows of a language count by the hash of their text, repeated ones once. The
    n-grams are counted where the texts are and the weights fitted in a task of
    their own; the driver gets counts by slot and language, and the model. Rows
    without text or language teach nothing; with none left, all is `und`.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    per = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not per:
        return Model(["und"], np.zeros((SLOTS, 1)), np.zeros(1))
    df, n = document_frequencies(known, "text")
    idf = np.log((1 + n) / (1 + df)) + 0.1
    share = {r.lang: min(1.0, sample_rows / 2 * (1 / len(per) / r.n + 1 / n)) for r in per}
    limit = F.element_at(F.create_map(*[F.lit(v) for name, part in share.items() for v in (name, int(part * (1 << 30)))]), F.col("lang"))
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sample = known.where(F.col("lang").isin(*share)).withColumn("order", order).where(F.col("order") < limit).dropDuplicates(["text", "lang"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                slot, times, at = counts(part)
                offsets = pa.array(at.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (slot, times)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, part.n) for c in (1, 2)), *lists], names=["lang", "order", "slots", "counts"])

    rows = map_arrow(sample.select("text", "lang", "order"), counted, "lang string, order long, slots array<int>, counts array<int>")
    # At most some thousand rows meet here, in the order of their hashes.
    rows = rows.repartition(1).sortWithinPartitions("order", "lang").select("lang", "slots", "counts")
    got = map_arrow(rows, _trainer(idf, 2 * sample_rows), "model binary").collect()
    return pickle.loads(got[0].model) if got else Model(["und"], np.zeros((SLOTS, 1)), np.zeros(1))


def languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row (all columns of docs), lang_pred and score for every row.

    Null texts and texts without a letter are `und` with score 0; other scores
    are the calibrated probability of the language named; of languages that
    tie, the first by name. Repeated rows get equal results; a long text is read
    whole, in a slice of its own; an empty table gives an empty one; columns of
    docs may have any names. If nothing was to learn from, every text is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0).field(place)):
                names, score = shared.value.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return map_arrow(rows, predict, T.StructType([rows.schema["row"]]).add("lang_pred", T.StringType()).add("score", T.DoubleType()))
