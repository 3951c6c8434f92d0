"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.scratch import map_arrow
from plumbline.llm.vectors import LOWER, Docs, gram_spans, hash_spans, maxima, slices, spans, sums, words

#: Labelled documents that training uses at most, to the row: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 120, 5, 64, 0.1, 10, 1.0


def _in_class(*ranges: tuple[int, int] | int) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for r in ranges:
        table[slice(r[0], r[1] + 1) if isinstance(r, tuple) else r] = True
    return table


#: Shares of bytes that are statistics.
CLASSES = {
    "upper": _in_class((65, 90)),
    "lower": _in_class((97, 122)),
    "digit": _in_class((48, 57)),
    "blank": _in_class(32, 9, 13),
    "newline": _in_class(10),
    "stop": _in_class(46, 63),
    "comma": _in_class(44, 59, 58),
    "bang": _in_class(33),
    "bar": _in_class(124, 95, 61, 126),
    "symbol": _in_class(35, 36, 37, 38, 42, 43, 64, 94, 60, 62, 92, 47),
    "bracket": _in_class(40, 41, 91, 93, 123, 125, 34, 39),
    "high": _in_class((128, 255)),
    "control": _in_class((0, 8), (11, 12), (14, 31), 127),
}
NAMES = [
    *CLASSES, "bytes", "words", "word_bytes", "word_spread", "longest_word", "short_words", "capitalised", "shouted", "distinct", "top_word", "echo", "distinct_pairs",
    "lines", "line_bytes", "line_spread", "repeated_lines", "full_stops_per_word", "same_byte", "glued",
]


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of different values in each document, and how often the most frequent stands there."""
    n = at.size - 1
    bits = max(int(n).bit_length(), 1)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    keys = np.sort((doc << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.empty(0, np.int64)
    run = np.diff(np.append(first, keys.size))
    to = np.searchsorted(first, at)
    return np.diff(to), maxima(run, to)


def _repeats(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each value is that before it in its document."""
    out = np.zeros(values.size, dtype=bool)
    out[1:] = values[1:] == values[:-1]
    out[at[:-1][at[:-1] < values.size]] = False
    return out


def statistics(docs: Docs) -> np.ndarray:
    """A row of NAMES for each document, whatever stands beside it; texts without bytes give zeros."""
    data, at, size = docs.data, docs.at, np.diff(docs.at)
    per_byte = 1 / np.maximum(size, 1)
    out = {name: sums(table[data], at) * per_byte for name, table in CLASSES.items()}
    w = words(docs)
    n, length = np.diff(w.at), w.end - w.start
    per_word = 1 / np.maximum(n, 1)
    mean = sums(length, w.at) * per_word
    first = data[w.start] if w.start.size else np.empty(0, np.uint8)
    capital = (first >= 65) & (first <= 90)
    loud = np.concatenate([[0], np.cumsum(CLASSES["upper"][data], dtype=np.int64)])
    distinct, top = _distinct(w.hash, w.at)
    where, to = gram_spans(w.at, 2)
    pairs, _ = _distinct(w.hash[where] * np.uint64(3) + w.hash[where + 1], to)
    same = _repeats(w.hash, w.at)
    begin, end = spans(data != 10, at)
    of = np.searchsorted(begin, at)
    lines = np.diff(of)
    per_line = 1 / np.maximum(lines, 1)
    line_mean = sums(end - begin, of) * per_line
    different, _ = _distinct(hash_spans(LOWER[data], begin, end), of)
    equal = _repeats(data, at)
    ends = np.where(w.end < np.repeat(at[1:], n), np.append(data, np.uint8(32))[w.end], np.uint8(32))
    out |= {
        "bytes": np.log1p(size),
        "words": np.log1p(n),
        "word_bytes": mean,
        "word_spread": np.sqrt(np.maximum(sums(length * length, w.at) * per_word - mean * mean, 0)),
        "longest_word": maxima(length, w.at),
        "short_words": sums(length <= 3, w.at) * per_word,
        "capitalised": sums(capital, w.at) * per_word,
        "shouted": sums(loud[w.end] - loud[w.start] > 1, w.at) * per_word,
        "distinct": distinct * per_word,
        "top_word": top * per_word,
        "echo": sums(same, w.at) * per_word,
        "distinct_pairs": pairs * per_word,
        "lines": np.log1p(lines),
        "line_bytes": np.log1p(line_mean),
        "line_spread": np.log1p(np.sqrt(np.maximum(sums((end - begin) ** 2, of) * per_line - line_mean**2, 0))),
        "repeated_lines": 1 - different * per_line,
        "full_stops_per_word": sums(CLASSES["stop"][data], at) * per_word,
        "same_byte": sums(equal, at) * per_byte,
        "glued": sums(CLASSES["symbol"][ends] | CLASSES["bang"][ends], w.at) * per_word,
    }
    return np.stack([out[name] for name in NAMES], axis=1).astype(np.float32)


def featurise(column: pa.Array) -> np.ndarray:
    parts = [statistics(docs) for docs in slices(column)]
    return np.concatenate(parts) if parts else np.empty((0, len(NAMES)), np.float32)


class Trees:
    """Boosted trees as flat arrays: node i of a tree splits on feature[t, i] and has children 2i+1 and 2i+2."""

    def __init__(self, base: float) -> None:
        self.base = base
        self.feature = np.empty((0, 2**DEPTH - 1), np.int64)
        self.limit = np.empty((0, 2**DEPTH - 1), np.float32)
        self.leaf = np.empty((0, 2**DEPTH), np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base, dtype=np.float64)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost TREES level-wise trees of DEPTH on the logistic loss, over BINS quantile bins."""
    share = float(np.clip(y.mean() if y.size else 0.5, 0.01, 0.99))
    model = Trees(float(np.log(share / (1 - share))))
    if y.size < 2 * LEAST or y.min() == y.max():
        return model
    n, m = x.shape
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(m)]).astype(np.float32)
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1)
    flat = binned + np.arange(m) * BINS
    margin = np.full(n, model.base)
    features, limits, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node, feature, limit = np.zeros(n, np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            g, h, c = (np.bincount(at, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2) for v in (grad, hess, np.ones(n)))
            whole = [v[:, :, -1:] for v in (g, h, c)]
            gain = g**2 / (h + RIDGE) + (whole[0] - g) ** 2 / (whole[1] - h + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(c < LEAST) | (whole[2] - c < LEAST)] = -np.inf
            gain[:, :, -1] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            j, b = best // BINS, best % BINS
            feature[first : first + width] = np.where(good, j, 0)
            limit[first : first + width] = np.where(good, edges[j, np.minimum(b, BINS - 2)], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + RIDGE)
        margin += value[leaf]
        features.append(feature), limits.append(limit), leaves.append(value)
    model.feature, model.limit, model.leaf = np.stack(features), np.stack(limits), np.stack(leaves).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, learn=None) -> Trees:
    """Fit on at most sample_rows labelled documents of those that `learn` (a condition on the id) admits.

    A document is a doc_id: of rows that repeat one, that with the smallest
    statistics counts. Statistics are taken where the texts are, and the trees
    grow in a task of their own, so the driver gets the model alone.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.where(learn(F.col(doc_id))) if learn is not None else known
    known = known.groupBy(F.col(doc_id).alias("label_id")).agg(F.max(label).cast("double").alias("y"))
    order = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30))
    share = 1.2 * sample_rows / max(known.count(), 1)
    known = known.withColumn("order", order).where(F.col("order") <= share * (1 << 30)).orderBy("order", "label_id").limit(sample_rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = featurise(batch.column(3))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["label_id", "order", "y", "x"])

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("label_id", "ascending")]).combine_chunks()
        x = np.asarray(table["x"].combine_chunks().flatten()).reshape(len(table), -1)
        return pa.table({"model": pa.array([pickle.dumps(fit(x, table["y"].to_numpy()))], pa.binary())})

    # The sampled labels are at most sample_rows rows of three numbers.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), F.col("id") == F.col("label_id")).select("label_id", "order", "y", "text")
    kind = labels.schema[doc_id].dataType.simpleString()
    one = map_arrow(rows, measured, f"label_id {kind}, order long, y double, x array<float>").groupBy("label_id", "order", "y").agg(F.min("x").alias("x"))
    got = one.groupBy().applyInArrow(grow, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit(np.empty((0, len(NAMES))), np.empty(0))


def with_quality(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """row (all columns of docs) and score, 0 to 1, for every row; null and empty texts are scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(featurise(batch.column(0).field(place)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    return map_arrow(rows, scored, T.StructType([rows.schema["row"]]).add("score", T.DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7, learn=None) -> DataFrame:
    """row, score and predicted (1 if score >= threshold, else 0) for every row of docs.

    Learns from labels (doc_id, quality 0/1; others and null ids are left out, a
    doc_id labelled twice counts once with its larger label) of documents that
    `learn` admits; without usable labels every score is 0.5. Only texts enter a
    score, so repeated rows get equal ones and rows of equal statistics tie;
    null, empty and wordless texts are scored as they are, long ones whole, in a
    slice of their own. An empty table gives an empty one; all columns of docs,
    whatever their names, are kept in the struct `row`.
    """
    model = train(docs, labels, text, doc_id, learn=learn)
    return with_quality(docs, model, text).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
