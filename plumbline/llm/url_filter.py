"""URL verdicts: rules on host and path, else the ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.scratch import map_arrow, store
from plumbline.llm.vectors import Docs, grams, mix, slices, sums

#: Fixed values: (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Longest context of the models, the weight of the shorter context, and the key of the empty context.
ORDER, BACKOFF, ALL = 4, 2.0, np.uint64(1)
FOLDS = 5
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?`` or ``#``; both empty without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is the longest
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _keys(docs: Docs) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: position of a character, 64-bit key of its n-gram, key of its context."""
    values = mix(docs.data.astype(np.uint64) + np.uint64(1))
    out = []
    position = np.arange(values.size) - np.repeat(docs.at[:-1], np.diff(docs.at))
    for k in range(ORDER + 1):
        gram = mix(grams(values, k + 1) + np.uint64(2 * k))
        context = mix(grams(values, k) + np.uint64(2 * k + 1))[: gram.size] if k else np.full(gram.size, ALL)
        inside = np.flatnonzero(position[k:] >= k)
        out.append((inside + k, gram[inside], context[inside]))
    return out


class Model:
    """Counts of the n-grams and contexts of some URLs among accepted and rejected ones; interpolated from order 0 to ORDER."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[:, order].astype(np.float64)
        # The larger side is smoothed as if it were no larger.
        size = np.maximum(size, 1)
        self.backoff = BACKOFF * size / size.min()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys on both sides; 0 for those never counted."""
        if not self.keys.size:
            return np.zeros((2, keys.size))
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[at] == keys, self.counts[:, at], 0.0)

    def ratio(self, docs: Docs) -> np.ndarray:
        """Log-likelihood of each URL as accepted less that as rejected, for each character."""
        p = np.full((2, docs.data.size), 1 / 256)
        weight = self.backoff[:, None]
        for at, gram, context in _keys(docs):
            p[:, at] = (self.find(gram) + weight * p[:, at]) / (self.find(context) + weight)
        return sums(np.log(p[0]) - np.log(p[1]), docs.at) / np.maximum(np.diff(docs.at), 1)


def _text(url: Column) -> Column:
    """What the models read: what follows ``://`` (all if there is none), between marks of its ends."""
    at = F.instr(url, "://")
    body = F.coalesce(F.when(at > 0, F.substr(url, at + 3)).otherwise(url), F.lit(""))
    return F.concat(F.lit("\x02"), body, F.lit("\x03"))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """key, yes and no: how often each n-gram and each context stands in accepted and in rejected URLs (text, accepted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for docs in slices(batch.column(0)):
                side = np.repeat(accepted[docs.first : docs.last], np.diff(docs.at))
                found = _keys(docs)
                at = np.concatenate([at for at, _, _ in found] * 2)
                key, of = np.unique(np.concatenate([g for _, g, _ in found] + [c for _, _, c in found]), return_inverse=True)
                total = [np.bincount(of[side[at] == s], minlength=key.size) for s in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, total)], names=["key", "yes", "no"])

    rows = map_arrow(labelled.select("text", "accepted"), count, "key long, yes long, no long")
    return rows.groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows numbered by the slice they are judged in."""
    base, k = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for docs in slices(batch.column("text")):
            part = batch.slice(docs.first, docs.n)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(docs.n, base + k))], names=[*batch.schema.names, "chunk"])
            k += 1


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each chunk."""
    for batch in batches:
        chunk = batch.column(1).to_numpy()
        for docs in slices(batch.column(0)):
            of = chunk[docs.first : docs.last]
            for c in np.unique(of).tolist():
                mine = np.repeat(of == c, np.diff(docs.at))
                key = np.unique(np.concatenate([k[mine[at]] for at, gram, context in _keys(docs) for k in (gram, context)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(key.size, c)), pa.array(key.view(np.int64))], names=["w_chunk", "w_key"])


def ratios(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (text, chunk and others) with ratio, each chunk judged with just the counts of its own n-grams."""
    total = counts.where(F.col("key") == int(ALL.view(np.int64))).first()
    size = np.array([total.yes, total.no] if total else [0, 0], dtype=np.float64)
    wanted = map_arrow(rows.select("text", "chunk"), _wanted, "w_chunk long, w_key long").distinct()
    met = wanted.join(counts, F.col("w_key") == F.col("key")).select("w_chunk", "key", "yes", "no")
    schema = T.StructType(list(rows.schema.fields)).add("ratio", T.DoubleType())

    def judge(part: pa.Table, found: pa.Table) -> pa.Table:
        counted = np.stack([found["yes"].to_numpy(), found["no"].to_numpy()])
        model = Model(found["key"].to_numpy().view(np.uint64), counted, size)
        each = [model.ratio(docs) for docs in slices(part["text"].combine_chunks())]
        return part.append_column("ratio", pa.array(np.concatenate(each) if each else np.empty(0)))

    return rows.groupBy("chunk").cogroup(met.groupBy("w_chunk")).applyInArrow(judge, schema)


def threshold_of(held: DataFrame) -> float:
    """The ratio that best tells accepted from rejected URLs (ratio, accepted); 0 if one kind is missing.

    What reaches the driver is a histogram of ratios.
    """
    edges = np.linspace(-6, 6, 1201)
    place = F.least(F.greatest(F.ceil((F.col("ratio") - F.lit(-6.0)) * 100).cast("int"), F.lit(0)), F.lit(edges.size))
    count = lambda side: F.sum((F.col("accepted") == side).cast("long"))
    total = np.zeros((2, edges.size + 1))
    for r in held.groupBy(place.alias("bin")).agg(count(True).alias("yes"), count(False).alias("no")).collect():
        total[:, r.bin] = r.yes, r.no
    yes, no = total
    if not (yes.sum() and no.sum()):
        return 0.0
    # Balanced accuracy; the middle of the best thresholds.
    right = (yes.sum() - np.cumsum(yes)) / yes.sum() + np.cumsum(no) / no.sum()
    return float(edges[np.flatnonzero(right[:-1] >= right[:-1].max() - 1e-12)].mean())


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and ratio for every row of pages.

    A rule `host/path` fits its host and all subdomains if the path starts with
    its path; the longest wins. URLs that no rule fits are judged by two models
    of the URLs that rules accept and reject: allowed if the length-normalised
    difference of their log-likelihoods reaches a threshold calibrated on a
    fifth of those URLs (0 if one kind is missing). N-grams and contexts are
    counted by 64-bit keys in a stored table that grows with the URLs, and each
    slice of URLs is joined with the counts of its own keys. Null URLs count as empty:
    host and path are empty and the models judge the empty string. A long URL is
    judged whole, in a slice of its own; of rules that tie in length, the later
    one wins; a ratio at the threshold is allowed. Repeated rows are judged
    alike; an empty table gives an empty one; columns besides page_id and url
    are not read.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("known", verdict).withColumn("text", _text(F.col("url"))).drop("url")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)))
    rows = store(map_arrow(rows, _chunks, T.StructType(list(rows.schema.fields)).add("chunk", T.LongType())), "urls")
    labelled = rows.where("known is not null").withColumn("accepted", F.col("known") == "allow")
    counts = store(gram_counts(labelled.where("fold > 0")), "grams")
    judged = store(ratios(rows, counts), "ratios")
    limit = threshold_of(judged.where("known is not null and fold = 0").select("ratio", (F.col("known") == "allow").alias("accepted")))
    guess = F.when(F.col("ratio") >= limit, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("known", guess).alias("verdict"), "ratio")
