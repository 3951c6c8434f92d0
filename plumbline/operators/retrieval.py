"""Keyword and vector retrieval over chunks, and rank fusion, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import once, token_estimate, tokens
from plumbline.sources.work import dealt, kept

#: Constants of the ranking function, of rank fusion, and of the over-fetch.
K1, B, EPSILON, RRF, OVERFETCH = 1.5, 0.75, 0.25, 60, 4
#: Query vectors that are broadcast at once, about twice as many at most.
QUERY_BLOCK = 4096


def tokenised(chunks: DataFrame, text: str = "text") -> DataFrame:
    """pos, length, t: the words of each chunk."""
    return chunks.select("pos", tokens(F.col(text)).alias("t")).select("pos", F.size("t").cast("long").alias("length"), "t")


def term_table(chunks: DataFrame, text: str = "text") -> DataFrame:
    """pos, length, term, tf: the postings of all chunks."""
    return tokenised(chunks, text).select("pos", "length", F.explode("t").alias("term")).groupBy("pos", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def mean_idf(idf: DataFrame) -> DataFrame:
    """mean: one row, the mean of raw over all words (term, df, raw).

    Words of equal df have the same raw, so each df is a term of the sum, times its
    words, and the terms are added in order of df: the mean doesn't depend on how
    rows are dealt, and its error on the number of dfs, not of words.
    """
    each = idf.groupBy("df").agg(F.count(F.lit(1)).alias("words"), F.min("raw").alias("raw"))
    listed = each.agg(F.array_sort(F.collect_list(F.struct("df", "words", "raw"))).alias("all"), F.sum("words").alias("n"))
    total = F.aggregate("all", F.lit(0.0), lambda s, e: s + e["words"] * e["raw"])
    return listed.select(F.when(F.col("n") > 0, total / F.col("n")).alias("mean"))


def bm25(chunks: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, pos, score of every chunk that shares a term with a query.

    Negative idf becomes EPSILON times the mean idf. Only postings of the
    queries' terms are scored; the statistics are over the whole corpus. Chunks
    are tokenised once, into a stored table.
    """
    words = kept(tokenised(chunks, text), "tokens")
    corpus = words.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    idf = words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(corpus))  # one row
    idf = idf.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = mean_idf(idf)
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    weight = asked.join(idf, "term").crossJoin(F.broadcast(floor))
    weight = weight.withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))).select("query_id", "term", "idf", "mean_length")
    # Only words that some query has are counted for each chunk.
    posted = words.select("pos", "length", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    hit = posted.groupBy("pos", "length", "term").agg(F.count(F.lit(1)).alias("tf")).join(weight, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return hit.groupBy("query_id", "pos").agg(F.sum(part).alias("score"))


def _best() -> tuple[Column, Column]:
    """Best score first, to nine decimals, as sums in another order differ beyond; of equals the first in the corpus."""
    return F.round("score", 9).desc(), F.col("pos").asc()


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with their rank from 0; Spark keeps k rows a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank - 1).where(F.col("rank") < k)


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int, city: str | None = None) -> DataFrame:
    """Chunks with a score above 0, best first, of equals the first in the corpus; the city filter precedes the cut."""
    scored = bm25(chunks, queries).where("score > 0")
    if city is not None:
        scored = scored.join(chunks.where(F.col("city").isin(city, "NATIONAL")).select("pos"), "pos")
    return top_k(scored, k, *_best())


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dense_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, pos, score of every chunk for every query of a stated set.

    Queries are broadcast in blocks of QUERY_BLOCK vectors at most; a larger set
    takes one pass over the chunks for each block.
    """
    asked = queries.select("query_id", "qvec")
    n = -(-asked.count() // QUERY_BLOCK) or 1
    parts = [asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * n)) == b) for b in range(1 if n == 1 else 2 * n)]
    scored = [chunks.select("pos", "vec").crossJoin(F.broadcast(q)).select("query_id", "pos", inner_product(F.col("vec"), F.col("qvec")).alias("score")) for q in parts]
    return reduce(DataFrame.union, scored)


#: Scores that are worked out together in a task.
SCORES_AT_ONCE = 1 << 21


def _nine_decimals(score: np.ndarray) -> np.ndarray:
    """Billionths, rounded half up by a number's shortest decimal form, as Spark's round takes it."""
    scaled = score * 1e9
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-2):
        out[i] = float(Decimal(repr(float(score[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.abs(scaled) < 2.0**52, out, scaled)


def nearest_of(a: np.ndarray, pos: np.ndarray, q: np.ndarray, k: int, best: pd.DataFrame | None) -> pd.DataFrame:
    """The k best rows (q, nine, pos, score) of each query q (m, d) among the vectors a (n, d) and the best so far.

    A matrix product finds who may be among them; those are scored again, term by
    term in order, so that a score doesn't depend on who is scored with it.
    """
    rough = q @ a.T
    size = lambda v: np.sqrt((v * v).sum(axis=1).max())
    apart = 1e-9 + 4e-16 * (q.shape[1] + 1) * size(a) * size(q)
    least = np.full(len(q), -np.inf)
    if best is not None:
        last = best[best.groupby("q").cumcount() == k - 1]
        least[last.q] = last.score - apart
    hit = rough >= least[:, None]
    if len(a) > k and hit.sum() > 4 * k * len(q):
        hit &= rough >= (np.partition(rough, len(a) - k, axis=1)[:, len(a) - k] - 2 * apart)[:, None]
    of, row = np.nonzero(hit)
    score = np.zeros(len(of))
    for i in range(q.shape[1]):
        score += a[row, i] * q[of, i]
    found = pd.DataFrame({"q": of, "nine": _nine_decimals(score), "pos": pos[row], "score": score})
    found = found if best is None else pd.concat([best, found])
    found = found.sort_values(["q", "nine", "pos"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("q").cumcount() < k]


def _plain(vector: Column, size: int) -> Column:
    """Whether a vector has so many numbers, all of them finite."""
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def dense_nearest(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, pos, score: for every query at least the k chunks that rank first, a task's k at most.

    Vectors meet queries by matrix products, in blocks of QUERY_BLOCK queries. Pairs
    with a vector that is null, of another length than the first query's or not
    finite are scored one by one, as few are expected.
    """
    asked = queries.select("query_id", "qvec")
    first = asked.where("size(qvec) > 0").select(F.size("qvec")).first()
    if first is None:
        return dense_scores(chunks, queries)
    size, count = first[0], asked.count()
    fit, known = asked.where(_plain(F.col("qvec"), size)), dealt(chunks.select("pos", "vec")).where(_plain(F.col("vec"), size))
    n = -(-count // QUERY_BLOCK)
    types = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *chunks.schema.fields]}

    def look(ids: pa.ChunkedArray, q: np.ndarray):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, step = None, max(1, SCORES_AT_ONCE // len(q))
            for batch in batches:
                a = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                pos = batch.column("pos").to_pandas().to_numpy()
                for low in range(0, len(a), step):
                    best = nearest_of(a[low : low + step], pos[low : low + step], q, k, best)
                kind = batch.schema.field("pos").type
            if best is not None and len(best):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.q)).combine_chunks(), pa.array(best.pos, kind), pa.array(best.score)], ["query_id", "pos", "score"])

        return search

    parts = []
    for block in range(1 if n == 1 else 2 * n):
        table = (fit if n == 1 else fit.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * n)) == block)).toArrow()
        if table.num_rows:
            q = table.column("qvec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            parts.append(known.mapInArrow(look(table.column("query_id"), q), f"query_id {types['query_id']}, pos {types['pos']}, score double"))
    odd_queries, odd = asked.where(~_plain(F.col("qvec"), size)), chunks.where(~_plain(F.col("vec"), size))
    return reduce(DataFrame.union, [*parts, dense_scores(odd, fit), dense_scores(chunks, odd_queries)])


def dense_top_k(chunks: DataFrame, queries: DataFrame, k: int, city: str | None = None) -> DataFrame:
    """Exact inner-product neighbours; with a city, only the first OVERFETCH * k are looked at before the filter."""
    if city is None:
        return top_k(dense_nearest(chunks, queries, k), k, *_best())
    wide = top_k(dense_nearest(chunks, queries, OVERFETCH * k), OVERFETCH * k, *_best()).drop("rank")
    inside = wide.join(chunks.where(F.col("city").isin(city, "NATIONAL")).select("pos"), "pos")
    return top_k(inside, k, *_best())


def reciprocal_rank_fusion(dense: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Sum of 1 / (60 + rank + 1) over both lists; of equals the first seen, the dense list first."""
    part = lambda df, place: df.select("query_id", "pos", F.lit(place).alias("list"), "rank")
    both = part(dense, 0).union(part(keyword, 1))
    fused = both.groupBy("query_id", "pos").agg(F.sum(1.0 / (RRF + F.col("rank") + 1)).alias("rrf"), F.min(F.struct("list", "rank")).alias("seen"))
    return top_k(fused, k, F.col("rrf").desc(), F.col("seen")).drop("seen")


def library_counts(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("page_num").alias("n_pages"))


def changed_files(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Files of which no known hash equals theirs."""
    return pages.join(known, ["source_file", "sha256"], "left_anti")


#: How clauses begin, in order of precedence (reference, heading), and how large a chunk and its overlap are.
CLAUSE_STARTS = (
    r"(?dm)^(\d{1,2}(?:\.\d{1,3}){1,4})\s{1,4}([A-Z][^\n]{3,})",
    r"(?dmi)^((?:Section|Regulation|Clause|Rule|Chapter|Article|Part)\s+[\dIVXivx]+[A-Za-z]?\.?)\s*([^\n]*)",
    r"(?dm)^(\d{1,3}\.)\s+([A-Z][^\n]{5,})",
)
MAX_TOKENS, OVERLAP = 512, 50
_MARK = "\x01"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clause_starts(text: Column) -> Column:
    """array of struct(start, ref): where clauses begin (from 0) and their reference with heading; at one place the first form counts.

    Each form is found in its own copy of the text, marked in front of every
    match, so that matches of one form don't overlap while those of two may. A
    control character 1 of the text reads as a blank in references.
    """
    return once(F.translate(text, _MARK, " "), _starts_in)


def _starts_in(clean: Column) -> Column:
    """clause_starts of a text without marks; what several steps use is worked out once (text.once)."""
    none = F.array().cast("array<int>")

    def starts(pieces: Column) -> Column:
        """Where all pieces but the first begin: a running sum of lengths."""
        step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["all"], s["at"] + F.length(p)).alias("all"))
        return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda s: s["all"])

    found = []
    for rank, pattern in enumerate(CLAUSE_STARTS):
        pieces = F.slice(F.split(F.regexp_replace(clean, pattern, _MARK + "$0"), _MARK), 1, 1 << 30)
        refs, headings = (F.regexp_extract_all(clean, F.lit(pattern), F.lit(g)) for g in (1, 2))
        named = F.zip_with(refs, headings, lambda r, h: _stripped(F.concat(_stripped(r), F.lit(" "), _stripped(h))))
        found.append(F.zip_with(once(pieces, starts), named, lambda p, r: F.struct(p.alias("start"), F.lit(rank).alias("rank"), r.alias("ref"))))  # noqa: B023
    return once(F.array_sort(F.concat(*found)), lambda ordered: F.filter(ordered, lambda s, i: (i == 0) | (s["start"] != F.get(ordered, i - 1)["start"])))


def chunk_clauses(pages: DataFrame, keys: list[str], max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """keys, clause, clause_ref, idx, text: page texts cut where clauses begin, long clauses split once more.

    Text before the first clause is left out; a page without any is UNCATEGORISED
    and split as a whole. idx numbers the parts of a clause.
    """
    rows = pages.select(*keys, "text", F.explode(F.array(clause_starts(F.col("text")))).alias("starts"))
    ends = F.transform("starts", lambda s, i: F.coalesce(F.get("starts", i + 1)["start"], F.length("text")))
    cut = F.zip_with("starts", ends, lambda s, e: F.struct(s["ref"].alias("clause_ref"), _stripped(F.substr("text", s["start"] + 1, e - s["start"])).alias("clause_text")))
    whole = F.array(F.struct(F.lit("UNCATEGORISED").alias("clause_ref"), F.col("text").alias("clause_text")))
    rows = rows.select(*keys, F.posexplode(F.when(F.size("starts") > 0, cut).otherwise(whole)).alias("clause", "c")).select(*keys, "clause", "c.*").where("clause_text != ''")
    short = (F.col("clause_ref") != "UNCATEGORISED") & (token_estimate(F.col("clause_text")) <= max_tokens)
    parts = F.when(short, F.array("clause_text")).otherwise(split_parts(F.col("clause_text"), max_tokens, overlap))
    return rows.select(*keys, "clause", "clause_ref", F.posexplode(parts).alias("idx", "text")).where("trim(text) != ''")


def chunk_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def split_parts(text: Column, max_tokens: int, overlap: int) -> Column:
    """The paragraphs of a text packed into parts of at most max_tokens, each beginning with the last paragraphs of the
    one before as far as they fit into overlap. A long paragraph is not split; a text without any is one part.
    """
    size = lambda p: F.floor(F.length(p) / 4)
    total = lambda ps: F.aggregate(ps, F.lit(0).cast("long"), lambda s, p: s + size(p).cast("long"))
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), _stripped), lambda p: p != "")
    kind = "struct<done: array<array<string>>, now: array<string>>"
    none = F.array().cast("array<string>")

    def keep(state: Column, p: Column) -> Column:
        fits = state["open"] & (total(state["kept"]) + size(p) <= overlap)
        return F.struct(F.when(fits, F.concat(F.array(p), state["kept"])).otherwise(state["kept"]).alias("kept"), fits.alias("open"))

    tail = lambda ps: F.aggregate(F.reverse(ps), F.struct(none.alias("kept"), F.lit(True).alias("open")), keep, lambda s: s["kept"])

    def step(state: Column, p: Column) -> Column:
        full = (F.size(state["now"]) > 0) & (total(state["now"]) + size(p) > max_tokens)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.concat(tail(state["now"]), F.array(p))).otherwise(F.concat(state["now"], F.array(p))).alias("now"),
        )

    start = F.from_json(F.lit('{"done": [], "now": []}'), kind)
    parts = F.aggregate(paragraphs, start, step, lambda s: F.concat(s["done"], F.when(F.size(s["now"]) > 0, F.array(s["now"])).otherwise(F.array().cast("array<array<string>>"))))
    return F.when(F.size(paragraphs) == 0, F.array(_stripped(text))).otherwise(F.transform(parts, lambda ps: F.array_join(ps, "\n\n")))


def sub_split(chunks: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """All columns of chunks with part and part_text: a row for each part of the text (see split_parts)."""
    return chunks.select("*", F.posexplode(split_parts(F.col("text"), max_tokens, overlap)).alias("part", "part_text"))


def resolve_chunks(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """The fused ranks with the chunks they stand for."""
    return fused.join(chunks, "pos")


def municipality_listing(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks and distinct source files of each municipality."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("source_file").alias("n_files"))


def sparse_pages(pages: DataFrame, share: float = 0.3) -> DataFrame:
    """Pages (source_file, page_num, text) whose text is shorter than a share of their file's mean."""
    mean = pages.groupBy("source_file").agg(F.avg(F.length("text")).alias("mean"))
    return pages.join(mean, "source_file").where(F.length("text") < share * F.col("mean")).drop("mean")
