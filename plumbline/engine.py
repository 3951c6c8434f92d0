"""What a user calls: check plans, edit them, keep a library of regulations, search it, and evaluate runs.

Each call takes and returns DataFrames; paths name tables on storage that all
executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import document_city, document_kind
from plumbline.operators import evaluation, gates, plans, retrieval, rules
from plumbline.sources import records


def check(plan_rows: DataFrame, ruleset: list[rules.Rule], municipality: str) -> dict[str, DataFrame]:
    """Results of every active rule for every plan, the overall status, and advice on what failed; impossible values are withdrawn first."""
    results = rules.evaluate(gates.physical_bounds(plan_rows), ruleset, municipality)
    return {"results": results, "overall": rules.rollup(results, "plan_id"), "suggestions": rules.suggestions(results)}


def check_ruleset(spark: SparkSession, plan_rows: DataFrame, path: str, municipality: str, version: str | None = None) -> dict[str, DataFrame]:
    """check with the rules of a file; an absent file has none."""
    return check(plan_rows, records.load_rules(records.read_rules(spark, path, municipality, version)), municipality)


def edited(plan_rows: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """The plans with their good edits, the edits that were refused with their problem, and each edit as a correction of what was there."""
    checked = plans.checked_edits(edits)
    before = plans.predictions(plan_rows, plans.EDITABLE).select("plan_id", "field", F.col("value").alias("before"))
    made = checked.where("problem is null").join(before, ["plan_id", "field"], "left")
    return {"plans": plans.apply_edits(plan_rows, edits), "refused": checked.where("problem is not null"), "corrections": made}


def ingest(spark: SparkSession, pages: DataFrame, path: str, municipality: str, force: bool = False) -> DataFrame:
    """Chunk the pages (source_file, page_num, text, sha256) of new or changed files into the library at path; counts by file.

    A forced run takes all files. Chunks are appended, as are the files' hashes.
    """
    known = spark.read.schema("source_file string, sha256 string").json(f"{path}/hashes") if records._exists(spark, f"{path}/hashes") else spark.createDataFrame([], "source_file string, sha256 string")
    new = pages if force else retrieval.changed_files(pages, known)
    cut = retrieval.chunk_clauses(new, ["source_file", "page_num"])
    named = cut.select(
        retrieval.chunk_id(F.lit(municipality), "source_file", F.concat(F.lit("p"), F.col("page_num").cast("string")), "clause_ref", F.col("idx").cast("string")).alias("chunk_id"),
        "text", "clause_ref", "source_file", document_kind(F.col("source_file")).alias("doc_type"), document_city(F.col("source_file")).alias("city"), F.lit(municipality).alias("municipality"), "page_num",
    )
    named.write.mode("overwrite" if force else "append").json(f"{path}/chunks")
    new.select("source_file", "sha256").distinct().write.mode("overwrite" if force else "append").json(f"{path}/hashes")
    return library(spark, path)


def library(spark: SparkSession, path: str) -> DataFrame:
    """Chunks and pages of each file of a library."""
    return retrieval.library_counts(records.read_chunks(spark, f"{path}/chunks"), "source_file")


def search(chunks: DataFrame, queries: DataFrame, k: int = 8, city: str | None = None, vectors: DataFrame | None = None, each: int = 20) -> DataFrame:
    """query_id, pos, rank and the chunk: keyword search, fused with vector search where vectors (query_id, qvec) are given.

    chunks: pos, text, city and, for vectors, vec. An empty query is an error.
    """
    if not queries.where("trim(coalesce(query, '')) = ''").isEmpty():
        raise ValueError("a query is empty")
    keyword = retrieval.bm25_top_k(chunks, queries, each, city).select("query_id", "pos", "rank")
    if vectors is None:
        ranked = keyword.where(F.col("rank") < k)
    else:
        dense = retrieval.dense_top_k(chunks, vectors, each, city).select("query_id", "pos", "rank")
        ranked = retrieval.reciprocal_rank_fusion(dense, keyword, k)
    return retrieval.resolve_chunks(ranked.select("query_id", "pos", "rank"), chunks)


def drafting_inputs(chunks: DataFrame, questions: DataFrame, least: int = 3, k: int = 8) -> DataFrame:
    """query_id, chunk_ids, refused: what a rule may be drafted from for each question (query_id, query); refused with fewer than `least` chunks."""
    found = search(chunks, questions, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"))
    rows = questions.join(found, "query_id", "left").withColumn("chunk_ids", F.coalesce(F.transform("c", lambda x: x["chunk_id"]), F.array().cast("array<string>")))
    return rows.select("query_id", "query", "chunk_ids", (F.size("chunk_ids") < least).alias("refused"))


def evaluate(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """The aggregates of every modality with a line of text each."""
    return evaluation.run_eval(truth, predictions).withColumn("line", evaluation.report_line())
