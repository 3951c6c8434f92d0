"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, quality
from plumbline.llm.decontaminate import contamination
from plumbline.llm.exact_dedup import exact_dedup
from plumbline.llm.licenses import license_scan
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.scratch import new_path
from plumbline.llm.token_counts import token_counts
from plumbline.llm.token_files import read_token_files, write_token_files
from plumbline.llm.url_filter import judge_urls

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT, END_ID, QUALITY = 1024, 2, 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text modulo `of`; -1 for null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)), F.lit(-1))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = quality.quality_scores(docs, labels, threshold=QUALITY, learn=lambda i: fold(i, 4) != 2)
    return scored.select(F.col("row.doc_id").alias("doc_id"), (fold(F.col("row.doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = language.languages(docs.select("doc_id", "text"), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), (fold(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), TOKEN_LIMIT)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), wrapped=True)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), END_ID)
    return read_token_files(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_language, op3_near_dedup, op4_mixing, op5_token_counts, op6_exact_dedup, op7_licenses, op8_url_filter, op9_decontamination, op10_token_files)
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents
        ), h AS (SELECT doc_id, length(text) AS size, sha256(norm) AS text_sha256 FROM t),
        w AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
    """,
}
