"""The corpus pipeline: from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
and read again as the next one's docs. All but the last keep the columns of
documents, whatever further ones docs has. Every stage takes nulls in any
column, repeated rows, ties, empty and very long texts, which are read whole,
and turns an empty table into an empty one; the docstring of its operator says
what comes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import quality
from plumbline.llm.decontaminate import decontaminate as without_benchmark
from plumbline.llm.mixing import mix_sources, repeat_by_copies
from plumbline.llm.near_dedup import drop_near_duplicates
from plumbline.llm.queries import END_ID, QUALITY, VOCABULARY, fold
from plumbline.llm.scratch import forget, made, new_path, store
from plumbline.llm.token_files import read_token_files, write_token_files


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like any other. See quality_scores."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.quality_scores(docs, labels, threshold=QUALITY, learn=lambda i: fold(i, 4) != 2)
    return scored.where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; null, empty and wordless texts all stay. See drop_near_duplicates."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; null, empty and wordless texts stay. See find_passages."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null, empty and wordless texts never. See mix_sources."""
    return repeat_by_copies(docs, mix_sources(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document; null and empty texts hold the end id alone. See write_token_files."""
    path = new_path(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path(VOCABULARY), END_ID)
    return read_token_files(spark, path)


STAGES = [("quality", keep_good), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("tokens", tokens)]

#: Trained models, Poisson draws and token ids have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage stored on its way goes once its result is stored, and that once the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = made()
        kept = store(stage(spark, docs, sf_dir), name)
        forget(spark, made() - before - {kept.stored_at} | ({docs.stored_at} if name != STAGES[0][0] else set()))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
