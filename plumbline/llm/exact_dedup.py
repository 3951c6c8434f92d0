"""Exact duplicates by merging sorted digest runs in a tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import store

#: Runs that meet in one merge of the binomial tree, and merges before all runs meet.
FAN_IN, ROUNDS = 8, 2
RUNS = FAN_IN**ROUNDS
#: The characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Which row of equal texts stays, for every row of docs.

    Texts are equal when they are identical without blanks (null counts as
    empty). The row with the most code points in its original text stays, then
    the smallest doc_id, nulls last. Returns doc_id, keep_id, group_size, kept,
    text_sha256. Rows that repeat a doc_id are all counted, and each that
    carries the kept id is marked kept. Long texts are hashed whole. Other
    columns are not read; an empty table gives an empty one.

    Digests are taken once, into a stored table, and each row belongs to one of
    RUNS runs. A run's digests are reduced first (within each task before the
    shuffle), then FAN_IN runs at a time, keeping a digest's best row and count;
    rows count as equal at every level only if a second hash and the length
    without blanks agree with the digest. Only digests cross the network, at
    most once per digest and run, so a text that fills a third of the table
    weighs no more than any other. Winners meet the rows in a join whose large
    side can be split.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.sha2(normalised(F.col(text)), 256).alias("text_sha256"),
        F.coalesce(F.length(text), F.lit(0)).alias("size"),
        F.xxhash64(normalised(F.col(text))).alias("second"),
        F.length(normalised(F.col(text))).alias("length"),
    ).withColumn("run", F.pmod(F.xxhash64("doc_id", "size"), F.lit(RUNS)))
    base = store(base, "digests")
    rank = F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id"))
    same = ["text_sha256", "second", "length"]
    merged = base.groupBy("run", *same).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    for level in range(1, ROUNDS + 1):
        run = F.floor(F.col("run") / F.lit(FAN_IN)) if level < ROUNDS else F.lit(0).cast("long")
        merged = merged.withColumn("run", run).groupBy("run", *same).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    winners = merged.where("n > 1").select(*[F.col(c).alias(f"w_{c}") for c in same], F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    rows = base.join(winners, [F.col(c) == F.col(f"w_{c}") for c in same], "left")
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
