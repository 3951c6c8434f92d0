"""Governance of a truth corpus: corrections, promotions, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending_corrections(events: DataFrame, promotions: DataFrame) -> DataFrame:
    """Correction events that have not been promoted."""
    return events.join(promotions.select("correction_id"), "correction_id", "left_anti")


def promotion_reasons(events: DataFrame, promotions: DataFrame, fields: list[str]) -> DataFrame:
    """correction_id and why it can't be promoted; OK if it can."""
    done = promotions.select("correction_id", F.lit(True).alias("done"))
    reason = (
        F.when(F.col("done"), "ALREADY_PROMOTED")
        .when(F.col("split") == "heldout", "HELDOUT_IS_FROZEN")
        .when(~F.col("field").isin(*fields), "UNKNOWN_FIELD")
        .when(F.col("sha256").isNull(), "MISSING_FILE")
        .otherwise("OK")
    )
    return events.join(done, "correction_id", "left").select("correction_id", reason.alias("reason"))


def latest_edits(events: DataFrame) -> DataFrame:
    """Each edit with the value it replaced, by document and field in time order."""
    order = Window.partitionBy("document_id", "field").orderBy("recorded_at", "correction_id")
    return events.withColumn("before", F.lag("corrected").over(order))


def corpus_problems(truth: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each problem of a truth row: plan_id, field, problem."""
    problems = F.array_compact(
        F.array(
            F.when(~F.col("field").isin(*fields), "UNKNOWN_FIELD"),
            F.when((F.col("tier") == "must_abstain") & F.col("value").isNotNull(), "ABSTAIN_WITH_VALUE"),
            F.when((F.col("tier") != "must_abstain") & F.col("value").isNull(), "TIER_WITHOUT_VALUE"),
            F.when(F.isnan(F.coalesce("value", F.lit(0.0))), "NOT_A_NUMBER"),
        )
    )
    return truth.select("plan_id", "field", F.explode(problems).alias("problem"))


def freeze_diff(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Files ADDED, REMOVED or CHANGED since a freeze; unchanged ones are left out."""
    a, b = frozen.select("file", F.col("sha256").alias("was")), current.select("file", F.col("sha256").alias("now"))
    kind = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "CHANGED")
    return a.join(b, "file", "full_outer").select("file", kind.alias("change")).where("change is not null")


def replace_by_key(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows without those whose key is among the new, and the new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def promoted(events: DataFrame, promotions: DataFrame, fields: list[str]) -> dict[str, DataFrame]:
    """What promoting all corrections that can be comes to: truth rows (of tier `inspected`), and the promotions to be added.

    The latest correction of a document's field is its truth.
    """
    good = events.join(promotion_reasons(events, promotions, fields).where("reason = 'OK'"), "correction_id", "left_semi")
    last = good.groupBy("document_id", "field").agg(F.max_by("corrected", F.struct("recorded_at", "correction_id")).alias("value"))
    return {"truth": last.withColumn("tier", F.lit("inspected")), "promotions": good.select("correction_id", F.col("document_id").alias("plan_id"))}


def blank_truth(plans: DataFrame, frozen: DataFrame, fields: list[str]) -> DataFrame:
    """An unverified, empty truth row for each field of new plans (plan_id, split); plans for a split that is frozen get none."""
    open_ = plans.join(frozen.select("split").distinct(), "split", "left_anti")
    return open_.select("plan_id", "split", F.explode(F.array(*map(F.lit, fields))).alias("field"), F.lit(None).cast("double").alias("value"), F.lit("unverified").alias("tier"))


def fingerprint(files: DataFrame, *keys: str) -> DataFrame:
    """keys and the first 16 digits of a hash over all files (path, sha256) in order of path: a key for kept results."""
    each = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.groupBy(*keys).agg(F.left(F.sha2(F.array_join(F.transform(each, lambda f: F.concat_ws(":", f["path"], f["sha256"])), ","), 256), F.lit(16)).alias("fingerprint"))
