"""Competing observations of one quantity, reconciled with robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import measures as m
from plumbline.functions.levels import level_from_score

#: Consistency factor and limit of the robust z-score.
MAD_FACTOR, MAD_LIMIT = 0.6745, 3.5


def _with_spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row with its group's count, median and median absolute deviation.

    The groups stay on the partitioning of the first shuffle; the joins add none.
    """
    center = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("med"))
    rows = rows.join(center, keys)
    spread = rows.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))
    return rows.join(spread, keys)


def reconcile(candidates: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n, status, value, n_outliers, level for every group of candidates.

    One candidate is UNCORROBORATED. Two agree within a tolerance, vary within
    three, else conflict without a value. Of three or more, those with a robust
    z-score of at most MAD_LIMIT count (all, if the deviation is 0).
    """
    rows = _with_spread(candidates.where(F.col(value).isNotNull()), keys, value)
    z = F.when(F.col("mad") > 1e-9, MAD_FACTOR * F.abs(F.col(value) - F.col("med")) / F.col("mad")).otherwise(0.0)
    inside = (F.col("n") < 3) | (z <= MAD_LIMIT)
    kept = F.when(inside, F.col(value))
    g = rows.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("med").alias("med"), F.avg(kept).alias("mean"), F.count(kept).alias("n_kept"), (F.max(kept) - F.min(kept)).alias("spread")
    )
    tol = m.reconcile_tolerance(F.col("med"))
    status = (
        F.when(F.col("n") == 1, "UNCORROBORATED")
        .when((F.col("n") == 2) & (F.col("spread") <= tol), "AGREED")
        .when((F.col("n") == 2) & (F.col("spread") <= tol * 3), "MINOR_VARIANCE")
        .when((F.col("n") == 2) | (F.col("n_kept") * 2 <= F.col("n")), "CONFLICTING_EVIDENCE")
        .when(F.col("n_kept") < F.col("n"), "OUTLIER_DETECTED")
        .when(F.col("spread") <= tol, "AGREED")
        .otherwise("MINOR_VARIANCE")
    )
    g = g.withColumn("status", status)
    conflict = F.col("status") == "CONFLICTING_EVIDENCE"
    level = F.when(conflict, "CONFLICTING").when(F.col("status") == "AGREED", "HIGH").otherwise("MEDIUM")
    return g.select(*keys, "n", "status", F.when(~conflict, F.col("mean")).alias("value"), (F.col("n") - F.col("n_kept")).alias("n_outliers"), level.alias("level"))


def mad_outliers(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Each sample with `kept`: false for those of three or more whose robust z-score is over the limit."""
    rows = _with_spread(samples, keys, value)
    z = MAD_FACTOR * F.abs(F.col(value) - F.col("med")) / F.col("mad")
    return rows.withColumn("kept", (F.col("n") < 3) | (F.col("mad") < 1e-9) | (z <= MAD_LIMIT)).drop("n", "med", "mad")


def scale_estimate(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median and relative spread (deviation by median) of the samples that are no outliers, and a level by number and spread."""
    kept = mad_outliers(samples, keys, value)
    used = F.when(F.col("kept"), F.col(value))
    g = kept.groupBy(*keys).agg(
        F.percentile(used, F.lit(0.5)).alias("scale"), F.stddev_pop(used).alias("deviation"), F.count(used).alias("n_used"), F.count(F.when(~F.col("kept"), 1)).alias("n_rejected")
    )
    spread = F.when(F.col("n_used") < 2, 0.0).otherwise(F.coalesce(F.try_divide("deviation", "scale"), F.lit(1.0)))
    g = g.withColumn("spread", spread).drop("deviation")
    level = F.when((F.col("n_used") >= 3) & (F.col("spread") < 0.05), "HIGH").when((F.col("n_used") >= 2) & (F.col("spread") < 0.15), "MEDIUM").otherwise("LOW")
    return g.withColumn("level", level)


def best_measurement(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident measurement for each key; of equals the first. value_m goes before value."""
    value = F.coalesce("value_m", "value")
    rows = measurements.where(value.isNotNull()).withColumn("v", value)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("v", "unit", "confidence", "page"), F.struct("confidence", -F.col("pos"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias("cv_value"), F.col("b.unit").alias("cv_unit"), F.col("b.confidence").alias("cv_confidence"))


def best_vision(items: DataFrame, keys: list[str], kind: str = "length") -> DataFrame:
    """The most confident vision reading for each key; of equals the first page, then the first row."""
    value = m.vision_metres(F.col("value"), F.col("unit")) if kind == "length" else m.vision_area(F.col("value"), F.col("unit"))
    unit = F.lit("m") if kind == "length" else m.vision_area_unit(F.col("unit"))
    rows = items.withColumn("v", value).withColumn("u", unit).where("v is not null")
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("v", "u", "confidence", "grounded"), F.struct("confidence", -F.col("page"), -F.col("pos"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias("vision_value"), F.col("b.u").alias("vision_unit"), F.col("b.confidence").alias("vision_confidence"), F.col("b.grounded").alias("grounded"))


def fuse(cv: DataFrame, vision: DataFrame, keys: list[str], kind: str = "length") -> DataFrame:
    """Best CV measurement against best vision reading by key: a full outer join and a decision.

    Agreeing values are averaged at HIGH; a single source keeps the level of its
    own score (an ungrounded vision area at most LOW); disagreement has no value.
    """
    both = best_measurement(cv, keys).join(best_vision(vision, keys, kind), keys, "full_outer")
    a, b = F.col("cv_value"), F.col("vision_value")
    unit = F.coalesce("vision_unit", "cv_unit", F.lit("m" if kind == "length" else "m2"))
    agree = F.abs(a - b) <= m.fusion_tolerance(a, b, unit)
    status = F.when(a.isNull(), "VISION_ONLY").when(b.isNull(), "CV_ONLY").when(agree, "AGREED").otherwise("CONFLICT")
    seen = level_from_score(F.col("vision_confidence"))
    if kind != "length":
        seen = F.when(F.col("grounded") == F.lit(False), "LOW").otherwise(seen)
    level = F.when(F.col("status") == "AGREED", "HIGH").when(F.col("status") == "CONFLICT", "CONFLICTING").when(F.col("status") == "CV_ONLY", level_from_score(F.col("cv_confidence"))).otherwise(seen)
    value = F.when(F.col("status") == "AGREED", (a + b) / 2.0).when(F.col("status") == "CV_ONLY", a).when(F.col("status") == "VISION_ONLY", b)
    return both.withColumn("unit", unit).withColumn("status", status).select(*keys, "cv_value", "vision_value", "unit", "status", value.alias("value"), level.alias("level"))


def validate(cv: DataFrame, vision: DataFrame, keys: list[str], skeleton: DataFrame) -> DataFrame:
    """Statuses by key of the skeleton, with the validation tolerances; keys without any value are MISSING."""
    got = skeleton.join(best_measurement(cv, keys), keys, "left").join(best_vision(vision, keys), keys, "left")
    a, b = F.col("cv_value"), F.col("vision_value")
    near = F.abs(a - b) <= m.validation_tolerance(a, b, F.lit("m"))
    status = F.when(a.isNull() & b.isNull(), "MISSING").when(a.isNull(), "VISION_ONLY").when(b.isNull(), "CV_ONLY").when(near, "AGREED").otherwise("CONFLICT")
    return got.select(*keys, "cv_value", "vision_value", status.alias("status"))


def status_counts(rows: DataFrame, keys: list[str], statuses: list[str]) -> DataFrame:
    """A count column for each status of a fixed list."""
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}") for s in statuses])


def cross_check(primary: DataFrame, other: DataFrame, keys: list[str], skeleton: DataFrame) -> DataFrame:
    """A primary reading against an independent one, for every key of the skeleton.

    Columns value and level on both sides. Agreement (tolerance of the primary
    value) ships it at HIGH; a conflict ships it flagged; the other alone is not
    shipped.
    """
    a = primary.select(*keys, F.col("value").alias("pdf_value"), F.col("level").alias("pdf_level"))
    b = other.select(*keys, F.col("value").alias("dxf_value"), F.col("level").alias("dxf_level"))
    got = skeleton.join(a, keys, "left").join(b, keys, "left")
    x, y = F.col("pdf_value"), F.col("dxf_value")
    status = F.when(x.isNull() & y.isNull(), "BOTH_MISSING").when(x.isNull(), "DXF_ONLY").when(y.isNull(), "PDF_ONLY").when(F.abs(x - y) <= m.truth_tolerance(x), "AGREED").otherwise("CONFLICT")
    got = got.withColumn("status", status)
    level = F.when(F.col("status") == "AGREED", "HIGH").when(x.isNotNull(), F.col("pdf_level")).otherwise("MISSING")
    return got.select(*keys, "pdf_value", "dxf_value", F.abs(x - y).alias("difference"), "status", x.alias("shipped_value"), level.alias("shipped_level"), (F.col("status") == "CONFLICT").alias("flagged"))
