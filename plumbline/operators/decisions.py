"""Verdicts on a field from two candidates and the document's own evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import measures as m

#: Weights of evidence, and the score from which a candidate may win a conflict.
WEIGHTS = {"printed": 5, "dimension_line": 4, "semantic": 3, "ocr": 3, "geometry": 3, "repeated": 2, "cv": 1, "vision": 1}
THRESHOLD = 6


def occurrences(candidates: DataFrame, numbers: DataFrame, keys: list[str], document: list[str], tolerance: float = 0.01) -> DataFrame:
    """Candidates (keys, side, value) with n_printed: how often their number is printed in the document's texts.

    numbers: the document's keys and value, a row for each printed number. Values
    meet by cells as wide as the tolerance, so the join is on equality.
    """
    cell = lambda c: F.floor(c / tolerance).cast("long")
    printed = numbers.groupBy(*document, F.col("value").alias("o_value")).agg(F.count(F.lit(1)).alias("o_n")).withColumn("cell", cell(F.col("o_value")))
    near = candidates.select(*keys, "side", "value", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(F.col("value")) + d)).alias("cell"))
    met = near.join(printed, [*document, "cell"]).where(F.abs(F.col("value") - F.col("o_value")) <= tolerance)
    n = met.groupBy(*keys, "side").agg(F.sum("o_n").alias("n_printed"))
    return candidates.join(n, [*keys, "side"], "left").withColumn("n_printed", F.coalesce("n_printed", F.lit(0).cast("long")))


def evidence(candidates: DataFrame, measurements: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence flags and score of each candidate (keys, side, value) from the measurements near it.

    Measurements: value, source (NATIVE_TEXT, OCR, VECTOR_GEOMETRY, DERIVED), has_line, semantic.
    Candidates may carry n_printed (see occurrences): a number printed in the
    document's texts counts as printed, one printed twice as repeated. Without
    texts nothing is repeated.
    """
    if "n_printed" not in candidates.columns:
        candidates = candidates.withColumn("n_printed", F.lit(0).cast("long"))
    near = measurements.select(*keys, F.col("value").alias("m_value"), "source", "has_line", "semantic")
    met = candidates.join(near, keys, "left").withColumn("near", F.coalesce(m.close(F.col("m_value"), F.col("value")), F.lit(False)))

    def any_(condition: Column) -> Column:
        return F.coalesce(F.bool_or(F.col("near") & condition), F.lit(False))

    g = met.groupBy(*keys, "side", "value").agg(
        (any_(F.col("source") == "NATIVE_TEXT") | (F.max("n_printed") > 0)).alias("printed"),
        any_(F.col("has_line")).alias("dimension_line"),
        any_(F.col("semantic")).alias("semantic"),
        any_(F.col("source") == "OCR").alias("ocr"),
        any_(F.col("source") == "VECTOR_GEOMETRY").alias("geometry"),
        (F.max("n_printed") > 1).alias("repeated"),
        any_(F.lit(True)).alias("cv"),
    )
    g = g.withColumn("vision", F.col("side") == "vision")
    score = reduce(lambda a, b: a + b, (F.when(F.col(k), w).otherwise(0) for k, w in WEIGHTS.items()))
    direct = F.col("printed") | F.col("ocr") | F.col("geometry")
    return g.withColumn("score", score).withColumn("direct", direct)


#: Fixed value: the most that evidence can score.
MOST_EVIDENCE = sum(WEIGHTS.values())


def resolve(cv: DataFrame, vision: DataFrame, measurements: DataFrame, keys: list[str], threshold: int = THRESHOLD, skeleton: DataFrame | None = None, numbers: DataFrame | None = None, document: list[str] | None = None) -> DataFrame:
    """keys, status, winner, value, decision, level, evidence for every key that has a CV or a vision value.

    With a skeleton of keys, those without either are NOT_FOUND_BY_EITHER. Two
    candidates that differ are a CONFLICT where both are well supported and tie;
    where neither is, the decision is to ABSTAIN. evidence is the winner's score
    as a share of the most it can be. numbers and document: see occurrences.
    """
    sides = cv.select(*keys, F.lit("cv").alias("side"), "value").union(vision.select(*keys, F.lit("vision").alias("side"), "value"))
    if numbers is not None:
        sides = occurrences(sides, numbers, keys, document or keys)
    e = evidence(sides, measurements, keys)
    g = e.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("cv", "vision") for c in ("value", "score", "direct")])
    if skeleton is not None:
        g = skeleton.select(*keys).join(g, keys, "left")
    a, b = F.col("cv_value"), F.col("vision_value")
    strong = {s: F.coalesce((F.col(f"{s}_score") >= threshold) & F.col(f"{s}_direct"), F.lit(False)) for s in ("cv", "vision")}
    winner = (
        F.when(a.isNull() & b.isNull(), None)
        .when(a.isNotNull() & b.isNotNull() & m.close(a, b), "cv+vision")
        .when(b.isNull(), "cv")
        .when(a.isNull(), "vision")
        .when(strong["cv"] & ~strong["vision"], "cv")
        .when(strong["vision"] & ~strong["cv"], "vision")
        .when(strong["cv"] & strong["vision"] & (F.col("cv_score") > F.col("vision_score")), "cv")
        .when(strong["cv"] & strong["vision"] & (F.col("cv_score") < F.col("vision_score")), "vision")
    )
    g = g.withColumn("winner", winner).withColumn("tied", strong["cv"] & strong["vision"])
    one = F.when(a.isNull(), F.lit("VISION_ONLY")).when(b.isNull(), F.lit("CV_ONLY"))
    direct = F.when(F.col("winner") == "vision", F.col("vision_direct")).otherwise(F.col("cv_direct"))
    status = (
        F.when(a.isNull() & b.isNull(), "NOT_FOUND_BY_EITHER")
        .when(F.col("winner").isNull(), "UNRESOLVED_CONFLICT")
        .when(F.col("winner") == "cv+vision", F.when(direct, "AGREED_DOCUMENT_VERIFIED").otherwise("AGREED_UNVERIFIED"))
        .when(one.isNotNull(), F.concat(one, F.when(direct, "_DOCUMENT_VERIFIED").otherwise("_UNVERIFIED")))
        .otherwise("CONFLICT_RESOLVED_BY_DOCUMENT_EVIDENCE")
    )
    g = g.withColumn("status", status)
    value = F.when(F.col("winner") == "cv+vision", F.bround((a + b) / 2, 4)).when(F.col("winner") == "cv", a).when(F.col("winner") == "vision", b)
    decision = F.when(F.col("winner").isNotNull(), "ACCEPT").when((F.col("status") == "UNRESOLVED_CONFLICT") & F.col("tied"), "CONFLICT").otherwise("ABSTAIN")
    level = (
        F.when(F.col("winner").isNull(), F.when((F.col("status") == "UNRESOLVED_CONFLICT") & F.col("tied"), "CONFLICTING").otherwise("MISSING"))
        .when(F.col("status") == "AGREED_UNVERIFIED", "MEDIUM")
        .when(F.col("status").endswith("_UNVERIFIED"), "LOW")
        .otherwise("HIGH")
    )
    # Where both agree, vision speaks for the CV value as well.
    score = F.when(F.col("winner") == "vision", F.col("vision_score")).when(F.col("winner") == "cv", F.col("cv_score")).when(F.col("winner") == "cv+vision", F.col("cv_score") + WEIGHTS["vision"])
    share = F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / MOST_EVIDENCE)))
    return g.select(*keys, "status", "winner", value.alias("value"), decision.alias("decision"), level.alias("level"), share.alias("evidence"))


def reported_vs_calculated(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """The first printed and the first derived value of each key, and whether they agree; the printed one stands."""
    first = {name: F.min_by("value", F.when(F.col("source") == source, F.col("pos"))) for name, source in (("reported", "NATIVE_TEXT"), ("calculated", "DERIVED"))}
    some = {name: F.count(F.when(F.col("source") == source, 1)) for name, source in (("n_reported", "NATIVE_TEXT"), ("n_calculated", "DERIVED"))}
    g = measurements.where("value is not null").groupBy(*keys).agg(*[c.alias(n) for n, c in {**first, **some}.items()])
    g = g.withColumn("reported", F.when(F.col("n_reported") > 0, F.col("reported"))).withColumn("calculated", F.when(F.col("n_calculated") > 0, F.col("calculated")))
    r, c = F.col("reported"), F.col("calculated")
    status = F.when(r.isNull(), "CALCULATED_VALUE_ONLY").when(c.isNull(), "REPORTED_VALUE_ONLY").when(m.close(r, c, 0.05, 0.001), "REPORTED_VALUE_WITH_GEOMETRIC_CHECK").otherwise("REPORTED_CALCULATION_DIFFER")
    return g.where(r.isNotNull() | c.isNotNull()).select(*keys, "reported", "calculated", F.coalesce(r, c).alias("value"), status.alias("status"))


def duplicate_penalty(items: DataFrame, keys: list[str], tolerance: float = 0.005, penalty: float = 0.5) -> DataFrame:
    """Items (pos, region, type, value) with n_duplicates and confidence * penalty ** n_duplicates.

    A duplicate is an item of the same keys in another region with another type
    and the same value. Values meet by cells of the tolerance, so the join is on
    equality and no group is paired with itself.
    """
    cell = F.floor(F.col("value") / tolerance).cast("long")
    rows = items.withColumn("cell", cell)
    near = rows.select(*keys, F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("pos").alias("o_pos"), F.col("region").alias("o_region"), F.col("type").alias("o_type"), F.col("value").alias("o_value"))
    met = rows.join(near, [*keys, "cell"]).where((F.col("region") != F.col("o_region")) & (F.col("type") != F.col("o_type")) & (F.abs(F.col("value") - F.col("o_value")) <= tolerance))
    n = met.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n_duplicates"))
    out = items.join(n, [*keys, "pos"], "left").withColumn("n_duplicates", F.coalesce("n_duplicates", F.lit(0).cast("long")))
    return out.withColumn("confidence", F.col("confidence") * F.pow(F.lit(penalty), F.col("n_duplicates")))


def vision_only(items: DataFrame, native: DataFrame, keys: list[str]) -> DataFrame:
    """Vision items whose value to 2 decimals no native dimension has; the first for each type and value."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents")
    known = native.select(*keys, cents).distinct()
    left = items.withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("long")).join(known, [*keys, "cents"], "left_anti")
    first = left.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "type", "cents").orderBy("pos")))
    return first.where("nth = 1").select(*keys, "type", "cents", "pos", F.lit("LOW").alias("level"))
