"""Tables about runs and results: gates, policies, margins, explanations, merges and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import measures as m
from plumbline.functions.levels import cap_level, level_from_score
from plumbline.functions.text import value_forms
from plumbline.operators import scoring
from plumbline.sources.work import spread_join

#: Fields without which a plan's boundary isn't resolved.
BOUNDARY = ("plot.width", "plot.depth", "building.footprint_area")


def gated_aggregates(scores: DataFrame) -> DataFrame:
    """The aggregates of all plans, and of those whose boundary fields (as far as they have a truth) are all CORRECT.

    Whole plans are left out, never single fields. One pass: each plan's row set
    is counted for one or both views.
    """
    bad = F.col("field").isin(*BOUNDARY) & F.col("truth").isNotNull() & (F.col("status") != "CORRECT") & F.col("plan_id").isNotNull()
    rows = scores.withColumn("bad", F.max(F.coalesce(bad, F.lit(False))).over(Window.partitionBy("plan_id")))
    views = F.when(F.col("bad"), F.array(F.lit("all_plans"))).otherwise(F.array(F.lit("all_plans"), F.lit("boundary_resolved_only")))
    return scoring.aggregate(rows.withColumn("view", F.explode(views)), "view")


def scale_consistency(scores: DataFrame, *keys: str, spread: float = 1.15) -> DataFrame:
    """Median, spread (largest by smallest) and number of the ratios of predicted to true values; one scale explains them if
    two or more ratios spread by less than `spread`."""
    ratio = F.col("predicted") / F.nullif("truth", F.lit(0.0))
    g = scores.withColumn("ratio", ratio).where("ratio is not null").groupBy(*keys).agg(F.percentile("ratio", F.lit(0.5)).alias("median"), F.max("ratio").alias("high"), F.min("ratio").alias("low"), F.count(F.lit(1)).alias("n"))
    wide = F.when((F.col("n") > 1) & (F.col("low") > 0), F.col("high") / F.col("low"))
    return g.select(*keys, "n", "median", wide.alias("spread"), F.coalesce(wide < spread, F.lit(False)).alias("one_scale"))


def run_summary(runs: DataFrame) -> DataFrame:
    """status, n, median and longest seconds (the upper median) of runs (status, seconds)."""
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seconds DESC)")
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), middle.alias("median_seconds"), F.max("seconds").alias("most_seconds"))


#: Fixed value: how a requirement begins.
REQUIREMENT = r"^([\w.]+)\s*(>=|<=|>|<|==)\s*([0-9.]+)"


def requirement(text: Column) -> dict[str, Column]:
    """field, op and threshold of a requirement's text, null where it is no plain comparison."""
    part = lambda i: F.nullif(F.regexp_extract(text, REQUIREMENT, i), F.lit(""))
    return {"field": part(1), "op": part(2), "threshold": part(3).try_cast("double")}


def fragility(value: Column, threshold: Column) -> dict[str, Column]:
    """margin to a threshold, and whether it is smaller than the tolerance of scoring."""
    margin = F.abs(value - threshold)
    return {"margin": margin, "fragile": margin < m.truth_tolerance(value)}


def status_from_source(source: Column) -> Column:
    """How a value came about, from the text of its provenance."""
    old = F.regexp_extract(source, r":\s*(agreed|uncorroborated|minor_variance|outlier_detected|conflicting_evidence)\s+across", 1)
    return (
        F.when(source.isNull() | (source == ""), "NO_VALUE")
        .when(old != "", F.concat(F.lit("LEGACY_"), F.upper(old)))
        .when(source.startswith("FINAL:"), source)
        .when(source.startswith("evidence_decision:"), F.concat(F.lit("EVDEC_"), F.regexp_extract(source, r"^evidence_decision:(.*?)(?:_DOCUMENT.*)?$", 1)))
        .when(source.startswith("legacy_fallback:"), "EVDEC_LEGACY_FALLBACK")
        .otherwise(F.concat(F.lit("OTHER("), F.left(F.trim(F.split_part(source, F.lit("="), F.lit(1))), F.lit(40)), F.lit(")")))
    )


#: Ways to treat a model's readings when runs are replayed.
POLICIES = ("base", "tol5", "grounded_only", "cv_priority", "vlm_only_low")


def replayed(pairs: DataFrame, policy: str) -> DataFrame:
    """status, value and level of pairs (cv_value, cv_confidence, vision_value, vision_confidence, grounded) under a policy.

    tol5 agrees within 0.15 or 5 %. Where both differ, cv_priority and
    vlm_only_low take the CV value, grounded_only does so if the reading isn't
    grounded; vlm_only_low trusts a lone reading LOW at most.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    a, b = F.col("cv_value"), F.col("vision_value")
    within = F.abs(a - b) <= (F.greatest(F.lit(0.15), 0.05 * F.greatest(F.abs(a), F.abs(b))) if policy == "tol5" else m.fusion_tolerance(a, b, F.lit("m")))
    prefer = {"cv_priority": F.lit(True), "vlm_only_low": F.lit(True), "grounded_only": F.coalesce(F.col("grounded") == F.lit(False), F.lit(False))}.get(policy, F.lit(False))
    status = F.when(a.isNull() & b.isNull(), "MISSING").when(a.isNull(), "VISION_ONLY").when(b.isNull() | (~within & prefer), "CV_ONLY").when(within, "AGREED").otherwise("CONFLICT")
    seen = level_from_score(F.col("vision_confidence"))
    alone = cap_level(seen, F.lit("LOW")) if policy == "vlm_only_low" else seen
    rows = pairs.withColumn("status", status)
    level = F.when(F.col("status") == "AGREED", "HIGH").when(F.col("status") == "CONFLICT", "CONFLICTING").when(F.col("status") == "CV_ONLY", level_from_score(F.col("cv_confidence"))).when(F.col("status") == "VISION_ONLY", alone).otherwise("MISSING")
    value = F.when(F.col("status") == "AGREED", (a + b) / 2.0).when(F.col("status") == "CV_ONLY", a).when(F.col("status") == "VISION_ONLY", b)
    return rows.withColumn("value", value).withColumn("level", level)


def explained(results: DataFrame, texts: DataFrame) -> DataFrame:
    """Rule results (plan_id, rule_id, explanation) with the text written for them, the engine's own where there is none."""
    said = texts.select("plan_id", "rule_id", F.nullif("plain", F.lit("")).alias("plain"), "suggestion")
    return results.join(said, ["plan_id", "rule_id"], "left").withColumn("plain", F.coalesce("plain", "explanation"))


def same_source(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries (pos, tags, sha256 map) made from corrections that share a file's hash, by kind, with an event (correction_id,
    sha256 map): correction_id and the first such entry."""
    made = entries.where(F.array_contains("tags", "user_correction")).select("plan_id", "pos", F.explode("sha256").alias("kind", "digest"))
    asked = events.select("correction_id", F.explode("sha256").alias("kind", "digest"))
    return asked.join(made, ["kind", "digest"]).groupBy("correction_id").agg(F.min_by("plan_id", "pos").alias("plan_id"))


def first_of_each(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row of each key."""
    kept = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def distinct_measurements(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """Measurements with one of each field and value to four decimals, the first."""
    rows = measurements.withColumn("_value", F.bround("value", 4))
    return first_of_each(rows, [*keys, "field", "_value"]).drop("_value")


def merged_metadata(pages: DataFrame, key: str) -> DataFrame:
    """key, name, value: what a document's pages (page, metadata map) say, the first page that says something."""
    rows = pages.select(key, "page", F.explode("metadata").alias("name", "value")).where("value is not null and trim(value) not in ('', '[]', '{}')")
    return rows.groupBy(key, "name").agg(F.min_by("value", "page").alias("value"))


def grounded_items(items: DataFrame, tokens: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Items of a model (keys, pos, value, evidence) that a page's text bears out (kept) and those dropped, with a warning each.

    tokens: keys, tokens (the numbers printed on the page, or no row). See text.grounding.
    """
    from plumbline.functions.text import grounding

    rows = spread_join(items, tokens, keys, "left")
    rows = rows.withColumn("g", F.explode(F.array(grounding(F.col("value"), F.col("evidence"), F.coalesce("tokens", F.array().cast("array<string>"))))))
    rows = rows.withColumn("value", F.col("g.value")).withColumn("grounded", F.col("g.grounded")).withColumn("keep", F.col("g.keep")).drop("g", "tokens")
    warning = F.concat(F.lit("not printed on the page: "), F.element_at(value_forms(F.col("value")), 1))
    return {"kept": rows.where("keep").drop("keep"), "dropped": rows.where("not keep").drop("keep").withColumn("warning", warning)}


def municipalities(*tables: DataFrame) -> DataFrame:
    """The different municipalities of several tables."""
    out = tables[0].select("municipality")
    for t in tables[1:]:
        out = out.union(t.select("municipality"))
    return out.distinct()


def run_eval(truth: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("plan_id", "field")) -> DataFrame:
    """The aggregates of every modality: overall, by field and by plan, in one pass over the scores.

    predictions: modality, keys, value, level, flagged. Columns modality, plan_id
    and field are null where a row stands for all of them. A plan counts for a
    modality if that predicts anything for it.
    """
    seen = predictions.select("modality", "plan_id").distinct()
    asked = truth.join(seen, "plan_id")
    scores = scoring.score_fields(asked, predictions, ["modality", *keys])
    views = F.array(*[F.struct(*[(F.col(k) if k in kept else F.lit(None).cast(scores.schema[k].dataType)).alias(f"v_{k}") for k in keys]) for kept in ((), ("field",), ("plan_id",))])
    rows = scores.select("modality", "status", "level", "flagged", F.inline(views))
    found = scoring.aggregate(rows, "modality", *[f"v_{k}" for k in keys])
    return found.withColumnsRenamed({f"v_{k}": k for k in keys})


def report_line() -> Column:
    """The line of text of a row of run_eval."""
    share = lambda c: F.coalesce(F.format_string("%.1f%%", F.col(c) * 100), F.lit("n/a"))
    name = F.concat_ws(" ", "modality", F.coalesce("field", F.col("plan_id").cast("string"), F.lit("overall")))
    counts = F.format_string("correct %d wrong %d missing %d spurious %d", "n_correct", "n_wrong", "n_missing", "n_spurious")
    return F.concat(name, F.lit(": "), counts, F.lit(", answer rate "), share("answer_rate"), F.lit(", accuracy "), share("accuracy"))


def text_report(evaluated: DataFrame) -> DataFrame:
    """A line of text for each row of run_eval."""
    return evaluated.select("modality", "plan_id", "field", report_line().alias("line"))
