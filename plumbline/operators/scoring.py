"""Scores of predictions against truth, and statistics over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.measures import truth_tolerance

#: Truth tiers that count, levels that are confident, and pairs of axes without order.
TIERS = ("printed", "derived", "inspected", "legacy")
CONFIDENT = ("HIGH", "MEDIUM")
AXIS_PAIRS = {"plot.width": "plot.depth", "building.width": "building.depth"}


def matches(predicted: Column, expected: Column, unit: Column | None = None) -> Column:
    """Within 0.15 or 5 %; whole numbers for counts."""
    near = F.abs(predicted - expected) <= truth_tolerance(expected)
    return near if unit is None else F.when(unit == "count", F.bround(predicted, 0) == expected).otherwise(near)


def score_fields(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, truth, predicted, level, flagged, status for every truth row that counts.

    truth: value, tier; predictions: value, level, flagged. Values that must be
    withheld are SPURIOUS if predicted, else ABSTAINED_OK.
    """
    t = truth.where((F.col("tier") == "must_abstain") | (F.col("tier").isin(*TIERS) & F.col("value").isNotNull()))
    t = t.select(*keys, F.col("value").alias("truth"), "tier")
    p = predictions.select(*keys, F.col("value").alias("predicted"), "level", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    rows = t.join(p, keys, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    status = (
        F.when(F.col("tier") == "must_abstain", F.when(F.col("predicted").isNull(), "ABSTAINED_OK").otherwise("SPURIOUS"))
        .when(F.col("predicted").isNull(), "MISSING")
        .when(matches(F.col("predicted"), F.col("truth")), "CORRECT")
        .otherwise("WRONG")
    )
    return rows.select(*keys, F.when(F.col("tier") != "must_abstain", F.col("truth")).alias("truth"), "predicted", "level", "flagged", status.alias("status"))


def score_axis_pairs(pairs: DataFrame) -> DataFrame:
    """Both axes of a pair (ta, tb, pa, pb): swapped only if that matches strictly more; a lone value may match either."""
    ta, tb, pa, pb = (F.col(c) for c in ("ta", "tb", "pa", "pb"))
    hit = lambda p, t: matches(p, t).cast("int")
    both = pa.isNotNull() & pb.isNotNull()
    swap = both & (hit(pa, tb) + hit(pb, ta) > hit(pa, ta) + hit(pb, tb))

    def status(p: Column, own: Column, other: Column) -> Column:
        right = F.when(both, F.when(swap, matches(p, other)).otherwise(matches(p, own))).otherwise(matches(p, own) | matches(p, other))
        return F.when(p.isNull(), "MISSING").when(right, "CORRECT").otherwise("WRONG")

    return pairs.withColumns({"status_a": status(pa, ta, tb), "status_b": status(pb, tb, ta), "swapped": F.coalesce(swap, F.lit(False))})


def aggregate(scores: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates over score rows, in one aggregation."""
    status, level = F.col("status"), F.col("level")
    answered = status.isin("CORRECT", "WRONG", "SPURIOUS")
    valued = status.isin("CORRECT", "WRONG", "MISSING")
    confident = answered & F.coalesce(level.isin(*CONFIDENT), F.lit(False)) & ~F.col("flagged")
    wrong = answered & (status != "CORRECT")

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    columns = {
        "n_truth": n(valued),
        **{f"n_{s.lower()}": n(status == s) for s in ("CORRECT", "WRONG", "MISSING", "SPURIOUS", "ABSTAINED_OK")},
        "answer_rate": F.try_divide(n(valued & answered), n(valued)),
        "accuracy": F.try_divide(n(status == "CORRECT"), n(valued & answered)),
        "n_confident": n(confident),
        "n_confident_wrong": n(confident & wrong),
        "wrong_caught": F.try_divide(n(wrong & ~confident), n(wrong)),
    }
    return scores.groupBy(*keys).agg(*[c.alias(name) for name, c in columns.items()])


def risk_coverage(scores: DataFrame, *keys: str) -> DataFrame:
    """Coverage and risk when only answers of at least a level count."""
    status, level = F.col("status"), F.col("level")
    valued = F.count_if(status.isin("CORRECT", "WRONG", "MISSING"))
    rows = []
    for name, levels in (("HIGH", ("HIGH",)), ("HIGH+MEDIUM", ("HIGH", "MEDIUM")), ("ALL", ("HIGH", "MEDIUM", "LOW"))):
        at = status.isin("CORRECT", "WRONG", "SPURIOUS") & F.coalesce(level.isin(*levels), F.lit(False))
        rows.append(F.struct(F.lit(name).alias("at_least"), F.try_divide(F.count_if(at & (status != "SPURIOUS")), valued).alias("coverage"), F.try_divide(F.count_if(at & (status != "CORRECT")), F.count_if(at)).alias("risk"), F.count_if(at).alias("answers")))
    return scores.groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.inline("r"))


def auroc(rows: DataFrame, score: str, positive: str, *keys: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties a half; null if a class is empty. No pairs are formed.

    Scores are counted first, so that the window runs over distinct scores.
    """
    per = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("wins2", F.col("pos") * (2 * below + F.col("neg")))
    g = per.groupBy(*keys).agg(F.sum("wins2").alias("wins2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("wins2"), F.lit(2) * F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def confusion(rows: DataFrame, predicted: Column, actual: Column, *keys: str) -> DataFrame:
    tp, fp, fn, tn = (F.count_if(c) for c in (predicted & actual, predicted & ~actual, ~predicted & actual, ~predicted & ~actual))
    columns = {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)}
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def error_metrics(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute error and the upper median of relative errors over answered rows."""
    done = scores.where("truth is not null and predicted is not null")
    error = F.abs(F.col("predicted") - F.col("truth"))
    g = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("total_error"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(predicted - truth) / nullif(abs(truth), 0) DESC)").alias("median_ape"))
    return g.select(*keys, "n", (F.col("total_error") / F.col("n")).alias("mae"), "median_ape")


def mcnemar(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Exact two-sided McNemar test on paired booleans: discordant counts and p."""
    g = pairs.groupBy(*keys).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # One pass: the logarithm of a binomial term is a running sum of log((n - i) / (i + 1)).
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.log((n - i) / (i + 1))).alias("log"), (s["sum"] + F.exp(s["log"] - n * F.log(F.lit(2.0)))).alias("sum"))
    p = F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda s: s["sum"]))
    return g.select(*keys, "only_a", "only_b", F.when(n == 0, 1.0).otherwise(p).alias("p_value"))


#: Decided and undecided statuses of a rule.
DECIDED = ("PASS", "FAIL")


def outcome(truth: Column, predicted: Column) -> Column:
    """How a predicted rule status relates to the true one."""
    return (
        F.when((truth == "NOT_APPLICABLE") & (predicted == "NOT_APPLICABLE"), "CORRECT_NOT_APPLICABLE")
        .when(truth == "NOT_APPLICABLE", "SPURIOUS_APPLICABILITY")
        .when(~truth.isin(*DECIDED), "GT_UNDECIDABLE")
        .when(truth == predicted, "CORRECT_DECISION")
        .when(predicted == "PASS", "FALSE_PASS")
        .when(predicted == "FAIL", "FALSE_FAIL")
        .when(predicted == "NOT_APPLICABLE", "APPLICABILITY_FLIP")
        .otherwise(F.concat(F.lit("ABSTAIN_"), predicted))
    )


#: Differences count in steps of this size; the largest product of their number and the steps of their sum that a test takes.
STEP, MOST_WORK = 1e-6, 4_000_000_000


def sign_flip(rows: DataFrame, difference: str, *keys: str) -> DataFrame:
    """Exact randomisation test of paired differences: keys, n, observed, p_value.

    p is the share of all sign choices whose sum is at least as far from 0 as the
    observed one. Differences are fixed decimals, in steps of STEP. They are first
    counted by their size, and the distribution of the sum grows by one difference
    after another over the sums that can be reached; a group that is too large
    for that raises.
    """
    d = F.bround(F.col(difference).cast("double") / STEP).cast("long")
    per = rows.where(F.col(difference).isNotNull()).select(*keys, d.alias("d")).groupBy(*keys, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    # A group is one row with its sizes, so that a task goes through many groups in one call.
    groups = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("all"), F.sum("total").alias("total")).select(*keys, "all.size", "all.n", "total")

    def test(size: np.ndarray, n: np.ndarray, total: int) -> tuple[int, float, float]:
        step = int(np.gcd.reduce(size)) or 1
        size, reach = size // step, int((size // step * n).sum())
        if reach * int(n.sum()) > MOST_WORK:
            raise ValueError("the differences of a group are too many and too fine for the exact test")
        chance = np.zeros(2 * reach + 1)
        chance[reach] = 1.0
        for s, times in zip(size.tolist(), n.tolist(), strict=True):
            for _ in range(times if s else 0):
                grown = np.zeros(2 * reach + 1)
                grown[: len(grown) - s] = chance[s:]
                grown[s:] += chance[: len(grown) - s]
                chance = grown / 2
        far = np.abs(np.arange(-reach, reach + 1)) >= abs(total) // step
        return int(n.sum()), total * STEP, float(chance[far].sum())

    def tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("size").value_lengths().to_numpy().cumsum()
            size, n = (batch.column(c).flatten().to_numpy() for c in ("size", "n"))
            found = [test(size[end - k : end], n[end - k : end], total) for end, k, total in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), batch.column("total").to_pylist(), strict=True)]
            parts = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(p, t) for p, t in zip(parts, (pa.int64(), pa.float64(), pa.float64()), strict=True)]], [*keys, "n", "observed", "p_value"])

    return groups.mapInArrow(tests, f"{types}, n long, observed double, p_value double")
