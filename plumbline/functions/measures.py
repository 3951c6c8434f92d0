"""Units, tolerances and derived measures as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a unit of length, square metres in a unit of area, and spellings of them.
METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "ft": 0.3048, "in": 0.0254}
VISION_METRES = {"m": 1.0, "meter": 1.0, "metre": 1.0, "mm": 0.001, "cm": 0.01, "ft": 0.3048, "feet": 0.3048}
SQUARE_FEET_IN_SQUARE_METRE = 10.7639104167
VISION_SQUARE_FOOT = 0.09290304


def lookup(key: Column, table: dict[str, float]) -> Column:
    """Value of a small fixed table, null for other keys."""
    return reduce(lambda rest, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(rest), table.items(), F.lit(None).cast("double"))


def to_metres(value: Column, unit: Column) -> Column:
    """Length in metres to 6 decimals, null for units that are no length."""
    return F.round(value * lookup(unit, METRES), 6)


def feet_inches_to_metres(feet: Column, inches: Column) -> Column:
    """(ft + in / 12) * 0.3048; null unless 0 <= inches < 12."""
    return F.when((inches >= 0) & (inches < 12), (feet + inches / 12.0) * 0.3048)


def to_square_metres(square_feet: Column) -> Column:
    return F.round(square_feet / SQUARE_FEET_IN_SQUARE_METRE, 6)


def vision_metres(value: Column, unit: Column) -> Column:
    return value * lookup(F.lower(F.coalesce(unit, F.lit("m"))), VISION_METRES)


def vision_area_unit(unit: Column) -> Column:
    """m2, % or ratio for the spellings in use; ft2 becomes m2, others null."""
    name = F.replace(F.lower(F.coalesce(unit, F.lit("m2"))), F.lit("²"), F.lit("2"))
    return (
        F.when(name.isin("m2", "sqm", "sq.m", "square_metre", "square_meter", "ft2"), "m2")
        .when(name.isin("%", "percent", "percentage"), "%")
        .when(name == "ratio", "ratio")
    )


def vision_area(value: Column, unit: Column) -> Column:
    name = F.replace(F.lower(F.coalesce(unit, F.lit("m2"))), F.lit("²"), F.lit("2"))
    return F.when(name == "ft2", value * VISION_SQUARE_FOOT).when(vision_area_unit(unit).isNotNull(), value)


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(a), F.abs(b))


def reconcile_tolerance(median: Column) -> Column:
    return F.greatest(F.lit(0.05), F.abs(median) * 0.05)


def fusion_tolerance(a: Column, b: Column, unit: Column) -> Column:
    least = F.when(unit == "%", 0.20).when(unit == "ratio", 0.02).otherwise(0.05)
    return F.greatest(least, 0.01 * _larger(a, b))


def validation_tolerance(a: Column, b: Column, unit: Column) -> Column:
    least = F.when(unit == "%", 0.10).when(unit == "ratio", 0.01).otherwise(0.05)
    return F.greatest(least, 0.01 * _larger(a, b))


def close(a: Column, b: Column, least: float = 0.05, share: float = 0.01) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), share * _larger(a, b))


def truth_tolerance(expected: Column) -> Column:
    """Scoring and cross-checks: 0.15 or 5 % of the reference value."""
    return F.greatest(F.lit(0.15), F.abs(expected) * 0.05)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval of k of n; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
