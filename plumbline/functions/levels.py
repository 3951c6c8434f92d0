"""Confidence levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels that order by trust, weakest first, and those outside the order.
ORDERED = ("LOW", "MEDIUM", "HIGH")
UNORDERED = ("CONFLICTING", "MISSING")
HIGH_FROM, MEDIUM_ABOVE = 0.85, 0.75


def level_from_score(score: Column) -> Column:
    """HIGH from 0.85 on, MEDIUM above 0.75, else LOW; a null score is LOW."""
    return F.when(score >= HIGH_FROM, "HIGH").when(score > MEDIUM_ABOVE, "MEDIUM").otherwise("LOW")


def ordinal(level: Column) -> Column:
    """Place of an ordered level, null for the others."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(ORDERED):
        out = F.when(level == name, i).otherwise(out)
    return out


def cap_level(level: Column, ceiling: Column) -> Column:
    """The weaker of two ordered levels; CONFLICTING and MISSING on either side leave the level as it is."""
    outside = ordinal(level).isNull() | ordinal(ceiling).isNull()
    return F.when(outside, level).otherwise(F.when(ordinal(level) <= ordinal(ceiling), level).otherwise(ceiling))


def usable(value: Column, level: Column) -> Column:
    """Whether a value may enter a comparison."""
    return value.isNotNull() & F.coalesce(~level.isin(*UNORDERED), F.lit(True))
