"""Numbers of floors from the texts of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text

#: Names of levels from the ground up, and how levels are named in titles, captions, cells and rows of tables.
ORDINALS = ("GROUND", "FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH")
WORDS = "|".join(ORDINALS)
TOKEN = rf"(?:{WORDS}|\d{{1,2}}\s*(?:ST|ND|RD|TH))"
LEVEL = rf"(?i)({WORDS})|(\d{{1,2}})\s*(?:ST|ND|RD|TH)"
NAMED = rf"(?i)\b({WORDS})\s+FLOORS?\b"
CAPTION = rf"(?i)\b({TOKEN}(?:\s*(?:,|&|AND)\s*{TOKEN})*)\s+FLOORS?\s+PLANS?\b"
CELL = rf"(?i)^\s*({TOKEN})\s+FLOORS?\s*$"
ROW = r"(?i)\b(?:PLINTH|BUILT[\s-]?UP|COVERAGE|FLOOR|CARPET)?\s*AREA\s+IN\s+([GFST])\.?\s*F\b"
AMBIGUOUS = r"(?i)\b(BASEMENT|CELLAR|MEZZANINE|PODIUM)\s+FLOORS?\s+PLANS?\b"
ABBREVIATIONS = "GFST"


def _ordinal(word: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, ORDINALS)), F.upper(word)) - 1).cast("int")


def levels_in(fragment: Column) -> Column:
    """Numbers of all levels that a fragment names, ground 0."""
    words, digits = (F.regexp_extract_all(fragment, F.lit(LEVEL), F.lit(i)) for i in (1, 2))
    return F.zip_with(words, digits, lambda w, d: F.when(w != "", _ordinal(w)).otherwise(d.try_cast("int")))


def levels_by_form(t: Column) -> Column:
    """array of struct(form, levels) of one text; a title counts only with two different levels."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(NAMED), F.lit(1)), _ordinal))
    none = F.array().cast("array<int>")
    captions = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(CAPTION), F.lit(1)), levels_in))
    cell, row = F.regexp_extract(t, CELL, 1), F.upper(F.regexp_extract(t, ROW, 1))
    forms = {
        "title": F.when(F.size(named) >= 2, named).otherwise(none),
        "captions": captions,
        "cells": levels_in(cell),
        "rows": F.when(row != "", F.array((F.instr(F.lit(ABBREVIATIONS), row) - 1).cast("int"))).otherwise(none),
    }
    return F.array(*[F.struct(F.lit(n).alias("form"), c.alias("levels")) for n, c in forms.items()])


def named_levels(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, floors, n_forms: floors by the levels that a document's texts name.

    A form counts if its levels run from the ground without a gap; forms that
    differ, or a caption of a basement and the like, leave the document out.
    Levels are reduced to distinct ones before documents meet.
    """
    seen = texts.select(*keys, F.col("text").rlike(AMBIGUOUS).alias("odd"), F.inline(levels_by_form(F.col("text")))).select(*keys, "odd", "form", F.explode_outer("levels").alias("level"))
    per = seen.groupBy(*keys, "form", "level").agg(F.bool_or("odd").alias("odd"))
    per = per.groupBy(*keys, "form").agg(F.bool_or("odd").alias("odd"), F.min("level").alias("low"), F.max("level").alias("high"), F.count("level").alias("n"))
    fits = (F.col("low") == 0) & (F.col("high") + 1 == F.col("n"))
    g = per.groupBy(*keys).agg(F.bool_or("odd").alias("odd"), F.min(F.when(fits, F.col("n"))).alias("least"), F.max(F.when(fits, F.col("n"))).alias("floors"), F.count(F.when(fits, 1)).alias("n_forms"))
    return g.where(~F.col("odd") & (F.col("least") == F.col("floors"))).select(*keys, F.col("floors").cast("int").alias("floors"), "n_forms")


def floor_counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, floors, level, source: the first text (by pos) that prints a number of floors, MEDIUM; else the named levels,
    MEDIUM if two forms agree, else LOW."""
    said = texts.withColumn("said", text.floor_count(F.col("text"))).groupBy(*keys).agg(F.min_by("said", F.when(F.col("said").isNotNull(), F.col("pos"))).alias("said"), F.count("said").alias("n"))
    rows = said.join(named_levels(texts, keys), keys, "left")
    printed = F.col("n") > 0
    level = F.when(printed | (F.col("n_forms") >= 2), "MEDIUM").otherwise("LOW")
    out = rows.select(*keys, F.when(printed, F.col("said")).otherwise(F.col("floors")).alias("floors"), level.alias("level"), F.when(printed, "label").otherwise("levels").alias("source"))
    return out.where("floors is not null")


def floors_from_vision(regions: DataFrame, keys: list[str], least: float = 0.7) -> DataFrame:
    """keys, floors: different kinds of floor plans that a model sees with at least that confidence."""
    kind = F.upper("type")
    seen = regions.where((F.col("confidence") >= least) & kind.endswith("_FLOOR_PLAN"))
    return seen.groupBy(*keys).agg(F.count_distinct(kind).alias("floors"))
