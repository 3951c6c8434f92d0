"""From single verdicts to a plan: fusion applied to its fields, areas reconciled, decisions shipped, edits and context.

A plan is a wide row: plan_id and a struct (num, str, level) for each field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.levels import cap_level
from plumbline.functions.text import building_use
from plumbline.operators.decisions import reported_vs_calculated
from plumbline.operators.gates import PLAUSIBLE_RATIO, SIDES, ratios

#: The fields that decisions may ship, those that follow from others, and limits of area reconciliation.
SHIPPABLE = ("plot.width", "plot.depth", "plot.area", "building.width", "building.depth", "building.footprint_area", "road.width", *SIDES, "coverage", "far")
DERIVED = ("coverage", "far")
RECTANGULAR_ENOUGH, AREA_TOLERANCE = 0.85, 0.08
SHIPPED = ("AGREED", "CV_ONLY", "VISION_ONLY")


def field(num: Column, level: Column) -> Column:
    return F.struct(num.cast("double").alias("num"), F.lit(None).cast("string").alias("str"), level.alias("level"))


def conflicting() -> Column:
    return field(F.lit(None), F.lit("CONFLICTING"))


def missing() -> Column:
    return field(F.lit(None), F.lit("MISSING"))


def cap_field(value: Column, ceiling: Column) -> Column:
    """A field whose level is no better than the ceiling."""
    return F.struct(value["num"].alias("num"), value["str"].alias("str"), cap_level(value["level"], ceiling).alias("level"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns computed once, as the optimiser doesn't copy a generated row into what uses it."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, row.alias("_once")).select(*kept, "_once.*")


def _parts_once(df: DataFrame, **fields: Column) -> DataFrame:
    """df with the fields computed once, each as two plain columns `<name>|num` and `<name>|level` (nested ones confuse column pruning)."""
    flat = {f"{n}|{part}": c[part] for n, c in fields.items() for part in ("num", "level")}
    return _once(df, **flat)


def by_field(rows: DataFrame, values: list[str], fields: tuple[str, ...]) -> DataFrame:
    """Long rows (plan_id, field, values) as one row for each plan, a struct `f_<field>` of values for each field."""
    return rows.groupBy("plan_id").agg(*[F.first(F.when(F.col("field") == n, F.struct(*values)), ignorenulls=True).alias(f"f_{n}") for n in fields])


def reconciled_area(direct: Column, width: Column, depth: Column, rectangularity: Column, fallback: Column, printed: Column) -> Column:
    """An area read directly against width by depth of the final sides.

    Width by depth counts where both are positive and the shape is rectangular
    enough (unknown shapes are), at the weaker level of the two. A direct reading
    within AREA_TOLERANCE of it stays, and so does a printed one; else the sides
    win. Without such sides the direct reading stands, else the fallback.
    """
    usable = (width["num"] > 0) & (depth["num"] > 0) & (F.coalesce(rectangularity, F.lit(1.0)) >= RECTANGULAR_ENOUGH)
    product = width["num"] * depth["num"]
    known = direct["num"].isNotNull()
    stays = F.coalesce(direct["num"] > 0, F.lit(False)) & ((F.abs(direct["num"] - product) / product <= AREA_TOLERANCE) | printed)
    by_sides = field(F.bround(product, 4), cap_level(width["level"], depth["level"]))
    return F.when(F.coalesce(usable, F.lit(False)), F.when(stays, direct).otherwise(by_sides)).otherwise(F.when(known, direct).otherwise(fallback))


def apply_agreement(plans: DataFrame, fused: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """The plans with the fused values of CV and vision in place of their own, and `conflicts`, the fields in conflict.

    fused: plan_id, field, status, value, level. A conflict is shown and never
    replaced by the plan's own value; fields without fused value keep it. Areas
    are reconciled with the final sides, a footprint larger than the plot is a
    conflict, and coverage and FAR follow from the final areas unless fused
    themselves. shapes: plan_id, plot_shape, building_shape (rectangularity) and
    plot_printed, building_printed (the plan's area is from a printed table).
    """
    wide = by_field(fused, ["status", "value", "level"], SHIPPABLE)
    if shapes is None:
        shapes = plans.select("plan_id", *[F.lit(None).cast(k).alias(n) for n, k in (("plot_shape", "double"), ("building_shape", "double"), ("plot_printed", "boolean"), ("building_printed", "boolean"))])
    used = (*SHIPPABLE, "building.floor_count")
    rows = plans.join(wide, "plan_id", "left").join(shapes, "plan_id", "left")
    rows = rows.select(
        *[F.col(f"`{c}`") for c in plans.columns if c not in SHIPPABLE], *shapes.drop("plan_id").columns,
        *[F.col(f"`{n}`.{part}").alias(f"{n}|{part}") for n in used for part in ("num", "level")], *[F.col(f"`f_{n}`.{part}").alias(f"f_{n}|{part}") for n in SHIPPABLE for part in ("status", "value", "level")],
    )
    own = lambda n: field(F.col(f"`{n}|num`"), F.col(f"`{n}|level`"))
    fuse = lambda n, part: F.col(f"`f_{n}|{part}`")

    def final(name: str, fallback: Column) -> Column:
        usable = fuse(name, "status").isin(*SHIPPED) & fuse(name, "value").isNotNull()
        return F.when(fuse(name, "status") == "CONFLICT", conflicting()).when(usable, field(F.bround(fuse(name, "value"), 4), fuse(name, "level"))).otherwise(fallback)

    plain = [n for n in SHIPPABLE if n not in (*DERIVED, "plot.area", "building.footprint_area")]
    rows = _parts_once(rows, **{n: final(n, own(n)) for n in plain})
    for part, area in (("plot", "plot.area"), ("building", "building.footprint_area")):
        printed = F.coalesce(f"{part}_printed", F.lit(False))
        rows = _parts_once(rows, read=final(area, F.when(printed, own(area))))
        # A printed area of the plan itself is only asked for where nothing was fused.
        printed = printed & ~F.coalesce(fuse(area, "status").isin(*SHIPPED, "CONFLICT"), F.lit(False))
        rows = _parts_once(rows, **{area: reconciled_area(own("read"), own(f"{part}.width"), own(f"{part}.depth"), F.col(f"{part}_shape"), own(area), printed)})
    foot, plot = own("building.footprint_area"), own("plot.area")
    rows = _parts_once(rows, **{"building.footprint_area": F.when(F.coalesce((plot["num"] > 0) & (foot["num"] / plot["num"] > PLAUSIBLE_RATIO), F.lit(False)), conflicting()).otherwise(foot)})
    rows = _parts_once(rows, **{f"r_{n}": c for n, c in ratios(foot, plot, own("building.floor_count")).items()})
    rows = _parts_once(rows, **{n: final(n, F.when(own(f"r_{n}")["num"].isNotNull(), own(f"r_{n}")).otherwise(own(n))) for n in DERIVED})
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"`{n}|level`") == "CONFLICTING", F.lit(n)) for n in SHIPPABLE]))
    return rows.select(*[own(c).alias(c) if c in SHIPPABLE else F.col(f"`{c}`") for c in plans.columns], conflicts.alias("conflicts"))


def vision_only_plans(ids: DataFrame, vision: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Wide plans of the best vision readings alone: ids (plan_id); vision: plan_id, field, value, level. All else is MISSING."""
    wide = ids.join(by_field(vision, ["value", "level"], fields), "plan_id", "left")
    made = [F.when(F.col(f"`f_{n}`.value").isNotNull(), field(F.bround(F.col(f"`f_{n}`.value"), 4), F.col(f"`f_{n}`.level"))).otherwise(missing()).alias(n) for n in fields]
    return wide.select("plan_id", *made)


def bridged_decisions(decisions: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, field, decision, num, level, source for every shippable field of every plan.

    decisions: plan_id, field, decision, value, level; a field without a row
    abstains. Where a decision abstains, the plan's own value ships if it is at
    least MEDIUM, and at most as MEDIUM. Coverage and FAR that abstain follow from
    the shipped areas first, and fall back to the plan's own only then.
    """
    rows = plans.join(by_field(decisions, ["decision", "value", "level"], SHIPPABLE), "plan_id", "left")
    own = lambda n: F.col(f"`{n}`")
    kind = lambda decision, num, level, source: F.struct(decision.alias("decision"), num.cast("double").alias("num"), level.alias("level"), source.alias("source"))
    none = kind(F.lit("ABSTAIN"), F.lit(None), F.lit("MISSING"), F.lit(None).cast("string"))

    def own_value(n: str, otherwise: Column) -> Column:
        fits = own(n)["num"].isNotNull() & own(n)["level"].isin("MEDIUM", "HIGH")
        return F.when(fits, kind(F.lit("ACCEPT"), own(n)["num"], cap_level(own(n)["level"], F.lit("MEDIUM")), F.lit("legacy"))).otherwise(otherwise)

    def decided(n: str, otherwise: Column) -> Column:
        f = F.col(f"`f_{n}`")
        return F.when(f["decision"].isin("ACCEPT", "CONFLICT"), kind(f["decision"], f["value"], f["level"], F.lit("evidence"))).otherwise(otherwise)

    rows = _once(rows, **{f"d_{n}": decided(n, own_value(n, none) if n not in DERIVED else none) for n in SHIPPABLE})
    made = ratios(F.col("`d_building.footprint_area`"), F.col("`d_plot.area`"), own("building.floor_count"))
    rows = _once(rows, **{f"r_{n}": c for n, c in made.items()})
    derived = {f"d_{n}": F.when(F.col(f"`d_{n}`.decision") != "ABSTAIN", F.col(f"`d_{n}`")).when(F.col(f"r_{n}.num").isNotNull(), kind(F.lit("ACCEPT"), F.col(f"r_{n}.num"), F.col(f"r_{n}.level"), F.lit("derived"))).otherwise(own_value(n, none)) for n in DERIVED}
    rows = _once(rows, **derived)
    return rows.select("plan_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), *[F.col(f"`d_{n}`.{c}").alias(c) for c in ("decision", "num", "level", "source")]) for n in SHIPPABLE])))


def apply_decisions(plans: DataFrame, bridged: DataFrame) -> DataFrame:
    """The plans with the shippable fields that were decided in place of their own."""
    wide = plans.join(by_field(bridged, ["num", "level"], SHIPPABLE), "plan_id", "left")
    return wide.select(*[F.coalesce(F.when(F.col(f"`f_{c}`").isNotNull(), field(F.col(f"`f_{c}`.num"), F.col(f"`f_{c}`.level"))), F.col(f"`{c}`")).alias(c) if c in SHIPPABLE else F.col(f"`{c}`") for c in plans.columns])


def decision_differences(plans: DataFrame, bridged: DataFrame) -> DataFrame:
    """plan_id, field, old, old_level, new, new_level wherever the plan and the decisions differ in value or level."""
    old = plans.select("plan_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`.num").alias("old"), F.col(f"`{n}`.level").alias("old_level")) for n in SHIPPABLE])))
    met = old.join(bridged.select("plan_id", "field", F.col("num").alias("new"), F.col("level").alias("new_level")), ["plan_id", "field"])
    return met.where(~F.col("old").eqNullSafe(F.col("new")) | ~F.col("old_level").eqNullSafe(F.col("new_level")))


def document_fusion(resolved: DataFrame, measurements: DataFrame) -> DataFrame:
    """plan_id, field, final, status: verdicts with printed values before calculated ones, and derived coverage and FAR.

    resolved: plan_id, field, status, value. A printed value stands where CV alone
    or both spoke. Coverage and FAR (of one floor) that are without value follow
    from the final areas where these are plausible; their status says so.
    """
    printed = reported_vs_calculated(measurements, ["plan_id", "field"]).select("plan_id", "field", "reported")
    rows = resolved.join(printed, ["plan_id", "field"], "left")
    spoke = F.col("status").rlike("^(CV_ONLY|AGREED)_")
    rows = rows.select("plan_id", "field", "status", F.when(spoke, F.coalesce("reported", "value")).otherwise(F.col("value")).alias("final"))
    pick = lambda n: F.max(F.when(F.col("field") == n, F.col("final")))
    areas = rows.groupBy("plan_id").agg(pick("building.footprint_area").alias("foot"), pick("plot.area").alias("plot"), pick("coverage").alias("coverage"), pick("far").alias("far"))
    medium = lambda c: field(F.col(c), F.lit("MEDIUM"))
    areas = _once(areas, r=F.struct(*[c.alias(n) for n, c in ratios(medium("foot"), medium("plot"), missing()).items()]))
    made = [F.when(F.col(n).isNull() & F.col(f"r.{n}.num").isNotNull(), F.struct(F.lit(n).alias("field"), F.lit("DERIVED_FROM_FOOTPRINT_AND_PLOT_AREA").alias("status"), F.bround(F.col(f"r.{n}.num"), 4).alias("final"))) for n in DERIVED]
    derived = areas.select("plan_id", F.inline(F.array_compact(F.array(*made))))
    kept = rows.join(derived.select("plan_id", "field"), ["plan_id", "field"], "left_anti")
    return kept.select("plan_id", "field", "final", "status").unionByName(derived.select("plan_id", "field", "final", "status"))


# ---------------------------------------------------------------- heights

#: Kinds of heights that are read, by what they stand for.
HEIGHTS = {"overall": ("BUILDING_HEIGHT", "PROPOSED_BUILDING_HEIGHT"), "floor": ("FLOOR_HEIGHT",), "stilt": ("STILT_HEIGHT",), "plinth": ("PLINTH_HEIGHT",), "parapet": ("PARAPET_HEIGHT",), "without_stilt": ("HEIGHT_EXCLUDING_STILT",)}


def building_heights(readings: DataFrame, floors: DataFrame) -> DataFrame:
    """plan_id, height, height_level, without_stilt, source from readings of heights in metres.

    readings: plan_id, type, value, confidence, pos; of one kind the most confident
    counts, the first of equals (an overall height: the last reading above 0.8,
    else the first). Without an overall height it is floors times the height of a
    floor, with stilt, plinth and parapet; MEDIUM if that height is read at 0.8 or
    more, else LOW. Heights that a regulation allows are none.
    """
    is_ = lambda kind: F.col("type").isin(*HEIGHTS[kind])
    best = lambda kind: F.max_by(F.struct("value", "confidence"), F.when(is_(kind), F.struct("confidence", -F.col("pos"))))
    some = lambda kind: F.count(F.when(is_(kind), 1)) > 0
    late = F.max_by(F.struct("value", "confidence"), F.when(is_("overall") & (F.col("confidence") > 0.8), F.col("pos")))
    early = F.min_by(F.struct("value", "confidence"), F.when(is_("overall"), F.col("pos")))
    sure = F.count(F.when(is_("overall") & (F.col("confidence") > 0.8), 1)) > 0
    g = readings.where("value is not null").groupBy("plan_id").agg(F.when(sure, late).when(some("overall"), early).alias("overall"), *[F.when(some(k), best(k)).alias(k) for k in HEIGHTS if k != "overall"])
    rows = g.join(floors.select("plan_id", "floors"), "plan_id", "left")
    part = lambda k: F.coalesce(F.col(f"{k}.value"), F.lit(0.0))
    made = F.when((F.col("floors") > 0) & F.col("floor.value").isNotNull(), F.col("floor.value") * F.col("floors") + part("stilt") + part("plinth") + part("parapet"))
    own = F.col("overall.value").isNotNull()
    level = lambda c: F.when(c >= 0.85, "HIGH").when(c > 0.75, "MEDIUM").otherwise("LOW")
    made_level = F.when(F.col("floor.confidence") >= 0.8, "MEDIUM").otherwise("LOW")
    height = F.bround(F.coalesce("overall.value", made), 4)
    return rows.select("plan_id", height.alias("height"), F.when(own, level(F.col("overall.confidence"))).when(made.isNotNull(), made_level).otherwise("MISSING").alias("height_level"), F.bround("without_stilt.value", 4).alias("without_stilt"), F.when(own, "read").when(made.isNotNull(), "derived").alias("source"))


# ---------------------------------------------------------------- edits and context

#: Fields that a person may edit, the text ones, and other names of two.
EDITABLE = ("plot.width", "plot.depth", "plot.area", "building.width", "building.depth", "building.footprint_area", "building.floor_count", "road.width", *SIDES, "coverage", "far", "building_height_estimated", "building_height_excluding_stilt")
EDITABLE_TEXT = ("development_area", "building_use")
EDIT_NAMES = {"building.height_estimated": "building_height_estimated", "building.height_excluding_stilt": "building_height_excluding_stilt"}


def checked_edits(edits: DataFrame) -> DataFrame:
    """edits (field, value as text) with field by its usual name, num, str and problem (null if the edit may be applied)."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in EDIT_NAMES.items() for v in kv]), F.col("field")), F.col("field"))
    said = F.trim("value")
    number = F.when(F.col("field").isin(*EDITABLE), F.when(F.col("field") == "building.floor_count", F.floor(said.try_cast("double")).cast("double")).otherwise(said.try_cast("double")))
    area = F.when(F.upper(said).isin("A", "B", "C"), F.upper(said))
    text = F.when(F.col("field") == "development_area", area).when(F.col("field") == "building_use", building_use(said))
    problem = (
        F.when(~F.col("field").isin(*EDITABLE, *EDITABLE_TEXT), "NOT_EDITABLE")
        .when(said.isNull() | (said == ""), "NO_VALUE")
        .when(F.col("field").isin(*EDITABLE_TEXT), F.when(F.col("str").isNull(), "UNSUPPORTED_VALUE"))
        .when(F.col("num").isNull(), "NOT_A_NUMBER")
        .when((F.col("field") == "building.floor_count") & (F.col("num") < 1), "NO_FLOORS")
        .when(F.col("num") < 0, "NEGATIVE")
    )
    return edits.withColumn("field", name).withColumn("num", number).withColumn("str", text).withColumn("problem", problem)


def apply_edits(plans: DataFrame, edits: DataFrame) -> DataFrame:
    """The plans with the last good edit of each field (plan_id, field, value, pos) at level HIGH."""
    good = checked_edits(edits).where("problem is null")
    last = good.groupBy("plan_id", "field").agg(F.max_by(F.struct("num", "str"), "pos").alias("v")).select("plan_id", "field", "v.*")
    wide = plans.join(by_field(last, ["num", "str"], (*EDITABLE, *EDITABLE_TEXT)), "plan_id", "left")
    edited = lambda c: F.struct(F.col(f"`f_{c}`.num").alias("num"), F.col(f"`f_{c}`.str").alias("str"), F.lit("HIGH").alias("level"))
    return wide.select(*[F.when(F.col(f"`f_{c}`").isNotNull(), edited(c)).otherwise(F.col(f"`{c}`")).alias(c) if c in (*EDITABLE, *EDITABLE_TEXT) else F.col(f"`{c}`") for c in plans.columns])


def context_from_metadata(metadata: Column) -> dict[str, Column]:
    """development_area, building_use and building_height_excluding_stilt (HIGH) as a plan's free metadata (map of texts) give them, else null."""
    said = lambda name: F.nullif(F.trim(F.try_element_at(metadata, F.lit(name))), F.lit(""))
    text = lambda c: F.when(c.isNotNull(), F.struct(F.lit(None).cast("double").alias("num"), c.alias("str"), F.lit("HIGH").alias("level")))
    height = said("building_height_excluding_stilt").try_cast("double")
    use = building_use(F.coalesce(said("building_use"), said("building_type")))
    return {"development_area": text(F.upper(said("development_area"))), "building_use": text(use), "building_height_excluding_stilt": F.when(height.isNotNull(), field(height, F.lit("HIGH")))}


def with_context(plans: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The plans with context fields that they lack taken from their metadata."""
    given = context_from_metadata(F.col(metadata))
    lacks = lambda c: F.col(f"`{c}`.num").isNull() & F.col(f"`{c}`.str").isNull()
    return plans.withColumns({c: F.when(lacks(c) & v.isNotNull(), v).otherwise(F.col(f"`{c}`")) for c, v in given.items()})


def predictions(plans: DataFrame, fields: tuple[str, ...] = SHIPPABLE) -> DataFrame:
    """plan_id, field, value, level, flagged: the plan's fields as long rows, to be scored."""
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"`{n}`.num").alias("value"), F.col(f"`{n}`.level").alias("level"), (F.col(f"`{n}`.level") == "CONFLICTING").alias("flagged")) for n in fields]
    return plans.select("plan_id", F.inline(F.array(*rows)))


def ungated(level: Column) -> Column:
    """As if LOW values counted: LOW becomes MEDIUM."""
    return F.when(level == "LOW", "MEDIUM").otherwise(level)


def flagged_as_conflict(level: Column, flagged: Column) -> Column:
    """As if flagged values were conflicts."""
    return F.when(F.coalesce(flagged, F.lit(False)), "CONFLICTING").otherwise(level)
