"""Plausibility gates and derived areas over wide plan rows (fields are structs num, str, level)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.levels import cap_level
from plumbline.operators.rules import FIELDS, TEXT_FIELDS

#: Bounds beyond which a measure is impossible, and the fields that fall with it.
PLOT_AREA, SITE_SIDE, BUILDING_SIDE, FOOTPRINT, COVERAGE = (12.0, 500_000.0), (1.5, 1_000.0), (1.0, 1_000.0), (4.0, 200_000.0), (0.0, 100.0)
FAR_MAX, SAME_POLYGON, CLOSED_SETBACK, CLOSED_SIDES, PLAUSIBLE_RATIO = 12.0, 0.95, 0.3, 3, 1.02
SIDES = ("setbacks.front", "setbacks.rear", "setbacks.left", "setbacks.right")
BUILDING_CHAIN = ("building.width", "building.depth", "building.footprint_area", *SIDES, "coverage", "far")
GEOMETRY_CHAIN = ("plot.area", "plot.width", "plot.depth", *BUILDING_CHAIN)


def num(name: str) -> Column:
    return F.col(f"`{name}`")["num"]


def _outside(x: str, bounds: tuple[float, float]) -> str:
    return f"coalesce({x} < {bounds[0]!r}D OR {x} > {bounds[1]!r}D, false)"


def physical_bounds(plans: DataFrame) -> DataFrame:
    """Withdraw what is physically impossible, step by step; later steps see earlier withdrawals.

    Adds `withdrawn`, the fields that lost a value, in order. Projections only:
    as a step can only take values away, what it sees follows from the original
    values and from which of the few steps before it struck.
    """
    v = lambda n: f"v.`{n}`"
    rows = plans.withColumn("v", F.explode(F.array(F.expr("named_struct(" + ", ".join(f"'{n}', `{n}`.num" for n in GEOMETRY_CHAIN) + ")"))))
    odd, foot = _outside(v("building.footprint_area"), FOOTPRINT), v("building.footprint_area")
    first = {
        "area": _outside(v("plot.area"), PLOT_AREA),
        "odd": odd,
        "same": f"NOT {odd} AND coalesce({v('plot.area')} <> 0 AND {foot} >= {SAME_POLYGON!r}D * {v('plot.area')}, false)",
        "closed": " + ".join(f"CASE WHEN {v(s)} <= {CLOSED_SETBACK!r}D THEN 1 ELSE 0 END" for s in SIDES) + f" >= {CLOSED_SIDES}",
    }
    rows = rows.withColumn("s", F.explode(F.array(F.expr("named_struct(" + ", ".join(f"'{n}', {c}" for n, c in first.items()) + ")"))))
    alive = "NOT s.area"
    shape = f"{alive} AND NOT s.odd AND NOT s.same"  # the building's fields are still there after the footprint's steps
    built = f"{shape} AND NOT s.closed"
    own = {n: f"{alive} AND {_outside(v(n), SITE_SIDE)}" for n in ("plot.width", "plot.depth")} | {n: f"{alive} AND {_outside(v(n), BUILDING_SIDE)}" for n in ("building.width", "building.depth")}
    sides = [f"CASE WHEN NOT ({own[n]}) THEN {v(n)} END" for n in ("plot.width", "plot.depth")]
    sides = {s: f"{built} AND coalesce({v(s)} < 0 OR {v(s)} > greatest({', '.join(sides)}), false)" for s in SIDES}
    covered = f"{built} AND {_outside(v('coverage'), COVERAGE)}"
    # Steps in their order: when each strikes, and whom. A field goes with the first step that takes it.
    steps = [("s.area", GEOMETRY_CHAIN), *((c, (n,)) for n, c in own.items()), (f"{alive} AND s.odd", BUILDING_CHAIN), (f"{alive} AND s.same", GEOMETRY_CHAIN), (f"{shape} AND s.closed", BUILDING_CHAIN)]
    steps += [*((c, (n,)) for n, c in sides.items()), (covered, ("coverage", "far")), (f"{built} AND NOT ({covered}) AND {_outside(v('far'), (0.0, FAR_MAX))}", ("far",))]
    rows = rows.withColumn("h", F.explode(F.array(F.expr(f"array({', '.join(c for c, _ in steps)})"))))
    takes = {n: [i for i, (_, names) in enumerate(steps) if n in names] for n in GEOMETRY_CHAIN}
    lost = {n: f"{v(n)} IS NOT NULL AND ({' OR '.join(f'h[{i}]' for i in takes[n])})" for n in GEOMETRY_CHAIN}
    rows = rows.withColumn("l", F.explode(F.array(F.expr("named_struct(" + ", ".join(f"'{n}', {c}" for n, c in lost.items()) + ")"))))
    gone = [f"CASE WHEN l.`{n}` AND h[{i}]{''.join(f' AND NOT h[{j}]' for j in takes[n] if j < i)} THEN '{n}' END" for i, (_, names) in enumerate(steps) for n in names]
    names = F.expr(f"concat_ws(',', {', '.join(gone)})")
    missing = "named_struct('num', CAST(NULL AS DOUBLE), 'str', CAST(NULL AS STRING), 'level', 'MISSING')"
    kept = [F.expr(f"CASE WHEN l.`{n}` THEN {missing} ELSE `{n}` END").alias(n) if n in lost else F.col(f"`{n}`") for n in plans.columns]
    return rows.select(*kept, F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, ",")).alias("withdrawn"))


def ratios(foot: Column, plot: Column, floors: Column) -> dict[str, Column]:
    """coverage and far as structs (num, str, level) from three fields; full precision.

    A footprint over PLAUSIBLE_RATIO of the plot is CONFLICTING. Levels are those
    of the weaker input; FAR is never HIGH, and without floors it counts one at LOW.
    """
    known = foot["num"].isNotNull() & plot["num"].isNotNull() & (plot["num"] > 0)
    area = F.when(plot["num"] > 0, plot["num"])
    fine = known & (foot["num"] / area <= PLAUSIBLE_RATIO)
    weaker = cap_level(foot["level"], plot["level"])
    counted = floors["num"] > 0
    far_level = F.when(counted, cap_level(F.lit("MEDIUM"), floors["level"])).otherwise("LOW")

    def out(value: Column, level: Column) -> Column:
        return F.struct(F.when(fine, value).alias("num"), F.lit(None).cast("string").alias("str"), F.when(fine, level).when(known, "CONFLICTING").otherwise("MISSING").alias("level"))

    return {"coverage": out(foot["num"] / area * 100.0, weaker), "far": out(F.when(counted, foot["num"] * floors["num"]).otherwise(foot["num"]) / area, cap_level(far_level, weaker))}


def coverage_and_far(plans: DataFrame) -> DataFrame:
    """plan_id, coverage, coverage_level, far, far_level from footprint, plot area and floors (see ratios)."""
    made = ratios(*(F.col(f"`{n}`") for n in ("building.footprint_area", "plot.area", "building.floor_count")))
    return plans.select("plan_id", *[made[n][part].alias(n + suffix) for n in ("coverage", "far") for part, suffix in (("num", ""), ("level", "_level"))])


def consistency_conflicts(plans: DataFrame, tolerance: float = 0.05, rectangular: Column | None = None) -> DataFrame:
    """A row for each impossible combination of measures: plan_id, check, expected, actual."""
    rectangular = F.lit(True) if rectangular is None else rectangular

    def case(name: str, when: Column, expected: Column, actual: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("check"), expected.alias("expected"), actual.alias("actual")))

    checks = []
    for axis in ("width", "depth"):
        plot, building = num(f"plot.{axis}"), num(f"building.{axis}")
        checks.append(case(f"building.{axis}", building >= plot + tolerance, plot, building))
    for side in SIDES:
        checks.append(case(side, num(side) < -tolerance, F.lit(0.0), num(side)))
    for axis, (a, b) in (("width", ("setbacks.left", "setbacks.right")), ("depth", ("setbacks.front", "setbacks.rear"))):
        plot, total = num(f"plot.{axis}"), num(f"building.{axis}") + num(a) + num(b)
        allowed = F.greatest(F.lit(tolerance), plot * 0.05)
        checks.append(case(f"sum.{axis}", rectangular & (F.abs(total - plot) > allowed), plot, total))
    return plans.select("plan_id", F.inline(F.array_compact(F.array(*checks))))


def missing_fields(plans: DataFrame) -> DataFrame:
    """A row for each field of a plan whose level is MISSING."""
    names = F.filter(F.array(*[F.when(F.col(f"`{n}`")["level"] == "MISSING", F.lit(n)) for n in FIELDS if n not in TEXT_FIELDS]), lambda x: x.isNotNull())
    return plans.select("plan_id", F.explode(names).alias("field"))


def setback_flags(plans: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """plan_id, field, value, cap for each setback above what plot and building leave on its axis; values stay.

    The larger of both axes counts, as the sheet's axes need not be the plot's.
    """

    def budget(axis: str) -> Column:
        plot, building = (F.when(F.col(f"`{n}.{axis}`")["level"].isin("HIGH", "MEDIUM"), num(f"{n}.{axis}")) for n in ("plot", "building"))
        return plot - building + tolerance

    cap = F.greatest(budget("width"), budget("depth"))
    both = budget("width").isNotNull() & budget("depth").isNotNull()
    rows = F.array_compact(F.array(*[F.when(both & (num(s) > cap), F.struct(F.lit(s).alias("field"), num(s).alias("value"), cap.alias("cap"))) for s in SIDES]))
    return plans.select("plan_id", F.inline(rows))


def setback_rows(plans: DataFrame) -> DataFrame:
    """plan_id, side, distance for each setback that a plan has."""
    rows = F.array(*[F.struct(F.lit(s.split(".")[1]).alias("side"), num(s).alias("distance")) for s in SIDES])
    return plans.select("plan_id", F.inline(rows)).where("distance is not null")


#: Fixed value: the share of its box from which a plot counts as a rectangle.
RECTANGULAR = 0.9


def area_from_shape(width: Column, depth: Column, shape_area: Column, rectangularity: Column) -> tuple[Column, Column]:
    """Area and level: width by depth, HIGH, of a rectangle; else the shape's own, MEDIUM; else MISSING. Four decimals."""
    square = (rectangularity >= RECTANGULAR) & width.isNotNull() & depth.isNotNull()
    square = F.coalesce(square, F.lit(False))
    shaped = F.coalesce(shape_area > 0, F.lit(False))
    return F.when(square, F.bround(width * depth, 4)).when(shaped, F.bround(shape_area, 4)), F.when(square, "HIGH").when(shaped, "MEDIUM").otherwise("MISSING")
