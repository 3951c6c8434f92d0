"""Queries that carry fused values and decisions into plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import decisions, plans, reconcile
from plumbline.plans import catalogue as c
from plumbline.plans import projections as p
from plumbline.plans.registry import query

_N = lambda name: name.replace(".", "_")


def _ratio_sql(foot: str, plot: str, floors: str, out: str) -> str:
    """Columns {out}_coverage, {out}_coverage_l, {out}_far, {out}_far_l of three numbers with levels (suffix _l)."""
    fine = f"({foot} IS NOT NULL AND {plot} > 0 AND {foot} / nullif({plot}, 0) <= 1.02::DOUBLE)"
    known = f"({foot} IS NOT NULL AND {plot} > 0)"
    weak = c._CAP.format(a=f"{foot}_l", b=f"{plot}_l")
    far_level = f"CASE WHEN {floors} > 0 THEN {c._CAP.format(a=chr(39) + 'MEDIUM' + chr(39), b=f'{floors}_l')} ELSE 'LOW' END"
    return f"""CASE WHEN {fine} THEN {foot} / {plot} * 100.0::DOUBLE END AS {out}_coverage, CASE WHEN {fine} THEN {weak} WHEN {known} THEN 'CONFLICTING' ELSE 'MISSING' END AS {out}_coverage_l,
        CASE WHEN {fine} THEN CASE WHEN {floors} > 0 THEN {foot} * {floors} ELSE {foot} END / {plot} END AS {out}_far, CASE WHEN {fine} THEN {c._CAP.format(a=f"({far_level})", b=f"({weak})")} WHEN {known} THEN 'CONFLICTING' ELSE 'MISSING' END AS {out}_far_l"""


def _fused(spark, sf_dir) -> DataFrame:
    return c.fuse_cv_vision(spark, sf_dir).select("plan_id", "field", "status", "value", "level")


def _agreement_sql() -> str:
    """The plans with fused values, area by area, as CTEs."""
    pick = ", ".join(f"max({col}) FILTER (field = '{n}') AS f_{_N(n)}{suffix}" for n in plans.SHIPPABLE for col, suffix in (("status", "_s"), ("value", ""), ("level", "_l")))
    usable = lambda n: f"(f_{n}_s IN ('AGREED', 'CV_ONLY', 'VISION_ONLY') AND f_{n} IS NOT NULL)"
    plain = [_N(n) for n in plans.SHIPPABLE if n not in ("coverage", "far", "plot.area", "building.footprint_area")]
    first = ", ".join(f"CASE WHEN f_{n}_s = 'CONFLICT' THEN NULL WHEN {usable(n)} THEN round_even(f_{n}, 4) ELSE {n} END AS {n}, CASE WHEN f_{n}_s = 'CONFLICT' THEN 'CONFLICTING' WHEN {usable(n)} THEN f_{n}_l ELSE {n}_l END AS {n}_l" for n in plain)

    def area(n: str, part: str, shape: str, printed: str) -> str:
        """direct d, its level, and the reconciled area."""
        direct, level = f"CASE WHEN f_{n}_s = 'CONFLICT' THEN NULL WHEN {usable(n)} THEN round_even(f_{n}, 4) WHEN {printed} THEN {n} END", f"CASE WHEN f_{n}_s = 'CONFLICT' THEN 'CONFLICTING' WHEN {usable(n)} THEN f_{n}_l WHEN {printed} THEN {n}_l END"
        w, d = f"{part}_width", f"{part}_depth"
        ok = f"coalesce({w} > 0 AND {d} > 0 AND coalesce({shape}, 1.0) >= 0.85, false)"
        trust = f"({printed} AND f_{n}_s IS NULL)"
        stays = f"coalesce(({direct}) > 0 AND (abs(({direct}) - {w} * {d}) / ({w} * {d}) <= 0.08::DOUBLE OR {trust}), false)"
        cap = c._CAP.format(a=f"{w}_l", b=f"{d}_l")
        value = f"CASE WHEN {ok} THEN CASE WHEN {stays} THEN ({direct}) ELSE round_even({w} * {d}, 4) END WHEN ({direct}) IS NOT NULL THEN ({direct}) ELSE {n} END"
        lvl = f"CASE WHEN {ok} THEN CASE WHEN {stays} THEN ({level}) ELSE {cap} END WHEN ({direct}) IS NOT NULL THEN ({level}) ELSE {n}_l END"
        return f"{value} AS {n}, {lvl} AS {n}_l"

    outside = "building_footprint_area / nullif(plot_area, 0) > 1.02::DOUBLE AND plot_area > 0"
    final = lambda n: f"CASE WHEN f_{n}_s = 'CONFLICT' THEN NULL WHEN {usable(n)} THEN round_even(f_{n}, 4) WHEN r_{n} IS NOT NULL THEN r_{n} ELSE {n} END AS {n}, CASE WHEN f_{n}_s = 'CONFLICT' THEN 'CONFLICTING' WHEN {usable(n)} THEN f_{n}_l WHEN r_{n} IS NOT NULL THEN r_{n}_l ELSE {n}_l END AS {n}_l"
    keep = ", ".join(f"{n}, {n}_l" for n in plain)
    fcols = ", ".join(f"f_{_N(n)}_s, f_{_N(n)}, f_{_N(n)}_l" for n in plans.SHIPPABLE)
    rest = "coverage, coverage_l, far, far_l, building_floor_count, building_floor_count_l"
    return f"""{c._FUSED}, {p.SQL_PLANS}, wide AS (SELECT plan_id, {pick} FROM fused GROUP BY plan_id),
a0 AS (SELECT * FROM (SELECT plan_id, {', '.join(f"{_N(n)}, {_N(n)}_l" for n in plans.SHIPPABLE)}, building_floor_count, building_floor_count_l,
    CASE plan_id % 4 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.9::DOUBLE END AS shape, plan_id % 3 = 0 AS printed FROM plans) LEFT JOIN wide USING (plan_id)),
a1 AS (SELECT plan_id, {first}, plot_area, plot_area_l, building_footprint_area, building_footprint_area_l, {rest}, shape, printed, {fcols} FROM a0),
a2 AS (SELECT plan_id, {keep}, {area('plot_area', 'plot', 'shape', 'printed')}, building_footprint_area, building_footprint_area_l, {rest}, shape, printed, {fcols} FROM a1),
a3 AS (SELECT plan_id, {keep}, plot_area, plot_area_l, {area('building_footprint_area', 'building', 'shape', 'printed')}, {rest}, {fcols} FROM a2),
a4 AS (SELECT * REPLACE (CASE WHEN {outside} THEN NULL ELSE building_footprint_area END AS building_footprint_area, CASE WHEN {outside} THEN 'CONFLICTING' ELSE building_footprint_area_l END AS building_footprint_area_l) FROM a3),
a5 AS (SELECT *, {_ratio_sql('building_footprint_area', 'plot_area', 'building_floor_count', 'r')} FROM a4),
agreed AS (SELECT plan_id, {keep}, plot_area, plot_area_l, building_footprint_area, building_footprint_area_l, {final('coverage')}, {final('far')} FROM a5)"""


_AGREEMENT = _agreement_sql()
_AGREED_COLUMNS = [f"{_N(n)}{s}" for n in plans.SHIPPABLE for s in ("", "_l")]


def _agreed(spark, sf_dir) -> DataFrame:
    base = p.plans(spark, sf_dir)
    shape = F.when(F.col("plan_id") % 4 == 0, 0.7).when(F.col("plan_id") % 4 == 1, 0.9)
    printed = F.col("plan_id") % 3 == 0
    shapes = base.select("plan_id", shape.alias("plot_shape"), shape.alias("building_shape"), printed.alias("plot_printed"), printed.alias("building_printed"))
    return plans.apply_agreement(base, _fused(spark, sf_dir), shapes)


@query(f"{_AGREEMENT} SELECT plan_id, {', '.join(_AGREED_COLUMNS)}, {' + '.join(f'({_N(n)}_l = {chr(39)}CONFLICTING{chr(39)})::INT' for n in plans.SHIPPABLE)} AS n_conflicts FROM agreed")
def apply_agreement(spark, sf_dir):
    out = _agreed(spark, sf_dir)
    return out.select("plan_id", *[F.col(f"`{n}`.{part}").alias(_N(n) + s) for n in plans.SHIPPABLE for part, s in (("num", ""), ("level", "_l"))], F.size("conflicts").alias("n_conflicts"))


_LONG = " UNION ALL ".join(f"SELECT plan_id, '{n}' AS field, {_N(n)} AS value, {_N(n)}_l AS level, {_N(n)}_l = 'CONFLICTING' AS flagged FROM agreed" for n in plans.SHIPPABLE)


@query(f"{_AGREEMENT} {_LONG}")
def plan_predictions(spark, sf_dir):
    return plans.predictions(_agreed(spark, sf_dir))


@query(f"""{c._FUSED}, {p.SQL_PLANS}, v AS (SELECT plan_id, field, round_even(value, 4) AS value, level FROM fused WHERE status = 'VISION_ONLY' OR status = 'AGREED'),
n AS (SELECT plan_id, unnest({list(plans.SHIPPABLE)!r}) AS field FROM plans) SELECT plan_id, field, value, coalesce(level, 'MISSING') AS level FROM n LEFT JOIN v USING (plan_id, field)""")
def vision_only_plans(spark, sf_dir):
    seen = _fused(spark, sf_dir).where("status in ('VISION_ONLY', 'AGREED')").select("plan_id", "field", "value", "level")
    made = plans.vision_only_plans(p.plans(spark, sf_dir).select("plan_id"), seen, plans.SHIPPABLE)
    return plans.predictions(made).drop("flagged")


def _bridge_sql() -> str:
    pick = ", ".join(f"max({col}) FILTER (field = '{n}') AS d_{_N(n)}{suffix}" for n in plans.SHIPPABLE for col, suffix in (("decision", "_d"), ("value", ""), ("level", "_l")))
    cap = "CASE {n}_l WHEN 'HIGH' THEN 'MEDIUM' ELSE {n}_l END"
    own = "({n} IS NOT NULL AND {n}_l IN ('MEDIUM', 'HIGH'))"
    shown = []
    for name in plans.SHIPPABLE:
        n = _N(name)
        said, mine = f"d_{n}_d IN ('ACCEPT', 'CONFLICT')", own.format(n=n) if name not in plans.DERIVED else "FALSE"
        shown.append(f"CASE WHEN {said} THEN d_{n}_d WHEN {mine} THEN 'ACCEPT' ELSE 'ABSTAIN' END AS x_{n}_d, CASE WHEN {said} THEN d_{n} WHEN {mine} THEN {n} END AS x_{n}, CASE WHEN {said} THEN d_{n}_l WHEN {mine} THEN {cap.format(n=n)} ELSE 'MISSING' END AS x_{n}_l, CASE WHEN {said} THEN 'evidence' WHEN {mine} THEN 'legacy' END AS x_{n}_s")
    rows = []
    for name in plans.SHIPPABLE:
        n = _N(name)
        if name in plans.DERIVED:
            out = "CASE WHEN x_{n}_d <> 'ABSTAIN' THEN x_{n}{s} WHEN r_{n} IS NOT NULL THEN {derived} WHEN " + own.format(n=n) + " THEN {legacy} ELSE {none} END"
            parts = [out.format(n=n, s=s, derived=d, legacy=g, none=z) for s, d, g, z in (("_d", "'ACCEPT'", "'ACCEPT'", "'ABSTAIN'"), ("", f"r_{n}", n, "NULL"), ("_l", f"r_{n}_l", cap.format(n=n), "'MISSING'"), ("_s", "'derived'", "'legacy'", "NULL"))]
        else:
            parts = [f"x_{n}_d", f"x_{n}", f"x_{n}_l", f"x_{n}_s"]
        rows.append(f"SELECT plan_id, '{name}' AS field, {parts[0]} AS decision, {parts[1]} AS num, {parts[2]} AS level, {parts[3]} AS source FROM x2")
    return f"""{c._DECIDED}, {p.SQL_PLANS}, dw AS (SELECT plan_id, {pick} FROM decided GROUP BY plan_id), x1 AS (SELECT plans.*, {', '.join(shown)} FROM plans LEFT JOIN dw USING (plan_id)),
x2 AS (SELECT *, {_ratio_sql('x_building_footprint_area', 'x_plot_area', 'building_floor_count', 'r')} FROM x1), bridged AS ({' UNION ALL '.join(rows)})"""


_BRIDGE = _bridge_sql()


def _bridged(spark, sf_dir) -> DataFrame:
    decided = c.decide_field(spark, sf_dir).select("plan_id", "field", "decision", "value", "level")
    return plans.bridged_decisions(decided, p.plans(spark, sf_dir))


@query(f"{_BRIDGE} SELECT * FROM bridged")
def bridged_decisions(spark, sf_dir):
    return _bridged(spark, sf_dir)


_OLD = " UNION ALL ".join(f"SELECT plan_id, '{n}' AS field, {_N(n)} AS old, {_N(n)}_l AS old_level FROM plans" for n in plans.SHIPPABLE)


@query(f"{_BRIDGE}, o AS ({_OLD}) SELECT plan_id, field, old, old_level, num AS \"new\", level AS new_level FROM o JOIN bridged USING (plan_id, field) WHERE old IS DISTINCT FROM num OR old_level IS DISTINCT FROM level")
def decision_differences(spark, sf_dir):
    return plans.decision_differences(p.plans(spark, sf_dir), _bridged(spark, sf_dir))


@query(f"{_BRIDGE} SELECT plan_id, field, num AS value, level FROM bridged")
def apply_decisions(spark, sf_dir):
    return plans.predictions(plans.apply_decisions(p.plans(spark, sf_dir), _bridged(spark, sf_dir))).drop("flagged")


@query(f"""{c._DECIDED}, k AS (SELECT DISTINCT plan_id, unnest({list(plans.SHIPPABLE)!r}) AS field FROM decided), r AS (SELECT plan_id, field, arg_min(value, pos) FILTER (kind = 'NATIVE_TEXT') AS reported FROM candidates GROUP BY ALL),
f AS (SELECT k.plan_id, k.field, coalesce(status, 'NOT_FOUND_BY_EITHER') AS status, CASE WHEN regexp_matches(coalesce(status, ''), '^(CV_ONLY|AGREED)_') THEN coalesce(reported, value) ELSE value END AS final FROM k LEFT JOIN decided d ON d.plan_id = k.plan_id AND d.field = k.field LEFT JOIN r ON r.plan_id = k.plan_id AND r.field = k.field),
a AS (SELECT plan_id, max(final) FILTER (field = 'building.footprint_area') AS foot, 'MEDIUM' AS foot_l, max(final) FILTER (field = 'plot.area') AS plot, 'MEDIUM' AS plot_l, NULL::DOUBLE AS fl, 'MISSING' AS fl_l, max(final) FILTER (field = 'coverage') AS coverage, max(final) FILTER (field = 'far') AS far FROM f GROUP BY plan_id),
b AS (SELECT *, {_ratio_sql('foot', 'plot', 'fl', 'r')} FROM a), n AS (SELECT plan_id, 'coverage' AS field, round_even(r_coverage, 4) AS final FROM b WHERE coverage IS NULL AND r_coverage IS NOT NULL UNION ALL SELECT plan_id, 'far', round_even(r_far, 4) FROM b WHERE far IS NULL AND r_far IS NOT NULL)
SELECT plan_id, field, CAST(floor(final * 1e3 + 0.5) AS BIGINT) AS milli, status FROM (SELECT plan_id, field, final, status FROM f ANTI JOIN n USING (plan_id, field) UNION ALL SELECT plan_id, field, final, 'DERIVED_FROM_FOOTPRINT_AND_PLOT_AREA' FROM n)""")
def document_fusion(spark, sf_dir):
    cv, vision = c._two(spark, sf_dir)
    ids = cv.select("plan_id").union(vision.select("plan_id")).distinct()
    skeleton = ids.select("plan_id", F.explode(F.array(*map(F.lit, plans.SHIPPABLE))).alias("field"))
    resolved = decisions.resolve(cv, vision, c._measured(spark, sf_dir), ["plan_id", "field"], skeleton=skeleton)
    measured = c._measured(spark, sf_dir).where(F.col("field").isin(*plans.SHIPPABLE))
    found = plans.document_fusion(resolved.select("plan_id", "field", "status", "value"), measured)
    return found.select("plan_id", "field", F.floor(F.col("final") * 1e3 + 0.5).cast("long").alias("milli"), "status")


_HEIGHT_TYPES = ("FLOOR_HEIGHT", "BUILDING_HEIGHT", "STILT_HEIGHT", "PLINTH_HEIGHT", "PARAPET_HEIGHT", "HEIGHT_EXCLUDING_STILT", "REGULATORY_MAX_HEIGHT", "PROPOSED_BUILDING_HEIGHT")


@query(f"""WITH {p.SQL_CANDIDATES}, h AS (SELECT plan_id, pos, value / 8.0::DOUBLE AS v, confidence AS cf, {p.sql_pick(_HEIGHT_TYPES, 'pos % 8')} AS type FROM candidates WHERE plan_id % 2 = 0 OR pos % 8 <> 1),
g AS (SELECT plan_id, arg_max(v, pos) FILTER (type LIKE '%BUILDING_HEIGHT' AND cf > 0.8) AS late, arg_max(cf, pos) FILTER (type LIKE '%BUILDING_HEIGHT' AND cf > 0.8) AS late_c, arg_min(v, pos) FILTER (type LIKE '%BUILDING_HEIGHT') AS early, arg_min(cf, pos) FILTER (type LIKE '%BUILDING_HEIGHT') AS early_c,
    {', '.join(f"first(v ORDER BY cf DESC, pos) FILTER (type = '{t}') AS {n}" for n, t in (('fl', 'FLOOR_HEIGHT'), ('st', 'STILT_HEIGHT'), ('pl', 'PLINTH_HEIGHT'), ('pa', 'PARAPET_HEIGHT'), ('ws', 'HEIGHT_EXCLUDING_STILT')))}, max(cf) FILTER (type = 'FLOOR_HEIGHT') AS fl_c FROM h GROUP BY plan_id),
k AS (SELECT *, coalesce(late, early) AS own, CASE WHEN late IS NULL THEN early_c ELSE late_c END AS own_c, CASE WHEN plan_id % 3 > 0 THEN plan_id % 3 END AS floors FROM g), m AS (SELECT *, CASE WHEN floors > 0 THEN fl * floors + coalesce(st, 0) + coalesce(pl, 0) + coalesce(pa, 0) END AS made FROM k)
SELECT plan_id, CAST(floor(coalesce(own, made) * 1e3 + 0.5) AS BIGINT) AS milli, CASE WHEN own IS NOT NULL THEN CASE WHEN own_c >= 0.85 THEN 'HIGH' WHEN own_c > 0.75 THEN 'MEDIUM' ELSE 'LOW' END WHEN made IS NOT NULL THEN CASE WHEN fl_c >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'MISSING' END AS height_level,
    CAST(floor(ws * 1e3 + 0.5) AS BIGINT) AS without_milli, CASE WHEN own IS NOT NULL THEN 'read' WHEN made IS NOT NULL THEN 'derived' END AS source FROM m""")
def building_heights(spark, sf_dir):
    rows = p.candidates(spark, sf_dir).where("plan_id % 2 = 0 OR pos % 8 != 1")
    readings = rows.select("plan_id", "pos", (F.col("value") / 8).alias("value"), "confidence", p.pick(_HEIGHT_TYPES, F.col("pos") % 8).alias("type"))
    floors = p.plans(spark, sf_dir).select("plan_id", F.when(F.col("plan_id") % 3 > 0, F.col("plan_id") % 3).alias("floors"))
    found = plans.building_heights(readings, floors)
    milli = lambda n: F.floor(F.col(n) * 1e3 + 0.5).cast("long")
    return found.select("plan_id", milli("height").alias("milli"), "height_level", milli("without_stilt").alias("without_milli"), "source")


_EDIT_FIELDS = ("plot.width", "building.floor_count", "far", "development_area", "building_use", "building.height_estimated", "road.name", "coverage")
_EDIT_VALUES = ("12.5", "-1", "b", "House", "", "0", "shop", "3")


@query(f"""WITH e AS (SELECT event_id, {p.sql_pick(_EDIT_FIELDS, 'event_id % 8')} AS f, {p.sql_pick(_EDIT_VALUES, '(event_id // 8) % 8')} AS v FROM events), t AS (SELECT *, TRY_CAST(v AS DOUBLE) AS x FROM e)
SELECT event_id, CASE f WHEN 'building.height_estimated' THEN 'building_height_estimated' ELSE f END AS field, CASE WHEN f = 'road.name' THEN 'NOT_EDITABLE' WHEN v = '' THEN 'NO_VALUE' WHEN f = 'development_area' THEN CASE WHEN v <> 'b' THEN 'UNSUPPORTED_VALUE' END WHEN f = 'building_use' THEN CASE WHEN v <> 'House' THEN 'UNSUPPORTED_VALUE' END
    WHEN x IS NULL THEN 'NOT_A_NUMBER' WHEN f = 'building.floor_count' AND x < 1 THEN 'NO_FLOORS' WHEN x < 0 THEN 'NEGATIVE' END AS problem FROM t""")
def checked_edits(spark, sf_dir):
    e = p.table(spark, sf_dir, "events").select("event_id", p.pick(_EDIT_FIELDS, F.col("event_id") % 8).alias("field"), p.pick(_EDIT_VALUES, F.floor(F.col("event_id") / 8) % 8).alias("value"))
    return plans.checked_edits(e).select("event_id", "field", "problem")


@query(f"""WITH {p.SQL_PLANS}, e AS (SELECT event_id AS pos, event_id % (SELECT max(o_orderkey) FROM orders) AS plan_id, {p.sql_pick(('plot.width', 'far', 'building_use', 'coverage'), 'event_id % 4')} AS field, {p.sql_pick(('7.25', '2', 'House', '-5'), 'event_id % 4')} AS v FROM events),
l AS (SELECT plan_id, field, arg_max(v, pos) AS v FROM e WHERE v <> '-5' GROUP BY ALL), w AS (SELECT plan_id, max(v) FILTER (field = 'plot.width') AS a, max(v) FILTER (field = 'far') AS b, max(v) FILTER (field = 'building_use') AS u FROM l GROUP BY plan_id)
SELECT plan_id, coalesce(a::DOUBLE, plot_width) AS width, CASE WHEN a IS NOT NULL THEN 'HIGH' ELSE plot_width_l END AS width_l, coalesce(b::DOUBLE, far) AS far, CASE WHEN u IS NOT NULL THEN 'residential' ELSE building_use END AS use, coverage FROM plans LEFT JOIN w USING (plan_id)""")
def apply_edits(spark, sf_dir):
    base = p.plans(spark, sf_dir)
    most = p.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    e = p.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") % most).alias("plan_id"), p.pick(("plot.width", "far", "building_use", "coverage"), F.col("event_id") % 4).alias("field"), p.pick(("7.25", "2", "House", "-5"), F.col("event_id") % 4).alias("value"))
    return plans.apply_edits(base, e).select("plan_id", F.col("`plot.width`.num").alias("width"), F.col("`plot.width`.level").alias("width_l"), F.col("far.num").alias("far"), F.col("building_use.str").alias("use"), F.col("coverage.num").alias("coverage"))


@query(f"""WITH {p.SQL_PLANS}, m AS (SELECT *, plan_id % 5 AS k FROM plans) SELECT plan_id, coalesce(development_area, CASE WHEN k = 1 THEN 'C' END) AS area, coalesce(building_use, CASE WHEN k = 2 THEN 'residential' END) AS use,
    coalesce(building_height_excluding_stilt, CASE WHEN k = 3 THEN 9.5::DOUBLE END) AS height FROM m""")
def context_from_metadata(spark, sf_dir):
    k = F.col("plan_id") % 5
    key = p.pick(("other", "development_area", "building_type", "building_height_excluding_stilt", "building_use"), k)
    rows = p.plans(spark, sf_dir).withColumn("metadata", F.create_map(key, p.pick(("x", " c ", "Residential-Building", "9.5", "spaceport"), k)))
    out = plans.with_context(rows)
    return out.select("plan_id", F.col("development_area.str").alias("area"), F.col("building_use.str").alias("use"), F.col("building_height_excluding_stilt.num").alias("height"))


@query(f"""WITH {p.SQL_SCORES} SELECT plan_id, field, CASE WHEN flagged THEN 'CONFLICTING' ELSE level END AS flagged_level, CASE WHEN level = 'LOW' THEN 'MEDIUM' ELSE level END AS ungated_level, {c._CAP.format(a='level', b="'MEDIUM'")} AS capped FROM predictions""")
def counterfactual_levels(spark, sf_dir):
    _, guess = p.truth_and_predictions(spark, sf_dir)
    capped = plans.cap_field(F.struct(F.col("value").alias("num"), F.lit(None).cast("string").alias("str"), F.col("level").alias("level")), F.lit("MEDIUM"))
    return guess.select("plan_id", "field", plans.flagged_as_conflict(F.col("level"), F.col("flagged")).alias("flagged_level"), plans.ungated(F.col("level")).alias("ungated_level"), capped["level"].alias("capped"))


@query(f"""WITH {p.SQL_CANDIDATES}, a AS (SELECT plan_id, field, page, pos, confidence, grounded, unnest([value]) AS value, {p.sql_pick(('m2', 'ft2', '%', 'acre'), 'pos % 4')} AS unit FROM candidates WHERE source = 'VISION'),
v AS (SELECT *, CASE unit WHEN 'ft2' THEN value * 0.09290304::DOUBLE WHEN 'acre' THEN NULL ELSE value END AS x, CASE unit WHEN 'ft2' THEN 'm2' WHEN 'acre' THEN NULL ELSE unit END AS u FROM a)
SELECT plan_id, field, CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS micro, u AS unit, grounded FROM v WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY plan_id, field ORDER BY confidence DESC, page, pos) = 1""")
def best_vision_area(spark, sf_dir):
    rows = p.candidates(spark, sf_dir).where("source = 'VISION'").withColumn("unit", p.pick(("m2", "ft2", "%", "acre"), F.col("pos") % 4))
    found = reconcile.best_vision(rows, ["plan_id", "field"], kind="area")
    return found.select("plan_id", "field", F.floor(F.col("vision_value") * 1e6 + 0.5).cast("long").alias("micro"), F.col("vision_unit").alias("unit"), "grounded")
