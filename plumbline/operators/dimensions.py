"""Printed dimensions: their units, the lines they belong to, what they measure, and the scale they imply."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.measures import lookup
from plumbline.functions.text import keyword_scores, points_per_metre
from plumbline.sources.work import spread_join

#: Metres in the units of dimensions, how a sheet names its unit, and lengths that may be meant in it.
METRES = {"m": 1.0, "mm": 0.001, "cm": 0.01, "ft": 0.3048, "in": 0.0254, "ft_in": 0.3048}
UNIT_NOTE = r"(?i)ALL\s+DIMENSIONS?\s*(?:ARE|IS)?\s*IN\s+(METRE|METER|MILLIMETRE|MILLIMETER|MM|CENTIMETRE|CENTIMETER|CM|FEET|FOOT|FT)"
NOTED = {"METRE": "m", "METER": "m", "MILLIMETRE": "mm", "MILLIMETER": "mm", "MM": "mm", "CENTIMETRE": "cm", "CENTIMETER": "cm", "CM": "cm", "FEET": "ft", "FOOT": "ft", "FT": "ft"}
PLAUSIBLE = (0.05, 60.0)
#: Reach of a dimension's line, the least trust in it, weights of its nearness, direction and length.
REACH, LEAST_TRUST, WEIGHTS = 40.0, 0.35, (0.6, 0.25, 0.15)
#: Kinds of dimensions, in the order in which equal scores win.
KINDS = ("PLOT_WIDTH", "PLOT_DEPTH", "BUILDING_WIDTH", "BUILDING_DEPTH", "FRONT_SETBACK", "REAR_SETBACK", "LEFT_SETBACK", "RIGHT_SETBACK", "ROOM_DIMENSION", "ROAD_WIDTH", "OTHER")
NEAR_SHARE = 0.03


def metres(value: Column, unit: Column) -> Column:
    """Length in metres (feet with inches are decimal feet); null for other units and for what is not positive."""
    made = value * lookup(F.lower(F.trim(unit)), METRES)
    return F.when(made > 0, made)


def noted_unit(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit: the unit that a sheet's first note names for all its dimensions."""
    said = F.upper(F.nullif(F.regexp_extract("text", UNIT_NOTE, 1), F.lit("")))
    table = F.create_map(*[F.lit(v) for kv in NOTED.items() for v in kv])
    rows = texts.withColumn("_unit", F.element_at(table, said)).where("_unit is not null")
    return rows.groupBy(*keys).agg(F.min_by("_unit", "pos").alias("unit"))


def with_noted_unit(raw: Column, value: Column, unit: Column, noted: Column) -> Column:
    """The unit, or the sheet's noted one where a number without unit has a decimal point and may be a length."""
    return F.coalesce(unit, F.when(raw.contains(".") & value.between(*PLAUSIBLE), noted))


def _scored_lines(items: DataFrame, lines: DataFrame, keys: list[str], reach: float, cell: float) -> DataFrame:
    """keys, item, line, distance, score of every line within reach of a text's middle."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    low, high = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    span = lambda a, b: F.explode(F.sequence(F.floor((low(a, b) - reach) / cell).cast("long"), F.floor((high(a, b) + reach) / cell).cast("long")))
    spread = lines.select(*keys, F.col("id").alias("line"), "x1", "y1", "x2", "y2").withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    pairs = spread_join(items.select(*keys, F.col("id").alias("item"), "x", "y", "angle", at("x").alias("cx"), at("y").alias("cy")), spread, [*keys, "cx", "cy"])
    pairs = pairs.withColumn("distance", g.point_segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).where(F.col("distance") <= reach)
    way = g.orientation_alignment(g.orientation_degrees(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.pmod(F.col("angle"), F.lit(180.0)))
    length = F.least(F.lit(1.0), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 20.0)
    near, along, long = WEIGHTS
    score = near * F.greatest(F.lit(0.0), 1.0 - F.col("distance") / reach) + along * F.coalesce(way, F.lit(0.5)) + long * length
    return pairs.select(*keys, "item", "line", "distance", score.alias("score"))


def near_lines(items: DataFrame, lines: DataFrame, keys: list[str], reach: float = REACH, cell: float = 64.0) -> DataFrame:
    """keys, item, line, distance, score, rank of every line within reach of a text's middle, the most likely first.

    items: keys, id, x, y, angle (may be null); lines: keys, id, x1..y2. Both meet
    in the grid cells that a line's box touches once grown by the reach; a pair
    counts in the cell of its text, so once.
    """
    order = Window.partitionBy(*keys, "item").orderBy(F.desc("score"), "line")
    return _scored_lines(items, lines, keys, reach, cell).withColumn("rank", F.row_number().over(order) - 1)


def best_line(items: DataFrame, lines: DataFrame, keys: list[str], reach: float = REACH, least: float = LEAST_TRUST, cell: float = 64.0) -> DataFrame:
    """keys, item, line, distance, score: the most likely line of each text, if it is near enough to be trusted.

    Texts of one place and angle ask once, and of equal lines only the first can be
    the most likely. A text's pairs are reduced where they are made.
    """
    firsts = lines.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min("id").alias("id"))
    places = items.groupBy(*keys, "x", "y", "angle").agg(F.min("id").alias("id"))
    best = _scored_lines(places, firsts, keys, reach, cell).groupBy(*keys, F.col("item").alias("at")).agg(F.min_by(F.struct("line", "distance", "score"), F.struct(-F.col("score"), "line")).alias("best"))
    best = best.where(1.0 - F.col("best.distance") / reach >= least).select(*keys, "at", "best.*")
    place = places.select(*[F.col(k).alias(f"p_{k}") for k in [*keys, "x", "y", "angle"]], F.col("id").alias("at"))
    of = items.join(place, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in [*keys, "x", "y", "angle"]])).select(*keys, F.col("id").alias("item"), "at")
    return of.join(best, [*keys, "at"]).select(*keys, "item", "line", "distance", "score")


def longest(lines: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The longest lines of each sheet, a stated number at most; of equals those with the smaller id."""
    order = Window.partitionBy(*keys).orderBy(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).desc(), "id")
    return lines.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")


def scale_samples(dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, value: points per metre of each dimension (value, unit, x1..y2) with a length and a line."""
    length, said = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), metres(F.col("value"), F.col("unit"))
    return dimensions.where((length > 1e-6) & said.isNotNull()).select(*keys, "id", (length / said).alias("value"))


# ---------------------------------------------------------------- what a model saw


def native_match(value: Column, native: Column) -> Column:
    """Whether a native dimension prints a value that a model read, within 0.08 or 2 %."""
    return F.abs(native - value) <= F.greatest(F.lit(0.08), value * 0.02)


def vision_values(items: DataFrame, keys: list[str], least: float = 0.75) -> DataFrame:
    """keys, type, value, pos: a model's values in metres, near-equal ones (0.02 or 1 %) once, by the first.

    Values of one key and type are few; they are folded in order of pos.
    """
    rows = items.where((F.col("confidence") >= least) & F.col("value").isNotNull() & ~F.coalesce(F.lower("unit").isin("mm", "cm", "ft", "in"), F.lit(False)))
    listed = rows.groupBy(*keys, F.upper("type").alias("type")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("all"))
    near = lambda kept, v: F.exists(kept, lambda k: F.abs(v["value"] - k["value"]) <= F.greatest(F.lit(0.02), v["value"] * 0.01))
    fold = F.aggregate(F.slice("all", 2, 1 << 30), F.slice("all", 1, 1), lambda kept, v: F.when(near(kept, v), kept).otherwise(F.concat(kept, F.array(v))))
    return listed.select(*keys, "type", F.inline(fold))


def preferred_values(items: DataFrame, native: DataFrame, keys: list[str], least: float = 0.75) -> DataFrame:
    """keys, type, value: the first of a model's values that a native dimension (keys, metres) of the sheet confirms; on a
    sheet without native dimensions the first. Values meet by their cents, widened by the tolerance."""
    values = vision_values(items, keys, least)
    cell = lambda c: F.floor(c * 10).cast("long")
    wide = F.greatest(F.lit(0.08), F.col("value") * 0.02)
    asked = values.withColumn("cell", F.explode(F.sequence(cell(F.col("value") - wide), cell(F.col("value") + wide))))
    seen = native.select(*keys, F.col("metres"), cell(F.col("metres")).alias("cell")).distinct()
    met = asked.join(seen, [*keys, "cell"]).where(native_match(F.col("value"), F.col("metres"))).select(*keys, "type", "pos").distinct().withColumn("ok", F.lit(True))
    some = native.select(*keys).distinct().withColumn("some", F.lit(True))
    rows = values.join(met, [*keys, "type", "pos"], "left").join(some, keys, "left").where("ok or some is null")
    return rows.groupBy(*keys, "type").agg(F.min_by("value", "pos").alias("value"))


def vision_setbacks(items: DataFrame, keys: list[str], least: float = 0.75) -> DataFrame:
    """keys, side, value: setbacks that a model names, the last reading of each side."""
    side = F.lower(F.regexp_extract(F.upper("type"), "^(FRONT|REAR|LEFT|RIGHT)_SETBACK$", 1))
    rows = items.withColumn("side", side).where((F.col("side") != "") & (F.col("confidence") >= least) & F.col("value").isNotNull())
    return rows.groupBy(*keys, "side").agg(F.max_by("value", "pos").alias("value"))


def vision_hints(dimensions: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, hint, hint_score: the kind that a model gives each dimension's value, by its confidence times its nearness.

    dimensions: keys, id, value, x, y (middle of its line, or null); items: keys,
    pos, type, value, confidence, corners (or null). Values within 0.08 or 2 % of
    the dimension's count, and meet by cells of a tenth. A box far away still
    counts a quarter, an unknown place 0.35.
    """
    cell = lambda c: F.floor(c * 10).cast("long")
    reach = F.greatest(F.lit(0.08), F.abs("value") * 0.02)
    asked = dimensions.withColumn("cell", F.explode(F.sequence(cell(F.col("value") - reach), cell(F.col("value") + reach))))
    seen = items.where(F.col("type").isin(*KINDS) & (F.col("confidence") > 0)).select(*keys, cell(F.col("value")).alias("cell"), F.col("value").alias("i_value"), "type", "confidence", "pos", "min_x", "min_y", "max_x", "max_y")
    met = asked.join(seen, [*keys, "cell"]).where(F.abs(F.col("i_value") - F.col("value")) <= reach)
    away = F.hypot(F.col("x") - (F.col("min_x") + F.col("max_x")) / 2, F.col("y") - (F.col("min_y") + F.col("max_y")) / 2)
    size = F.greatest(F.lit(80.0), (F.col("max_x") - F.col("min_x")) * 3, (F.col("max_y") - F.col("min_y")) * 3)
    score = F.col("confidence") * F.coalesce(F.greatest(F.lit(0.25), 1.0 - away / size), F.lit(0.35))
    best = met.groupBy(*keys, "id").agg(F.max_by(F.struct("type", score.alias("s")), F.struct(score, -F.col("pos"))).alias("b"))
    return best.select(*keys, "id", F.col("b.type").alias("hint"), F.col("b.s").alias("hint_score"))


# ---------------------------------------------------------------- kinds of dimensions


def classify(dimensions: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, kind, level, score of each dimension, by where its line lies, its label, and a model's hint.

    dimensions: keys, id, label, x1..y2 (null without line), hint, hint_score.
    sheets: keys, plot (ring or null), buildings (array of rings), front, rear,
    left, right (arrays of edges), roads (array of rings). A line on the plot's
    boundary measures the plot, one on a building's boundary the building, one
    across the gap between both a setback, one inside a building a room, one
    outside beside a road the road. Scores of all kinds of evidence add up; of
    equal sums the kind that comes first in KINDS wins.
    """
    rows = dimensions.join(sheets, keys, "left")
    edge = F.struct(*[F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    away = lambda edges: F.coalesce(F.array_min(F.transform(edges, lambda e: g.point_segment_distance(mx, my, e["x1"], e["y1"], e["x2"], e["y2"]))), F.lit(float("inf")))
    way = lambda edges, otherwise: F.coalesce(F.element_at(F.transform(F.slice(edges, 1, 1), lambda e: g.orientation_degrees(e["x2"] - e["x1"], e["y2"] - e["y1"])), 1), F.lit(otherwise)) if otherwise is not None else F.element_at(F.transform(F.slice(edges, 1, 1), lambda e: g.orientation_degrees(e["x2"] - e["x1"], e["y2"] - e["y1"])), 1)
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    sides = {s: F.coalesce(F.col(s), none) for s in ("front", "rear", "left", "right")}
    box = g.bounds(F.col("plot"))
    first = {
        "has_plot": F.col("plot").isNotNull(),
        "near": F.greatest(NEAR_SHARE * F.coalesce(F.hypot(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]), F.lit(0.0)), F.lit(1e-6)),
        "to_plot": F.coalesce(F.when(F.col("plot").isNotNull(), g.boundary_distance(mx, my, F.col("plot"))), F.lit(float("inf"))),
        "to_building": F.coalesce(F.array_min(F.transform("buildings", lambda b: g.boundary_distance(mx, my, b))), F.lit(float("inf"))),
        "inside": F.coalesce(F.exists("buildings", lambda b: g.point_in_polygon(mx, my, b)), F.lit(False)),
        "to_road": F.coalesce(F.array_min(F.transform("roads", lambda r: g.boundary_distance(mx, my, r))), F.lit(float("inf"))),
        "line_way": g.orientation_degrees(edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]),
        "front_way": F.when(F.col("plot").isNotNull(), way(F.concat(sides["front"], sides["rear"]), None)),
        "depth_way": F.when(F.col("plot").isNotNull(), way(F.concat(sides["left"], sides["right"]), None)),
        **{f"to_{s}": away(e) for s, e in sides.items()},
        **{f"{s}_side": way(e, None) for s, e in sides.items()},
    }
    first["front_way"], first["depth_way"] = F.coalesce(first["front_way"], F.lit(0.0)), F.coalesce(first["depth_way"], F.lit(90.0))
    rows = rows.withColumn("c", F.explode(F.array(F.struct(*[c.alias(n) for n, c in first.items()])))).withColumn("words", F.explode(F.array(keyword_scores(F.col("label")))))
    c = lambda n: F.col(f"c.{n}")
    on_plot, on_building = c("has_plot") & (c("to_plot") <= c("near")), c("to_building") <= c("near")
    front, depth = g.orientation_alignment(c("line_way"), c("front_way")), g.orientation_alignment(c("line_way"), c("depth_way"))
    gap = c("has_plot") & (c("to_building") < float("inf")) & ~on_plot & (c("to_building") <= c("near") * 4)
    across = {s: 1.0 - g.orientation_alignment(c("line_way"), c(f"{s}_side")) for s in sides}
    geo = {
        "PLOT_WIDTH": F.when(on_plot & (front >= depth), 0.9 * front),
        "PLOT_DEPTH": F.when(on_plot & (front < depth), 0.9 * depth),
        "BUILDING_WIDTH": F.when(on_building & ~on_plot & (front >= depth), 0.85 * front),
        "BUILDING_DEPTH": F.when(on_building & ~on_plot & (front < depth), 0.85 * depth),
        **{f"{s.upper()}_SETBACK": F.when(gap & (c(f"to_{s}") <= c("near") * 4) & (a > 0.4), 0.8 * a) for s, a in across.items()},
        "ROOM_DIMENSION": F.when(c("inside") & ~on_building, 0.6),
        "ROAD_WIDTH": F.when(~on_plot & (c("to_plot") > c("near")) & (c("to_road") <= c("near") * 4), 0.7),
    }
    lined = F.col("x1").isNotNull()
    # Without a line a strong hint decides alone; else the words do.
    hint_counts = F.col("hint").isNotNull() & (F.col("hint_score") >= 0.35)
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    scored = []
    for i, kind in enumerate(KINDS):
        shape, said = F.when(lined, zero(geo.get(kind, F.lit(0.0)))).otherwise(0.0), zero(F.element_at("words", F.lit(kind)))
        hinted = F.when(lined & hint_counts & (F.col("hint") == kind), F.col("hint_score")).otherwise(0.0)
        some = (shape > 0) | F.map_contains_key("words", F.lit(kind)) | (hinted > 0)
        scored.append(F.when(some, F.struct((shape + said + hinted).alias("score"), F.lit(-i).alias("place"), F.lit(kind).alias("kind"), (shape > 0).alias("geo"), (said > 0).alias("word"))))
    rows = rows.withColumn("best", F.explode(F.array(F.array_max(F.array_compact(F.array(*scored))))))
    best = F.col("best")
    alone = ~lined & F.col("hint").isNotNull() & (F.col("hint_score") >= 0.45)
    seen = lined & hint_counts & (F.col("hint") == best["kind"])
    strong = F.when(F.col("hint_score") >= 0.75, "HIGH").otherwise("MEDIUM")
    level = (
        F.when(alone, strong).when(~lined | best.isNull(), "LOW").when(seen, strong).when(best["geo"] & best["word"], "HIGH")
        .when(best["geo"], F.when(best["score"] >= 0.7, "MEDIUM").otherwise("LOW")).otherwise(F.when(best["score"] >= 0.9, "MEDIUM").otherwise("LOW"))
    )
    return rows.select(*keys, "id", F.when(alone, F.col("hint")).otherwise(F.coalesce(best["kind"], F.lit("OTHER"))).alias("kind"), level.alias("level"), F.when(alone, F.col("hint_score")).otherwise(zero(best["score"])).alias("score"))


def edge_matches(dimensions: DataFrame, rings: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """keys, id, edge_length: dimensions whose two points (px, py, qx, qy) are the ends of an edge of the ring, in either order."""
    ring = rings.select(*keys, F.posexplode(g.edges(F.col("points"))).alias("edge", "e"))
    far = lambda ax, ay, bx, by: F.hypot(F.col("px") - ax, F.col("py") - ay) + F.hypot(F.col("qx") - bx, F.col("qy") - by)
    e = F.col("e")
    apart = F.least(far(e["x1"], e["y1"], e["x2"], e["y2"]), far(e["x2"], e["y2"], e["x1"], e["y1"]))
    met = dimensions.join(ring, keys).where(apart <= 2 * tolerance)
    return met.groupBy(*keys, "id").agg(F.min_by(F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]), "edge").alias("edge_length"))


# ---------------------------------------------------------------- scales

#: Metres in the units of a drawing's header, other factors to try (in order), areas a plot may have, and trust in each way.
HEADER_UNITS = {1: 0.0254, 2: 0.3048, 3: 1609.344, 4: 0.001, 5: 0.01, 6: 1.0, 7: 1000.0, 10: 0.9144, 14: 0.1, 15: 10.0, 16: 100.0}
FACTORS, PLOT_AREAS = (1.0, 0.001, 0.01, 0.3048, 0.0254), (20.0, 20_000.0)
TRUST = {"header_confirmed": 0.98, "header": 0.90, "tried": 0.60, "header_implausible": 0.50, "default": 0.20}
#: How far a printed and a measured scale may differ, and two labels.
SCALE_AGREES, LABELS_AGREE = 0.05, 0.02


def unit_factor(header: Column, largest_area: Column) -> dict[str, Column]:
    """factor (metres in a drawing unit), trust and way, from the header's unit code and the largest raw area.

    The header's unit counts if it makes the area that of a plot, or if no area is
    known; else the first factor to try that does; else the header's; else 1.
    """
    own = F.element_at(F.create_map(*[F.lit(v) for kv in HEADER_UNITS.items() for v in kv]), header.cast("int"))
    area = F.when(largest_area > 0, largest_area)
    fits = lambda f: F.coalesce((area * f * f).between(*PLOT_AREAS), F.lit(False))
    tried = reduce(lambda rest, f: F.when(fits(F.lit(f)), F.lit(f)).otherwise(rest), reversed(FACTORS), F.lit(None).cast("double"))
    way = (
        F.when(area.isNull(), F.when(own.isNotNull(), "header").otherwise("default")).when(own.isNotNull() & fits(own), "header_confirmed").when(tried.isNotNull(), "tried").when(own.isNotNull(), "header_implausible").otherwise("default")
    )
    return {"factor": F.when(way == "tried", tried).when(way == "default", 1.0).otherwise(own), "trust": lookup(way, TRUST), "way": way}


def resolved_scale(samples: Column, denominator: Column) -> dict[str, Column]:
    """points_per_metre and trust from the scales that edge labels imply (array) and the printed scale 1:N (or null).

    Where both differ by more than 5 % the printed one stands, trusted less.
    """
    n = F.coalesce(F.size(samples), F.lit(0))
    labelled = F.when(n > 0, F.aggregate(samples, F.lit(0.0), lambda s, v: s + v) / n)
    printed = points_per_metre(denominator)
    agree = F.abs(printed - labelled) / printed <= SCALE_AGREES
    pair = F.coalesce((n == 2) & (F.abs(F.get(samples, F.lit(0)) - F.get(samples, F.lit(1))) / labelled < LABELS_AGREE), F.lit(False))
    trust = F.when(printed.isNotNull(), F.when(labelled.isNull(), 0.95).when(agree, 0.99).otherwise(0.80)).when(labelled.isNotNull(), F.when(pair, 0.99).otherwise(0.80))
    return {"points_per_metre": F.coalesce(printed, labelled), "trust": trust}


#: Distances that are looked at together, at least one row of them.
_AT_ONCE = 4_000_000


def _best_notes(notes: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, denominator, o: for each place and denominator of its sheet, the order (keyword, squared distance, pos) of the best note.

    Equal places ask once, and of equal notes the first counts. The others of a
    sheet meet in blocks in one task, so that no pair is stored.
    """
    k = F.when(F.col("keyword"), 0).otherwise(1)
    notes = notes.groupBy(*keys, "denominator", k.alias("k"), "x", "y").agg(F.min("pos").alias("pos"))
    asked = places.select(*keys, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    type_of = dict(notes.dtypes)
    key_types = ", ".join(f"`{c}` {type_of[c]}" for c in keys)

    def meet(at: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=[*keys, "px", "py", "denominator", "k", "d", "p"])]
        px, py = at[["px", "py"]].to_numpy(float).T
        for denominator, rows in of.groupby("denominator", dropna=False):
            rows = rows[rows.k == rows.k.min()].sort_values("pos")  # those that say so go before all others
            x, y, pos = rows.x.to_numpy(float), rows.y.to_numpy(float), rows.pos.to_numpy()
            step = max(1, _AT_ONCE // len(rows))
            for i in range(0, len(at), step):
                d = (x - px[i : i + step, None]) ** 2 + (y - py[i : i + step, None]) ** 2
                d[np.isnan(d)] = -1.0  # unknown places go first, as nulls do
                best = d.argmin(axis=1)
                part = at.iloc[i : i + step].assign(denominator=denominator, k=int(rows.k.iloc[0]), d=d[np.arange(len(d)), best], p=pos[best])
                out.append(part)
        return pd.concat(out[1:] or out)[out[0].columns]

    found = asked.distinct().groupBy(*keys).cogroup(notes.groupBy(*keys)).applyInPandas(meet, f"{key_types}, px double, py double, denominator {type_of['denominator']}, k int, d double, p {type_of['pos']}")
    found = found.select(*[F.col(c).alias(f"f_{c}") for c in keys], "px", "py", "denominator", F.struct("k", "d", "p").alias("o"))
    same = [F.col(c) == F.col(f"f_{c}") for c in keys] + [F.col("x").eqNullSafe(F.col("px")), F.col("y").eqNullSafe(F.col("py"))]
    return places.select(*keys, F.col("id").alias("place"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(found, same).select(*keys, "place", "denominator", "o")


def nearest_scale_note(notes: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, denominator: for each place (id, x, y) the scale note (x, y, keyword, denominator, pos) nearest to it; notes that say so first."""
    return _best_notes(notes, places, keys).groupBy(*keys, "place").agg(F.min_by("denominator", "o").alias("denominator"))


def distinct_scales(notes: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, denominator, rank: the different scales to try for a place, best first, and last none (null)."""
    per = _best_notes(notes, places, keys)
    per = per.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "place").orderBy("o")) - 1).drop("o")
    last = places.select(*keys, F.col("id").alias("place")).join(per.groupBy(*keys, "place").agg(F.count(F.lit(1)).alias("n")), [*keys, "place"], "left")
    return per.select(*keys, "place", "denominator", "rank").unionByName(last.select(*keys, "place", F.lit(None).cast("int").alias("denominator"), F.coalesce("n", F.lit(0)).cast("int").alias("rank")))
