"""Candidates for plots and buildings: filters, scores, and the choice between hypotheses."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators.spatial import CORNERS, nesting

#: Shares of a plot that a building's box may take, its longest aspect, and words of rooms.
BUILDING_SHARE, BUILDING_ASPECT, NESTED_SHARE = (0.01, 0.92), 8.0, 0.98
ROOMS = r"(?i)\b(bed\s*room|bedroom|kitchen|hall|toilet|bath(room)?|w\.?c\.?|living|dining|store|balcony|passage|verandah|veranda|puja|study|column|col\.)\b"
#: Weights of what speaks for a plot, the least score to be used, and margins for HIGH and MEDIUM.
PLOT_WEIGHTS = {"area_rank": 0.20, "rectangularity": 0.15, "aspect_ratio": 0.10, "boundary_annotation": 0.20, "label_match": 0.20, "road_adjacency": 0.10, "not_nested": 0.05}
LEAST_PLOT_SCORE, PLOT_MARGINS = 0.65, (0.15, 0.05)
#: Boxes that a sheet's border holds at least, and their share of all others.
BORDER = (4, 0.5)


def page_frame(page_width: Column, page_height: Column, touch: float = 4.0, share: float = 0.92) -> Column:
    """Whether a box (its corners as columns) is the border of a page: nearly all of it, and at two edges or more."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    at = [F.col("min_x") <= touch, F.col("min_y") <= touch, F.col("max_x") >= page_width - touch, F.col("max_y") >= page_height - touch]
    n = reduce(lambda a, b: a + b, (c.cast("int") for c in at))
    return (page_width > 0) & (page_height > 0) & (w * h / (page_width * page_height) >= share) & (n >= 2)


def first_outside(corners: np.ndarray) -> np.ndarray:
    """Which boxes (n, 4), in order, stay: those that no box before them that stays holds, 1 at most beyond its sides and larger by 2 %.

    The head of the list stays and strikes what it holds; an equal one after it finds nothing left to strike.
    """
    stays, left = np.zeros(len(corners), bool), np.arange(len(corners))
    c = np.ascontiguousarray(corners.T)
    area, struck = (c[2] - c[0]) * (c[3] - c[1]), set()
    while len(left):
        i, left = left[0], left[1:]
        stays[i] = True
        own = tuple(c[:, i].tolist())
        if own in struck:
            continue
        struck.add(own)
        b = c[:, left]
        held = (b[0] >= own[0] - 1) & (b[1] >= own[1] - 1) & (b[2] <= own[2] + 1) & (b[3] <= own[3] + 1) & (area[left] < area[i] * NESTED_SHARE)
        left = left[~held] if held.any() else left
    return stays


def filter_buildings(boxes: DataFrame, plots: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Every building candidate (keys, id, pos, corners) with the reason for which it falls, null if it stays.

    plots: keys, area (or no row); labels: keys, text, corners. In this order: too
    slender, as large as the plot, too small for it, beside the name of a room,
    inside a candidate before it that stays. The last is decided in order of pos
    in one task a sheet, where a kept box strikes all later ones that it holds at once.
    """
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    rows = boxes.join(plots.select(*keys, F.col("area").alias("plot_area")), keys, "left")
    share = w * h / F.col("plot_area")
    rows = rows.withColumn("reason", F.when(g.aspect_ratio(w, h) > BUILDING_ASPECT, "SLENDER").when(share >= BUILDING_SHARE[1], "PLOT").when(share < BUILDING_SHARE[0], "SMALL"))
    named = labels.where(F.col("text").rlike(ROOMS)).select(*[F.col(k).alias(f"t_{k}") for k in keys], *[F.col(c).alias(f"t_{c}") for c in CORNERS]).distinct()
    box = rows.where("reason is null").select(*keys, "id", *[F.col(c).alias(f"b_{c}") for c in CORNERS])
    near = g.bbox_gap("b", "t") <= 0.15 * F.greatest(F.col("b_max_x") - F.col("b_min_x"), F.col("b_max_y") - F.col("b_min_y"))
    # A semi-join: a box looks no farther than its first label.
    rooms = box.join(named, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"t_{k}") for k in keys], near), "left_semi").select(*keys, "id").distinct().withColumn("room", F.lit(True))
    rows = rows.join(rooms, [*keys, "id"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("room"), "ROOM"))).drop("room", "plot_area")
    order = dict(rows.dtypes)

    def stay_of(sheet: pd.DataFrame) -> pd.DataFrame:
        sheet = sheet.sort_values(["pos", "id"])
        return sheet.loc[first_outside(sheet[list(CORNERS)].to_numpy(float)), [*keys, "id"]]

    few = rows.where("reason is null").select(*keys, "pos", "id", *CORNERS)
    types = ", ".join(f"`{k}` {order[k]}" for k in [*keys, "id"])
    stay = few.groupBy(*keys).applyInPandas(stay_of, types).withColumn("stays", F.lit(True))
    out = rows.join(stay, [*keys, "id"], "left")
    return out.select(*boxes.columns, F.coalesce("reason", F.when(F.col("stays").isNull(), "NESTED")).alias("reason"))


def survivors(filtered: DataFrame) -> DataFrame:
    return filtered.where("reason is null").drop("reason")


def footprint(filtered: DataFrame, keys: list[str], per_metre: str = "per_metre") -> DataFrame:
    """keys, blocks, square_metres: the areas of the surviving blocks (area, per_metre) together, and the largest one's id."""
    kept = survivors(filtered)
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("area") / F.pow(per_metre, F.lit(2))).alias("square_metres"), F.max_by("id", F.struct("area", -F.col("pos"))).alias("primary"))


def plausible_building(building_area: Column, plot_area: Column, least: float = 0.03) -> Column:
    """False for a building under 3 % of its plot."""
    return ~F.coalesce((plot_area > 0) & (building_area / plot_area < least), F.lit(False))


# ---------------------------------------------------------------- plots


def plot_scores(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """All columns of the candidates with area_rank, aspect_ratio, not_nested and score; a sheet's border is left out.

    candidates: keys, id, corners, area, rectangularity, boundary_annotation,
    label_match, road_adjacency and vision (or null), the latter shares from 0 to
    1. area_rank is by the largest candidate of all sheets of a document (keys but
    the last). A box inside a larger one of its sheet is nested; one that holds
    four others and half of them is a border.
    """
    held = nesting(candidates, keys).select(*keys, *CORNERS, "held")
    n = candidates.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("others"))
    rows = candidates.join(held, [*keys, *CORNERS], "left").join(n, keys)
    rows = rows.where(~F.coalesce((F.col("held") >= BORDER[0]) & (F.col("held") / F.col("others") >= BORDER[1]), F.lit(False))).drop("held", "others")
    own = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    nested = nesting(rows, keys).where(F.col("holder") > 1.02 * own).select(*keys, *CORNERS, F.lit(True).alias("nested"))
    most = rows.groupBy(*keys[:-1]).agg(F.max("area").alias("most"))
    rows = rows.join(nested, [*keys, *CORNERS], "left").join(most, keys[:-1]) if keys[:-1] else rows.join(nested, [*keys, *CORNERS], "left").crossJoin(F.broadcast(most))
    slender = g.aspect_ratio(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    rows = rows.withColumns({
        "area_rank": F.coalesce(F.try_divide("area", "most"), F.lit(0.0)),
        "aspect_ratio": F.when(slender < float("inf"), F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), slender - 1.0) / 6.0)).otherwise(0.0),
        "not_nested": F.when(F.col("nested"), 0.0).otherwise(1.0),
    })
    total = reduce(lambda a, b: a + b, (F.lit(w) * F.col(n) for n, w in PLOT_WEIGHTS.items()))
    return rows.drop("nested", "most").withColumn("score", total + 0.20 * F.coalesce("vision", F.lit(0.0)))


def page_basis(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, basis: the median extent of a page's candidates, by which nearness is judged."""
    return boxes.groupBy(*keys).agg(F.percentile(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), F.lit(0.5)).alias("basis"))


def ranked(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, winner, score, runner_up, n: the best candidate, the score of the next, and how many there are."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    rows = scored.withColumn("nth", F.row_number().over(order)).withColumn("runner_up", F.lead("score").over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return rows.where("nth = 1").select(*keys, F.col("id").alias("winner"), "score", "runner_up", "n")


def plot_level(score: Column, runner_up: Column) -> Column:
    """LOW under the least usable score, MEDIUM for a lone candidate, else by the margin."""
    margin = score - runner_up
    return F.when(score < LEAST_PLOT_SCORE, "LOW").when(runner_up.isNull(), "MEDIUM").when(margin >= PLOT_MARGINS[0], "HIGH").when(margin >= PLOT_MARGINS[1], "MEDIUM").otherwise("LOW")


def plot_building_score(plot_area: Column, areas: tuple[float, float], envelope: Column, aspect: Column, building: Column, ratio: Column, least_ratio: float, rebuilt: Column) -> Column:
    """How good a resolved plot with or without building is; -1 without a plot."""
    one = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    house = F.when(building, 2.0 + one(ratio.between(least_ratio, 0.92), 1.0) + one(~rebuilt, 1.0)).otherwise(0.0)
    total = 1.0 + one(~plot_area.between(*areas), -10.0) + one(envelope, -0.5) + house + one((aspect <= 6.0) & (aspect < float("inf")), 0.5) + F.least(F.lit(1.0), plot_area / 500.0)
    return F.when(plot_area.isNull(), -1.0).otherwise(total)


# ---------------------------------------------------------------- hypotheses


def structural_level(identity_failed: Column, captioned: Column, margin: Column, high: float, medium: float) -> Column:
    """LOW where nothing confirms the drawing, HIGH with its caption, else by the margin; a lone hypothesis is MEDIUM."""
    return F.when(identity_failed, "LOW").when(captioned, "HIGH").when(margin.isNull(), "MEDIUM").when(margin >= high, "HIGH").when(margin >= medium, "MEDIUM").otherwise("LOW")


def decide_structure(hypotheses: DataFrame, keys: list[str], least: float, high: float = 8.0, medium: float = 2.0) -> DataFrame:
    """keys, decision, accepted, level of the best of a role's hypotheses (id, score, captioned, identity_failed).

    Below the least score it abstains. Two that are both good enough and closer
    than `medium` are in conflict, unless the first alone has a caption.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    rows = hypotheses.withColumn("nth", F.row_number().over(order)).withColumn("next", F.lead(F.struct("score", "captioned")).over(order)).where("nth = 1")
    margin = F.col("score") - F.col("next.score")
    tie = F.coalesce((F.col("next.score") >= least) & (margin < medium) & ~(F.col("captioned") & ~F.col("next.captioned")), F.lit(False))
    decision = F.when(F.col("score") < least, "ABSTAIN").when(tie, "CONFLICT").otherwise("ACCEPT")
    level = structural_level(F.col("identity_failed"), F.col("captioned"), margin, high, medium)
    rows = rows.withColumn("decision", decision).withColumn("level", F.when(decision == "ABSTAIN", "MISSING").when(decision == "CONFLICT", "CONFLICTING").otherwise(level))
    return rows.select(*keys, "decision", F.when(F.col("decision") == "ACCEPT", F.col("id")).alias("accepted"), "level")


#: Distances that are looked at together, at least one row of them.
AT_ONCE = 4_000_000


def borrowed_road(plots: DataFrame, roads: DataFrame, keys: list[str], reach: float = 3.0, margin: float = 0.25) -> DataFrame:
    """keys, plot, road, distance: the road of another region nearest to a plot (id, corners), by the middles of their boxes.

    None beyond `reach` diagonals of the plot, nor where a second road is nearly as near. Plots with one
    middle ask once; middles of a sheet meet in blocks in one task, so no pair is stored.
    """
    x, y = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    diagonal = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    plots = plots.select(*keys, F.col("id").alias("plot"), x.alias("px"), y.alias("py"), diagonal.alias("diagonal")).where("diagonal > 1e-9")
    nth = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy("road"))
    # Of roads with one middle the first three are enough, as a plot may be one of them and two are asked for.
    roads = roads.select(*keys, F.col("id").alias("road"), x.alias("x"), y.alias("y")).withColumn("nth", nth).where("nth <= 3").drop("nth")
    type_of = dict(roads.dtypes)

    def meet(at: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("road")
        rx, ry, road = of.x.to_numpy(float), of.y.to_numpy(float), of.road.to_numpy()
        out = [pd.DataFrame(columns=[*at.columns, "road", "d"])]
        step = max(1, AT_ONCE // max(1, len(of)))
        for i in range(0, len(at) if len(of) else 0, step):
            some = at.iloc[i : i + step]
            d = (rx - some.px.to_numpy(float)[:, None]) ** 2 + (ry - some.py.to_numpy(float)[:, None]) ** 2
            row = np.arange(len(some))
            for _ in range(min(3, len(of))):  # the nearest, of equals the first; then the next
                best = d.argmin(axis=1)
                out.append(some.assign(road=road[best], d=np.sqrt(d[row, best])))
                d[row, best] = np.inf
        return pd.concat(out[1:] or out)[out[0].columns]

    places = plots.select(*keys, "px", "py").where("px is not null and py is not null").distinct()
    near = places.groupBy(*keys).cogroup(roads.where("x is not null and y is not null").groupBy(*keys)).applyInPandas(meet, ", ".join(f"`{c}` {type_of[c]}" for c in keys) + f", px double, py double, road {type_of['road']}, d double")
    per = near.groupBy(*keys, "px", "py").agg(F.array_sort(F.collect_list(F.struct("d", "road"))).alias("near"))
    met = plots.join(per, [*keys, "px", "py"]).withColumn("near", F.filter("near", lambda r: r["road"] != F.col("plot")))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    met = met.select(*keys, "plot", "diagonal", first["road"].alias("road"), first["d"].alias("distance"), second["d"].alias("next"))
    fits = (F.col("distance") <= reach * F.col("diagonal")) & (F.col("next").isNull() | (F.col("next") > F.col("distance") * (1 + margin)))
    return met.where(fits).select(*keys, "plot", "road", "distance")


# ---------------------------------------------------------------- captions and readings

#: Captions of the regions of a sheet, and the longest text that is one.
CAPTIONS = {
    "SITE_PLAN": r"(?i)\bSITE\s+PLAN\b", "AREA_STATEMENT": r"(?i)\bAREA\s+STATEMENT\b", "GROUND_FLOOR_PLAN": r"(?i)\bGROUND\s+FLOOR\s+PLAN\b", "FIRST_FLOOR_PLAN": r"(?i)\bFIRST\s+FLOOR\s+PLAN\b", "SECOND_FLOOR_PLAN": r"(?i)\bSECOND\s+FLOOR\s+PLAN\b", "THIRD_FLOOR_PLAN": r"(?i)\bTHIRD\s+FLOOR\s+PLAN\b",
    "OTHER_FLOOR_PLAN": r"(?i)\b(?:TERRACE|STILT|BASEMENT|FOURTH|FIFTH|SIXTH|TYPICAL|MEZZANINE)\s+FLOOR\s+PLAN\b", "ELEVATION": r"(?i)\bELEVATION\b", "SECTION": r"(?i)\bSECTION\b",
}
LONGEST_CAPTION = 45


def captions(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, type, anchor: the text (id, text, min_y) that is the caption of each kind of region: the longest, the uppermost of equals."""
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in CAPTIONS.items()]))
    rows = texts.where(F.length(F.trim("text")) <= LONGEST_CAPTION).withColumn("type", F.explode(kinds))
    return rows.groupBy(*keys, "type").agg(F.max_by("id", F.struct(F.length("text"), -F.col("min_y"), -F.col("id"))).alias("anchor"))


def needs_ocr(native_chars: Column, force: Column | None = None) -> Column:
    """Whether a page has to be read by OCR: it has (next to) no text of its own, or that is asked for."""
    few = F.coalesce(native_chars, F.lit(0)) < 3
    return few if force is None else few | F.coalesce(force, F.lit(False))


def confidence_mass(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mass: characters read, weighted by confidence; groups of a line don't count."""
    mass = F.length(F.trim("text")) * F.coalesce("confidence", F.lit(0.0))
    return items.where(~F.coalesce("is_group", F.lit(False))).groupBy(*keys).agg(F.sum(mass).alias("mass"))


def merged_readings(first: DataFrame, more: DataFrame, keys: list[str], cell: float = 6.0) -> DataFrame:
    """All of the first pass, and of the second what is not the same text at the same place; of equals the first by pos."""
    same = [F.lower(F.trim("text")).alias("k_text"), F.col("is_group").alias("k_group"), F.bround(F.col("x") / cell).alias("k_x"), F.bround(F.col("y") / cell).alias("k_y")]
    known = first.select(*keys, *same).distinct()
    new = more.select("*", *same).join(known, [*keys, "k_text", "k_group", "k_x", "k_y"], "left_anti")
    new = new.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "k_text", "k_group", "k_x", "k_y").orderBy("pos"))).where("_nth = 1")
    return first.unionByName(new.select(*first.columns))


def rotation(degrees: Column) -> Column:
    """A rotation folded to 0, 90, 180 or 270."""
    return (F.floor(F.pmod(degrees.cast("int"), F.lit(360)) / 90) * 90).cast("int")


def points_per_pixel(dpi: Column) -> Column:
    return F.when(dpi > 0, F.lit(72.0) / dpi)
