"""What a sheet says of itself: labelled areas and ratios, numbers, regions under captions, relations of lines, its kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.text import dimension_candidate
from plumbline.operators.candidates import captions
from plumbline.operators.spatial import CORNERS
from plumbline.sources.work import kept

#: Labels of areas and ratios in order of precedence (field, pattern, unit), and the targets of a drawing.
AREA_LABELS = [
    ("plot.area", r"^AREA\s+OF\s+PLOT\s*\(\s*Minimum\s*\)", "m2"), ("plot.area", r"\bSITE\s+AREA\b", "m2"), ("plot.net_area", r"^NET\s+AREA\s+OF\s+PLOT", "m2"),
    ("building.footprint_area", r"^PROPOSED\s+COVERAGE\s+AREA", "m2"), ("building.footprint_area", r"\bGROUND\s+COVERAGE\s+AREA\b", "m2"), ("building.footprint_area", r"\bG\.?\s*F\.?\s+AREA\b", "m2"), ("building.footprint_area", r"\bPLINTH\s+AREA\s+IN\s+G\.?\s*F\.?", "m2"),
    ("coverage", r"^PROPOSED\s+COVERAGE\s+AREA", "%"), ("coverage", r"\bCOVERAGE\b.{0,20}%|%.{0,20}\bCOVERAGE\b", "%"), ("far.area", r"^PROPOSED\s+FAR\s+AREA", "m2"), ("far", r"^ACHIEVED\s+NET\s+FAR\s+AREA", "ratio"), ("far.area", r"^ACHIEVED\s+NET\s+FAR\s+AREA", "m2"),
    ("far", r"\b(?:FAR|FSI)\b.{0,20}\bACHIEVED\b|\bACHIEVED\b.{0,20}\b(?:FAR|FSI)\b", "ratio"), ("building.gross_built_up_area", r"^PROPOSED\s+BUILTUP\s+AREA", "m2"), ("building.gross_built_up_area", r"\bTOTAL\s+BUILT[\s-]?UP\s+AREA\b", "m2"),
]
TARGET_FIELDS = {"plot.area": "plot_area_gross", "plot.net_area": "plot_area_net", "building.footprint_area": "building_footprint_area"}
INLINE, ANY_NUMBER = r"(?i)(\d+(?:\.\d+)?)\s*(?:sq\.?\s*m|sqm|m2|m²|smt)\b", r"(?<![\d.])(\d+(?:\.\d+)?)(?![\d.])(?!\s*%)"
NUMBER_CELL, PERCENT_CELL = r"^(?:\d+(?:\.\d+)?|\.\d+)$", r"^(\d+(?:\.\d+)?)\s*%$"
LEAST_AREA, MOST_COVERAGE, MOST_FAR, ROW_REACH = 10.0, 100.0, 10.0, 18.0
#: What a point across rows and one along a row count in the choice of a label's cell.
ACROSS, ALONG = 20.0, 0.01


def inline_area(tail: Column) -> Column:
    """The area behind a label in its own text: the first number with an area unit, else the first that is no percentage."""
    with_unit, plain = (F.regexp_extract(tail, p, 1).try_cast("double") for p in (INLINE, ANY_NUMBER))
    return F.coalesce(with_unit, plain)


def nearest_cell(labels: DataFrame, cells: DataFrame, keys: list[str], reach: float = ROW_REACH) -> DataFrame:
    """keys, label, value: the cell (pos, x, y, value) right of each label (pos, right, y), in its row: nearness across rows counts most.

    Labels of one place ask once, and of cells at one place only the first can be
    nearest (the second, for a label that is a cell itself). They meet within a
    small part of the reach first; a label whose cell costs less than any cell
    farther across rows is settled, the others meet within a larger part.
    """
    place = [*keys, "right", "ly", "own"]
    selves = cells.select(*keys, "pos").distinct().withColumn("self", F.lit(True))
    own = F.when(F.col("self"), F.col("pos").cast("string")).otherwise("")
    labels = labels.join(selves, [*keys, "pos"], "left").select(*keys, F.col("pos").alias("label"), F.col("right").cast("double").alias("right"), F.col("y").cast("double").alias("ly"), own.alias("own"))
    nth = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy("pos"))
    cells = cells.withColumn("nth", nth).where("nth <= 2").select(*keys, F.col("pos").alias("cell"), "x", "y", "value")
    labels, cells = kept(labels, "labels"), kept(cells, "cells")
    left, done = kept(labels.select(*place).where("right is not null and ly is not null").distinct(), "places"), []
    cost = F.bround(F.abs(F.col("y") - F.col("ly")) * ACROSS + (F.col("x") - F.col("right")) * ALONG, 9)
    for part in (64, 8, 1):
        near = reach / part
        band = lambda y, d=0: F.floor(F.col(y) / near).cast("long") + d  # noqa: E731, B023
        met = left.withColumn("band", F.explode(F.array(*[band("ly", d) for d in (-1, 0, 1)]))).join(cells.withColumn("band", band("y")), [*keys, "band"])
        met = met.where((F.col("cell").cast("string") != F.col("own")) & (F.col("x") >= F.col("right")) & (F.abs(F.col("y") - F.col("ly")) <= near))
        best = met.groupBy(*place).agg(F.min(F.struct(cost.alias("cost"), "cell", "value")).alias("best"))
        if part > 1:
            best = best.where(F.col("best.cost") < ACROSS * near - 1e-8)
        done.append(kept(best, "nearest"))
        left = left.join(done[-1].select(*place), place, "left_anti")
    return labels.join(reduce(DataFrame.union, done), place).select(*keys, "label", F.col("best.value").alias("value"))


def area_measurements(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, value, unit, rank, pos: areas, coverage and FAR with printed labels; texts: keys, pos (reading order), text, corners.

    A value stands in the label's text or in a cell right of it in its row. Areas
    under 10, coverage beyond 100 and FAR beyond 10 belong to something else. Of
    one field and value the first label counts.
    """
    said, middle = F.trim("text"), lambda a: (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2
    rows = texts.select(*keys, "pos", said.alias("text"), F.col("max_x").alias("right"), middle("x").alias("x"), middle("y").alias("y"))
    found = []
    for rank, (name, pattern, unit) in enumerate(AREA_LABELS):
        head = f"(?is)^{pattern[1:]}" if pattern.startswith("^") else f"(?is)^.*?(?:{pattern})"
        found.append(F.when(F.col("text").rlike("(?i)" + pattern), F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("field"), F.lit(unit).alias("unit"), F.regexp_replace("text", head, "").alias("tail"))))
    labels = rows.withColumn("l", F.explode(F.array_compact(F.array(*found)))).select(*keys, "pos", "text", "right", "y", "l.*")
    at = labels.select(*keys, "pos", "right", "y").distinct()
    numbers = rows.where(F.col("text").rlike(NUMBER_CELL)).withColumn("value", F.col("text").try_cast("double"))
    percents = rows.withColumn("value", F.regexp_extract("text", PERCENT_CELL, 1).try_cast("double")).where("value is not null")
    beside = lambda cells, name: nearest_cell(at, cells, keys).withColumnRenamed("label", "pos").withColumnRenamed("value", name)
    labels = labels.join(beside(numbers, "cell"), [*keys, "pos"], "left").join(beside(percents, "percent"), [*keys, "pos"], "left")
    inside = lambda p: F.regexp_extract("text", p, 1).try_cast("double")
    between = lambda v, low, high: F.when((v > low) & (v <= high), v)
    large = lambda v: F.when(v >= LEAST_AREA, v)
    value = (
        F.when(F.col("field") == "coverage", between(F.coalesce(inside(r"\(\s*(\d+(?:\.\d+)?)\s*%"), "percent"), 0.0, MOST_COVERAGE))
        .when(F.col("field") == "far", F.coalesce(inside(r"\(\s*(\d+(?:\.\d+)?)\s*\)"), between(F.col("cell"), 0.0, MOST_FAR)))
        .otherwise(F.coalesce(large(inline_area(F.col("tail"))), large(F.col("cell"))))
    )
    labels = labels.withColumn("value", value).where("value is not null").withColumn("v4", F.bround("value", 4))
    first = labels.groupBy(*keys, "field", "v4").agg(F.min_by(F.struct("value", "unit", "rank", "pos"), F.struct("rank", "pos")).alias("m"))
    return first.select(*keys, "field", "m.*")


def area_targets(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, value: what a drawing's rectangles must come to, the first label of each."""
    named = F.element_at(F.create_map(*[F.lit(v) for kv in TARGET_FIELDS.items() for v in kv]), F.col("field"))
    rows = measurements.withColumn("target", named).where("target is not null")
    return rows.groupBy(*keys, "target").agg(F.min_by("value", F.struct("rank", "pos")).alias("value"))


def best_rectangle(rects: DataFrame, targets: DataFrame, keys: list[str], tolerance: float = 0.03) -> DataFrame:
    """keys, rect, error: the rectangle (id, corners, per_metre, flush) whose area comes nearest to a target within the
    tolerance; one that is not flush with its container goes first."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) / F.pow("per_metre", F.lit(2))
    met = rects.where("per_metre > 0").join(targets.where("value > 0"), keys).withColumn("error", F.abs(area - F.col("value")) / F.col("value")).where(F.col("error") <= tolerance)
    best = met.groupBy(*keys).agg(F.min_by(F.struct("id", "error"), F.struct("flush", F.bround("error", 12), "id")).alias("b"))
    return best.select(*keys, F.col("b.id").alias("rect"), F.col("b.error").alias("error"))


#: Texts without lengths, sizes in schedules, and the longest length of a site.
NO_LENGTHS, SCHEDULE_SIZE, LONGEST = r"(?i)sq\.m|sqm|sq\.ft|sqft|bearing|scale", r"\d+(?:\.\d+)?\s*[xX]\s*\d+(?:\.\d+)?", 60.0
FEET_CELL, NUMBER_TOKEN = r"(?i)(\d+(?:\.\d+)?)\s*'\s*-?\s*(\d+(?:\.\d+)?)?\s*\"?", r"(?i)(?<![A-Za-z])(\d*\.\d+|\d+)(?:\s*(mm|cm|m|ft|feet|in|\"|'))?"


def lengths_in(text: Column) -> Column:
    """array of metres: the lengths that a text prints, none in area statements and schedules; feet with inches count as one."""
    feet, inches = F.regexp_extract(text, FEET_CELL, 1).try_cast("double"), F.coalesce(F.regexp_extract(text, FEET_CELL, 2).try_cast("double"), F.lit(0.0))
    values, units = (F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(i)) for i in (1, 2))
    factor = lambda u: F.when(u == "mm", 0.001).when(u == "cm", 0.01).when(u.isin("ft", "feet", "'"), 0.3048).when(u.isin("in", '"'), 0.0254).otherwise(1.0)
    plain = F.filter(F.zip_with(values, units, lambda v, u: v.try_cast("double") * factor(F.lower(u))), lambda m: (m > 0) & (m <= LONGEST))
    none = F.array().cast("array<double>")
    return F.when(text.rlike(NO_LENGTHS) | text.rlike(SCHEDULE_SIZE), none).when(feet.isNotNull() & (inches < 12), F.array((feet + inches / 12.0) * 0.3048)).otherwise(plain)


#: How far a region reaches around its caption, as shares of the page: to the sides, above and below.
SIDEWAYS, ABOVE, BELOW = 0.18, 0.30, 0.06


def region_windows(texts: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, type, corners: the part of the page around each caption; a caption that reads sideways has a window on both sides.

    texts: keys, id, text, corners; pages: keys, width, height.
    """
    box = texts.select(*keys, F.col("id").alias("anchor"), *[F.col(c).alias(f"t_{c}") for c in CORNERS])
    rows = captions(texts, keys).join(box, [*keys, "anchor"]).join(pages, keys)
    cx, cy = (F.col("t_min_x") + F.col("t_max_x")) / 2, (F.col("t_min_y") + F.col("t_max_y")) / 2
    turned = (F.col("t_max_y") - F.col("t_min_y")) > (F.col("t_max_x") - F.col("t_min_x"))
    dx = F.when(turned, F.col("width") * ABOVE).otherwise(F.col("width") * SIDEWAYS)
    up, down = (F.when(turned, F.col("height") * SIDEWAYS).otherwise(F.col("height") * share) for share in (ABOVE, BELOW))
    low, high = lambda v: F.greatest(F.lit(0.0), v), F.least
    return rows.select(*keys, "type", low(cx - dx).alias("min_x"), low(cy - up).alias("min_y"), high(F.col("width"), cx + dx).alias("max_x"), high(F.col("height"), cy + down).alias("max_y"))


#: Alignment from which lines are parallel, to which they are perpendicular, and shares of the longer one that count as one line and as its continuation.
PARALLEL, PERPENDICULAR, ONE_LINE, CONTINUES = 0.95, 0.05, 0.02, 0.05


def line_relation(a: Column, b: Column) -> Column:
    """How two lines (x1, y1, x2, y2) lie: INTERSECTS, CONTINUES, COLLINEAR, PARALLEL, PERPENDICULAR, or null."""
    length = lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
    scale = F.greatest(length(a), length(b), F.lit(1e-9))
    way = lambda e: g.orientation_degrees(e["x2"] - e["x1"], e["y2"] - e["y1"])
    along = g.orientation_alignment(way(a), way(b))
    mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    offset = F.abs((a["x2"] - a["x1"]) * (my - a["y1"]) - (a["y2"] - a["y1"]) * (mx - a["x1"])) / F.greatest(length(a), F.lit(1e-12))
    to = lambda s, x, y: g.point_segment_distance(x, y, s["x1"], s["y1"], s["x2"], s["y2"])
    gap = F.least(to(b, a["x1"], a["y1"]), to(b, a["x2"], a["y2"]), to(a, b["x1"], b["y1"]), to(a, b["x2"], b["y2"]))
    one = F.when(gap <= CONTINUES * scale, "CONTINUES").otherwise("COLLINEAR")
    return (
        F.when(g.segment_distance(a, b) <= 1e-6 * scale, "INTERSECTS")
        .when(along >= PARALLEL, F.when(offset <= ONE_LINE * scale, one).otherwise("PARALLEL"))
        .when(along <= PERPENDICULAR, "PERPENDICULAR")
    )


#: Words of site plans and of floor plans, and layers of roads, plots and buildings.
SITE_WORDS = r"(?i)SITE\s*PLAN|LOCATION\s*PLAN|KEY\s*PLAN|SETBACK|PLOT\s*(?:AREA|BOUNDARY|DIMENSION)|NORTH\s*ARROW|ADJOINING|ROAD\s*WIDTH|SITE\s*AREA|PROPERTY\s*LINE"
FLOOR_WORDS = r"(?i)FLOOR\s*PLAN|GROUND\s*FLOOR|FIRST\s*FLOOR|SECOND\s*FLOOR|GA\s*PLAN|FURNITURE\s*LAYOUT|BED\s*ROOM|BEDROOM|LIVING\s*ROOM|KITCHEN|TOILET|W\.?C\.?|DINING|ELEVATION|SECTION\s*[A-Z]-[A-Z]|ROOF\s*PLAN"
LAYERS = {"plot": r"(?i)PLOT|BOUNDARY|SITE[-_ ]?BOUND|PROPERTY[-_ ]?LINE|PARCEL", "building": r"(?i)BUILDING|BLDG|FOOTPRINT|STRUCTUR|\bWALL", "road": r"(?i)\bROAD\b|\bROW\b|RIGHT[-_ ]?OF[-_ ]?WAY|STREET"}


def sheet_kinds(polygons: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score: positive for site plans, negative for floor plans.

    polygons: keys, layer, area; texts: keys, text. Words, layers, how far the
    largest polygon outgrows the next, and how many there are all count.
    """
    hits = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    words = texts.groupBy(*keys).agg(hits(SITE_WORDS).alias("site"), hits(FLOOR_WORDS).alias("floor"))
    on = lambda n: F.coalesce(F.col("layer").rlike(LAYERS[n]), F.lit(False))
    order = Window.partitionBy(*keys).orderBy(F.desc("area"))
    top = polygons.withColumn("nth", F.row_number().over(order))
    shapes = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("nth") == 1, F.col("area"))).alias("a1"), F.max(F.when(F.col("nth") == 2, F.col("area"))).alias("a2"), F.bool_or(on("road")).alias("road"), F.bool_or(on("plot")).alias("plot"), F.max(F.when(on("building"), F.col("area"))).alias("b"))
    rows = words.join(shapes, keys, "full_outer")
    part = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    lead = F.when(F.col("a2") > 0, F.col("a1") / F.col("a2"))
    terms = [
        1.5 * F.least(F.coalesce("site", F.lit(0)), F.lit(3)), -0.4 * F.least(F.coalesce("floor", F.lit(0)), F.lit(3)), part(F.col("road"), 2.5), part(F.col("plot"), 3.5),
        F.when(lead >= 8.0, 4.5).when(lead >= 3.0, 3.0).when(lead <= 1.5, -0.75).otherwise(0.0), F.when(F.col("n") >= 15, -0.4).when(F.col("n").between(1, 4), 0.5).otherwise(0.0), part((F.col("a1") > 0) & (F.col("b") / F.col("a1") < 0.6), 1.0),
    ]
    return rows.select(*keys, reduce(lambda a, b: a + b, terms).alias("score"))


def dominant_positions(lines: DataFrame, keys: list[str], most: int = 60, least: float = 45.0) -> DataFrame:
    """keys, position, extent: the axis positions of lines (position, start, end) with the longest strokes, to a tenth of a
    point; those too short for a side are left out, and the strongest `most` stay."""
    per = lines.groupBy(*keys, F.bround("position", 1).alias("position")).agg(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("extent")).where(F.col("extent") >= least)
    order = Window.partitionBy(*keys).orderBy(F.desc("extent"), "position")
    return per.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def confidence_caps(unit_trust: Column, curved: Column, envelope: Column, fitted: Column, rectangularity: Column, doubtful: Column, confirmed: Column) -> dict[str, Column]:
    """Confidence of a drawing's area and lengths: the least of what its unit, curves, fitted outline, shape and identity allow;
    a length that a printed dimension confirms is not held down by outline and shape."""
    curve = F.when(curved, 0.90).otherwise(1.0)
    outline = F.when(~envelope, 1.0).when(fitted, 0.85).otherwise(0.75)
    shape = F.when(rectangularity >= 0.85, 1.0).otherwise(F.greatest(F.lit(0.5), rectangularity))
    identity = F.when(doubtful, 0.4).otherwise(1.0)
    area = F.least(F.lit(0.98), unit_trust, curve, outline, identity)
    return {"area": area, "length": F.when(confirmed, F.least(F.lit(0.98), unit_trust, curve, identity)).otherwise(F.least(F.lit(0.95), unit_trust, curve, outline, shape, identity))}


#: Fixed value: where a value comes from that a person entered.
USER_EDIT = "USER_EDIT"


def formatted(plans: DataFrame, fields: dict[str, str], sources: str = "sources") -> DataFrame:
    """plan_id and one JSON summary of fields (name -> unit): value, unit, confidence, source, edited, conflict.

    sources: column with a map of field to source.
    """

    def shown(name: str, unit: str) -> Column:
        f, source = F.col(f"`{name}`"), F.try_element_at(F.col(sources), F.lit(name))
        return F.struct(f["num"].alias("value"), F.lit(unit).alias("unit"), f["level"].alias("confidence"), source.alias("source"), F.coalesce(source == USER_EDIT, F.lit(False)).alias("edited"), (f["level"] == "CONFLICTING").alias("conflict"))

    return plans.select("plan_id", F.to_json(F.struct(*[shown(n, u).alias(n) for n, u in fields.items()])).alias("summary"))


def dimension_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos and the parts of the dimension that a text prints; other texts are left out."""
    rows = texts.withColumn("d", F.explode(F.array(dimension_candidate(F.col("text"))))).where("d is not null")
    return rows.select(*keys, "pos", "d.value", "d.unit", "d.confidence")
