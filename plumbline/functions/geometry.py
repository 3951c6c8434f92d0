"""Boxes, segments and polygons (arrays of struct(x, y)) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import once


def shifted(points: Column) -> Column:
    """Each point's successor around the ring."""
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def edges(points: Column) -> Column:
    return F.zip_with(points, shifted(points), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def perimeter(points: Column) -> Column:
    return _total(F.transform(edges(points), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])))


def shoelace_area(points: Column) -> Column:
    return F.abs(_total(F.transform(edges(points), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2.0


def bounds(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def rectangularity(area: Column, width: Column, height: Column) -> Column:
    """Share of the box that a polygon fills, 1 at most; 0 for an empty box."""
    return F.when(width * height > 0, F.least(F.lit(1.0), area / (width * height))).otherwise(0.0)


def aspect_ratio(width: Column, height: Column) -> Column:
    short, long = F.least(width, height), F.greatest(width, height)
    return F.when(short <= 0, F.lit(float("inf"))).otherwise(long / short)


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the right."""
    crossing = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    flags = F.transform(edges(points), lambda e: F.when((e["y1"] > y) != (e["y2"] > y), crossing(e)).otherwise(False))
    return F.size(F.filter(flags, lambda c: c)) % 2 == 1


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length2))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def boundary_distance(x: Column, y: Column, points: Column) -> Column:
    return F.array_min(F.transform(edges(points), lambda e: point_segment_distance(x, y, e["x1"], e["y1"], e["x2"], e["y2"])))


def orientation_degrees(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def bbox_gap(a: str, b: str) -> Column:
    """Distance between two boxes whose corners are columns a_min_x .. b_max_y."""
    gap = lambda axis: F.greatest(F.lit(0.0), F.col(f"{b}_min_{axis}") - F.col(f"{a}_max_{axis}"), F.col(f"{a}_min_{axis}") - F.col(f"{b}_max_{axis}"))
    return F.hypot(gap("x"), gap("y"))


def bbox_intersection(a: str, b: str) -> Column:
    side = lambda axis: F.greatest(F.lit(0.0), F.least(f"{a}_max_{axis}", f"{b}_max_{axis}") - F.greatest(f"{a}_min_{axis}", f"{b}_min_{axis}"))
    return side("x") * side("y")


def bbox_area(a: str) -> Column:
    return (F.col(f"{a}_max_x") - F.col(f"{a}_min_x")) * (F.col(f"{a}_max_y") - F.col(f"{a}_min_y"))


def bbox_iou(a: str, b: str) -> Column:
    shared = bbox_intersection(a, b)
    return F.try_divide(shared, bbox_area(a) + bbox_area(b) - shared)


def bbox_contains(a: str, b: str) -> Column:
    """Whether box a holds box b, edges included."""
    return (F.col(f"{a}_min_x") <= F.col(f"{b}_min_x")) & (F.col(f"{a}_min_y") <= F.col(f"{b}_min_y")) & (F.col(f"{a}_max_x") >= F.col(f"{b}_max_x")) & (F.col(f"{a}_max_y") >= F.col(f"{b}_max_y"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(min_x: str = "min_x", min_y: str = "min_y", max_x: str = "max_x", max_y: str = "max_y") -> Column:
    """The four corners of a box as a ring."""
    return F.array(*(point(F.col(x), F.col(y)) for x, y in ((min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y))))


def centroid(points: Column) -> Column:
    """Centre of mass of the ring; the mean of its vertices where it has no area."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    mean = lambda axis: _total(F.transform(points, lambda p: p[axis])) / F.size(points)

    def centre(ring: Column, twice: Column) -> Column:
        by_area = lambda a, b: _total(F.transform(ring, lambda e: (e[a] + e[b]) * cross(e))) / (3.0 * twice)
        flat = F.abs(twice) < 2e-9
        return point(F.when(flat, mean("x")).otherwise(by_area("x1", "x2")), F.when(flat, mean("y")).otherwise(by_area("y1", "y2")))

    return once(edges(points), lambda ring: once(_total(F.transform(ring, cross)), lambda twice: centre(ring, twice)))


def segments_intersect(a: Column, b: Column) -> Column:
    """Whether two segments (x1, y1, x2, y2) share a point: they straddle each other, or an end lies on the other."""
    turn = lambda s, x, y: (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
    within = lambda v, p, q: v.between(F.least(p, q) - 1e-9, F.greatest(p, q) + 1e-9)
    touches = lambda s, x, y: (F.abs(turn(s, x, y)) < 1e-9) & within(x, s["x1"], s["x2"]) & within(y, s["y1"], s["y2"])
    apart = lambda s, o: F.signum(turn(s, o["x1"], o["y1"])) * F.signum(turn(s, o["x2"], o["y2"])) < 0
    ends = touches(a, b["x1"], b["y1"]) | touches(a, b["x2"], b["y2"]) | touches(b, a["x1"], a["y1"]) | touches(b, a["x2"], a["y2"])
    return (apart(a, b) & apart(b, a)) | ends


def segment_distance(a: Column, b: Column) -> Column:
    """Distance of two segments, 0 where they meet."""
    to = lambda s, x, y: point_segment_distance(x, y, s["x1"], s["y1"], s["x2"], s["y2"])
    return F.when(segments_intersect(a, b), 0.0).otherwise(F.least(to(b, a["x1"], a["y1"]), to(b, a["x2"], a["y2"]), to(a, b["x1"], b["y1"]), to(a, b["x2"], b["y2"])))


def polygon_edges_distance(points: Column, sides: Column) -> Column:
    """Least distance from a ring to a group of edges; infinite if the group is empty."""
    nearest = F.array_min(F.flatten(F.transform(edges(points), lambda e: F.transform(sides, lambda s: segment_distance(e, s)))))
    return F.when(F.size(sides) > 0, nearest).otherwise(F.lit(float("inf")))


def self_intersects(points: Column) -> Column:
    """Whether two edges that are not neighbours meet."""
    ring, n = edges(points), F.size(points)
    apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
    later = lambda e, i: F.exists(F.transform(ring, lambda o, j: apart(i, j) & segments_intersect(e, o)), lambda hit: hit)
    return (n >= 4) & F.exists(F.transform(ring, later), lambda hit: hit)


def is_valid_polygon(points: Column, min_vertices: int = 3, min_area: float = 1e-6, max_slenderness: float = 1e9) -> Column:
    """Enough distinct vertices, an area, no sliver (perimeter squared by area), no crossing of itself."""
    same = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) < 1e-6
    first = F.filter(points, lambda p, i: ~F.exists(F.slice(points, F.lit(1), i), lambda q: same(p, q)))
    area = shoelace_area(points)
    slender = F.try_divide(F.pow(perimeter(points), 2), area)
    return (F.size(first) >= min_vertices) & (area >= min_area) & (slender <= max_slenderness) & ~self_intersects(points)


def bbox_overlap_fraction(inner: str, outer: str) -> Column:
    """Share of the inner box's area that lies inside the outer; 0 for an empty inner box."""
    return F.coalesce(F.try_divide(bbox_intersection(inner, outer), bbox_area(inner)), F.lit(0.0))


def orientation_alignment(a: Column, b: Column) -> Column:
    """1 for parallel directions in degrees, 0 for perpendicular ones."""
    apart = F.pmod(F.abs(a - b), F.lit(180.0))
    return 1.0 - F.least(apart, 180.0 - apart) / 90.0


def outward_normal(edge: Column, centre: Column) -> Column:
    """Unit normal of an edge on the side away from the centre; 0 for an edge without length."""
    return once(F.struct(edge.alias("e"), centre.alias("c")), lambda s: _outward(s["e"], s["c"]))


def _outward(edge: Column, centre: Column) -> Column:
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    length = F.hypot(dx, dy)
    away = -dy * ((edge["x1"] + edge["x2"]) / 2 - centre["x"]) + dx * ((edge["y1"] + edge["y2"]) / 2 - centre["y"])
    turn = F.when(length < 1e-9, 0.0).when(away >= 0, 1.0).otherwise(-1.0)
    return point(F.coalesce(F.try_divide(-dy * turn, length), F.lit(0.0)), F.coalesce(F.try_divide(dx * turn, length), F.lit(0.0)))


def scaled(points: Column, per_metre: Column) -> Column:
    """The ring in metres; null unless the scale is positive."""
    return F.when(per_metre > 0, F.transform(points, lambda p: point(p["x"] / per_metre, p["y"] / per_metre)))


def vision_box(box: Column, page_width: Column, page_height: Column, dpi: float = 200.0) -> Column:
    """A box [x1, y1, x2, y2] of a vision model in page points (1/72 inch): min_x, min_y, max_x, max_y.

    Coordinates up to 1024 on a page that is rendered larger are read as a grid of
    0 to 1000, others as pixels; so are all where the page's size isn't known. Null
    unless the box has four numbers.
    """
    known = F.coalesce((page_width > 0) & (page_height > 0), F.lit(False))
    larger = F.greatest(page_width, page_height) / 72.0 * dpi > 1024.0
    grid = known & larger & (F.array_max(box) <= 1024.0)
    at = lambda pick, i, size: F.when(grid, pick(box[i], box[i + 2]) / 1000.0 * size).otherwise(pick(box[i], box[i + 2]) * (72.0 / dpi))
    made = F.struct(at(F.least, 0, page_width).alias("min_x"), at(F.least, 1, page_height).alias("min_y"), at(F.greatest, 0, page_width).alias("max_x"), at(F.greatest, 1, page_height).alias("max_y"))
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()), made)


def pixel_to_world(px: Column, py: Column, scale: Column, min_x: Column, min_y: Column, height: Column) -> Column:
    """World point of a pixel of a raster of so many rows, y upwards."""
    return point(px / scale + min_x, (height - py) / scale + min_y)


def world_to_pixel(x: Column, y: Column, scale: Column, min_x: Column, min_y: Column, height: Column) -> Column:
    return point((x - min_x) * scale, height - (y - min_y) * scale)
