"""Relations of boxes on a sheet: joins by grid cells, roles, bands and clusters."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.sources.work import kept, spread_join

CORNERS = ("min_x", "min_y", "max_x", "max_y")


def box_pairs(boxes: DataFrame, keys: list[str], reach: float = 0.0, cell: float = 16.0, ordered: bool = False) -> DataFrame:
    """Pairs of boxes of one sheet within reach: keys, a, b, their corners, gap.

    Boxes meet in the grid cells that they touch once grown by reach, so the join
    is on equality of sheet and cell and a large sheet is spread over its cells.
    A pair counts in the first cell that both touch. Unordered pairs have a < b.
    """
    to = lambda c, d: F.floor((F.col(c) + d) / cell).cast("long")
    half = reach / 2
    cells = boxes.withColumns({"x0": to("min_x", -half), "x1": to("max_x", half), "y0": to("min_y", -half), "y1": to("max_y", half)})
    cells = cells.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    side = lambda s: cells.select(*keys, "cx", "cy", F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in (*CORNERS, "x0", "y0")])
    pairs = spread_join(side("a"), side("b"), [*keys, "cx", "cy"]).where(F.col("a") != F.col("b") if ordered else F.col("a") < F.col("b"))
    pairs = pairs.where((F.col("cx") == F.greatest("a_x0", "b_x0")) & (F.col("cy") == F.greatest("a_y0", "b_y0")))
    pairs = pairs.withColumn("gap", g.bbox_gap("a", "b")).where(F.col("gap") <= reach)
    return pairs.drop("cx", "cy", "a_x0", "a_y0", "b_x0", "b_y0")


def containment_edges(boxes: DataFrame, keys: list[str], cell: float = 8.0) -> DataFrame:
    """Ordered pairs (a, b) of a sheet where box a holds box b.

    The first corner of a held box lies in its holder, so a held box stands in the
    grid cell of that corner alone and meets the boxes that touch the cell: a pair once.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    side = lambda s: [*keys, F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in CORNERS]]
    a = boxes.select(*side("a"), F.explode(F.sequence(at("min_x"), at("max_x"))).alias("cx"), at("min_y").alias("y0"), at("max_y").alias("y1"))
    a = a.withColumn("cy", F.explode(F.sequence("y0", "y1"))).drop("y0", "y1")
    pairs = spread_join(a, boxes.select(*side("b"), at("min_x").alias("cx"), at("min_y").alias("cy")), [*keys, "cx", "cy"])
    return pairs.where((F.col("a") != F.col("b")) & g.bbox_contains("a", "b")).select(*keys, "a", "b")


def relations(boxes: DataFrame, keys: list[str], near: float) -> DataFrame:
    """Unordered pairs and their relation: ENCLOSES, INSIDE, ADJACENT (touching) or NEAR."""
    pairs = box_pairs(boxes, keys, near)
    kind = F.when(g.bbox_contains("a", "b"), "ENCLOSES").when(g.bbox_contains("b", "a"), "INSIDE").when(F.col("gap") == 0, "ADJACENT").otherwise("NEAR")
    return pairs.select(*keys, "a", "b", kind.alias("relation"), "gap")


#: Cells of a table of a sheet's distinct corners that are summed up at once, pairs that cost as much as a cell, and pairs of boxes that are looked at together.
TABLE, CELL_COST, AT_ONCE = 1 << 24, 16.0, 1 << 22


def _ranks(corners: np.ndarray) -> list[np.ndarray]:
    """Places of each box's sides among the sheet's, so that a box holds another where none of its places is lower."""
    sides = (-corners[:, 0], -corners[:, 1], corners[:, 2], corners[:, 3])
    return [np.unique(side, return_inverse=True)[1].ravel() for side in sides]


def held_and_holder(corners: np.ndarray, n: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct boxes (corners (k, 4), each n times): how many boxes each holds, itself included, and the largest value of those that hold it.

    Sums and maxima run along the four sides of a table of the distinct corners, so
    no pairs are formed; boxes that are few for their distinct corners, or have too many, meet in blocks.
    """
    ranks = _ranks(corners)
    shape = [int(r.max()) + 1 for r in ranks]
    if np.prod([float(k) for k in shape]) <= min(TABLE, len(n) ** 2 / CELL_COST):
        at = tuple(ranks)
        table = np.zeros(shape, np.int64)
        table[at] = n
        for axis in range(4):
            np.cumsum(table, axis=axis, out=table)
        held = table[at]
        table = np.full(shape, -np.inf)
        table[at] = value
        for axis in range(4):
            table = np.flip(np.maximum.accumulate(np.flip(table, axis), axis=axis), axis)
        return held, table[at]
    order = np.argsort(ranks[0], kind="stable")
    r, n, value = np.stack(ranks)[:, order].astype(np.int32), n[order].astype(float), value[order]
    held, holder = np.zeros(len(n), np.int64), np.full(len(n), -np.inf)
    step = 512
    for low in range(0, len(n), step):
        outer = r[:, low : low + step]
        end = int(np.searchsorted(r[0], outer[0, -1], side="right"))
        for first in range(0, end, AT_ONCE // step):
            inner = slice(first, min(end, first + AT_ONCE // step))
            holds = outer[0][:, None] >= r[0, inner]
            for side in range(1, 4):
                holds &= outer[side][:, None] >= r[side, inner]
            held[low : low + step] += (holds @ n[inner]).astype(np.int64)
            holder[inner] = np.maximum(holder[inner], np.where(holds, value[low : low + step, None], -np.inf).max(axis=0))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return held[back], holder[back]


def nesting(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, corners, first (the smallest id there), held, holder of each distinct box of a sheet.

    held counts the other boxes that it holds, equal ones too; holder is the
    largest area of a box that holds it, its own included. A sheet's distinct boxes
    come to one task. Boxes with a null corner neither hold nor are held.
    """
    places = boxes.dropna(subset=list(CORNERS)).groupBy(*keys, *CORNERS).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))

    def sheet(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows[list(CORNERS)].to_numpy(float)
        held, holder = held_and_holder(c, rows.n.to_numpy(), (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1]))
        return rows.drop(columns="n").assign(held=held - 1, holder=holder)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.drop("n").schema.fields)
    return places.groupBy(*keys).applyInPandas(sheet, f"{types}, held long, holder double")


def nested_groups(corners: np.ndarray) -> np.ndarray:
    """A number for each of distinct boxes (k, 4), the same for those that are joined by boxes that hold one another.

    Boxes found are looked up no more, so a box meets only those that none before it reached.
    """
    v = np.stack(_ranks(corners)).astype(np.int32)
    left = np.argsort(-v.sum(axis=0), kind="stable")
    v, label, group = v[:, left], np.empty(len(left), np.int64), 0
    while len(left):
        queue, label[left[0]] = deque([v[:, 0]]), group
        left, v = left[1:], v[:, 1:]
        while queue and len(left):
            at = queue.popleft()[:, None]
            met = (v <= at).all(axis=0) | (v >= at).all(axis=0)
            if met.any():
                label[left[met]] = group
                queue.extend(v[:, met].T)
                left, v = left[~met], v[:, ~met]
        group += 1
    return label


def nested_components(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, root: the smallest id of the boxes of a sheet that are joined with a box by boxes that hold one another.

    Equal boxes go through a sheet's one task once, and no edges are stored.
    """
    places = boxes.dropna(subset=list(CORNERS)).groupBy(*keys, *CORNERS).agg(F.min("id").alias("root"))

    def sheet(rows: pd.DataFrame) -> pd.DataFrame:
        group = nested_groups(rows[list(CORNERS)].to_numpy(float))
        return rows.assign(root=rows.groupby(group).root.transform("min"))

    roots = places.groupBy(*keys).applyInPandas(sheet, places.schema)
    return boxes.join(roots, [*keys, *CORNERS], "left").select(*keys, "id", F.coalesce("root", "id").alias("root"))


def plot_role(boxes: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """The box of each sheet that holds the largest share of the others, if that is at least `least`."""
    held = nesting(boxes, keys).where("held > 0").select(*keys, F.col("first").alias("a"), "held")
    n = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    share = held.join(n, keys).withColumn("share", F.col("held") / (F.col("n") - 1)).where(F.col("share") >= least)
    best = share.groupBy(*keys).agg(F.max_by(F.struct("a", "held"), F.struct("share", -F.col("a"))).alias("best"))
    return best.select(*keys, F.col("best.a").alias("plot"), F.col("best.held").alias("n_inside"))


def building_role(boxes: DataFrame, plots: DataFrame, keys: list[str], slender: float = 12.0) -> DataFrame:
    """keys, building: the largest box inside the sheet's plot (keys, plot) that is not too slender; no row without one."""
    plot = boxes.join(plots.select(*keys, F.col("plot").alias("id")), [*keys, "id"]).select(*keys, F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in CORNERS])
    w, h = F.col("b_max_x") - F.col("b_min_x"), F.col("b_max_y") - F.col("b_min_y")
    held = boxes.select(*keys, "id", *[F.col(c).alias(f"b_{c}") for c in CORNERS]).join(plot, keys)
    rows = held.where((F.col("a") != F.col("id")) & g.bbox_contains("a", "b") & (g.aspect_ratio(w, h) <= slender))
    return rows.groupBy(*keys).agg(F.max_by("id", F.struct((w * h), -F.col("id"))).alias("building"))


def row_bands(items: DataFrame, keys: list[str], position: str, factor: float = 1.5, height: str = "height") -> DataFrame:
    """Bands of items along an axis: a gap over factor * the median height of the group begins a new one."""
    typical = items.groupBy(*keys).agg(F.percentile(height, F.lit(0.5)).alias("typical"))
    order = Window.partitionBy(*keys).orderBy(position, "id")
    rows = items.join(typical, keys).withColumn("gap", F.col(position) - F.lag(position).over(order))
    new = F.when(F.col("gap") > factor * F.col("typical"), 1).otherwise(0)
    return rows.withColumn("band", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("gap", "typical")


def glyph_swarm(items: DataFrame, keys: list[str], position: str, least: int = 500, bands: int = 4, per_band: float = 20, share: float = 0.7) -> DataFrame:
    """Whether the small polygons of a sheet are glyphs of text: many, in bands, and most bands populated."""
    banded = row_bands(items, keys, position).groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"))
    s = banded.groupBy(*keys).agg(F.sum("n").alias("n_polygons"), F.count(F.lit(1)).alias("n_bands"), F.percentile("n", F.lit(0.5)).alias("median_per_band"), F.avg((F.col("n") >= per_band).cast("double")).alias("populated"))
    swarm = (F.col("n_polygons") >= least) & (F.col("n_bands") >= bands) & (F.col("median_per_band") >= per_band) & (F.col("populated") >= share)
    return s.withColumn("is_swarm", swarm)


def nearest_right(labels: DataFrame, cells: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """For each label the nearest cell to its right in the same row of its page.

    Labels of one place ask once, and of cells at one place only the first can be nearest.
    """
    places = labels.select(*keys, F.col("x").alias("lx"), F.col("y").alias("ly")).distinct().withColumn("row", F.floor(F.col("ly") / tolerance).cast("long"))
    firsts = cells.groupBy(*keys, F.col("x").alias("cx"), F.col("y").alias("cy")).agg(F.min(F.struct(F.col("id").alias("cell"), "value")).alias("first"))
    row = F.floor(F.col("cy") / tolerance).cast("long")
    met = places.join(firsts.withColumn("row", F.explode(F.array(row - 1, row, row + 1))), [*keys, "row"])
    met = met.where((F.abs(F.col("ly") - F.col("cy")) <= tolerance) & (F.col("cx") > F.col("lx")))
    best = met.groupBy(*keys, "lx", "ly").agg(F.min_by("first", F.struct(F.col("cx") - F.col("lx"), F.col("first.cell"))).alias("best"))
    found = labels.select(*keys, F.col("id").alias("label"), F.col("x").alias("lx"), F.col("y").alias("ly")).join(best, [*keys, "lx", "ly"])
    return found.select(*keys, "label", "best.cell", "best.value")


def connected_components(nodes: DataFrame, links: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """The smallest node id of each node's component: ids spread along links, then labels jump to their labels.

    Stops when nothing changes, and raises if that takes more than `rounds` rounds; each round is a stored table.
    """
    both = links.select(*keys, "a", "b").union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select(*keys, "id", F.col("id").alias("root"))
    for _ in range(rounds):
        around = both.join(label.withColumnRenamed("id", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hop = label.join(around, [*keys, "id"], "left").select(*keys, "id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = hop.select(*keys, F.col("id").alias("root"), F.col("root").alias("up"))
        new = hop.join(jump, [*keys, "root"], "left").select(*keys, "id", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        new = kept(new, "labels")
        changed = new.where("root < old").limit(1).count()
        label = new.select(*keys, "id", "root")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Labels of rows in a table of areas, and a number with its unit.
SITE_LABEL = r"(?i)\bsite\s*area\b|\bplot\s*area\b"
FLOOR_LABEL = r"(?i)\b(stilt|ground|first|second|third|fourth|fifth|sixth|terrace|basement)\s*floor\b"
AREA_NUMBER = r"(?i)(?<![\d.])(\d+(?:\.\d+)?)\s*(sq\.?\s?m(?:ts?)?\.?|sqm|sq\.?\s?ft\.?|sqft)\b"
SQUARE_FEET = 10.7639104167
#: Labels of each name that look for a number in the first round.
FIRST_LABELS = 16


def area_statement(texts: DataFrame, keys: list[str]) -> DataFrame:
    """A printed table of areas: keys, label (site_area, <floor>_floor), square_metres, and the printed value and whether it is in feet.

    texts: keys, pos, text, corners. A label takes the leftmost number with an area
    unit in its row, a row and a half high, not left of it; the first label with a number wins. Labels meet
    numbers in bands of the page, the first FIRST_LABELS of each name at first and
    eight times as many in each further round, until every name has a number or no label is left.
    """
    band, middle = 12.0, (F.col("min_y") + F.col("max_y")) / 2
    floor = F.lower(F.regexp_extract("text", FLOOR_LABEL, 1))
    label = F.when(F.col("text").rlike(SITE_LABEL), "site_area").when(floor != "", F.concat(floor, F.lit("_floor")))
    tall = F.greatest(F.col("max_y") - F.col("min_y"), F.lit(8.0)) * 1.5
    at = lambda y: F.floor(y / band).cast("long")
    names = texts.select(*keys, "pos", label.alias("label"), middle.alias("y"), tall.alias("tall"), F.col("min_x").alias("left")).where("label is not null")
    names = names.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "label").orderBy("pos")))
    names = names.withColumn("band", F.explode(F.sequence(at(F.col("y") - F.col("tall")), at(F.col("y") + F.col("tall")))))
    number = F.regexp_extract("text", AREA_NUMBER, 1)
    said = F.struct(number.try_cast("double").alias("value"), F.regexp_extract("text", AREA_NUMBER, 2).rlike("(?i)ft").alias("feet"))
    cells = texts.where(number != "").select(*keys, at(middle).alias("band"), middle.alias("cy"), F.col("min_x").alias("cx"), F.col("pos").alias("cpos"), said.alias("said"))
    names, cells = kept(names, "labels"), kept(cells, "numbers")
    low, high, found, most = 0, FIRST_LABELS, None, names.agg(F.max("nth")).first()[0] or 0
    while True:
        some = names.where((F.col("nth") > low) & (F.col("nth") <= high))
        some = some if found is None else some.join(found.select(*keys, "label"), [*keys, "label"], "left_anti")
        met = some.join(cells, [*keys, "band"]).where((F.abs(F.col("cy") - F.col("y")) <= F.col("tall")) & (F.col("cx") >= F.col("left") - F.col("tall")))
        best = kept(met.groupBy(*keys, "label").agg(F.min_by("said", F.struct("pos", "cx", "cpos")).alias("said")), "areas")
        found = best if found is None else found.union(best)
        if high >= most or names.where(F.col("nth") > high).join(found, [*keys, "label"], "left_anti").isEmpty():
            break
        low, high = high, high * 8
    metres = F.when(F.col("said.feet"), F.round(F.col("said.value") / SQUARE_FEET, 6)).otherwise(F.col("said.value"))
    return found.select(*keys, "label", metres.alias("square_metres"), "said.value", "said.feet")
