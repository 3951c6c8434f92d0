"""Queries on drawings and runs: dimensions, scales, candidates, captions, policies, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry, text
from plumbline.operators import candidates, dimensions, evaluation, plans, sheets
from plumbline.plans import catalogue as c
from plumbline.plans import projections as p
from plumbline.plans.registry import query

_UNITS = ("m", "mm", "cm", "ft", "in", "ft_in", "sq_m", None)
_FACTOR = "CASE u WHEN 'm' THEN 1.0::DOUBLE WHEN 'mm' THEN 0.001::DOUBLE WHEN 'cm' THEN 0.01::DOUBLE WHEN 'ft' THEN 0.3048::DOUBLE WHEN 'in' THEN 0.0254::DOUBLE WHEN 'ft_in' THEN 0.3048::DOUBLE END"
_UNIT_SQL = "([" + ", ".join("NULL" if u is None else repr(u) for u in _UNITS) + "])[CAST(pos % 8 AS INT) + 1]"


def _milli(column, name: str):
    return F.floor(column * 1e6 + 0.5).cast("long").alias(name)


@query(f"""WITH {p.SQL_CANDIDATES}, r AS (SELECT pos, plan_id, (value - 1) / 4.0::DOUBLE AS v, {_UNIT_SQL} AS u0, pos % 3 = 0 AS dot, plan_id % 2 = 0 AS noted FROM candidates), t AS (SELECT *, coalesce(u0, CASE WHEN dot AND v BETWEEN 0.05 AND 60 AND noted THEN 'cm' END) AS u FROM r)
SELECT pos, plan_id, u AS unit, CAST(floor(CASE WHEN v * ({_FACTOR}) > 0 THEN v * ({_FACTOR}) END * 1e6 + 0.5) AS BIGINT) AS micro, CAST((pos % 720) // 90 % 4 * 90 AS INT) AS rotation, CASE WHEN pos % 5 > 0 THEN 72.0::DOUBLE / ((pos % 5) * 50) END AS per_pixel FROM t""")
def dimension_units(spark, sf_dir):
    r = p.candidates(spark, sf_dir).select("pos", "plan_id", ((F.col("value") - 1) / 4).alias("v"), p.pick(_UNITS, F.col("pos") % 8).alias("u0"))
    raw, noted = F.when(F.col("pos") % 3 == 0, "3.5").otherwise("35"), F.when(F.col("plan_id") % 2 == 0, "cm")
    r = r.withColumn("unit", dimensions.with_noted_unit(raw, F.col("v"), F.col("u0"), noted))
    return r.select("pos", "plan_id", "unit", _milli(dimensions.metres(F.col("v"), F.col("unit")), "micro"), candidates.rotation(F.col("pos") % 720).alias("rotation"), candidates.points_per_pixel((F.col("pos") % 5) * 50.0).alias("per_pixel"))


_NOTES = ("ALL DIMENSIONS ARE IN METRE", "all dimension in mm", "scale 1:100", "ALL DIMENSIONS IS IN FEET", "note")


@query(f"WITH {c._SQL_BRANDS}, t AS (SELECT sheet, id, {p.sql_pick(('m', 'mm', '', 'ft', ''), 'id % 5')} AS u FROM brands) SELECT sheet, arg_min(u, id) AS unit FROM t WHERE u <> '' GROUP BY sheet")
def noted_unit(spark, sf_dir):
    texts = c._brands(spark, sf_dir).select("sheet", F.col("id").alias("pos"), p.pick(_NOTES, F.col("id") % 5).alias("text"))
    return dimensions.noted_unit(texts, ["sheet"])


def _items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = c._brands(spark, sf_dir)
    items = b.select("sheet", "id", ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), (F.col("min_y") + 1.5).alias("y"), F.when(F.col("id") % 4 != 0, (F.col("id") % 4) * 45.0).alias("angle"))
    lines = b.where("id % 3 = 0").select("sheet", "id", F.col("min_x").alias("x1"), F.col("min_y").alias("y1"), F.col("max_x").alias("x2"), F.col("min_y").alias("y2"))
    return items, lines


_NEAR_LINES = f"""WITH {c._SQL_BRANDS}, i AS (SELECT sheet, id, (min_x + max_x) / 2 AS x, min_y + 1.5 AS y, CASE WHEN id % 4 <> 0 THEN (id % 4) * 45.0 END AS angle FROM brands), l AS (SELECT sheet, id, min_x AS x1, max_x AS x2, min_y AS y1 FROM brands WHERE id % 3 = 0),
m AS (SELECT i.sheet, i.id AS item, l.id AS line, angle, x2 - x1 AS len, sqrt(power(x - greatest(x1, least(x2, x)), 2) + power(y - y1, 2)) AS distance FROM i JOIN l USING (sheet)),
s AS (SELECT *, 0.6::DOUBLE * greatest(0, 1 - distance / 6.0::DOUBLE) + 0.25::DOUBLE * coalesce(1 - least(angle % 180, 180 - angle % 180) / 90.0::DOUBLE, 0.5) + 0.15::DOUBLE * least(1.0, len / 20.0::DOUBLE) AS score FROM m WHERE distance <= 6)"""


@query(f"{_NEAR_LINES} SELECT sheet, item, line, CAST(floor(distance * 1e6 + 0.5) AS BIGINT) AS distance, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score FROM s")
def near_lines(spark, sf_dir):
    found = dimensions.near_lines(*_items(spark, sf_dir), ["sheet"], reach=6.0, cell=16.0)
    return found.select("sheet", "item", "line", _milli(F.col("distance"), "distance"), _milli(F.col("score"), "score"))


@query(f"{_NEAR_LINES}, b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sheet, item ORDER BY round(score, 9) DESC, line) = 1) SELECT sheet, item, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score FROM b WHERE 1 - distance / 6.0::DOUBLE >= 0.35")
def best_line(spark, sf_dir):
    items, lines = _items(spark, sf_dir)
    return dimensions.best_line(items, lines, ["sheet"], reach=6.0, cell=16.0).select("sheet", "item", _milli(F.col("score"), "score"))


@query(f"WITH {c._SQL_BRANDS} SELECT sheet, id FROM brands QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY max_x - min_x DESC, id) <= 5")
def longest_lines(spark, sf_dir):
    lines = c._brands(spark, sf_dir).select("sheet", "id", F.col("min_x").alias("x1"), F.col("min_y").alias("y1"), F.col("max_x").alias("x2"), F.col("min_y").alias("y2"))
    return dimensions.longest(lines, ["sheet"], 5).select("sheet", "id")


@query(f"WITH {p.SQL_BOXES}, s AS (SELECT sheet, id, (max_x - min_x) AS len, CASE id % 4 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.6096::DOUBLE WHEN 2 THEN 0.002::DOUBLE END AS metres FROM boxes) SELECT sheet, id, CAST(floor(len / metres * 1e3 + 0.5) AS BIGINT) AS milli FROM s WHERE metres IS NOT NULL")
def scale_samples(spark, sf_dir):
    b = p.boxes(spark, sf_dir)
    rows = b.select("sheet", "id", F.lit(2.0).alias("value"), p.pick(("m", "ft", "mm", "sq_m"), F.col("id") % 4).alias("unit"), F.col("min_x").alias("x1"), F.col("min_y").alias("y1"), F.col("max_x").alias("x2"), F.col("min_y").alias("y2"))
    return dimensions.scale_samples(rows, ["sheet"]).select("sheet", "id", F.floor(F.col("value") * 1e3 + 0.5).cast("long").alias("milli"))


_SEEN_TYPES = ("plot_width", "FRONT_SETBACK", "REAR_SETBACK", "ROOM_DIMENSION")
_SEEN = f"""WITH {p.SQL_CANDIDATES}, i AS (SELECT plan_id, pos, {p.sql_pick(_SEEN_TYPES, 'pos % 4')} AS type, value / 100.0::DOUBLE AS value, confidence, CASE WHEN pos % 9 = 0 THEN 'mm' ELSE 'm' END AS unit FROM candidates WHERE source <> 'CV'),
k AS (SELECT plan_id, upper(type) AS type, list([{{'p': pos, 'v': value}}] ORDER BY pos) AS a FROM i WHERE confidence >= 0.75::DOUBLE AND unit <> 'mm' GROUP BY ALL),
f AS (SELECT plan_id, type, list_reduce(a, lambda x, y: CASE WHEN len(list_filter(x, lambda q: abs(y[1].v - q.v) <= greatest(0.02::DOUBLE, y[1].v * 0.01::DOUBLE))) > 0 THEN x ELSE list_concat(x, y) END) AS kept FROM k), vals AS (SELECT plan_id, type, u.p AS pos, u.v AS value FROM (SELECT plan_id, type, unnest(kept) AS u FROM f))"""


def _seen(spark, sf_dir) -> DataFrame:
    return p.candidates(spark, sf_dir).where("source != 'CV'").select("plan_id", "pos", p.pick(_SEEN_TYPES, F.col("pos") % 4).alias("type"), (F.col("value") / 100).alias("value"), "confidence", F.when(F.col("pos") % 9 == 0, "mm").otherwise("m").alias("unit"))


@query(f"{_SEEN} SELECT * FROM vals")
def vision_values(spark, sf_dir):
    return dimensions.vision_values(_seen(spark, sf_dir), ["plan_id"])


@query(f"""{_SEEN}, n AS (SELECT plan_id, value / 100.0::DOUBLE AS m FROM candidates WHERE source = 'CV' AND page <= 2), o AS (SELECT v.*, EXISTS (SELECT 1 FROM n WHERE n.plan_id = v.plan_id AND abs(m - v.value) <= greatest(0.08::DOUBLE, v.value * 0.02::DOUBLE)) AS ok, EXISTS (SELECT 1 FROM n WHERE n.plan_id = v.plan_id) AS any_native FROM vals v)
SELECT plan_id, type, arg_min(value, pos) AS value FROM o WHERE ok OR NOT any_native GROUP BY ALL""")
def preferred_vision(spark, sf_dir):
    native = p.candidates(spark, sf_dir).where("source = 'CV' and page <= 2").select("plan_id", (F.col("value") / 100).alias("metres"))
    return dimensions.preferred_values(_seen(spark, sf_dir), native, ["plan_id"])


@query(f"{_SEEN} SELECT plan_id, lower(split_part(upper(type), '_', 1)) AS side, arg_max(value, pos) AS value FROM i WHERE confidence >= 0.75::DOUBLE AND upper(type) LIKE '%_SETBACK' GROUP BY ALL")
def vision_setbacks(spark, sf_dir):
    return dimensions.vision_setbacks(_seen(spark, sf_dir), ["plan_id"])


@query(f"""WITH {p.SQL_CANDIDATES}, d AS (SELECT plan_id, pos AS id, value, CASE WHEN pos % 3 > 0 THEN page * 10.0::DOUBLE END AS x, 5.0::DOUBLE AS y FROM candidates WHERE source = 'CV'),
i AS (SELECT plan_id, pos, {p.sql_pick(("PLOT_WIDTH", "ROAD_WIDTH", "UNKNOWN"), "pos % 3")} AS type, value + (pos % 3 - 1) / 4.0::DOUBLE AS v, confidence AS cf, CASE WHEN pos % 4 > 0 THEN page * 30.0::DOUBLE END AS cx FROM candidates WHERE source = 'VISION'),
m AS (SELECT d.plan_id, d.id, type, pos, cf * coalesce(greatest(0.25::DOUBLE, 1 - sqrt(power(x - cx, 2) + 0) / 80.0::DOUBLE), 0.35::DOUBLE) AS s FROM d JOIN i ON i.plan_id = d.plan_id AND type <> 'UNKNOWN' AND cf > 0 AND abs(v - value) <= greatest(0.08::DOUBLE, abs(value) * 0.02::DOUBLE))
SELECT plan_id, id, CAST(floor(max(s) * 1e6 + 0.5) AS BIGINT) AS micro FROM m GROUP BY ALL""")
def vision_hints(spark, sf_dir):
    cand = p.candidates(spark, sf_dir)
    d = cand.where("source = 'CV'").select("plan_id", F.col("pos").alias("id"), "value", F.when(F.col("pos") % 3 > 0, F.col("page") * 10.0).alias("x"), F.lit(5.0).alias("y"))
    cx = F.when(F.col("pos") % 4 > 0, F.col("page") * 30.0)
    i = cand.where("source = 'VISION'").select("plan_id", "pos", p.pick(("PLOT_WIDTH", "ROAD_WIDTH", "UNKNOWN"), F.col("pos") % 3).alias("type"), (F.col("value") + (F.col("pos") % 3 - 1) / 4).alias("value"), "confidence", (cx - 2).alias("min_x"), F.lit(4.0).alias("min_y"), (cx + 2).alias("max_x"), F.lit(6.0).alias("max_y"))
    return dimensions.vision_hints(d, i, ["plan_id"]).select("plan_id", "id", _milli(F.col("hint_score"), "micro"))


@query(f"WITH {p.SQL_BOXES} SELECT id, CASE id % 3 WHEN 0 THEN max_x - min_x ELSE max_y - min_y END AS edge_length FROM boxes WHERE id % 3 < 2")
def edge_matches(spark, sf_dir):
    b, k = p.boxes(spark, sf_dir), F.col("id") % 3
    corner = lambda a, d, e: F.when(k == 0, F.col(a)).when(k == 1, F.col(d)).otherwise(F.col(e))
    dims = b.select(F.col("id").alias("sheet"), "id", corner("min_x", "max_x", "min_x").alias("px"), corner("min_y", "max_y", "min_y").alias("py"), corner("max_x", "max_x", "max_x").alias("qx"), corner("min_y", "min_y", "max_y").alias("qy"))
    return dimensions.edge_matches(dims, b.select(F.col("id").alias("sheet"), geometry.box_ring().alias("points")), ["sheet"]).drop("sheet")


_TRIED = " ".join(f"WHEN a * {f}::DOUBLE * {f}::DOUBLE BETWEEN 20 AND 20000 THEN {f}::DOUBLE" for f in dimensions.FACTORS)
_HEADER = "CASE h " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in dimensions.HEADER_UNITS.items()) + " END"


@query(f"""WITH t AS (SELECT p_partkey AS id, p_size % 18 AS h, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 11) * power(10.0::DOUBLE, p_partkey % 9 - 2) END AS a0 FROM part), r AS (SELECT id, {_HEADER} AS own, CASE WHEN a0 > 0 THEN a0 END AS a FROM t),
s AS (SELECT *, CASE {_TRIED} END AS tried, coalesce(a * own * own BETWEEN 20 AND 20000, false) AS fits FROM r)
SELECT id, CASE WHEN a IS NULL THEN coalesce(own, 1.0::DOUBLE) WHEN fits THEN own WHEN tried IS NOT NULL THEN tried ELSE coalesce(own, 1.0::DOUBLE) END AS factor,
    CASE WHEN a IS NULL THEN CASE WHEN own IS NOT NULL THEN 0.90::DOUBLE ELSE 0.20::DOUBLE END WHEN fits THEN 0.98::DOUBLE WHEN tried IS NOT NULL THEN 0.60::DOUBLE WHEN own IS NOT NULL THEN 0.50::DOUBLE ELSE 0.20::DOUBLE END AS trust FROM s""")
def unit_factor(spark, sf_dir):
    k = F.col("p_partkey")
    area = F.when(k % 7 > 0, (k % 11) * F.pow(F.lit(10.0), k % 9 - 2))
    made = dimensions.unit_factor(F.col("p_size") % 18, area)
    return p.table(spark, sf_dir, "part").select(k.alias("id"), made["factor"].alias("factor"), made["trust"].alias("trust"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN 50 * (p_partkey % 4 + 1) END AS n, p_partkey % 4 AS k, 28.0::DOUBLE + (p_partkey % 5) AS a, 28.25::DOUBLE + (p_partkey % 3) AS b FROM part),
r AS (SELECT id, k, a, b, 72000.0::DOUBLE / (25.4::DOUBLE * n) AS pr, CASE k WHEN 1 THEN a WHEN 2 THEN (a + b) / 2 WHEN 3 THEN (a + b + a) / 3 END AS l FROM t)
SELECT id, CAST(floor(coalesce(pr, l) * 1e6 + 0.5) AS BIGINT) AS micro, CASE WHEN pr IS NOT NULL THEN CASE WHEN l IS NULL THEN 0.95::DOUBLE WHEN abs(pr - l) / pr <= 0.05::DOUBLE THEN 0.99::DOUBLE ELSE 0.80::DOUBLE END WHEN l IS NOT NULL THEN CASE WHEN k = 2 AND abs(a - b) / l < 0.02::DOUBLE THEN 0.99::DOUBLE ELSE 0.80::DOUBLE END END AS trust FROM r""")
def resolved_scale(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = F.lit(28.0) + k % 5, F.lit(28.25) + k % 3
    samples = F.slice(F.array(a, b, a), F.lit(1), (k % 4).cast("int"))
    made = dimensions.resolved_scale(samples, F.when(k % 3 > 0, 50 * (k % 4 + 1)))
    return p.table(spark, sf_dir, "part").select(k.alias("id"), _milli(made["points_per_metre"], "micro"), made["trust"].alias("trust"))


_SCALE_NOTES = f"""WITH {c._SQL_BRANDS}, n AS (SELECT sheet, id AS pos, min_x AS x, min_y AS y, id % 2 = 0 AS keyword, [50, 100, 200, 500][CAST(id % 4 AS INT) + 1] AS denominator FROM brands WHERE id % 3 = 0), pl AS (SELECT sheet, id AS place, max_x AS px, max_y AS py FROM brands WHERE id % 5 = 0),
m AS (SELECT sheet, place, denominator, keyword, pos, power(x - px, 2) + power(y - py, 2) AS d FROM pl JOIN n USING (sheet))"""


def _notes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = c._brands(spark, sf_dir)
    notes = b.where("id % 3 = 0").select("sheet", F.col("id").alias("pos"), F.col("min_x").alias("x"), F.col("min_y").alias("y"), (F.col("id") % 2 == 0).alias("keyword"), F.element_at(F.array(*map(F.lit, (50, 100, 200, 500))), (F.col("id") % 4 + 1).cast("int")).alias("denominator"))
    return notes, b.where("id % 5 = 0").select("sheet", "id", F.col("max_x").alias("x"), F.col("max_y").alias("y"))


@query(f"{_SCALE_NOTES} SELECT sheet, place, denominator FROM m QUALIFY row_number() OVER (PARTITION BY sheet, place ORDER BY keyword DESC, d, pos) = 1")
def nearest_scale_note(spark, sf_dir):
    return dimensions.nearest_scale_note(*_notes(spark, sf_dir), ["sheet"])


@query(f"{_SCALE_NOTES}, b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sheet, place, denominator ORDER BY keyword DESC, d, pos) = 1), r AS (SELECT sheet, place, denominator, row_number() OVER (PARTITION BY sheet, place ORDER BY keyword DESC, d, pos) - 1 AS rank FROM b) SELECT * FROM r UNION ALL SELECT sheet, place, NULL, (SELECT count(*) FROM r WHERE r.sheet = pl.sheet AND r.place = pl.place) FROM pl")
def distinct_scales(spark, sf_dir):
    return dimensions.distinct_scales(*_notes(spark, sf_dir), ["sheet"])


# ---------------------------------------------------------------- candidates


@query(f"""WITH {p.SQL_BOXES}, b AS (SELECT *, max_x + (id % 3) AS pw, max_y + 5 * (id % 2) AS ph FROM boxes), e AS (SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE min_x END AS x0, CASE WHEN id % 4 = 0 THEN 0 ELSE min_y END AS y0, max_x, max_y, pw, ph FROM b)
SELECT id, (max_x - x0) * (max_y - y0) / (pw * ph) >= 0.92::DOUBLE AND (x0 <= 4)::INT + (y0 <= 4)::INT + (max_x >= pw - 4)::INT + (max_y >= ph - 4)::INT >= 2 AS frame FROM e""")
def page_frames(spark, sf_dir):
    b, k = p.boxes(spark, sf_dir), F.col("id")
    rows = b.withColumns({"pw": F.col("max_x") + k % 3, "ph": F.col("max_y") + 5 * (k % 2), "min_x": F.when(k % 4 == 0, 0.0).otherwise(F.col("min_x")), "min_y": F.when(k % 4 == 0, 0.0).otherwise(F.col("min_y"))})
    return rows.select("id", candidates.page_frame(F.col("pw"), F.col("ph")).alias("frame"))


_FILTERED = f"""WITH {c._SQL_BRANDS}, pl AS (SELECT sheet, max(max_x) * max(max_y) / 4.0::DOUBLE AS area FROM brands WHERE sheet <> 'Brand#11' GROUP BY sheet), lb AS (SELECT * FROM brands WHERE id % 29 = 0),
r AS (SELECT b.*, area, CASE WHEN greatest(max_x - min_x, max_y - min_y) / least(max_x - min_x, max_y - min_y) > 8 THEN 'SLENDER' WHEN (max_x - min_x) * (max_y - min_y) / area >= 0.92::DOUBLE THEN 'PLOT' WHEN (max_x - min_x) * (max_y - min_y) / area < 0.01::DOUBLE THEN 'SMALL' END AS why FROM brands b LEFT JOIN pl USING (sheet)),
q AS (SELECT a.*, coalesce(why, CASE WHEN EXISTS (SELECT 1 FROM lb b WHERE b.sheet = a.sheet AND {c._GAP} <= 0.15::DOUBLE * greatest(a.max_x - a.min_x, a.max_y - a.min_y)) THEN 'ROOM' END) AS w2 FROM r a),
o AS (SELECT sheet, list([{{'id': id, 'a': min_x, 'b': min_y, 'c': max_x, 'd': max_y}}] ORDER BY id) AS bs FROM q WHERE w2 IS NULL GROUP BY sheet),
k AS (SELECT sheet, list_reduce(bs, lambda x, n: CASE WHEN len(list_filter(x, lambda q: n[1].a >= q.a - 1 AND n[1].b >= q.b - 1 AND n[1].c <= q.c + 1 AND n[1].d <= q.d + 1 AND (n[1].c - n[1].a) * (n[1].d - n[1].b) < (q.c - q.a) * (q.d - q.b) * 0.98::DOUBLE)) > 0 THEN x ELSE list_concat(x, n) END) AS kept FROM o),
s AS (SELECT sheet, u.id AS id FROM (SELECT sheet, unnest(kept) AS u FROM k)), filtered AS (SELECT q.sheet, q.id, q.min_x, q.min_y, q.max_x, q.max_y, coalesce(w2, CASE WHEN s.id IS NULL THEN 'NESTED' END) AS reason FROM q LEFT JOIN s ON s.sheet = q.sheet AND s.id = q.id)"""


def _filtered(spark, sf_dir) -> DataFrame:
    b = c._brands(spark, sf_dir)
    plots = b.where("sheet != 'Brand#11'").groupBy("sheet").agg((F.max("max_x") * F.max("max_y") / 4).alias("area"))
    labels = b.where("id % 29 = 0").withColumn("text", F.when(F.col("id") % 2 == 0, "MASTER BED ROOM").otherwise("Kitchen"))
    return candidates.filter_buildings(b.withColumn("pos", F.col("id")), plots, labels, ["sheet"])


@query(f"{_FILTERED} SELECT sheet, id, reason FROM filtered")
def filter_buildings(spark, sf_dir):
    return _filtered(spark, sf_dir).select("sheet", "id", "reason")


@query(f"{_FILTERED}, f AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area FROM filtered WHERE reason IS NULL) SELECT sheet, count(*) AS blocks, sum(area / 4.0::DOUBLE) AS square_metres, arg_max(id, area * 1e7 - id) AS \"primary\" FROM f GROUP BY sheet")
def building_footprints(spark, sf_dir):
    rows = _filtered(spark, sf_dir).withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))).withColumn("per_metre", F.lit(2.0))
    return candidates.footprint(rows, ["sheet"])


_PLOTS = f"""WITH {c._SQL_BRANDS}, b0 AS (SELECT *, left(sheet, 7) AS doc, (max_x - min_x) * (max_y - min_y) AS area FROM brands), h AS (SELECT a.sheet, a.id, count(*) AS held FROM b0 a JOIN b0 b ON a.sheet = b.sheet AND a.id <> b.id AND {c._HOLDS.format('a', 'b')} GROUP BY ALL), n AS (SELECT sheet, count(*) - 1 AS others FROM b0 GROUP BY sheet),
b1 AS (SELECT b0.* FROM b0 LEFT JOIN h USING (sheet, id) JOIN n USING (sheet) WHERE NOT coalesce(held >= 4 AND held / others >= 0.5, false)), x AS (SELECT DISTINCT b.sheet, b.id FROM b1 a JOIN b1 b ON a.sheet = b.sheet AND a.id <> b.id AND a.area > 1.02::DOUBLE * b.area AND {c._HOLDS.format('a', 'b')}),
m AS (SELECT doc, max(area) AS most FROM b1 GROUP BY doc), s AS (SELECT doc, sheet, id, area / most AS rank, greatest(0.0::DOUBLE, 1 - greatest(0.0::DOUBLE, greatest(max_x - min_x, max_y - min_y) / least(max_x - min_x, max_y - min_y) - 1) / 6.0::DOUBLE) AS slim, CASE WHEN x.id IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS free FROM b1 JOIN m USING (doc) LEFT JOIN x USING (sheet, id)),
scored AS (SELECT doc, sheet, id, 0.20::DOUBLE * rank + 0.15::DOUBLE + 0.10::DOUBLE * slim + 0.20::DOUBLE * (id % 5 / 4.0::DOUBLE) + 0.20::DOUBLE * (id % 3 / 2.0::DOUBLE) + 0.10::DOUBLE * (id % 2) + 0.05::DOUBLE * free + 0.20::DOUBLE * (id % 4 / 3.0::DOUBLE) AS score FROM s)"""


def _plot_scores(spark, sf_dir) -> DataFrame:
    b, k = c._brands(spark, sf_dir), F.col("id")
    rows = b.withColumns({"doc": F.left("sheet", F.lit(7)), "area": (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")), "rectangularity": F.lit(1.0), "boundary_annotation": k % 5 / 4.0, "label_match": k % 3 / 2.0, "road_adjacency": (k % 2).cast("double"), "vision": k % 4 / 3.0})
    return candidates.plot_scores(rows, ["doc", "sheet"])


@query(f"{_PLOTS} SELECT doc, sheet, id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS micro FROM scored")
def plot_scores(spark, sf_dir):
    return _plot_scores(spark, sf_dir).select("doc", "sheet", "id", _milli(F.col("score"), "micro"))


@query(f"{_PLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, id) AS nth, lead(score) OVER (PARTITION BY doc ORDER BY score DESC, id) AS nx FROM scored) SELECT doc, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS micro, CASE WHEN score < 0.65 THEN 'LOW' WHEN nx IS NULL THEN 'MEDIUM' WHEN score - nx >= 0.15 THEN 'HIGH' WHEN score - nx >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r WHERE nth = 1")
def plot_winners(spark, sf_dir):
    best = candidates.ranked(_plot_scores(spark, sf_dir), ["doc"])
    return best.select("doc", _milli(F.col("score"), "micro"), candidates.plot_level(F.col("score"), F.col("runner_up")).alias("level"))


@query(f"WITH {c._SQL_BRANDS} SELECT sheet, median(greatest(max_x - min_x, max_y - min_y)) AS basis FROM brands GROUP BY sheet")
def page_basis(spark, sf_dir):
    return candidates.page_basis(c._brands(spark, sf_dir), ["sheet"])


@query(f"""WITH {p.SQL_CANDIDATES}, h AS (SELECT plan_id, pos, value / 4.0::DOUBLE AS score, grounded AS cap, region = 'N' AS bad FROM candidates), r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS ns, lead(cap) OVER w AS nc FROM h WINDOW w AS (PARTITION BY plan_id ORDER BY score DESC, pos)),
d AS (SELECT *, CASE WHEN score < 3 THEN 'ABSTAIN' WHEN coalesce(ns >= 3 AND score - ns < 2 AND NOT (cap AND NOT nc), false) THEN 'CONFLICT' ELSE 'ACCEPT' END AS decision FROM r WHERE nth = 1)
SELECT plan_id, decision, CASE WHEN decision = 'ACCEPT' THEN pos END AS accepted, CASE decision WHEN 'ABSTAIN' THEN 'MISSING' WHEN 'CONFLICT' THEN 'CONFLICTING' ELSE CASE WHEN bad THEN 'LOW' WHEN cap THEN 'HIGH' WHEN ns IS NULL THEN 'MEDIUM' WHEN score - ns >= 8 THEN 'HIGH' WHEN score - ns >= 2 THEN 'MEDIUM' ELSE 'LOW' END END AS level FROM d""")
def decide_structure(spark, sf_dir):
    rows = p.candidates(spark, sf_dir).select("plan_id", F.col("pos").alias("id"), (F.col("value") / 4).alias("score"), F.col("grounded").alias("captioned"), (F.col("region") == "N").alias("identity_failed"))
    return candidates.decide_structure(rows, ["plan_id"], 3.0)


@query(f"""WITH {p.SQL_PLANS}, t AS (SELECT plan_id, plot_area AS pa, plan_id % 3 = 0 AS env, plot_width / plot_depth AS asp, building_footprint_area IS NOT NULL AS b, building_footprint_area / plot_area AS ra, plan_id % 2 = 0 AS re FROM plans)
SELECT plan_id, CAST(floor(CASE WHEN pa IS NULL THEN -1.0::DOUBLE ELSE 1.0::DOUBLE + CASE WHEN pa BETWEEN 60 AND 400 THEN 0 ELSE -10 END + CASE WHEN env THEN -0.5::DOUBLE ELSE 0 END + CASE WHEN b THEN 2 + CASE WHEN ra BETWEEN 0.03 AND 0.92 THEN 1 ELSE 0 END + CASE WHEN NOT re THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN asp <= 6 THEN 0.5::DOUBLE ELSE 0 END + least(1.0::DOUBLE, pa / 500.0::DOUBLE) END * 1e6 + 0.5) AS BIGINT) AS micro,
    NOT coalesce(pa > 0 AND ra < 0.3::DOUBLE, false) AS plausible FROM t""")
def plot_building_score(spark, sf_dir):
    num = lambda n: F.col(f"`{n}`.num")
    ratio = num("building.footprint_area") / num("plot.area")
    score = candidates.plot_building_score(num("plot.area"), (60.0, 400.0), F.col("plan_id") % 3 == 0, num("plot.width") / num("plot.depth"), num("building.footprint_area").isNotNull(), ratio, 0.03, F.col("plan_id") % 2 == 0)
    return p.plans(spark, sf_dir).select("plan_id", _milli(score, "micro"), candidates.plausible_building(num("building.footprint_area"), num("plot.area"), 0.3).alias("plausible"))


@query(f"""WITH {c._SQL_BRANDS}, m AS (SELECT a.sheet, a.id AS plot, b.id AS road, sqrt(power((a.min_x + a.max_x - b.min_x - b.max_x) / 2, 2) + power((a.min_y + a.max_y - b.min_y - b.max_y) / 2, 2)) AS d, sqrt(power(a.max_x - a.min_x, 2) + power(a.max_y - a.min_y, 2)) AS g FROM brands a JOIN brands b ON a.sheet = b.sheet AND a.id % 3 = 0 AND b.id % 4 = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER w AS nth, lead(d) OVER w AS nx FROM m WINDOW w AS (PARTITION BY sheet, plot ORDER BY round(d, 9), road)) SELECT sheet, plot, road, CAST(floor(d * 1e6 + 0.5) AS BIGINT) AS micro FROM r WHERE nth = 1 AND d <= 3 * g AND (nx IS NULL OR nx > d * 1.25::DOUBLE)""")
def borrowed_roads(spark, sf_dir):
    b = c._brands(spark, sf_dir)
    found = candidates.borrowed_road(b.where("id % 3 = 0"), b.where("id % 4 = 0"), ["sheet"])
    return found.select("sheet", "plot", "road", _milli(F.col("distance"), "micro"))


_SHEET_TEXTS = ("SITE PLAN", "site plan scale 1:200", "GROUND FLOOR PLAN", "Typical Floor Plan", "SECTION A-A", "as per section 5 of the act, which is a long sentence", "ELEVATION", "note")
_SHEET_TYPES = ("SITE_PLAN", "SITE_PLAN", "GROUND_FLOOR_PLAN", "OTHER_FLOOR_PLAN", "SECTION", "", "ELEVATION", "")


@query(f"WITH {c._SQL_BRANDS}, t AS (SELECT sheet, id, min_y, {p.sql_pick(_SHEET_TEXTS, 'id % 8')} AS text, {p.sql_pick(_SHEET_TYPES, 'id % 8')} AS type FROM brands) SELECT sheet, type, id AS anchor FROM t WHERE type <> '' QUALIFY row_number() OVER (PARTITION BY sheet, type ORDER BY length(text) DESC, min_y, id) = 1")
def captions(spark, sf_dir):
    texts = c._brands(spark, sf_dir).withColumn("text", p.pick(_SHEET_TEXTS, F.col("id") % 8))
    return candidates.captions(texts, ["sheet"])


@query("SELECT source, sum(CASE WHEN doc_id % 5 <> 0 THEN length(trim(coalesce(text, ''), ' ')) * (doc_id % 4 / 4.0::DOUBLE) END) AS mass, sum((length(coalesce(text, '')) < 3 OR doc_id % 50 = 0)::INT)::BIGINT AS n_ocr FROM documents GROUP BY source")
def ocr_pages(spark, sf_dir):
    docs = p.table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 4 / 4.0).alias("confidence"), (F.col("doc_id") % 5 == 0).alias("is_group"))
    asked = docs.groupBy("source").agg(F.sum(candidates.needs_ocr(F.length("text"), F.col("doc_id") % 50 == 0).cast("int")).alias("n_ocr"))
    mass = candidates.confidence_mass(docs, ["source"]).withColumnRenamed("source", "m_source")
    return asked.join(mass, F.col("source").eqNullSafe(F.col("m_source")), "left").select("source", "mass", "n_ocr")


@query(f"""WITH {c._SQL_BRANDS}, t AS (SELECT sheet, id AS pos, {p.sql_pick(('a', 'B ', 'b'), 'id % 3')} AS text, id % 2 = 0 AS g, min_x AS x, min_y AS y FROM brands), k AS (SELECT *, lower(trim(text)) AS kt, round_even(x / 6.0::DOUBLE, 0) AS kx, round_even(y / 6.0::DOUBLE, 0) AS ky FROM t), f AS (SELECT * FROM k WHERE pos % 4 = 0)
SELECT sheet, pos FROM f UNION ALL SELECT sheet, pos FROM (SELECT * FROM k WHERE pos % 4 > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.sheet = k.sheet AND f.kt = k.kt AND f.g = k.g AND f.kx = k.kx AND f.ky = k.ky) QUALIFY row_number() OVER (PARTITION BY sheet, kt, g, kx, ky ORDER BY pos) = 1)""")
def merged_readings(spark, sf_dir):
    t = c._brands(spark, sf_dir).select("sheet", F.col("id").alias("pos"), p.pick(("a", "B ", "b"), F.col("id") % 3).alias("text"), (F.col("id") % 2 == 0).alias("is_group"), F.col("min_x").alias("x"), F.col("min_y").alias("y"))
    return candidates.merged_readings(t.where("pos % 4 = 0"), t.where("pos % 4 > 0"), ["sheet"]).select("sheet", "pos")


# ---------------------------------------------------------------- runs

_BAD = "(SELECT DISTINCT plan_id FROM scores WHERE field IN ('plot.width', 'plot.depth', 'building.footprint_area') AND truth IS NOT NULL AND status <> 'CORRECT')"


@query(f"WITH {p.SQL_SCORES}, v AS (SELECT 'all_plans' AS view, * FROM scores UNION ALL SELECT 'boundary_resolved_only', * FROM scores WHERE plan_id NOT IN {_BAD}) SELECT view, {c._AGGREGATE} FROM v GROUP BY view")
def gated_aggregates(spark, sf_dir):
    return evaluation.gated_aggregates(c._scores(spark, sf_dir))


@query(f"WITH {p.SQL_SCORES}, r AS (SELECT plan_id, predicted / nullif(truth, 0) AS q FROM scores), g AS (SELECT plan_id, count(q) AS n, median(q) AS md, max(q) AS hi, min(q) AS lo FROM r WHERE q IS NOT NULL GROUP BY plan_id) SELECT plan_id, n, CAST(floor(md * 1e6 + 0.5) AS BIGINT) AS median, CAST(floor(CASE WHEN n > 1 AND lo > 0 THEN hi / lo END * 1e6 + 0.5) AS BIGINT) AS spread, coalesce(n > 1 AND lo > 0 AND hi / nullif(lo, 0) < 1.15::DOUBLE, false) AS one_scale FROM g".replace("AS median", 'AS "median"'))
def scale_consistency(spark, sf_dir):
    g = evaluation.scale_consistency(c._scores(spark, sf_dir), "plan_id")
    return g.select("plan_id", "n", _milli(F.col("median"), "median"), _milli(F.col("spread"), "spread"), "one_scale")


@query("SELECT event_type AS status, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median_seconds, max(value) AS most_seconds FROM events WHERE value IS NOT NULL GROUP BY event_type")
def run_summary(spark, sf_dir):
    return evaluation.run_summary(p.table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("status"), F.col("value").alias("seconds")))


@query(f"""{c._RESULTS_SQL}, q AS (SELECT plan_id, rule_id, required, regexp_extract(required, '^([\\w.]+)\\s*(>=|<=|>|<|==)\\s*([0-9.]+)', 3) AS th, plan_id % 40 / 4.0::DOUBLE AS v FROM results WHERE required IS NOT NULL)
SELECT plan_id, rule_id, CASE WHEN th <> '' THEN th::DOUBLE END AS threshold, CASE WHEN th <> '' THEN abs(v - th::DOUBLE) < greatest(0.15::DOUBLE, abs(v) * 0.05::DOUBLE) END AS fragile FROM q""")
def threshold_margins(spark, sf_dir):
    r = c._results(spark, sf_dir).where("required is not null")
    said = evaluation.requirement(F.col("required"))
    v = F.col("plan_id") % 40 / 4.0
    return r.select("plan_id", "rule_id", said["threshold"].alias("threshold"), evaluation.fragility(v, said["threshold"])["fragile"].alias("fragile"))


#: A provenance text and how it came about.
SOURCES = [("plot.width: agreed across 2", "LEGACY_AGREED"), ("FINAL:CV_ONLY", "FINAL:CV_ONLY"), ("evidence_decision:AGREED_DOCUMENT_VERIFIED", "EVDEC_AGREED"), ("evidence_decision:CV_ONLY_UNVERIFIED", "EVDEC_CV_ONLY_UNVERIFIED"), ("legacy_fallback:x", "EVDEC_LEGACY_FALLBACK"), ("area = width x depth", "OTHER(area)"), ("", "NO_VALUE"), (None, "NO_VALUE")]


@query(f"SELECT o_orderkey AS id, {p.sql_pick(tuple(s[1] for s in SOURCES), 'o_orderkey % 8')} AS status FROM orders")
def status_from_source(spark, sf_dir):
    return p.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), evaluation.status_from_source(p.pick(tuple(s[0] for s in SOURCES), F.col("o_orderkey") % 8)).alias("status"))


def _policy_sql(name: str) -> str:
    tol = "greatest(0.15::DOUBLE, 0.05::DOUBLE * greatest(abs(a), abs(b)))" if name == "tol5" else "greatest(0.05::DOUBLE, 0.01::DOUBLE * greatest(abs(a), abs(b)))"
    prefer = {"cv_priority": "TRUE", "vlm_only_low": "TRUE", "grounded_only": "coalesce(NOT g, FALSE)"}.get(name, "FALSE")
    seen = lambda x: f"CASE WHEN {x} >= 0.85::DOUBLE THEN 'HIGH' WHEN {x} > 0.75::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END"
    status = f"CASE WHEN a IS NULL AND b IS NULL THEN 'MISSING' WHEN a IS NULL THEN 'VISION_ONLY' WHEN b IS NULL OR (abs(a - b) > {tol} AND {prefer}) THEN 'CV_ONLY' WHEN abs(a - b) <= {tol} THEN 'AGREED' ELSE 'CONFLICT' END"
    return f"SELECT '{name}' AS policy, plan_id, field, s AS status, CASE s WHEN 'AGREED' THEN (a + b) / 2 WHEN 'CV_ONLY' THEN a WHEN 'VISION_ONLY' THEN b END AS value, CASE s WHEN 'AGREED' THEN 'HIGH' WHEN 'CONFLICT' THEN 'CONFLICTING' WHEN 'CV_ONLY' THEN {seen('ca')} WHEN 'VISION_ONLY' THEN {chr(39) + 'LOW' + chr(39) if name == 'vlm_only_low' else seen('cb')} ELSE 'MISSING' END AS level FROM (SELECT *, {status} AS s FROM b)"


@query(f"WITH {p.SQL_CANDIDATES}, cv AS ({c._CV}), vi AS ({c._VISION}), b AS (SELECT coalesce(cv.plan_id, vi.plan_id) AS plan_id, coalesce(cv.field, vi.field) AS field, cv.value AS a, cv.confidence AS ca, vi.value AS b, vi.confidence AS cb, vi.grounded AS g FROM cv FULL JOIN vi ON cv.plan_id = vi.plan_id AND cv.field = vi.field) " + " UNION ALL ".join(_policy_sql(n) for n in evaluation.POLICIES))
def replay_policies(spark, sf_dir):
    from plumbline.operators import reconcile

    keys = ["plan_id", "field"]
    pairs = reconcile.best_measurement(c._sides(spark, sf_dir, "CV"), keys).join(reconcile.best_vision(c._sides(spark, sf_dir, "VISION"), keys), keys, "full_outer")
    parts = [evaluation.replayed(pairs, n).select(F.lit(n).alias("policy"), *keys, "status", "value", "level") for n in evaluation.POLICIES]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


@query(f"{c._RESULTS_SQL} SELECT plan_id, rule_id, CASE WHEN plan_id % 3 = 0 AND rule_id = 'R01-front' AND plan_id % 2 = 0 THEN 'said' ELSE status END AS plain FROM results")
def explained_results(spark, sf_dir):
    r = c._results(spark, sf_dir).select("plan_id", "rule_id", F.col("status").alias("explanation"))
    texts = r.where("plan_id % 3 = 0 and rule_id = 'R01-front'").select("plan_id", "rule_id", F.when(F.col("plan_id") % 2 == 0, "said").otherwise("").alias("plain"), F.lit(None).cast("string").alias("suggestion"))
    return evaluation.explained(r, texts).select("plan_id", "rule_id", "plain")


@query("""WITH e AS (SELECT page_id AS plan_id, page_id % 2 = 0 AS tagged, sha256(url) AS h, url FROM pages), v AS (SELECT page_id + 100000 AS correction_id, sha256(url) AS h FROM pages WHERE page_id % 3 = 0)
SELECT correction_id, min(plan_id) AS plan_id FROM v JOIN e USING (h) WHERE tagged GROUP BY correction_id""")
def same_source(spark, sf_dir):
    pages = p.table(spark, sf_dir, "pages").withColumn("sha", F.create_map(F.lit("pdf"), F.sha2("url", 256)))
    entries = pages.select(F.col("page_id").alias("plan_id"), F.col("page_id").alias("pos"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("user_correction"))).otherwise(F.array(F.lit("x"))).alias("tags"), F.col("sha").alias("sha256"))
    return evaluation.same_source(entries, pages.where("page_id % 3 = 0").select((F.col("page_id") + 100000).alias("correction_id"), F.col("sha").alias("sha256")))


@query(f"WITH {p.SQL_CANDIDATES} SELECT plan_id, field, value, min(pos) AS pos FROM candidates GROUP BY ALL")
def distinct_measurements(spark, sf_dir):
    return evaluation.distinct_measurements(p.candidates(spark, sf_dir).select("plan_id", "field", "value", "pos"), ["plan_id"])


@query(f"WITH {p.SQL_CANDIDATES}, t AS (SELECT plan_id, pos, unnest(['use', 'area']) AS name, unnest([region, CASE WHEN grounded THEN '' ELSE kind END]) AS value FROM candidates) SELECT plan_id, name, arg_min(value, pos) AS value FROM t WHERE value <> '' GROUP BY ALL")
def merged_metadata(spark, sf_dir):
    said = F.create_map(F.lit("use"), F.col("region"), F.lit("area"), F.when(F.col("grounded"), "").otherwise(F.col("kind")))
    return evaluation.merged_metadata(p.candidates(spark, sf_dir).select("plan_id", F.col("pos").alias("page"), said.alias("metadata")), "plan_id")


@query(f"""WITH {p.SQL_CANDIDATES}, t AS (SELECT plan_id, pos, page, value, plan_id % 3 = 0 AS bare FROM candidates) SELECT plan_id, count(*) FILTER (bare OR value < 26) AS n_kept, count(*) FILTER (NOT (bare OR value < 26)) AS n_dropped FROM t GROUP BY plan_id""")
def grounded_items(spark, sf_dir):
    items = p.candidates(spark, sf_dir).select("plan_id", "pos", "value", F.lit("").alias("evidence"))
    printed = F.array(*[F.lit(str(n)) for n in range(1, 26)])
    tokens = items.select("plan_id").distinct().where("plan_id % 3 != 0").withColumn("tokens", printed)
    found = evaluation.grounded_items(items, tokens, ["plan_id"])
    both = found["kept"].select("plan_id", F.lit(1).alias("k"), F.lit(0).alias("d")).union(found["dropped"].select("plan_id", F.lit(0), F.lit(1)))
    return both.groupBy("plan_id").agg(F.sum("k").alias("n_kept"), F.sum("d").alias("n_dropped"))


@query(f"WITH {p.SQL_CANDIDATES} SELECT plan_id, pos, page % 2 = 0 OR value = 7 AS found FROM candidates")
def token_in_text(spark, sf_dir):
    cand = p.candidates(spark, sf_dir)
    shown = F.when(F.col("page") % 2 == 0, F.concat(F.lit("w="), F.format_string("%.1f", F.col("value")), F.lit("m"))).otherwise("only 7")
    return cand.select("plan_id", "pos", text.token_in_text(F.col("value"), shown).alias("found"))


@query("SELECT DISTINCT municipality FROM (SELECT lang AS municipality FROM documents UNION SELECT source FROM documents UNION SELECT event_type FROM events)")
def municipalities(spark, sf_dir):
    docs = p.table(spark, sf_dir, "documents")
    return evaluation.municipalities(docs.select(F.col("lang").alias("municipality")), docs.select(F.col("source").alias("municipality")), p.table(spark, sf_dir, "events").select(F.col("event_type").alias("municipality")))


# ---------------------------------------------------------------- sheets

#: A text of an area table, its labels with precedence and value in the text, its number or percentage as a cell.
_AREA_TEXTS = ["SITE AREA : 160.77 Sq.m", "SITE AREA", "NET AREA OF PLOT 5", "Proposed Coverage Area (79.15 %)", "303.79", "45 %", "2.5", "FAR achieved", "note", "120"]
_AREA_ROWS = "(VALUES (0, 1, 'plot.area', 160.77), (1, 1, 'plot.area', NULL), (2, 2, 'plot.net_area', NULL), (3, 3, 'building.footprint_area', NULL), (3, 7, 'coverage', 79.15), (7, 12, 'far', NULL)) v(k, rank, field, said)"
_AREAS = f"""WITH {c._SQL_BRANDS}, t AS (SELECT sheet, id AS pos, id % 10 AS k, max_x AS r, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM brands), l AS (SELECT t.*, rank, field, said::DOUBLE AS said FROM t JOIN {_AREA_ROWS} ON v.k = t.k),
n AS (SELECT sheet, pos AS cell, x, y, CASE k WHEN 4 THEN 303.79::DOUBLE WHEN 6 THEN 2.5::DOUBLE WHEN 9 THEN 120.0::DOUBLE END AS v FROM t WHERE k IN (4, 6, 9)), b AS (SELECT l.sheet, l.pos, arg_min(n.v, round((abs(n.y - l.y) * 20 + (n.x - l.r) * 0.01) * 1e9) * 1e6 + cell) AS v FROM (SELECT DISTINCT sheet, pos, r, y FROM l) l JOIN n ON n.sheet = l.sheet AND n.x >= l.r AND abs(n.y - l.y) <= 18 GROUP BY ALL),
m AS (SELECT l.sheet, l.field, l.rank, l.pos, CASE WHEN field IN ('coverage') THEN said WHEN field = 'far' THEN CASE WHEN b.v > 0 AND b.v <= 10 THEN b.v END ELSE coalesce(said, CASE WHEN b.v >= 10 THEN b.v END) END AS value FROM l LEFT JOIN b ON b.sheet = l.sheet AND b.pos = l.pos),
areas AS (SELECT * FROM m WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sheet, field, value ORDER BY rank, pos) = 1)"""


def _area_texts(spark, sf_dir) -> DataFrame:
    return c._brands(spark, sf_dir).withColumn("pos", F.col("id")).withColumn("text", p.pick(tuple(_AREA_TEXTS), F.col("id") % 10))


@query(f"{_AREAS} SELECT sheet, field, value, pos FROM areas")
def area_measurements(spark, sf_dir):
    return sheets.area_measurements(_area_texts(spark, sf_dir), ["sheet"]).select("sheet", "field", "value", "pos")


@query(f"{_AREAS} SELECT sheet, CASE field WHEN 'plot.area' THEN 'plot_area_gross' WHEN 'plot.net_area' THEN 'plot_area_net' ELSE 'building_footprint_area' END AS target, value FROM areas WHERE field IN ('plot.area', 'plot.net_area', 'building.footprint_area') QUALIFY row_number() OVER (PARTITION BY sheet, field ORDER BY rank, pos) = 1")
def area_targets(spark, sf_dir):
    return sheets.area_targets(sheets.area_measurements(_area_texts(spark, sf_dir), ["sheet"]), ["sheet"])


@query(f"""WITH {c._SQL_BRANDS}, t AS (SELECT sheet, 60.0::DOUBLE AS v FROM brands GROUP BY sheet), m AS (SELECT b.sheet, id, abs((max_x - min_x) * (max_y - min_y) / 1.0 - v) / v AS e, id % 4 = 0 AS flush FROM brands b JOIN t USING (sheet))
SELECT sheet, id AS rect, CAST(floor(e * 1e6 + 0.5) AS BIGINT) AS micro FROM m WHERE e <= 0.2::DOUBLE QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY flush, e, id) = 1""")
def best_rectangle(spark, sf_dir):
    b = c._brands(spark, sf_dir)
    rects = b.withColumns({"per_metre": F.lit(1.0), "flush": F.col("id") % 4 == 0})
    found = sheets.best_rectangle(rects, b.select("sheet").distinct().withColumn("value", F.lit(60.0)), ["sheet"], 0.2)
    return found.select("sheet", "rect", _milli(F.col("error"), "micro"))


#: A text and the lengths in it, in tenths of a millimetre.
LENGTHS = [("8'-9\"", "[26670]"), ("12' 6", "[38100]"), ("2.00X1.35", "[]"), ("9.14 m, 450 mm", "[91400,4500]"), ("SITE 160 sq.m", "[]"), (".47", "[4700]"), ("D2 75", "[]"), ("5 ft 3 in", "[15240,762]"), ("1:100 scale", "[]"), ("10 cm", "[1000]")]


@query(f"SELECT p_partkey AS pos, {p.sql_pick(tuple(x[1] for x in LENGTHS), 'p_partkey % 10')} AS lengths FROM part")
def lengths_in_texts(spark, sf_dir):
    k = F.col("p_partkey")
    rows = p.table(spark, sf_dir, "part").select(k.alias("pos"), p.pick(tuple(x[0] for x in LENGTHS), k % 10).alias("text"))
    return rows.select("pos", F.to_json(F.transform(sheets.lengths_in(F.col("text")), lambda m: F.floor(m * 1e4 + 0.5).cast("long"))).alias("lengths"))


@query(f"""WITH {c._SQL_BRANDS}, t AS (SELECT sheet, id, min_x, min_y, max_x, max_y, {p.sql_pick(_SHEET_TEXTS, 'id % 8')} AS text, {p.sql_pick(_SHEET_TYPES, 'id % 8')} AS type FROM brands), a AS (SELECT * FROM t WHERE type <> '' QUALIFY row_number() OVER (PARTITION BY sheet, type ORDER BY length(text) DESC, min_y, id) = 1),
m AS (SELECT *, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, max_y - min_y > max_x - min_x AS turned FROM a) SELECT sheet, type, round_even(greatest(0.0::DOUBLE, cx - CASE WHEN turned THEN 30.0::DOUBLE ELSE 18.0::DOUBLE END), 9) AS x0, round_even(greatest(0.0::DOUBLE, cy - CASE WHEN turned THEN 14.4::DOUBLE ELSE 24.0::DOUBLE END), 9) AS y0, round_even(least(100.0::DOUBLE, cx + CASE WHEN turned THEN 30.0::DOUBLE ELSE 18.0::DOUBLE END), 9) AS x1 FROM m""")
def region_windows(spark, sf_dir):
    texts = c._brands(spark, sf_dir).withColumn("text", p.pick(_SHEET_TEXTS, F.col("id") % 8))
    pages = texts.select("sheet").distinct().withColumns({"width": F.lit(100.0), "height": F.lit(80.0)})
    found = sheets.region_windows(texts, pages, ["sheet"])
    return found.select("sheet", "type", F.bround("min_x", 9).alias("x0"), F.bround("min_y", 9).alias("y0"), F.bround("max_x", 9).alias("x1"))


@query(f"""WITH {p.SQL_BOXES}, w AS (SELECT id, id % 6 AS k, max_x - min_x AS w FROM boxes) SELECT id, CASE k WHEN 0 THEN 'INTERSECTS' WHEN 1 THEN 'PARALLEL' WHEN 2 THEN 'PERPENDICULAR' WHEN 3 THEN 'COLLINEAR' WHEN 4 THEN 'CONTINUES' END AS relation FROM w""")
def line_relations(spark, sf_dir):
    # The bottom of each box against: a line across it, one above it, one upright beside it, one far along, one just behind its end, an oblique one.
    b, k, w = p.boxes(spark, sf_dir), F.col("id") % 6, F.col("max_x") - F.col("min_x")
    line = lambda a, d, e, f: F.struct(a.alias("x1"), d.alias("y1"), e.alias("x2"), f.alias("y2"))
    x0, x1, y = F.col("min_x"), F.col("max_x"), F.col("min_y")
    other = (
        F.when(k == 0, line(x0, y - w, x1, y + w)).when(k == 1, line(x0, y + w, x1, y + w)).when(k == 2, line(x1 + w, y, x1 + w, y + w)).when(k == 3, line(x1 + w, y, x1 + 2 * w, y)).when(k == 4, line(x1 + 0.01 * w, y, x1 + w, y))
        .otherwise(line(x1 + w, y, x1 + 2 * w, y + w))
    )
    return b.select("id", sheets.line_relation(line(x0, y, x1, y), other).alias("relation"))


_KIND_TEXTS = ("SITE PLAN, setback", "BEDROOM and kitchen", "note", "ROAD WIDTH", "TOILET")
_KIND_LAYERS = ("0", "A-ROAD", "PLOT", "WALL-EXT", "TEXT", "0", "0")


@query(f"""WITH {c._SQL_BRANDS}, w AS (SELECT sheet, sum(CASE id % 5 WHEN 0 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS site, sum(CASE id % 5 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END) AS floor FROM brands GROUP BY sheet), q AS (SELECT *, (max_x - min_x) * (max_y - min_y) * CASE WHEN id % 9 = 0 THEN 9 ELSE 1 END AS area, row_number() OVER (PARTITION BY sheet ORDER BY (max_x - min_x) * (max_y - min_y) * CASE WHEN id % 9 = 0 THEN 9 ELSE 1 END DESC) AS nth FROM brands),
s AS (SELECT sheet, count(*) AS n, max(area) FILTER (nth = 1) AS a1, max(area) FILTER (nth = 2) AS a2, bool_or(id % 7 = 1) AS road, bool_or(id % 7 = 2) AS plot, max(area) FILTER (id % 7 = 3) AS b FROM q GROUP BY sheet)
SELECT sheet, CAST(floor((1.5::DOUBLE * least(site, 3) - 0.4::DOUBLE * least(floor, 3) + CASE WHEN road THEN 2.5 ELSE 0 END + CASE WHEN plot THEN 3.5 ELSE 0 END + CASE WHEN a1 / a2 >= 8 THEN 4.5 WHEN a1 / a2 >= 3 THEN 3 WHEN a1 / a2 <= 1.5 THEN -0.75 ELSE 0 END + CASE WHEN n >= 15 THEN -0.4 WHEN n BETWEEN 1 AND 4 THEN 0.5 ELSE 0 END + CASE WHEN b / a1 < 0.6 THEN 1 ELSE 0 END) * 1e3 + 0.5) AS BIGINT) AS milli FROM w JOIN s USING (sheet)""")
def sheet_kinds(spark, sf_dir):
    b = c._brands(spark, sf_dir)
    polygons = b.select("sheet", p.pick(_KIND_LAYERS, F.col("id") % 7).alias("layer"), ((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * F.when(F.col("id") % 9 == 0, 9).otherwise(1)).alias("area"))
    found = sheets.sheet_kinds(polygons, b.select("sheet", p.pick(_KIND_TEXTS, F.col("id") % 5).alias("text")), ["sheet"])
    return found.select("sheet", F.floor(F.col("score") * 1e3 + 0.5).cast("long").alias("milli"))


@query(f"WITH {c._SQL_BRANDS}, e AS (SELECT sheet, min_y AS position, sum(max_x - min_x) AS extent FROM brands GROUP BY ALL HAVING sum(max_x - min_x) >= 8) SELECT sheet, position, extent FROM e QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY extent DESC, position) <= 3")
def dominant_positions(spark, sf_dir):
    lines = c._brands(spark, sf_dir).select("sheet", (F.col("min_y") + 0.04).alias("position"), F.col("min_x").alias("start"), F.col("max_x").alias("end"))
    return sheets.dominant_positions(lines, ["sheet"], 3, 8.0)


@query("""WITH t AS (SELECT p_partkey AS id, [0.98::DOUBLE, 0.9::DOUBLE, 0.6::DOUBLE, 0.2::DOUBLE][CAST(p_partkey % 4 AS INT) + 1] AS u, p_partkey % 3 = 0 AS cu, p_partkey % 2 = 0 AS en, p_partkey % 4 = 0 AS fi, (p_partkey % 11) / 10.0::DOUBLE AS re, p_partkey % 13 = 0 AS d, p_partkey % 7 = 0 AS ok FROM part),
f AS (SELECT *, CASE WHEN cu THEN 0.9::DOUBLE ELSE 1 END AS c, CASE WHEN NOT en THEN 1 WHEN fi THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS o, CASE WHEN re >= 0.85 THEN 1 ELSE greatest(0.5::DOUBLE, re) END AS s, CASE WHEN d THEN 0.4::DOUBLE ELSE 1 END AS i FROM t)
SELECT id, least(0.98::DOUBLE, u, c, o, i) AS area, CASE WHEN ok THEN least(0.98::DOUBLE, u, c, i) ELSE least(0.95::DOUBLE, u, c, o, s, i) END AS length FROM f""")
def confidence_caps(spark, sf_dir):
    k = F.col("p_partkey")
    trust = F.element_at(F.array(*map(F.lit, (0.98, 0.9, 0.6, 0.2))), (k % 4 + 1).cast("int"))
    made = sheets.confidence_caps(trust, k % 3 == 0, k % 2 == 0, k % 4 == 0, k % 11 / 10.0, k % 13 == 0, k % 7 == 0)
    return p.table(spark, sf_dir, "part").select(k.alias("id"), made["area"].alias("area"), made["length"].alias("length"))


@query(f"""WITH {p.SQL_PLANS} SELECT plan_id, plot_width AS value, plot_width_l AS confidence, CASE WHEN plan_id % 3 = 0 THEN 'USER_EDIT' ELSE 'FINAL:CV_ONLY' END AS source, plan_id % 3 = 0 AS edited, plot_width_l = 'CONFLICTING' AS conflict FROM plans""")
def plan_summaries(spark, sf_dir):
    rows = p.plans(spark, sf_dir).withColumn("sources", F.create_map(F.lit("plot.width"), F.when(F.col("plan_id") % 3 == 0, "USER_EDIT").otherwise("FINAL:CV_ONLY")))
    made = sheets.formatted(rows, {n: "m" for n in plans.SHIPPABLE})
    kind = "struct<`plot.width`: struct<value: double, confidence: string, source: string, edited: boolean, conflict: boolean>>"
    return made.select("plan_id", F.from_json("summary", kind)["plot.width"].alias("s")).select("plan_id", "s.*")


@query(f"SELECT p_partkey AS pos, v AS value, u AS unit FROM (SELECT p_partkey, {p.sql_pick(('m', '', 'mm', 'ft'), 'p_partkey % 4')} AS u, [3.5::DOUBLE, NULL, 450.0::DOUBLE, 12.0::DOUBLE][CAST(p_partkey % 4 AS INT) + 1] AS v FROM part) WHERE v IS NOT NULL")
def dimension_texts(spark, sf_dir):
    k = F.col("p_partkey")
    texts = p.table(spark, sf_dir, "part").select((k % 3).alias("sheet"), k.alias("pos"), p.pick(("3.5 m", "a sentence without any", "450 mm", "12 ft"), k % 4).alias("text"))
    return sheets.dimension_texts(texts, ["sheet"]).select("pos", "value", "unit")


@query(f"""WITH {p.SQL_BOXES} SELECT id, CASE id % 5 WHEN 0 THEN 'PLOT_WIDTH' WHEN 1 THEN 'LEFT_SETBACK' WHEN 2 THEN 'ROAD_WIDTH' WHEN 3 THEN 'OTHER' ELSE 'PLOT_DEPTH' END AS kind, CASE id % 5 WHEN 0 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 4 THEN 'HIGH' ELSE 'LOW' END AS level FROM boxes""")
def dimension_kinds(spark, sf_dir):
    # The bottom of the plot, a label alone, a model's reading alone, a line far away, and the plot's left side with its label.
    b, k = p.boxes(spark, sf_dir), F.col("id") % 5
    ring = geometry.box_ring()
    part = lambda i: F.slice(geometry.edges(ring), i, 1)
    none = F.slice(F.array(ring), 1, 0)
    plots = b.select(F.col("id").alias("sheet"), ring.alias("plot"), none.alias("buildings"), part(1).alias("front"), part(3).alias("rear"), part(4).alias("left"), part(2).alias("right"), none.alias("roads"))
    at = lambda bottom, far, side: F.when(k == 0, F.col(bottom)).when(k == 3, F.col(far) + 1000).when(k == 4, F.col(side))
    dims = b.select(
        F.col("id").alias("sheet"), "id", F.when(k == 1, "left setback").when(k == 4, "plot depth").alias("label"), at("min_x", "min_x", "min_x").alias("x1"), at("min_y", "min_y", "min_y").alias("y1"), at("max_x", "max_x", "min_x").alias("x2"), at("min_y", "min_y", "max_y").alias("y2"),
        F.when(k == 2, "ROAD_WIDTH").alias("hint"), F.when(k == 2, 0.9).alias("hint_score"),
    )
    return dimensions.classify(dims, plots, ["sheet"]).select("id", "kind", "level")
