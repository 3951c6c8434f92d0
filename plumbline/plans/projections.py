"""Domain tables projected from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of candidates, by number.
CANDIDATE_FIELDS = (
    "plot.width", "plot.depth", "plot.area", "building.width", "building.depth", "building.footprint_area", "building.floor_count", "road.width",
    "setbacks.front", "setbacks.rear", "setbacks.left", "setbacks.right", "coverage",
)
SOURCES = ("CV", "VISION", "DXF")
KINDS = ("NATIVE_TEXT", "OCR", "VECTOR_GEOMETRY", "DERIVED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS INT) + 1]"


def candidates(spark: SparkSession, sf_dir: str, plan: str = "l_orderkey") -> DataFrame:
    """Observations: plan_id (the column plan), field, source, value, confidence, page, pos, kind, unit, grounded, region."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col(plan).alias("plan_id"),
        pick(CANDIDATE_FIELDS, F.col("l_partkey") % 13).alias("field"),
        pick(SOURCES, F.col("l_suppkey") % 3).alias("source"),
        F.col("l_quantity").alias("value"),
        (F.lit(1.0) - F.lit(4.0) * (F.col("l_discount") + F.lit(0.0))).alias("confidence"),
        F.col("l_linenumber").alias("page"),
        ((F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("pos"),
        pick(KINDS, F.col("l_partkey") % 4).alias("kind"),
        (F.col("l_linestatus") == "F").alias("grounded"),
        F.col("l_returnflag").alias("region"),
    )


SQL_CANDIDATES = f"""candidates AS (
    SELECT l_orderkey AS plan_id, {sql_pick(CANDIDATE_FIELDS, "l_partkey % 13")} AS field, {sql_pick(SOURCES, "l_suppkey % 3")} AS source, l_quantity AS value,
        1.0::DOUBLE - 4.0::DOUBLE * (l_discount + 0.0::DOUBLE) AS confidence, l_linenumber AS page,
        (l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey) * 100 + l_quantity::BIGINT AS pos, {sql_pick(KINDS, "l_partkey % 4")} AS kind, l_linestatus = 'F' AS grounded, l_returnflag AS region
    FROM lineitem)"""

#: How the wide plan's numbers follow from orders (k: o_orderkey, c: o_custkey); both engines read the same text.
PLAN_NUMBERS = {
    "plot.width": "6 + (k % 250) / 10.0",
    "plot.depth": "8 + (c % 300) / 10.0",
    "plot.area": "(60 + k % 250) * (80 + c % 300) / 100.0",
    "building.width": "5 + (k % 190) / 10.0",
    "building.depth": "6 + (c % 210) / 10.0",
    "building.footprint_area": "(50 + k % 190) * (60 + c % 210) / 100.0",
    "building.floor_count": "1 + k % 5",
    "road.width": "3 + (c % 150) / 10.0",
    "setbacks.front": "(k % 60 - 3) / 10.0",
    "setbacks.rear": "(c % 60 - 2) / 10.0",
    "setbacks.left": "(k % 40) / 10.0",
    "setbacks.right": "(c % 40) / 10.0",
    "coverage": "(k % 1100) / 10.0",
    "far": "(c % 130) / 10.0",
    "building_height_estimated": "3 + (k % 300) / 10.0",
    "building_height_excluding_stilt": "3 + (c % 300) / 10.0",
}
PLAN_TEXTS = {"development_area": ("A", "B", "C", None), "building_use": ("residential", "commercial", "hospital", None)}
LEVELS = ("HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "CONFLICTING", "MISSING")


def _plan_number(place: int, name: str) -> str:
    """A number is null where its level is MISSING or CONFLICTING, and for every eleventh plan."""
    return f"CASE WHEN (k + {place}) % 11 = 0 OR (k + c + {place}) % 7 >= 5 THEN NULL ELSE CAST({PLAN_NUMBERS[name]} AS DOUBLE) END"


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide plans: plan_id and a struct (num, str, level) for every field of the rule language."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    out = [F.col("k").alias("plan_id")]
    for place, name in enumerate(PLAN_NUMBERS):
        level = pick(LEVELS, (F.col("k") + F.col("c") + place) % 7)
        level = F.when((F.col("k") + place) % 11 == 0, "MISSING").otherwise(level)
        out.append(F.struct(F.expr(_plan_number(place, name)).alias("num"), F.lit(None).cast("string").alias("str"), level.alias("level")).alias(name))
    for place, (name, values) in enumerate(PLAN_TEXTS.items()):
        value = pick(values, (F.col("k") + place) % 4)
        # The lambda keeps this wide projection out of whole-stage code, whose one method would be too large to be compiled to machine code.
        unknown = F.exists(F.array(value), lambda v: v.isNull())
        out.append(F.struct(F.lit(None).cast("double").alias("num"), value.alias("str"), F.when(unknown, "MISSING").otherwise("HIGH").alias("level")).alias(name))
    return o.select(*out)


def _sql_plans() -> str:
    parts = ["k AS plan_id"]
    for place, name in enumerate(PLAN_NUMBERS):
        column = name.replace(".", "_")
        parts.append(f"{_plan_number(place, name)} AS {column}")
        parts.append(f"CASE WHEN (k + {place}) % 11 = 0 THEN 'MISSING' ELSE {sql_pick(LEVELS, f'(k + c + {place}) % 7')} END AS {column}_l")
    for place, (name, values) in enumerate(PLAN_TEXTS.items()):
        cases = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values) if v)
        parts.append(f"CASE (k + {place}) % 4 {cases} END AS {name}")
    return f"plans AS (SELECT {', '.join(parts)} FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))"


SQL_PLANS = _sql_plans()

SCORED = ("plot.width", "plot.depth", "plot.area", "building.width", "building.depth", "coverage")
TIERS = ("printed", "derived", "inspected", "legacy", "must_abstain", "unverified")


def truth_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """truth(plan_id, field, value, tier) and predictions(plan_id, field, value, level, flagged)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    rows = o.select("k", "c", F.posexplode(F.array(*map(F.lit, SCORED))).alias("i", "field"))
    value = (F.col("k") * 7 + F.col("i") * 13) % 400 / 8.0
    tier = pick(TIERS, (F.col("k") + F.col("i")) % 6)
    truth = rows.select(F.col("k").alias("plan_id"), "field", F.when(tier != "must_abstain", value).alias("value"), tier.alias("tier"))
    shown = F.when((F.col("k") + F.col("c") + F.col("i")) % 5 != 0, value + (F.col("c") % 9 - 4) / 8.0)
    level = pick(("HIGH", "MEDIUM", "LOW"), (F.col("c") + F.col("i")) % 3)
    guess = rows.where((F.col("c") + F.col("i")) % 13 != 0).select(F.col("k").alias("plan_id"), "field", shown.alias("value"), level.alias("level"), ((F.col("c") % 10) == 0).alias("flagged"))
    return truth, guess


SQL_SCORES = f"""scored AS (
    SELECT k, c, i, field FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders), (SELECT unnest(range({len(SCORED)})) AS i, unnest({list(SCORED)!r}) AS field)),
truth AS (SELECT k AS plan_id, field, {sql_pick(TIERS, "(k + i) % 6")} AS tier, CASE WHEN (k + i) % 6 <> 4 THEN ((k * 7 + i * 13) % 400) / 8.0::DOUBLE END AS value FROM scored),
predictions AS (
    SELECT k AS plan_id, field, CASE WHEN (k + c + i) % 5 <> 0 THEN ((k * 7 + i * 13) % 400) / 8.0::DOUBLE + (c % 9 - 4) / 8.0::DOUBLE END AS value,
        {sql_pick(("HIGH", "MEDIUM", "LOW"), "(c + i) % 3")} AS level, c % 10 = 0 AS flagged FROM scored WHERE (c + i) % 13 <> 0),
scores AS (
    SELECT t.plan_id, t.field, CASE WHEN tier <> 'must_abstain' THEN t.value END AS truth, p.value AS predicted, level, coalesce(flagged, false) AS flagged,
        CASE WHEN tier = 'must_abstain' THEN CASE WHEN p.value IS NULL THEN 'ABSTAINED_OK' ELSE 'SPURIOUS' END WHEN p.value IS NULL THEN 'MISSING'
             WHEN abs(p.value - t.value) <= greatest(0.15::DOUBLE, abs(t.value) * 0.05::DOUBLE) THEN 'CORRECT' ELSE 'WRONG' END AS status
    FROM truth t LEFT JOIN predictions p USING (plan_id, field) WHERE tier = 'must_abstain' OR (tier <> 'unverified' AND t.value IS NOT NULL))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of sheets: sheet, id, corners, height."""
    p = table(spark, sf_dir, "part")
    x, y, w, h = F.col("p_size"), (F.col("p_partkey") % 40), 1 + F.col("p_partkey") % 17, 1 + F.col("p_partkey") % 13
    cast = lambda c: c.cast("double")
    return p.select(F.concat_ws("/", "p_brand", "p_type").alias("sheet"), F.col("p_partkey").alias("id"), cast(x).alias("min_x"), cast(y).alias("min_y"), cast(x + w).alias("max_x"), cast(y + h).alias("max_y"), cast(h).alias("height"))


SQL_BOXES = """boxes AS (
    SELECT p_brand || '/' || p_type AS sheet, p_partkey AS id, p_size::DOUBLE AS min_x, (p_partkey % 40)::DOUBLE AS min_y, (p_size + 1 + p_partkey % 17)::DOUBLE AS max_x,
        (p_partkey % 40 + 1 + p_partkey % 13)::DOUBLE AS max_y, (1 + p_partkey % 13)::DOUBLE AS height FROM part)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: pos, text, source_file, city, page_num."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), "text", F.col("source").alias("source_file"), F.when(F.col("lang") == "de", "NATIONAL").otherwise(F.upper("lang")).alias("city"), (F.col("doc_id") % 7).alias("page_num"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction events: correction_id, recorded_at, document_id, field, corrected, split, sha256."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("correction_id"), F.col("ts").alias("recorded_at"), F.col("user_id").alias("document_id"), F.col("event_type").alias("field"), F.col("value").alias("corrected"), F.when(F.col("event_id") % 9 == 0, "heldout").otherwise("dev").alias("split"), F.when(F.col("event_id") % 14 != 0, F.sha2(F.col("user_id").cast("string"), 256)).alias("sha256"))
