from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry, levels, measures, text
from plumbline.operators import corpus, gates, reconcile, retrieval, scoring, spatial
from plumbline.operators.rules import FIELDS
from plumbline.sources import records
from plumbline.streaming import logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("values", "status", "value"),
    [
        ([5.0], "UNCORROBORATED", 5.0),
        ([5.0, 5.2], "AGREED", 5.1),
        ([5.0, 5.6], "MINOR_VARIANCE", 5.3),
        ([5.0, 9.0], "CONFLICTING_EVIDENCE", None),
        ([5.0, 5.0, 9.0], "MINOR_VARIANCE", 19 / 3),  # a deviation of 0 makes no outliers
        ([5.0, 5.1, 5.2, 50.0], "OUTLIER_DETECTED", 5.1),
    ],
)
def test_reconcile(spark, values, status, value):
    rows = spark.createDataFrame([(1, v) for v in values], "k int, value double")
    r = reconcile.reconcile(rows, ["k"]).first()
    assert r.status == status and (r.value is None if value is None else r.value == pytest.approx(value))


def test_levels(spark):
    got = [one(spark, levels.level_from_score(F.lit(s).cast("double"))) for s in (0.85, 0.8, 0.75, None)]
    assert got == ["HIGH", "MEDIUM", "LOW", "LOW"]
    assert one(spark, levels.cap_level(F.lit("HIGH"), F.lit("LOW"))) == "LOW"
    assert one(spark, levels.cap_level(F.lit("CONFLICTING"), F.lit("LOW"))) == "CONFLICTING"
    assert one(spark, levels.cap_level(F.lit("HIGH"), F.lit("MISSING"))) == "HIGH"


def test_units(spark):
    assert one(spark, measures.to_metres(F.lit(10.0), F.lit("ft"))) == 3.048
    assert one(spark, measures.to_metres(F.lit(10.0), F.lit("ell"))) is None
    assert one(spark, measures.feet_inches_to_metres(F.lit(5.0), F.lit(6.0))) == pytest.approx(1.6764)
    assert one(spark, measures.feet_inches_to_metres(F.lit(5.0), F.lit(12.0))) is None
    assert one(spark, measures.to_square_metres(F.lit(10.7639104167))) == 1.0


def _plan(spark, **values):
    row = [F.lit(1).alias("plan_id")]
    for n in FIELDS:
        v = values.get(n.replace(".", "_"))
        row.append(F.struct(F.lit(v).cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit("HIGH" if v is not None else "MISSING").alias("level")).alias(n))
    return spark.range(1).select(*row)


def test_bounds_see_earlier_withdrawals(spark):
    out = gates.physical_bounds(_plan(spark, plot_area=5.0, building_width=5000.0, far=3.0, road_width=9.0)).first()
    assert list(out.withdrawn) == ["plot.area", "building.width", "far"]
    assert out["road.width"].num == 9.0 and out["far"].level == "MISSING"
    out = gates.physical_bounds(_plan(spark, setbacks_front=0.1, setbacks_rear=0.1, setbacks_left=0.2, setbacks_right=2.0, coverage=50.0)).first()
    assert "coverage" in out.withdrawn


def test_coverage_and_far(spark):
    r = gates.coverage_and_far(_plan(spark, plot_area=200.0, building_footprint_area=100.0)).first()
    assert (r.coverage, r.coverage_level, r.far, r.far_level) == (50.0, "HIGH", 0.5, "LOW")
    r = gates.coverage_and_far(_plan(spark, plot_area=100.0, building_footprint_area=110.0, building_floor_count=2)).first()
    assert (r.coverage, r.coverage_level, r.far_level) == (None, "CONFLICTING", "CONFLICTING")


def test_setback_flags(spark):
    r = gates.setback_flags(_plan(spark, plot_width=10.0, plot_depth=20.0, building_width=8.0, building_depth=17.0, setbacks_front=3.0, setbacks_rear=3.5)).collect()
    assert [(x.field, x.value) for x in r] == [("setbacks.rear", 3.5)]


def test_mcnemar_and_wilson(spark):
    rows = spark.createDataFrame([(True, False)] * 6 + [(True, True)] * 4, "a boolean, b boolean")
    r = scoring.mcnemar(rows, "a", "b").first()
    assert (r.only_a, r.only_b) == (6, 0) and r.p_value == pytest.approx(0.03125)
    low, high = measures.wilson(F.lit(5), F.lit(10))
    assert one(spark, low) == pytest.approx(0.2366, abs=1e-4) and one(spark, high) == pytest.approx(0.7634, abs=1e-4)


def test_auroc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1.0, True), (1.0, False), (0.0, False), (2.0, True)], "s double, p boolean")
    assert scoring.auroc(rows, "s", "p").first().auroc == pytest.approx(0.875)
    assert scoring.auroc(rows.where("p"), "s", "p").first().auroc is None


def test_upper_median_of_errors(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "truth double, predicted double")
    assert scoring.error_metrics(rows).first().median_ape == 2.0


def test_text(spark):
    assert one(spark, text.tokens(F.lit("Élan vital-e 3.5, x"))) == ["lan", "vital-e", "3.5", "x"]
    assert one(spark, text.json_answer(F.lit('<think>{"a"}</think>```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert [tuple(n) for n in one(spark, text.scale_notes(F.lit("Scale 1:100, 1:2:4, 1 : 7, 1=50")))] == [(100, True), (50, False)]
    assert one(spark, text.scale_notes(F.lit("brick work in 1:60"))) == []
    assert one(spark, text.grounded(F.lit(3.5), F.lit("is 3.50 m"))) and not one(spark, text.grounded(F.lit(3.5), F.lit("13.5")))
    assert one(spark, text.looks_like_dimension(F.lit("12.50 M WIDE ROAD"))) and not one(spark, text.looks_like_dimension(F.lit("46.Due to")))


def test_geometry(spark):
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    assert one(spark, geometry.shoelace_area(points)) == 12 and one(spark, geometry.perimeter(points)) == 14
    assert one(spark, geometry.point_in_polygon(F.lit(1.0), F.lit(1.0), points)) and not one(spark, geometry.point_in_polygon(F.lit(5.0), F.lit(1.0), points))
    assert one(spark, geometry.boundary_distance(F.lit(6.0), F.lit(1.0), points)) == 2
    assert one(spark, geometry.aspect_ratio(F.lit(0.0), F.lit(2.0))) == math.inf


def test_box_pairs_against_all_pairs(spark):
    rows = [(1, i, float(i * 7 % 50), float(i * 13 % 40), float(i * 7 % 50 + i % 9 + 1), float(i * 13 % 40 + i % 30 + 1)) for i in range(60)]
    boxes = spark.createDataFrame(rows, "sheet int, id int, min_x double, min_y double, max_x double, max_y double")
    gap = lambda a, b: math.hypot(max(0, b[2] - a[4], a[2] - b[4]), max(0, b[3] - a[5], a[3] - b[5]))
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and gap(a, b) <= 5}
    got = [(r.a, r.b) for r in spatial.box_pairs(boxes, ["sheet"], 5.0, cell=8.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sub_split_keeps_long_paragraphs_whole_and_overlaps(spark):
    body = "\n\n".join(["a" * 40, "b" * 40, "c" * 400, "d" * 8])
    rows = retrieval.sub_split(spark.createDataFrame([(1, body)], "id int, text string"), 25, 12).orderBy("part").collect()
    assert [r.part_text[0] + str(len(r.part_text)) for r in rows] == ["a82", "b442", "d8"]


def _plain_chunks(text, most=512, overlap=50):
    """The chunker once more, line by line and with offsets."""
    import re

    forms = [(r"^(\d{1,2}(?:\.\d{1,3}){1,4})\s{1,4}([A-Z][^\n]{3,})", re.M), (r"^((?:Section|Regulation|Clause|Rule|Chapter|Article|Part)\s+[\dIVXivx]+[A-Za-z]?\.?)\s*([^\n]*)", re.M | re.I), (r"^(\d{1,3}\.)\s+([A-Z][^\n]{5,})", re.M)]
    marks = {}
    for pattern, flags in forms:
        for m in re.finditer(pattern, text, flags):
            marks.setdefault(m.start(), f"{m[1].strip()} {m[2].strip()}".strip())

    def pack(body):
        ps = [p.strip() for p in re.split(r"\n{2,}", body) if p.strip()]
        out, now = [], []
        for p in ps:
            if now and sum(len(x) // 4 for x in now) + len(p) // 4 > most:
                out.append(now)
                tail, used = [], 0
                for x in reversed(now):
                    if used + len(x) // 4 > overlap:
                        break
                    tail, used = [x, *tail], used + len(x) // 4
                now = [*tail, p]
            else:
                now = [*now, p]
        return ["\n\n".join(x) for x in [*out, now] if x] or [body.strip()]

    if not marks:
        return [("UNCATEGORISED", i, p) for i, p in enumerate(pack(text)) if p]
    at, rows = sorted(marks), []
    for a, b in zip(at, [*at[1:], len(text)], strict=True):
        body = text[a:b].strip()
        rows += [(marks[a], i, p) for i, p in enumerate([body] if len(body) // 4 <= most else pack(body)) if p]
    return rows


def test_chunks_against_a_plain_chunker(spark):
    rng = random.Random(5)
    parts = ["7.3.1 Minimum plot\n", "7.3.1\n  Split Heading\n", "Section 23 Height\n", "chapter IV Use\n", "Regulation 12.  Setbacks\n\n", "12. Parking spaces\n", "1. Small\n", " 4.2 Indented Line\n", "Part\nXII second\n", "2.1 lower case\n", "word " * 30 + "\n", "\n\n", "Rule 5A", "a.b 3.1 Not A Start\n", "para " * 200 + "\n\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(150)] + ["", "  \n ", "no clause"]
    pages = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in retrieval.chunk_clauses(pages, ["id"], 100, 20).orderBy("id", "clause", "idx").collect():
        got.setdefault(r.id, []).append((r.clause_ref, r.idx, r.text))
    for i, t in enumerate(texts):
        assert got.get(i, []) == _plain_chunks(t, 100, 20), repr(t)


def test_dimension_candidates(spark):
    want = {"12'-6\"": (12.5, "ft_in", 0.85), "8' 9": (8.75, "ft_in", 0.85), "12.5' 6\"": (13.0, "ft_in", 0.85), "5'14\"": (5.0, "ft", 0.75), ".47": (0.47, None, 0.55), "3 inches": None, "3 inch": (3.0, "in", 0.75), "40 sq.ft": (40.0, "sq_ft", 0.75), "12 Sq Mt": (12.0, "sq_m", 0.75), "7\"": (7.0, "in", 0.75), "12345": None, "46.Due to": None, "prose that is long": None, "9.14 M WIDE ROAD": (9.14, "m", 0.75)}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", text.dimension_candidate(F.col("t")).alias("c")).collect()
    assert {r.t: r.c and (pytest.approx(r.c.value), r.c.unit, r.c.confidence) for r in rows} == want
    assert one(spark, text.dimension_candidate(F.lit("3 m"), F.lit(0.5))).confidence == 0.625


def test_floor_counts(spark):
    want = {"Ground + 3": 4, "Gf+3": 4, "GF+2UF": 3, "no. of floors: 4, G+9": 4, "2 FLOOR PLAN": None, "5 story house": 5, "3 storeys": None, "7 floors": 7, "big 3 plans": None}
    assert {t: one(spark, text.floor_count(F.lit(t))) for t in want} == want


def test_grounding(spark):
    forms = one(spark, text.value_forms(F.lit(0.47)))
    assert set(forms) == {"0.47", "0.5", ".47", ".5"}
    assert one(spark, text.grounded(F.lit(3.125), F.lit("is 3.125 m"))) and one(spark, text.grounded(F.lit(12.0), F.lit("at 12 m")))
    tokens = F.array(F.lit("9.14"), F.lit("3"))
    got = [one(spark, text.grounding(F.lit(v).cast("double"), F.lit(e), t)) for v, e, t in ((0.0, "reads 9.14", tokens), (None, "none", tokens), (5.0, "", F.array().cast("array<string>")), (5.0, "", tokens))]
    assert [(g.value, g.grounded, g.keep) for g in got] == [(9.14, True, True), (None, None, True), (5.0, False, True), (5.0, False, False)]


def test_json_answers(spark):
    ask = lambda t: one(spark, text.json_answer(F.lit(t)))
    assert ask('<THINK>{"a"}</think> ```JSON\n{"a": 1}\n```') == '{"a": 1}'
    assert ask('Sure: {"a": "```"} done') == '{"a": "```"}' and ask("no json") is None and ask("{broken") is None


def test_freeze_and_replace(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "file string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "file string, sha256 string")
    assert {r.file: r.change for r in corpus.freeze_diff(a, b).collect()} == {"y": "CHANGED", "z": "REMOVED", "w": "ADDED"}
    assert {tuple(r) for r in corpus.replace_by_key(a, b, "file").collect()} == {("x", "1"), ("y", "2"), ("w", "1"), ("z", "1")}


def test_rule_files(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    assert records.read_rules(spark, path).count() == 0
    rows = spark.createDataFrame([("a", "xy", '{"field": "far", "op": "<", "value": 2}', "ACTIVE", 5)], "rule_id string, municipality string, threshold string, status string, priority int")
    records.write_rules(rows, path)
    (rule,) = records.load_rules(records.read_rules(spark, path, "Xy"))
    assert rule.municipality == "XY" and rule.threshold["field"] == "far" and rule.priority == 5
    assert records.read_rules(spark, path, "other").count() == 0


def test_page_texts(spark, tmp_path):
    (tmp_path / "a_ocr.txt").write_text("===== PAGE 1 =====\nhello\n===== PAGE 2 =====\n\n===== PAGE 3 =====\nbye\n")
    assert [(r.page_num, r.text.strip()) for r in records.read_page_texts(spark, str(tmp_path)).orderBy("page_num").collect() if r.text.strip()] == [(1, "hello"), (3, "bye")]


def test_correction_stream(spark, tmp_path):
    when = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("c1", when, "far"), ("c1", when, "far"), ("c2", when, "far"), ("c3", when, "far")], "correction_id string, recorded_at timestamp, field string")
    records.append_lines(events, str(tmp_path / "log"))
    promoted = spark.createDataFrame([("c2",)], "correction_id string")
    job = logs.pending_sink(logs.correction_stream(spark, str(tmp_path / "log")), promoted, str(tmp_path / "out"), str(tmp_path / "check"))
    job.awaitTermination()
    assert sorted(r.correction_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c1", "c3"]


def test_components_that_do_not_settle_raise(spark):
    from plumbline.operators import spatial

    nodes = spark.createDataFrame([("s", i) for i in range(12)], "sheet string, id long")
    links = spark.createDataFrame([("s", i, i + 1) for i in range(11)], "sheet string, a long, b long")
    with pytest.raises(RuntimeError):
        spatial.connected_components(nodes, links, ["sheet"], rounds=1)
    assert {r.root for r in spatial.connected_components(nodes, links, ["sheet"]).collect()} == {0}


def test_kinds_of_dimensions(spark):
    """One dimension for each way to be classified, on a plot of 20 by 30 with a building of 10 by 14 in it."""
    from plumbline.operators import dimensions

    ring = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    line = lambda a, b, c, d: (float(a), float(b), float(c), float(d))
    sheet = ("s", [(float(x), float(y)) for x, y in ring(0, 0, 20, 30)], [[(float(x), float(y)) for x, y in ring(5, 6, 15, 20)]], [line(0, 0, 20, 0)], [line(20, 30, 0, 30)], [line(0, 30, 0, 0)], [line(20, 0, 20, 30)], [[(float(x), float(y)) for x, y in ring(-10, -9, 30, -3)]])
    points, edges = "array<struct<x: double, y: double>>", "array<struct<x1: double, y1: double, x2: double, y2: double>>"
    sheets = spark.createDataFrame([sheet], f"sheet string, plot {points}, buildings array<{points}>, front {edges}, rear {edges}, left {edges}, right {edges}, roads array<{points}>")
    none = (None, None, None, None)
    cases = [
        (1, None, line(0, 0, 20, 0), None, None, ("PLOT_WIDTH", "MEDIUM")),
        (2, "PLOT DEPTH", line(0, 0, 0, 30), None, None, ("PLOT_DEPTH", "HIGH")),
        (3, None, line(5, 6, 15, 6), None, None, ("BUILDING_WIDTH", "MEDIUM")),
        (4, None, line(10, 0.5, 10, 5.5), None, None, ("FRONT_SETBACK", "MEDIUM")),
        (5, "bed room", line(8, 12, 12, 12), None, None, ("ROOM_DIMENSION", "HIGH")),
        (6, None, line(10, -9, 10, -3), None, None, ("ROAD_WIDTH", "MEDIUM")),
        (7, "left setback", none, None, None, ("LEFT_SETBACK", "LOW")),
        (8, None, none, "ROAD_WIDTH", 0.8, ("ROAD_WIDTH", "HIGH")),
        (9, None, none, None, None, ("OTHER", "LOW")),
        (10, None, line(60, 60, 61, 60), None, None, ("OTHER", "LOW")),
        (11, None, line(60, 60, 61, 60), "PLOT_WIDTH", 0.5, ("PLOT_WIDTH", "MEDIUM")),
        (12, "road", line(60, 60, 61, 60), None, None, ("ROAD_WIDTH", "LOW")),
    ]
    rows = [("s", i, label, *at, hint, score) for i, label, at, hint, score, _ in cases]
    table = spark.createDataFrame(rows, "sheet string, id int, label string, x1 double, y1 double, x2 double, y2 double, hint string, hint_score double")
    got = {r.id: (r.kind, r.level) for r in dimensions.classify(table, sheets, ["sheet"]).collect()}
    assert got == {c[0]: c[-1] for c in cases}


def test_sign_flip_of_many_differences(spark):
    """More differences than can be enumerated: against the binomial distribution, and decimals against all sign choices."""
    rows = spark.createDataFrame([("a", 1.0)] * 60 + [("a", -1.0)] * 40 + [("b", v) for v in (0.5, 0.25, -0.75, 1.5, 0.1)], "k string, d double")
    got = {r.k: r for r in scoring.sign_flip(rows, "d", "k").collect()}
    want = sum(math.comb(100, i) for i in range(101) if abs(2 * i - 100) >= 20) / 2**100
    assert got["a"].n == 100 and got["a"].p_value == pytest.approx(want)
    d = (0.5, 0.25, -0.75, 1.5, 0.1)
    sums = [sum(x if m >> i & 1 else -x for i, x in enumerate(d)) for m in range(32)]
    assert got["b"].p_value == sum(abs(s) >= abs(sum(d)) - 1e-9 for s in sums) / 32


def test_outliers_of_suppliers_over_ten_thousand_stay_apart(spark, tmp_path):
    from plumbline.plans.catalogue import QUERIES

    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_linestatus string, l_returnflag string"
    rows = [(1, 13, s, 1, q, 0.0, "F", "N") for s, q in ((5, 1.0), (5, 2.0), (10005, 40.0), (10005, 41.0))]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r.plan_id, r.kept) for r in QUERIES["mad_outliers"](spark, str(tmp_path)).collect()} == {(5, True), (10005, True)}
    assert {(r.plan_id, r.scale) for r in QUERIES["scale_estimate"](spark, str(tmp_path)).collect()} == {(5, 1.5), (10005, 40.5)}


def test_dimension_words_end_at_letters_of_any_script_or_of_ascii(spark):
    assert not one(spark, text.looks_like_dimension(F.lit("Leèm 3.5 m")))
    assert one(spark, text.looks_like_dimension(F.lit("Leèm 3.5 m"), ascii_words=True))


def test_area_statement_keeps_the_printed_value_and_asks_later_labels(spark):
    # Forty labels without a number in their row, then one with a number that lies on the edge of a thousandth.
    labels = [("s", i, "Site Area", 0.0, 100.0 * i, 10.0, 100.0 * i + 8) for i in range(41)]
    cells = [("s", 100, "1450.44 sq.ft", 20.0, 4000.0, 30.0, 4008.0), ("s", 101, "7 sqm", 40.0, 4000.0, 50.0, 4008.0)]
    texts = spark.createDataFrame(labels + cells, "sheet string, pos long, text string, min_x double, min_y double, max_x double, max_y double")
    got = spatial.area_statement(texts, ["sheet"]).collect()
    assert [(r.label, r.square_metres, r.value, r.feet) for r in got] == [("site_area", round(1450.44 / spatial.SQUARE_FEET, 6), 1450.44, True)]
    assert spatial.area_statement(texts.limit(0), ["sheet"]).count() == 0


def test_page_of_a_text_without_letters_keeps_its_space_in_the_digest(spark, tmp_path):
    import hashlib

    from plumbline.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "12 !"), (2, None), (3, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.page_num): r.digest for r in QUERIES["page_texts"](spark, str(tmp_path)).collect()}
    assert got == {(d, n): hashlib.md5(f"{t} {n}".encode()).hexdigest() for d, t in ((1, ""), (2, ""), (3, "a b")) for n in (1, 3)}


def test_evaluation_lines_need_no_join_of_the_aggregates(spark):
    from plumbline import engine

    truth = spark.createDataFrame([(1, "plot.width", 5.0, "printed")], "plan_id long, field string, value double, tier string")
    guess = spark.createDataFrame([("pdf", 1, "plot.width", 5.0, "HIGH", False)], "modality string, plan_id long, field string, value double, level string, flagged boolean")
    found = engine.evaluate(truth, guess)
    assert sorted(r.line.split(":")[0] for r in found.collect()) == ["pdf 1", "pdf overall", "pdf plot.width"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # truth with plans, and with predictions


def test_nearest_cell_against_all_cells(spark, monkeypatch):
    from plumbline.operators import sheets

    rng = random.Random(5)
    cells = [(s, i, rng.randrange(60) / 2, rng.choice([rng.randrange(80) / 2, rng.random() * 400]), float(i)) for s in range(2) for i in range(300)]
    labels = [(s, i, rng.randrange(60) / 2, rng.choice([rng.randrange(80) / 2, rng.random() * 400])) for s in range(2) for i in range(200, 500)]
    want = {}
    for s, i, right, y in labels:
        met = [(round(abs(cy - y) * 20 + (x - right) * 0.01, 9), c, v) for t, c, x, cy, v in cells if t == s and c != i and x >= right and abs(cy - y) <= 18]
        if met:
            want[s, i] = min(met)[2]
    rows = spark.createDataFrame(labels, "sheet int, pos long, right double, y double"), spark.createDataFrame(cells, "sheet int, pos long, x double, y double, value double")
    made = []
    plain = sheets.kept
    monkeypatch.setattr(sheets, "kept", lambda df, name: made.append((name, plain(df, name))) or made[-1][1])
    assert {(r.sheet, r.label): r.value for r in sheets.nearest_cell(*rows, ["sheet"]).collect()} == want
    assert [n for n, _ in made].count("nearest") == 3 and made[-1][1].count() < len(want) / 2  # most are settled near by


def test_scale_notes_against_all_pairs(spark):
    from plumbline.operators import dimensions

    rng = random.Random(8)
    at = lambda: float(rng.randrange(12))
    notes = [(s, i, at(), at(), s == 1 and rng.random() < 0.3, rng.choice((50, 100, 200))) for s in range(2) for i in range(60)] + [(3, 1, 0.0, 0.0, True, 50)]
    places = [(s, i, at(), at()) for s in range(3) for i in range(80)]
    one_each = {}
    for s, i, x, y in places:
        ways = sorted((not k, (x - a) ** 2 + (y - b) ** 2, p, d) for t, p, a, b, k, d in notes if t == s)
        one_each[s, i] = list(dict.fromkeys(w[3] for w in ways))
    n = spark.createDataFrame(notes, "sheet int, pos long, x double, y double, keyword boolean, denominator int")
    p = spark.createDataFrame(places, "sheet int, id long, x double, y double")
    assert {(r.sheet, r.place): r.denominator for r in dimensions.nearest_scale_note(n, p, ["sheet"]).collect()} == {k: v[0] for k, v in one_each.items() if v}
    found = dimensions.distinct_scales(n, p, ["sheet"])
    assert {(r.sheet, r.place, r["rank"], r.denominator) for r in found.collect()} == {(*k, j, d) for k, v in one_each.items() for j, d in enumerate([*v, None])}
    pairs = [j for j in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in j and "px" not in j and "LeftOuter" not in j]
    assert not pairs  # places meet no notes in a join


def test_borrowed_roads_against_all_pairs(spark, monkeypatch):
    from plumbline.operators import candidates

    monkeypatch.setattr(candidates, "AT_ONCE", 50)
    rng = random.Random(4)
    box = lambda s, i: (s, i, *(lambda x, y, w: (x, y, x + w, y + w))(*(float(rng.randrange(n)) for n in (30, 30)), float(rng.randrange(1, 4))))
    every = [box(s, i) for s in range(3) for i in range(12)] + [(0, 50, 9.0, 9.0, 10.0, 10.0), (0, 51, 9.0, 9.0, 10.0, 10.0)]
    plots, roads = [b for b in every if b[1] % 3 < 2], [b for b in every if b[1] % 4 == 0 or b[1] > 40]
    roads = [b for b in roads if b[0] != 2]
    want = set()
    for s, i, x0, y0, x1, y1 in plots:
        d = sorted((math.sqrt(((x0 + x1 - a - c) / 2) ** 2 + ((y0 + y1 - b - e) / 2) ** 2), r) for t, r, a, b, c, e in roads if t == s and r != i)
        if d and d[0][0] <= 3 * math.hypot(x1 - x0, y1 - y0) and (len(d) == 1 or d[1][0] > d[0][0] * 1.25):
            want.add((s, i, d[0][1]))
    ddl = "sheet int, id long, min_x double, min_y double, max_x double, max_y double"
    found = candidates.borrowed_road(spark.createDataFrame(plots, ddl), spark.createDataFrame(roads, ddl), ["sheet"])
    assert want and {(r.sheet, r.plot, r.road) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # plots with what was found for their middles


def test_nearest_right_asks_once_for_equal_places(spark):
    labels = [("s", i, float(i % 3), 10.0 * (i % 2)) for i in range(200)]
    cells = [("s", 1000 + i, float(i % 7), 10.0 * (i % 2) + i % 3, float(i)) for i in range(300)]
    want = {}
    for _, i, x, y in labels:
        want[i] = min((cx - x, c, v) for _, c, cx, cy, v in cells if cx > x and abs(cy - y) <= 2)[1:]
    l, c = spark.createDataFrame(labels, "sheet string, id long, x double, y double"), spark.createDataFrame(cells, "sheet string, id long, x double, y double, value double")  # noqa: E741
    found = spatial.nearest_right(l, c, ["sheet"], 2.0)
    assert {r.label: (r.cell, r.value) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3  # places, cells, and the best of their pairs


def _random_boxes(seed, n=300):
    import numpy as np

    rng = np.random.default_rng(seed)
    low, size = rng.integers(0, 30, (n, 2)), rng.integers(1, 9, (n, 2))
    return np.concatenate([low, low + size], axis=1).astype(float)


@pytest.mark.parametrize("table", [1 << 24, 0])
def test_nesting_forms_no_pairs(spark, monkeypatch, table):
    import numpy as np

    monkeypatch.setattr(spatial, "TABLE", table)
    monkeypatch.setattr(spatial, "CELL_COST", 1e-3)
    monkeypatch.setattr(spatial, "AT_ONCE", 1 << 14)
    c = np.unique(_random_boxes(1), axis=0)
    n, area = np.arange(len(c)) % 3 + 1, (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1])
    holds = np.array([[a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3] for b in c] for a in c])
    held, holder = spatial.held_and_holder(c, n, area)
    assert (held == holds @ n).all() and (holder == np.where(holds, area[:, None], -1).max(axis=0)).all()
    label = spatial.nested_groups(c)
    links = holds | holds.T
    root = np.arange(len(c))
    for _ in range(len(c)):
        root = np.where(links, root[None, :], len(c)).min(axis=1)
    assert len(set(zip(label.tolist(), root.tolist(), strict=True))) == len(set(label.tolist())) == len(set(root.tolist()))


def test_equal_boxes_and_boxes_without_a_corner_in_nesting(spark):
    rows = [("s", 5, 0.0, 0.0, 9.0, 9.0), ("s", 3, 0.0, 0.0, 9.0, 9.0), ("s", 4, 1.0, 1.0, 2.0, 2.0), ("s", 7, None, 1.0, 2.0, 2.0), ("t", 1, 0.0, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "sheet string, id long, min_x double, min_y double, max_x double, max_y double")
    assert sorted(tuple(r) for r in spatial.nested_components(boxes, ["sheet"]).collect()) == [("s", 3, 3), ("s", 4, 3), ("s", 5, 3), ("s", 7, 7), ("t", 1, 1)]
    assert [tuple(r) for r in spatial.plot_role(boxes, ["sheet"]).collect()] == [("s", 3, 2)]
    for name in ("plot_role", "nested_components"):
        assert "cx" not in getattr(spatial, name)(boxes, ["sheet"])._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_fall_by_those_before_them_that_stay():
    from plumbline.operators.candidates import first_outside

    c = _random_boxes(3, 400)
    area, kept = (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1]), []
    for i, b in enumerate(c):
        if not any(b[0] >= k[0] - 1 and b[1] >= k[1] - 1 and b[2] <= k[2] + 1 and b[3] <= k[3] + 1 and area[i] < area[j] * 0.98 for j, k in ((j, c[j]) for j in kept)):
            kept.append(i)
    assert first_outside(c).nonzero()[0].tolist() == kept


def test_mcnemar_takes_many_discordant_pairs(spark):
    started = datetime.datetime.now()
    pairs = spark.range(60000).select((F.col("id") % 2 == 0).alias("a"), (F.col("id") % 2 != 0).alias("b"))
    row = scoring.mcnemar(pairs, "a", "b").first()
    assert (row.only_a, row.only_b, row.p_value) == (30000, 30000, 1.0)
    few = spark.range(10).select((F.col("id") < 2).alias("a"), (F.col("id") >= 2).alias("b"))
    assert scoring.mcnemar(few, "a", "b").first().p_value == pytest.approx(2 * (1 + 10 + 45) / 1024)
    assert (datetime.datetime.now() - started).total_seconds() < 15


def test_gated_aggregates_go_through_the_scores_once(spark):
    from plumbline.operators import evaluation

    rows = [(1, "plot.width", 2.0, 2.0, "HIGH", False, "WRONG"), (1, "coverage", 1.0, 1.0, "HIGH", False, "CORRECT"), (None, "plot.width", 2.0, 9.0, "LOW", False, "WRONG"), (None, "coverage", 2.0, 2.0, "LOW", False, "CORRECT")]
    scores = spark.createDataFrame(rows, "plan_id long, field string, truth double, predicted double, level string, flagged boolean, status string")
    found = evaluation.gated_aggregates(scores)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["view"] for r in found.collect()} == {"all_plans", "boundary_resolved_only"}


def test_best_line_asks_once_for_equal_texts(spark):
    from plumbline.operators import dimensions

    rng = random.Random(7)
    items = [("s", i, float(rng.randrange(30)), float(rng.randrange(20)), rng.choice([None, 0.0, 45.0, 90.0])) for i in range(200)]
    ends = [(float(rng.randrange(30)), float(rng.randrange(20)), float(rng.randrange(1, 9))) for _ in range(40)]
    lines = [("s", 1000 - i, x, y, x + w, y) for i, (x, y, w) in enumerate(ends + ends)]
    items = spark.createDataFrame(items, "sheet string, id long, x double, y double, angle double")
    lines = spark.createDataFrame(lines, "sheet string, id long, x1 double, y1 double, x2 double, y2 double")
    best = dimensions.best_line(items, lines, ["sheet"], reach=6.0, cell=8.0)
    assert "Window" not in best._jdf.queryExecution().optimizedPlan().toString()
    want = dimensions.near_lines(items, lines, ["sheet"], reach=6.0, cell=8.0).where((F.col("rank") == 0) & (1 - F.col("distance") / 6.0 >= 0.35)).drop("rank")
    assert sorted(best.collect()) == sorted(want.collect())


def test_bm25_mean_idf_is_exact_for_many_rare_words(spark):
    # 300,000 words of one chunk each, added one by one, drift by far more than the last digits
    n, each = 3, 100_000
    rare = [" ".join(f"w{i}x{j}" for j in range(each)) for i in range(n)]
    chunks = spark.createDataFrame([(i, f"the {rare[i]}") for i in range(n)], "pos long, text string").coalesce(1)
    asked = spark.createDataFrame([(0, "the")], "query_id long, query string")
    raw = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    mean = math.fsum([raw(1)] * (n * each) + [raw(n)]) / (n * each + 1)
    want = retrieval.EPSILON * mean * (retrieval.K1 + 1) / (1 + retrieval.K1)
    for row in retrieval.bm25(chunks, asked).collect():
        assert abs(row.score / want - 1) < 1e-15


def test_held_boxes_stand_in_one_cell(spark):
    rng = random.Random(3)
    rows = [("s", i, float(x), float(y), float(x + rng.choice([0, 1, 3, 9, 25])), float(y + rng.choice([0, 1, 2, 8, 30]))) for i, (x, y) in enumerate((rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(150))]
    boxes = spark.createDataFrame(rows, "sheet string, id long, min_x double, min_y double, max_x double, max_y double")
    found = spatial.containment_edges(boxes, ["sheet"])
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and a[2] <= b[2] and a[3] <= b[3] and a[4] >= b[4] and a[5] >= b[5])
    assert sorted((r.a, r.b) for r in found.collect()) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


def _is_dealt_out(df) -> bool:
    """Whether the pairs of a join are made over all cores, not beside a broadcast table in the tasks that read the other."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_pairs_of_boxes_are_made_over_all_cores(spark):
    x = F.col("id").cast("double")
    boxes = spark.range(40).select(F.lit("s").alias("sheet"), "id", x.alias("min_x"), x.alias("min_y"), (x + 2).alias("max_x"), (x + 2).alias("max_y"))
    pairs, kinds, edges = spatial.box_pairs(boxes, ["sheet"], 0.0), spatial.relations(boxes, ["sheet"], 0.0), spatial.containment_edges(boxes, ["sheet"])
    assert all(map(_is_dealt_out, (pairs, kinds, edges)))
    assert (pairs.count(), kinds.count(), edges.count()) == (39 + 38, 39 + 38, 0)


def test_lines_near_texts_are_found_over_all_cores(spark):
    from plumbline.operators import dimensions

    x = F.col("id").cast("double")
    items = spark.range(30).select(F.lit("s").alias("sheet"), "id", x.alias("x"), F.lit(0.5).alias("y"), F.lit(None).cast("double").alias("angle"))
    lines = spark.range(30).select(F.lit("s").alias("sheet"), "id", x.alias("x1"), F.lit(0.0).alias("y1"), (x + 1).alias("x2"), F.lit(0.0).alias("y2"))
    found = dimensions.near_lines(items, lines, ["sheet"], reach=0.6).drop("rank")
    assert _is_dealt_out(found) and found.count() == 30 + 29


def test_dense_nearest_meets_queries_by_matrix_product(spark, monkeypatch):
    """Ties, copies, vectors that are null, short or infinite, and several blocks give what scoring pair by pair gives."""
    rng, rows = random.Random(4), []
    for i in range(300):
        v = [rng.randrange(-3, 4) / 4 for _ in range(4)] if i % 3 else [rng.gauss(0, 1) for _ in range(4)]
        rows.append((i, None if i % 97 == 5 else v[:3] if i % 89 == 7 else [*v[:3], None] if i % 83 == 9 else [*v[:3], float("inf")] if i % 79 == 11 else v))
    chunks = spark.createDataFrame(rows, "pos long, vec array<float>")
    queries = chunks.where("pos % 10 in (0, 2)").select(F.col("pos").alias("query_id"), F.col("vec").alias("qvec"))
    want = retrieval.top_k(retrieval.dense_scores(chunks, queries), 7, *retrieval._best())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 100)
    got = retrieval.dense_top_k(chunks, queries, 7)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_clause_starts_are_worked_out_once(spark):
    """A text of many clauses: the time grew with the square of their number, each step working out all before it again."""
    import time

    n = 300
    rows = spark.createDataFrame([("Preface\n" + "".join(f"Section {i + 1}\n{'words and more words ' * 10}\n" for i in range(n)),)], "text string")
    began = time.perf_counter()
    (r,) = rows.select(retrieval.clause_starts(F.col("text")).alias("s")).collect()
    assert len(r.s) == n and r.s[0].start == 8 and r.s[-1].ref.startswith(f"Section {n} words")
    assert time.perf_counter() - began < 15


def test_numbers_print_as_the_formatter_prints_them(spark):
    values = [0.0, -0.0, -0.001, 0.005, 1.005, 2.675, 0.125, 99.995, 9999999.995, 12345678.9, 1e16, 1e-5, 0.09999999, float("nan"), None] + [i / 16 for i in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    differ = [rows.where(~text._fixed(F.col("v"), d).eqNullSafe(F.format_string(f"%.{d}f", "v"))).count() for d in (0, 1, 2, 5)]
    assert differ == [0] * 4


def test_grounding_works_out_a_value_once(spark):
    """The plan names the evidence that a value is read from once, not for each form in which it may be printed."""
    rows = spark.createDataFrame([(0.0, "reads 9.14", ["9.14"]), (3.0, "", ["4"])], "v double, said_here string, t array<string>")
    found = rows.select(text.grounding(F.col("v"), F.col("said_here"), F.col("t")).alias("g")).select("g.*")
    assert [tuple(r) for r in found.collect()] == [(9.14, True, True), (3.0, False, False)]
    plan = rows.select(text.grounding(F.col("v"), F.col("said_here"), F.col("t")).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(said_here") == 1


def test_parts_grow_with_the_bytes_read(spark, tmp_path):
    """A task's memory doesn't grow with the input: what is dealt out has a part for each so many bytes read."""
    from plumbline.operators import drawing
    from plumbline.sources import work

    path = str(tmp_path / "boxes")
    spark.range(20000).selectExpr("id", "rand(1) as x").write.parquet(path)
    few, many = work.dealt(spark.read.parquet(path), "id", each=1 << 40), work.dealt(spark.read.parquet(path), "id", each=4096)
    assert few.rdd.getNumPartitions() == max(4, 2 * spark.sparkContext.defaultParallelism) and many.rdd.getNumPartitions() > 20
    ring = F.array(*[geometry.point(F.col("id") + a, F.lit(b)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    plots = spark.range(9).select("id", ring.alias("points"))
    seen = plots.select("id", F.lit("road").alias("kind"), F.lit(0.0).alias("x"), F.lit(5.0).alias("y"))
    sides = plots.select("id", F.lit(0).alias("front"), F.lit(2).alias("rear"), F.array(F.lit(3)).alias("lefts"), F.array(F.lit(1)).alias("rights"))
    for found in (drawing.front_sides(plots, seen, "id"), drawing.setbacks(plots, plots, sides, "id", F.lit(1.0))):
        assert found.count() == 9 and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_sign_flip_goes_through_many_groups_in_one_call(spark):
    rows = spark.createDataFrame([(k, float(d)) for k in (1, None, 3) for d in (1, -2, 3)], "k long, d double")
    found = scoring.sign_flip(rows, "d", "k")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k or 0, r.n, r.observed, r.p_value) for r in found.collect()) == [(0, 3, 2.0, 0.75), (1, 3, 2.0, 0.75), (3, 3, 2.0, 0.75)]


def test_centre_of_a_ring_is_worked_out_once(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    ring = F.array(*[geometry.point(x, y) for x, y in ((F.col("a"), F.lit(0)), (F.col("b"), F.lit(0)), (F.col("b"), F.lit(3)), (F.col("a"), F.lit(3)))])
    plan = rows.select(geometry.centroid(ring).alias("c"))
    assert plan.select("c.*").first()[:] == (1.5, 1.5)
    assert plan._jdf.queryExecution().analyzed().toString().count("zip_with") == 1
