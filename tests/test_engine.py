"""The engine's calls and its command line over small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline import cli, engine
from plumbline.operators.rules import Rule
from plumbline.sources import records
from tests.test_rules import plan


def test_check_and_edit(spark):
    rules = [Rule("a", {"field": "setbacks.front", "op": ">=", "value": 3.0}, municipality="X")]
    plans = plan(spark, setbacks_front=(2, "HIGH"), plot_area=(100, "HIGH"))
    found = engine.check(plans, rules, "x")
    assert found["overall"].first().overall == "FAIL" and found["suggestions"].first().field == "setbacks.front"
    edits = spark.createDataFrame([(1, "setbacks.front", "4", 1), (1, "far", "-1", 2), (1, "setbacks.front", "3.5", 3)], "plan_id int, field string, value string, pos int")
    after = engine.edited(plans, edits)
    assert [r.problem for r in after["refused"].collect()] == ["NEGATIVE"]
    assert sorted((r.num, r.before) for r in after["corrections"].collect()) == [(3.5, 2.0), (4.0, 2.0)]
    assert engine.check(after["plans"], rules, "X")["overall"].first().overall == "PASS"


def test_library_and_search(spark, tmp_path):
    pages = spark.createDataFrame([("pune_dcr.pdf", 1, "7.3.1 Open spaces\nfront margin of three metres\nSection 5 Height\nup to fifteen metres", "h1"), ("nbc.pdf", 1, "12. Parking spaces\none car each flat", "h2")], "source_file string, page_num int, text string, sha256 string")
    path = str(tmp_path / "library")
    assert {r.source_file: r.n_chunks for r in engine.ingest(spark, pages, path, "PMC").collect()} == {"pune_dcr.pdf": 2, "nbc.pdf": 1}
    more = pages.union(spark.createDataFrame([("fire.pdf", 1, "no clause", "h3")], pages.schema))
    assert sum(r.n_chunks for r in engine.ingest(spark, more, path, "PMC").collect()) == 4  # unchanged files are left as they are
    chunks = records.read_chunks(spark, f"{path}/chunks").withColumn("pos", F.xxhash64("chunk_id"))
    asked = spark.createDataFrame([(0, "height metres"), (1, "car parking")], "query_id long, query string")
    best = {r.query_id: r.chunk_id for r in engine.search(chunks, asked, 1).collect()}
    assert best == {0: "PMC::pune_dcr.pdf::p1::Section 5 Height::0", 1: "PMC::nbc.pdf::p1::12. Parking spaces::0"}
    assert {r.city for r in chunks.collect()} == {"Pune", "NATIONAL", "UNKNOWN"}
    with pytest.raises(ValueError):
        engine.search(chunks, asked.withColumn("query", F.lit(" ")))
    assert [r.refused for r in engine.drafting_inputs(chunks, asked).orderBy("query_id").collect()] == [True, True]


def test_command_line(spark, tmp_path):
    plan(spark, setbacks_front=(4, "HIGH")).write.parquet(str(tmp_path / "plans"))
    rule = spark.createDataFrame([("a", "X", '{"field": "setbacks.front", "op": ">=", "value": 3}', "ACTIVE", 5)], "rule_id string, municipality string, threshold string, status string, priority int")
    records.write_rules(rule, str(tmp_path / "rules.json"))
    out = cli.run(spark, ["check", str(tmp_path / "plans"), str(tmp_path / "rules.json"), "x", "--out", str(tmp_path / "out")])
    assert [r.status for r in out.collect()] == ["PASS"]
    assert records.read_drafts(spark, str(tmp_path / "none.json")).count() == 0
