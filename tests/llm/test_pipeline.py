from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import quality
from plumbline.llm.mixing import source_targets
from plumbline.llm.scratch import store
from tests.llm import helpers

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    labels = [(i, int(i not in (11, 6)), 0) for i in range(1, 14)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    passage = " ".join(helpers.odd_rows()[9][1].split()[100:115])
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    helpers.odd_docs(spark).write.parquet(f"{root}/documents.parquet")
    return str(root)


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]


def test_every_stage_takes_odd_and_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "tokens":
            assert out.columns == docs.columns, name
        out.count()
        assert stage(spark, docs.limit(0), tables).count() == 0, name


def test_decisions_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["near_dedup"](spark, docs, tables).count() == len(helpers.near_classes(helpers.odd_rows()))
    clean = {r.doc_id for r in stages["decontamination"](spark, docs, tables).collect()}
    assert 7 not in clean and 8 not in clean and {1, 2, 3, 4, 5} <= clean
    assert stages["tokens"](spark, docs, tables).count() == len(helpers.odd_rows())


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_run_against_brute_force(spark, tmp_path):
    """Each stage restated plainly over what the one before kept, and run() as their chain."""
    rng = random.Random(31)
    base = [helpers.prose(rng, rng.randint(20, 60)) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(200 + i, " ".join([*base[i].split()[:-1], "changed"]), "en", "s1", 0) for i in range(30)]  # near copies
    rows += [(300 + i, base[i], "en", "s2", 0) for i in range(50, 60)]  # exact ones
    rows += [(400 + i, "BUY NOW!!! " * rng.randint(5, 20), "en", "s3", 0) for i in range(60)]
    rows += [(500, None, "en", "s0", 0), (501, "", None, None, 0)]
    labels = [(i, int(i < 400), 0) for i, *_ in rows if i < 480]
    items = [(1, " ".join(base[7].split()[3:18])), (2, " ".join(base[90].split()[:4])), (3, None)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Quality: each text by itself through trees grown on the plain sample.
    order = {r.i: r.h for r in spark.range(600).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).collect()}
    text = {i: t for i, t, *_ in rows}
    measure = lambda t: quality.featurise(pa.array([t], pa.string()))
    known = sorted((order[i], i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    model = quality.fit(np.concatenate([measure(text[i]) for _, i, _ in known]), np.array([float(y) for _, _, y in known]))
    good = [r for r in rows if model.score(measure(r[1]))[0] >= 0.7]
    # Near-duplicates: all pairs; the smallest id of a class stays. Then every window of every item.
    kept = sorted(min((good[i] for i in c), key=lambda r: r[0]) for c in helpers.near_classes(good))
    clean = [r for r, found in zip(kept, helpers.passages(kept, [i for i in items if i[1]]), strict=True) if not found[-1]]
    assert 7 not in {r[0] for r in clean} and len(clean) > 50

    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, str(tmp_path)), name)
        out[name] = sorted(r.doc_id for r in docs.collect())
    assert out["quality"] == sorted(r[0] for r in good)
    assert out["near_dedup"] == [r[0] for r in kept] and out["decontamination"] == [r[0] for r in clean]

    # Mixing: every document once less or more than its source's share, sources near their targets.
    taken, size = Counter(out["mixing"]), {r[0]: len((r[1] or "").split()) for r in clean}
    source = {r[0]: r[3] for r in clean}
    target = {r.source: r.target for r in source_targets(spark.createDataFrame([(source[i], n) for i, n in size.items()], "source string, size long")).collect()}
    whole = Counter()
    for i, n in size.items():
        whole[source[i]] += n
    for s, t in target.items():
        own = [i for i in size if source[i] == s and size[i]]
        share = t / whole[s] if whole[s] else 0
        assert all(taken[i] in (int(share), int(share) + 1) for i in own)
        assert abs(sum(taken[i] * size[i] for i in own) - t) <= max((size[i] for i in own), default=0)

    # Tokens: the library's ids of the mixed documents in order, and run() the same rows.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i in out["mixing"]:
        ids = np.array([*tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, ids.size, zlib.crc32(ids.tobytes())))
        at += ids.size
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_fold_is_crc32_of_the_id_as_text(spark):
    from plumbline.llm.queries import fold

    got = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)
