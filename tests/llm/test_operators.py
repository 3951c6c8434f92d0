"""Each operator over the odd table, the empty table and, where it fits, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bag_minhash, language, quality, queries
from plumbline.llm.decontaminate import Index, Text, Windows, contamination, decontaminate, joined
from plumbline.llm.exact_dedup import exact_dedup
from plumbline.llm.licenses import TEMPLATES, Templates, license_scan
from plumbline.llm.mixing import mix_sources, repeat_by_copies, source_targets
from plumbline.llm.near_dedup import _closing, components, drop_near_duplicates, near_duplicates
from plumbline.llm.scratch import new_path
from plumbline.llm.token_counts import token_counts
from plumbline.llm.token_files import read_token_files, write_token_files
from plumbline.llm.url_filter import BACKOFF, FOLDS, ORDER, RULES, gram_counts, judge_urls
from plumbline.llm.vectors import slices, words
from tests.llm import helpers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ROWS = helpers.odd_rows()


def _key(i):
    return (i is not None, i or 0)


@pytest.fixture(scope="module")
def docs(spark):
    return helpers.odd_docs(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return helpers.empty_docs(spark)


def _ids(rows):
    return sorted((r["doc_id"] for r in rows), key=_key)


ALL_IDS = sorted((r[0] for r in ROWS), key=_key)


def test_exact_dedup(docs, none):
    got = exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i))
    want = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()) for _, _, i in members]
    order = lambda r: (_key(r[0]), r[4])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert exact_dedup(none).count() == 0


def test_exact_dedup_is_native(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_duplicates_on_odd_rows(docs, none):
    got = near_duplicates(docs).collect()
    assert _ids(got) == ALL_IDS
    by = defaultdict(set)
    for r in got:
        by[(r.doc_id, r.text_hash)].add((r.class_id, r.class_size))
    sizes = sorted(size for c in helpers.near_classes(ROWS) for size in [len(c)] * len(c))
    assert sorted(r.class_size for r in got) == sizes
    assert {r.class_id for r in got if r.doc_id in (1, 2, 3, 13)} == {1}
    assert near_duplicates(none).count() == 0
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len([c for c in helpers.near_classes(ROWS)])
    assert drop_near_duplicates(none).count() == 0


def test_near_duplicates_chains_and_a_large_group(spark):
    """A chain of drifting copies and a crowd of near copies: every link between different texts counts."""
    rng = random.Random(9)
    rows, text = [], helpers.prose(rng, 120).split()
    for i in range(60):
        text = list(text)
        text[rng.randrange(len(text))] = f"w{i}"
        rows.append((i, " ".join(text), "en", "a", 0))
    base = helpers.prose(rng, 60).split()
    for i in range(60, 260):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(base)
        rows.append((i, " ".join(copy), "en", "a", 0))
    rows += [(i, helpers.prose(rng, 40), "en", "a", 0) for i in range(260, 330)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, helpers.SCHEMA)).collect()}
    want = {i: min(c) for c in helpers.near_classes(rows) for i in c}
    assert got == want


def test_pairs_are_compared_where_their_band_keys_first_agree():
    """Registers whose 16 bits agree by chance in an earlier band don't make a pair skipped."""
    keys = np.arange(2 * bag_minhash.BANDS).reshape(2, bag_minhash.BANDS)
    keys[1, 5:] = keys[0, 5:]
    node = [{"a": 1, "b": 1}, {"a": 2, "b": 2}]
    table = {"band": [5, 5], "i": [0, 0], "j": [0, 0], "block": [0, 0], "root": node, "node": node, "registers": [bytes(2 * bag_minhash.REGISTERS)] * 2, "bands": keys.tolist(), "elements": [[1, 2, 3]] * 2}
    found = _closing(0.8)(pa.table(table))
    assert [(r["u"]["a"], r["v"]["a"], r["similarity"]) for r in found.to_pylist()] == [(1, 2, 1.0)]
    assert _closing(0.8)(pa.table(table | {"band": [6, 6]})).num_rows == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n for n, root in got if root == 1} == {2, 3, 7, 8, 9} and (21, 20) in got


def test_mixing(docs, none, spark):
    got = mix_sources(docs).collect()
    assert _ids(got) == ALL_IDS
    size = Counter()
    for _, text, _, source, _ in ROWS:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {r.source: r.source_size for r in got} == dict(size)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(size.values()))
    assert all(r.taken == r.copies * r["size"] and r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    assert mix_sources(none).count() == 0
    repeated = repeat_by_copies(docs, mix_sources(docs))
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.copies for r in got)


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 50), "en", f"s{min(i % 9, 5)}", 0) for i in range(3000)]
    got = mix_sources(spark.createDataFrame(rows, helpers.SCHEMA)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 50 for s, t in target.items())


def test_targets_reshare_by_brute_force(spark):
    size = {"a": 10, "b": 500, "c": 3, "d": 70, None: 200}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(size.values()), dict.fromkeys(size, 0.0), set(size)
    left = float(total)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
        for s in list(free):
            if target[s] > 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                free.discard(s)
    assert got == pytest.approx(target)


def test_token_counts(docs, none):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS), key=lambda r: (_key(r[0]), r[1]))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, VOCABULARY).collect()), key=lambda r: (_key(r[0]), r[1]))
    assert got == want
    assert token_counts(none, VOCABULARY).count() == 0


def test_token_files_round_trip(spark, docs, none):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    path = new_path(spark, "tokens")
    write_token_files(docs, path, VOCABULARY, 2)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [_key(r.doc_id) for r in got] == sorted(_key(i) for i in ALL_IDS)
    at = 0
    for row, (_, text) in zip(got, sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (_key(r[0]), r[1] is not None, r[1] or "")), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, ids.size, zlib.crc32(ids.tobytes()))
        at += ids.size
    path = new_path(spark, "tokens")
    write_token_files(none, path, VOCABULARY, 2)
    assert read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_against_brute_force(spark, none, block_bytes):
    rng = random.Random(8)
    items = [(10 * i, helpers.prose(rng, rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(7, ""), (8, "!!"), (3, "same words here"), (33, "Same words, HERE")]
    rows = []
    for i in range(150):
        text = helpers.prose(rng, rng.randint(0, 60)).split()
        if i % 3 == 0:
            item = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(item) - 5))
            text[len(text) // 2 : len(text) // 2] = item[a : a + rng.choice([5, 9, 10, 11, 30])]
        rows.append((i, " ".join(text), "en", "a", 0))
    items += [(None, " ".join(rows[7][1].split()[:12])), (None, "an er")]  # without an id they hit, but are in no list
    bench = spark.createDataFrame([*items, (50, None)], "item_id long, text string")
    got = contamination(spark.createDataFrame(rows, helpers.SCHEMA), bench, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got)) == helpers.passages(rows, items)
    assert contamination(none, bench).count() == 0


def test_decontamination_of_periodic_texts_is_quick():
    """An item of one word a thousand times, and one of two in turn, in documents of the same: no pair of places is formed."""
    items = pa.array(["same " * 1000, "tick tock " * 500, "same tick"])
    index = Index(pa.array(["a", "b", "c"]), items)
    texts = ["same " * 20_000, "tock tick " * 10_000, "same " * 9 + "tick", "x " * 20_000, "same " * 10 + "other " + "tick tock " * 5]
    began = time.perf_counter()
    (docs,) = slices(pa.array(texts))
    w, hit, pairs = index.match(docs)
    assert time.perf_counter() - began < 1
    assert np.add.reduceat(hit.astype(int), w.at[:-1]).tolist() == [20_000, 20_000, 2, 0, 20]
    assert pairs.tolist() == [[0, 1, 2, 4, 4], [0, 1, 2, 0, 1]]


def test_windows_of_one_hash_are_told_apart_by_their_bytes():
    (docs,) = slices(pa.array(["aa bb", "cc dd", "cc dd ee"]))
    w = words(docs)
    text = Text(*joined(docs, w))
    found = Windows(2, text, np.array([0, 2, 4]), np.full(3, 9, np.uint64), np.array([0, 1, 2]))
    at, which = found.find(np.full(4, 9, np.uint64), np.array([0, 2, 4, 5]), text, text)
    assert {(a, *found.item[found.at[k] : found.at[k + 1]].tolist()) for a, k in zip(at.tolist(), which.tolist(), strict=True)} >= {(0, 0), (2, 1)}
    assert 5 not in at.tolist() and {0, 2, 4} == set(at.tolist())


def test_decontamination_on_odd_rows(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(ROWS[0][1].split()[5:20])), (2, "one two")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in contamination(docs, bench).collect() if r.doc_id is not None}
    assert {i for i, hit in got.items() if hit} == {1, 2, 3, 9, 10, 13}
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {None, 4, 5, 6, 7, 8, 11, 12}
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_licenses(spark, docs, none):
    lines = [
        (1, "CC BY, cc\nby. All Rights reserved! all rights", 4, "cc-by,reserved", "cc-by,reserved"),
        (2, "text\nLicensed under the Apache License, Version 2.0.\nmore", 0, "", "apache-2.0"),
        (3, "Released under the\nMIT License.", 0, "", ""),
        (4, "GNU General Public License", 1, "gpl", "gpl"),
        (5, None, 0, "", ""),
    ]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([(i, t) for i, t, *_ in lines], "doc_id long, text string")).collect()}
    assert got[1].n_base == 3 and got[1].first_word == 0 and got[1].last_word == 4
    for i, _, _, base, labels in lines:
        assert (got[i].base_labels, got[i].labels) == (base, labels)
    assert got[5].n_words == 0 and got[5].first_word is None and got[2].score == 1.0
    assert _ids(license_scan(docs).collect()) == ALL_IDS
    assert license_scan(none).count() == 0


def test_license_join_finds_every_block_over_the_threshold(spark):
    rng = random.Random(6)
    templates = [("x", "alpha beta gamma delta epsilon zeta"), ("y", "alpha omega sigma"), ("z", "beta beta gamma")]
    vocabulary = sorted({w for _, t in templates for w in t.split()}) + ["other", "more"]
    rows = [(i, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 9))) for _ in range(4))) for i in range(300)]
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, containment=0.7).collect()}
    for i, text in rows:
        want = {label for label, t in templates for line in text.split("\n") if len(set(t.split()) & set(line.split())) >= 0.7 * len(set(t.split())) - 1e-9}
        assert got[i] == ",".join(sorted(want))


def test_positional_filter_removes_blocks_short_of_words():
    """A block with a template's rare word and none after it is left before its overlap is counted; others are not."""
    table = Templates([("x", "rare alpha beta gamma delta")], {"rare": 1, "alpha": 5, "beta": 6, "gamma": 7, "delta": 8}, 0.8)
    texts = ["rare rare rare rare rare", "rare alpha beta gamma more", "alpha beta gamma delta more", "rare delta more more more"]
    (docs,) = slices(pa.array(texts))
    found = table.match(docs)
    assert found["labels"] == ["", "x", "x", ""] and found["score"].tolist() == [0, 0.8, 0.8, 0]


def test_licenses_wrapped_over_lines(spark):
    """Every template, broken at each narrow width and behind comment marks, is found; one spread over a text isn't."""
    found = []
    for i, (label, text) in enumerate(TEMPLATES):
        for width in (20, 40, 72):
            found.append((len(found), label, "before it\n * " + "\n * ".join(textwrap.wrap(text, width)) + "\n\nafter it"))
    spread = [(1000 + i, "", " \n".join(f"{w} " + "filler " * 5 for w in text.split())) for i, (_, text) in enumerate(TEMPLATES)]
    halves = [(2000, "", "released under the"), (2001, "", "mit license")]
    rows = spark.createDataFrame([(i, t) for i, _, t in found + spread + halves], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan(rows, wrapped=True).collect()}
    assert [i for i, label, _ in found if label not in got[i]] == []
    assert all(got[i] == {""} for i, _, _ in spread + halves)


def test_urls(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/2?x=/es/", "ftp://x.net/es/#a", "http://net/fr/1", "http://notcom/", "com/x", "", None, "http://shop.com", "http://shop.com/a?b", "x://h?en"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host long")
    got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(pages).collect()}
    want = [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("x.net", "/es/", "net/es/"), ("net", "/fr/1", "net/fr/"), ("notcom", "/", None),
        ("", "", None), ("", "", None), ("", "", None), ("shop.com", "", None), ("shop.com", "/a", "com/"), ("h", "", None), ("a.example.com", "/en/1", "example.com/en/"),
    ]
    assert [got[i] for i in range(len(want))] == want
    assert judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in judge_urls(pages).collect()} <= {"allow", "block"}


def test_url_models_tell_the_kinds_apart(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{helpers.prose(rng, 1)}.com/news/{i}") for i in range(200)] + [(1000 + i, f"http://{helpers.prose(rng, 1)}.net/es/pills{i}") for i in range(200)]
    unknown = [(5000, "http://anon.org/news/7"), (5001, "http://anon.org/es/pills9")]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows + unknown, "page_id long, url string")).collect()}
    assert got[5000] == "allow" and got[5001] == "block"


def test_url_counts_are_exact_however_many_there_are(spark):
    """More distinct n-grams than any fixed table of some 100,000 slots holds, each counted by itself."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-_./?=&%", k=80)) for _ in range(6000)]
    rows = spark.createDataFrame([(t, i % 3 > 0) for i, t in enumerate(texts)], "text string, accepted boolean")
    want = Counter()
    for i, t in enumerate(texts):
        for k in range(ORDER + 1):
            for j in range(len(t) - k):
                want["gram", t[j : j + k + 1], i % 3 > 0] += 1
                want["context", k, t[j : j + k], i % 3 > 0] += 1
    got = gram_counts(rows).collect()
    assert len(got) == len({key[:-1] for key in want}) > 1 << 18
    assert sorted(n for r in got for n in (r.yes, r.no) if n) == sorted(want.values())


def test_url_ratio_and_verdict_against_a_dictionary_model(spark):
    """The whole result of judge_urls, with n-grams counted in dictionaries of strings."""
    rng = random.Random(12)
    ends = ["com/a", "com/en/x", "net/es/b", "net/fr/c", "org/d", "org/en/e", "example.com/en/q"]
    urls = [f"http://{helpers.prose(rng, 1)}.{rng.choice(ends)}{rng.randint(0, 99)}" for _ in range(400)] + [None, "", "no scheme", "x://" + "long/" * 4000, "http://z.org/é"]
    rows = [(i, u, "x", 1.0) for i, u in enumerate(urls + urls[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, ratio double")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert len(got) == len(rows)
    text = {i: b"\x02" + ((u or "").split("://", 1)[-1]).encode() + b"\x03" for i, u, *_ in rows}
    fold = {r.page_id: r.f for r in spark.createDataFrame([(i, t.decode()) for i, t in text.items()], "page_id long, t string").select("page_id", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).alias("f")).collect()}
    known = {i: dict((t, says) for says, t in RULES)[got[i].rule] for i in text if got[i].rule}
    grams, contexts = [Counter(), Counter()], [Counter(), Counter()]
    for i, says in known.items():
        if fold[i]:
            for k in range(ORDER + 1):
                for j in range(k, len(text[i])):
                    grams[says == "block"][text[i][j - k : j + 1]] += 1
                    contexts[says == "block"][k, text[i][j - k : j]] += 1
    size = [max(c[0, b""], 1) for c in contexts]
    weight = [BACKOFF * s / min(size) for s in size]

    def ratio(t: bytes) -> float:
        total = 0.0
        for j in range(len(t)):
            p = [1 / 256, 1 / 256]
            for k in range(min(ORDER, j) + 1):
                p = [(grams[s][t[j - k : j + 1]] + weight[s] * p[s]) / (contexts[s][k, t[j - k : j]] + weight[s]) for s in (0, 1)]
            total += np.log(p[0]) - np.log(p[1])
        return total / len(t)

    want = {i: ratio(t) for i, t in text.items()}
    assert all(got[i].ratio == pytest.approx(want[i], abs=1e-9) for i in text)
    held = [(want[i], known[i] == "allow") for i in known if not fold[i]]
    edges = np.linspace(-6, 6, 1201)
    good = [np.mean([r > e for r, a in held if a]) + np.mean([r <= e for r, a in held if not a]) for e in edges]
    limit = edges[np.array(good) >= max(good) - 1e-9].mean()
    assert all(got[i].verdict == known.get(i, "allow" if want[i] >= limit else "block") for i in text if i in known or abs(want[i] - limit) > 0.02)


def test_trees_against_plain_boosting():
    """The histogram booster against one that scans all rows for each bin edge."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)), 1).astype(np.float32)
    y = ((x[:, 0] + 0.3 * rng.normal(size=300) > 0) & (x[:, 2] < 1)).astype(float)
    model = quality.fit(x, y)
    edges = [np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]).astype(np.float32) for j in range(3)]
    margin = np.full(300, model.base)
    for t in range(4):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)

        def split(rows, depth, node, t=t, grad=grad, hess=hess):
            if depth == quality.DEPTH:
                value = -quality.RATE * grad[rows].sum() / (hess[rows].sum() + quality.RIDGE)
                assert model.leaf[t, node - (2**quality.DEPTH - 1)] == pytest.approx(value, rel=1e-4, abs=1e-6)
                margin[rows] += value
                return
            j, limit = int(model.feature[t, node]), model.limit[t, node]
            worth = lambda r: grad[r].sum() ** 2 / (hess[r].sum() + quality.RIDGE)
            gains = [worth(rows[x[rows, f] <= e]) + worth(rows[x[rows, f] > e]) - worth(rows) for f in range(3) for e in edges[f] if min((x[rows, f] <= e).sum(), (x[rows, f] > e).sum()) >= quality.LEAST]
            own = x[rows, j] <= limit
            if np.isinf(limit):
                assert max(gains, default=0) <= 1e-6 + 1e-9
            else:
                assert worth(rows[own]) + worth(rows[~own]) - worth(rows) == pytest.approx(max(gains), rel=1e-6)
            split(rows[own], depth + 1, 2 * node + 1)
            split(rows[~own], depth + 1, 2 * node + 2)

        split(np.arange(300), 0, 0)


def test_quality_query_against_a_plain_run(spark, tmp_path):
    """The whole result of op1: statistics, training and scoring once more, one document at a time."""
    rng = random.Random(21)
    rows = [(i, helpers.prose(rng, rng.randint(5, 60)) if i % 3 else "BUY!! " * rng.randint(3, 30), "en", "a", 0) for i in range(400)] + [(400, None, None, None, None), (401, "", "en", "a", 0), (3, "again", "en", "a", 0)]
    labels = [(i, int(bool(i % 3)), 0) for i in range(0, 400, 2)] + [(None, 1, 0)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in queries.op1_quality(spark, str(tmp_path)).collect())
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    order = {r.i: r.h for r in spark.range(402).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).collect()}
    known = sorted((order[i], i, y) for i, y, _ in labels if i is not None and crc(i, 4) != 2)
    statistics = lambda t: quality.featurise(pa.array([t], pa.string()))[0]
    x = np.stack([min((statistics(t) for j, t, *_ in rows if j == i), key=tuple) for _, i, _ in known])
    model = quality.fit(x, np.array([float(y) for _, _, y in known]))
    score = lambda t: float(model.score(statistics(t)[None])[0])
    want = sorted((i, crc(i, 4) == 2, round(score(t), 9), int(score(t) >= 0.7)) for i, t, *_ in rows)
    assert got == want


def test_language_query_against_plain_regression(spark, tmp_path):
    """The whole result of op2, with n-grams in dictionaries and the penalised leader followed weight by weight."""
    rng = random.Random(13)
    kinds = {"en": "the an er on in", "de": "sch ein ge ü ß", "fr": "é eau oi que ré"}
    rows = [(i, helpers.prose(rng, rng.randint(2, 9), kinds[k := list(kinds)[i % 3]]), k, "a", 0) for i in range(90)]
    rows += [(90, None, "en", "a", 0), (91, "12 !!", "en", "a", 0), (92, rows[0][1], None, "a", 0), (93, "", None, None, None), (94, "日本", None, "b", 0)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_language(spark, str(tmp_path)).collect()}
    crc = lambda i: zlib.crc32(str(i).encode()) % 3
    learn = [(t, k) for i, t, k, *_ in rows if crc(i) != 1 and t is not None and k is not None]

    def slots(t):
        (docs,) = slices(pa.array([t]))
        return Counter(language.ngrams(docs)[0].tolist())

    df = Counter(s for t, _ in learn for s in slots(t))
    idf = lambda s: np.log((1 + len(learn)) / (1 + df[s])) + 0.1
    order = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for t, _ in learn}], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(1 << 30)).alias("h")).collect()}
    learn = sorted(set(learn), key=lambda r: (order[r[0]], r[1]))
    classes = sorted({k for _, k in learn})
    values = [{s: language.SCALE * n / sum(c.values()) * idf(s) for s, n in c.items()} | {language.SLOTS: 1.0} for c in (slots(t) for t, _ in learn)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(s, k):
        a = z[s, k]
        return 0.0 if abs(a) <= language.L1 else -(a - np.sign(a) * language.L1) / ((language.BETA + np.sqrt(n[s, k])) / language.ALPHA + language.L2)

    def chances(v, t=1.0):
        e = np.exp([sum(x * weight(s, k) for s, x in v.items()) / t for k in range(len(classes))])
        return e / e.sum()

    train = [i for i in range(len(learn)) if i % 5]
    for epoch in range(language.EPOCHS):
        turn = np.random.default_rng(epoch).permutation(train)
        for first in range(0, len(turn), language.BATCH):
            g = defaultdict(float)
            for i in turn[first : first + language.BATCH].tolist():
                p = chances(values[i])
                for k, name in enumerate(classes):
                    for s, x in values[i].items():
                        g[s, k] += x * (p[k] - (learn[i][1] == name))
            was = {key: weight(*key) for key in g}
            for key, d in g.items():
                z[key] += d - (np.sqrt(n[key] + d * d) - np.sqrt(n[key])) / language.ALPHA * was[key]
                n[key] += d * d
    held = [i for i in range(len(learn)) if i % 5 == 0]
    heat = min(np.geomspace(0.05, 20, 121), key=lambda t: -sum(np.log(chances(values[i], t)[classes.index(learn[i][1])] + 1e-12) for i in held))
    for i, t, *_ in rows:
        assert got[i].held_out == (crc(i) == 1)
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        c = slots(t)
        p = chances({s: language.SCALE * m / sum(c.values()) * idf(s) for s, m in c.items()} | {language.SLOTS: 1.0}, heat)
        assert got[i].lang_pred == classes[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-3)


def test_language_learns_rare_languages_from_a_small_sample(spark):
    rng = random.Random(14)
    rows = [(i, helpers.prose(rng, 20, "the an er on in"), "en", "a", 0) for i in range(1500)] + [(5000 + i, helpers.prose(rng, 20, "sch ein ge ü ß"), "de", "a", 0) for i in range(30)]
    table = spark.createDataFrame(rows, helpers.SCHEMA)
    model = language.train(table, sample_rows=60)
    assert model.classes == ["de", "en"]
    got = language.languages(table, model).collect()
    assert sum(r.lang_pred == r.row.lang for r in got) >= 0.97 * len(got)


def test_quality_takes_one_row_for_each_labelled_document(spark):
    rows = [(i % 40, f"text {i} " * (1 + i % 7), "en", "a", 0) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, helpers.SCHEMA)
    model = quality.train(table, labels, sample_rows=25)
    assert isinstance(model, quality.Trees)
    assert {r.score for r in quality.with_quality(table, quality.train(table, labels, sample_rows=0)).collect()} == {0.5}


def test_quality(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, helpers.prose(rng, 60) if i % 3 else "!! ".join(["SPAM"] * 40) + helpers.prose(rng, 5).upper(), "en", "a", 0) for i in range(600)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(600)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, helpers.SCHEMA)
    scored = quality.quality_scores(table, labels, learn=lambda i: i % 4 != 2).collect()
    assert len(scored) == 600
    assert all(r.predicted == int(bool(r.row.doc_id % 3)) for r in scored if r.row.doc_id % 4 == 2)
    odd = quality.quality_scores(docs, labels).collect()
    assert sorted((r.row.doc_id for r in odd), key=_key) == ALL_IDS and all(0 <= r.score <= 1 for r in odd)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_language(spark, docs, none):
    rng = random.Random(3)
    kinds = {"en": "the an er on in", "de": "sch ein ge ü ß", "fr": "é eau oi que ré"}
    rows = [(i, helpers.prose(rng, 30, kinds[k := list(kinds)[i % 3]]), k, "a", 0) for i in range(600)]
    table = spark.createDataFrame(rows, helpers.SCHEMA)
    model = language.train(table.where("doc_id % 5 != 1"))
    got = language.languages(table, model).collect()
    held = [r for r in got if r.row.doc_id % 5 == 1]
    assert sum(r.lang_pred == r.row.lang for r in held) >= 0.97 * len(held)
    odd = language.languages(docs, model).collect()
    assert sorted((r.row.doc_id for r in odd), key=_key) == ALL_IDS
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.row.text or "")) for r in odd)
    assert language.languages(none, model).count() == 0
    empty = language.train(none)
    assert {r.lang_pred for r in language.languages(docs, empty).collect()} == {"und"}
