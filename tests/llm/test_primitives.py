from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bag_minhash, pretokens, quality, simple8b, vectors
from tests.llm import helpers


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    assert (simple8b.decode(simple8b.encode(ids), ids.size) == ids).all()


def test_simple8b_packs_small_ids():
    assert simple8b.encode(np.ones(6000, np.uint64)).size == 100


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=20), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts, chunk):
    got = []
    for docs in vectors.slices(pa.array(texts, pa.string()), chunk):
        w = vectors.words(docs)
        low = vectors.LOWER[docs.data].tobytes()
        for a, b in zip(w.at, w.at[1:], strict=False):
            got.append([low[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
    assert got == [helpers.words(t) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (docs,) = vectors.slices(pa.array(["The cat", "a the CAT cat"]))
    h = vectors.words(docs).hash
    assert h[0] == h[3] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 3


@given(st.text(max_size=30))
@settings(max_examples=100, deadline=None)
def test_code_points(text):
    for docs in vectors.slices(pa.array([text])):
        cp, _ = vectors.codepoints(docs)
        assert len(cp) == len(text)
        assert [c for c in cp.tolist() if c > 0x250] == [ord(c) for c in text if ord(c) > 0x250]


@pytest.fixture(scope="module")
def coder():
    vocabulary = pretokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    whole = pretokens.whole_tokens(vocabulary)
    return pretokens.Encoder(vocabulary, pa.array([*whole]), pa.array([*whole.values()]))


def test_ids_are_the_librarys(coder):
    rng = random.Random(3)
    letters = [*"abst'mdrelv 's  \n\t .,!12²½éÀ中あ가×՘", "<|endoftext|>", "🤔", "'re", "'ll", " '", "\r\n", "\u0085", "\u00a0"]
    texts = [None, "", *("".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(20_000)), helpers.prose(rng, 5000)]
    got = [ids[a:b].tolist() for _, _, ids, at, _ in coder.texts(pa.array(texts)) for a, b in zip(at, at[1:], strict=False)]
    assert got == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_whole_tokens_encode_alone(coder):
    vocabulary = pretokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    whole = pretokens.whole_tokens(vocabulary)
    sample = random.Random(1).sample(sorted(whole), 500)
    assert [e.ids for e in coder.tokenizer.encode_batch(sample, add_special_tokens=False)] == [[whole[t]] for t in sample]


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a = rng.integers(1, 6, 40)
        b = a.copy()
        at = rng.choice(40, rng.integers(0, 40), replace=False)
        b[at] = rng.integers(1, 9, at.size)
        h = rng.integers(0, 2**63, 40).astype(np.uint64)
        s = bag_minhash.signatures(bag_minhash.Bags(np.tile(h, 2), np.concatenate([a, b]), np.array([0, 40, 80])))
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signatures_do_not_depend_on_what_is_signed_with_them():
    rng = random.Random(4)
    texts = [helpers.prose(rng, n) for n in (5, 12, 16, 24, 34, 60)]
    want = [bag_minhash.signatures(bag_minhash.bags(d))[0] for t in texts for d in vectors.slices(pa.array([t]))]
    for others in (0, 3, 40, 700):
        (docs,) = vectors.slices(pa.array([*texts, *(helpers.prose(rng, 50) for _ in range(others))]))
        got = bag_minhash.signatures(bag_minhash.bags(docs))[: len(texts)]
        assert (got == np.stack(want)).all(axis=1).tolist() == [True] * len(texts)


def test_similarity_of_multisets_is_exact():
    rng = random.Random(2)
    texts = [helpers.prose(rng, 30, "a b c") for _ in range(12)] + ["", "a", "a b"]
    (docs,) = vectors.slices(pa.array(texts))
    values, at = bag_minhash.elements(docs)
    for i in range(len(texts)):
        x, y = helpers.shingle_bag(texts[i]), helpers.shingle_bag(texts[0])
        shared = sum((x & y).values())
        want = shared / max(1, sum(x.values()) + sum(y.values()) - shared)
        got = bag_minhash.similarities(values[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), values[: at[1]], np.array([0, at[1]]))
        assert got[0] == pytest.approx(want)


def test_trees_learn_and_flat_traversal_matches_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.95

    def walk(row):
        total = model.base
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            i = 0
            while i < len(feature):
                i = 2 * i + 1 + int(row[feature[i]] > limit[i])
            total += float(leaf[i - len(feature)])
        return total

    assert model.margin(x[:20]) == pytest.approx([walk(r) for r in x[:20]])


def test_statistics_of_odd_texts_are_finite():
    texts = pa.array([r[1] for r in helpers.odd_rows()])
    x = quality.featurise(texts)
    assert x.shape == (len(texts), len(quality.NAMES)) and np.isfinite(x).all()
    assert quality.featurise(pa.array([], pa.string())).shape == (0, len(quality.NAMES))


def test_statistics_do_not_depend_on_the_texts_beside():
    rng = random.Random(3)
    texts = [helpers.prose(rng, rng.randint(1, 30)) for _ in range(40)] + ["a", "a", "a!", "!a", "a a", "", "aa", "a\n", "\na", *(r[1] for r in helpers.odd_rows())]
    rng.shuffle(texts)
    alone = np.concatenate([quality.featurise(pa.array([t], pa.string())) for t in texts])
    assert (quality.featurise(pa.array(texts, pa.string())) == alone).all()
