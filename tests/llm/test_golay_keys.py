"""Candidates of the near-duplicate stage: Golay codewords of SimHash fingerprints."""

import numpy as np

from gritstone.llm import shingles
from gritstone.llm.golay import BITS, Golay
from tests.llm.test_shingles import brute_groups


def test_votes_of_one_weight_decode_as_bits():
    golay = Golay()
    bits = np.random.default_rng(1).integers(0, 2, (3000, BITS))
    assert np.array_equal(golay.nearest(2 * bits - 1), golay.decode(bits @ (1 << np.arange(BITS))))


def test_votes_are_the_fingerprints_majorities():
    hashes = shingles.shingle_set(" ".join(f"w{i}" for i in range(600)))
    whole = shingles.votes(hashes)
    parts = shingles.votes(hashes[:200]) + shingles.votes(hashes[200:]) - shingles._TIES
    assert np.allclose(whole, parts, atol=1e-3)
    assert abs((whole > 0).mean() - 0.5) < 0.05


def keys(hashes, golay):
    return shingles.fuzzy_keys(shingles.codewords(shingles.votes(hashes), golay)[None])[0]


def test_similar_sets_share_a_key_and_unlike_ones_hardly_any():
    rng, golay = np.random.default_rng(2), Golay()
    accidents = 0
    for a, b, both in [(0, 1, 4), (1, 1, 8), (0, 2, 8), (2, 2, 16), (10, 10, 80), (0, 40, 160)] * 20:
        x = rng.integers(0, 1 << 63, a + b + both, np.uint64)
        left, right = x[: a + both], x[a:]
        assert (keys(left, golay) == keys(right, golay)).any()
        apart = (shingles.votes(left)[: shingles.SKETCH] > 0) != (shingles.votes(right)[: shingles.SKETCH] > 0)
        assert apart.sum() <= shingles.most_bits(0.8)
        accidents += (keys(left, golay) == keys(rng.integers(0, 1 << 63, 50, np.uint64), golay)).sum()
    assert accidents <= 1


def test_a_crowd_just_below_and_strays(spark, monkeypatch):
    """Copies that differ from each other by a little too much, a few links among them, texts of their own beside."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        copy = list(base)
        for at in rng.choice(120, 1 + i % 3, replace=False):
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy)))
        rows.append((100 + i, " ".join(f"z{i}q{k}" for k in range(60))))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_groups(rows)
    for paired in (16, 4):
        monkeypatch.setattr(shingles, "PAIRED", paired)
        assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == want
