import math
import random

import numpy as np
import pytest
from tests.llm.same import by_spark, by_sql

from gritstone.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN = float("nan")


def f32(x):
    return float(np.float32(x))


def brute(rows, every=50):
    sound = []
    for i, v, label in rows:
        if i is None or label is None or not v or not all(x is not None and math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * c) for c in v]
        if sum(c * c for c in x) < 2**62:
            sound.append((i, x, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    anchors = {}
    for i, x, label in sound:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (x, label)), (x, label))
    out = []
    for a, (x, label) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in sound if i != a and len(y) == len(x))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, positive, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fit[:3])]
    return sorted(out)


def mined(rows_df, every=50, block=negatives.ANCHOR_BLOCK):
    rows_df = negatives.labelled(rows_df)
    return sorted(tuple(r) for r in negatives.mine(rows_df, rows_df.where(f"vec_id % {every} = 0"), block=block).collect())


def test_query_by_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert by_spark(negatives.op11_negatives(spark, sf)) == by_sql(negatives.OP11_SQL, "embeddings", f"{sf}/embeddings.parquet")


@pytest.mark.parametrize("block", [3, 2048])
def test_by_brute_force_with_ties_repeats_and_unsound_rows(spark, block):
    rng = random.Random(5)
    rows = [(i, [f32(rng.gauss(0.2, 0.5)) for _ in range(5)], rng.randrange(4)) for i in range(400)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(60)] + [(100, rows[7][1], 2), (100, rows[7][1], 1), (9, rows[9][1], rows[9][2])]
    rows += [(None, [1.0] * 5, 1), (150, None, 1), (200, [], 1), (250, [1.0, NAN, 0.0, 0.0, 0.0], 1), (300, [1.0, None, 0.0, 0.0, 0.0], 1), (350, [1.0] * 5, None), (1100, [f32(1e30)] * 5, 1), (1150, [1.0, 2.0], 3), (1151, [1.0, 2.5], 3), (1152, [0.9, 1.5], 2)]
    rows += [(1200, [0.0] * 5, 1), (-50, [f32(-0.3)] * 5, -3), (-49, [f32(-0.4)] * 5, -2), (1250, [f32(3e6)] * 5, 2), (1251, [f32(2.9e6)] * 5, 2), (1252, [f32(2e6)] * 5, 3)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", score long, anchor_id long")
    got = mined(df, block=block)
    assert got == brute(rows) and {r[0] for r in got} >= {50, 100, 1250}


def test_few_rows_and_empty_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.1], 1), (1, [0.8, 0.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_pass_over_rows_and_lose_none():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12)) * 200
    x = (centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 12)) * 4).astype(np.int64)
    rows, anchors = negatives.Candidates(np.arange(3000), np.zeros(3000, np.int64), x), x[:100]
    forest, seen = negatives.Forest(anchors), [set() for _ in range(100)]
    scores = anchors @ x.T
    lowest, highest = (0.5 * scores.max(axis=1)).astype(np.int64), (0.95 * scores.max(axis=1)).astype(np.int64)

    def met(at, need, s):
        assert (s == scores[at, need]).all()
        seen[at] |= set(need[(s >= lowest[at]) & (s <= highest[at])].tolist())

    forest.walk(anchors, rows, lambda at, low, high: (high >= lowest[at]) & (low <= highest[at]), met)
    assert forest.passed > forest.scored
    assert all(seen[a] == set(np.flatnonzero((scores[a] >= lowest[a]) & (scores[a] <= highest[a])).tolist()) for a in range(100))
