import math
import random

import numpy as np
import pytest
from tests.llm.same import by_spark, by_sql

from gritstone.llm import vptree

SCHEMA = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")


def f32(x):
    return float(np.float32(x))


def brute(rows, every, k):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in sound:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        near = sorted((math.sqrt(sum_in_order(v, w)), i) for i, w in sound if i != q and len(w) == len(v))
        out += [(q, n + 1, d, i) for n, (d, i) in enumerate(near[:k])]
    return sorted(out, key=repr)


def sum_in_order(v, w):
    s = 0.0
    for x, y in zip(v, w):
        s += (x - y) * (x - y)
    return s


def found(df):
    return sorted(((r["query_id"], r["rank"], r["score"], r["vec_id"]) for r in df.collect()), key=repr)


def test_query_by_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert by_spark(vptree.op12_vptree(spark, sf)) == by_sql(vptree.OP12_SQL, "embeddings", f"{sf}/embeddings.parquet")


@pytest.mark.parametrize("shard_rows, leaf, block", [(30, 4, 3), (1000, 16, 100)])
def test_exact_by_brute_force_with_copies_and_unsound_rows(spark, shard_rows, leaf, block):
    rng = random.Random(7)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(80)] + [(30, rows[40][1]), (30, rows[41][1]), (77, rows[77][1]), (77, rows[77][1])]
    rows += [(None, [1.0] * 6), (40, None), (50, []), (60, [0.0] * 6), (70, [1.0, NAN, 0.0, 0.0, 0.0, 0.0]), (80, [INF] * 6), (90, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2000, [1.0, 2.0]), (2001, [3.0, 2.0]), (2010, [f32(1e30), 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", shard string, rank int")
    index = vptree.build(df, shard_rows=shard_rows, sample=50, leaf=leaf)
    assert found(vptree.search(index, df.where("vec_id % 10 = 0"), k=7, block=block)) == brute(rows, 10, 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)
    assert vptree.search(vptree.build(none), one).collect() == [] == vptree.search(vptree.build(one), none).collect() == vptree.search(vptree.build(one), one).collect()


def clustered(n, seed=3, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim)) * 3
    return (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.4).astype(np.float32)


def test_greater_factors_meet_fewer_rows_at_a_recall_above_nine_tenths():
    points = clustered(4000)
    ids = np.arange(4000)
    tree = vptree.Tree.build(ids, points)
    queries, met, recall = points[:200], [], []
    exact = None
    for factor in (1.0, 1.5, 2.0):
        best = vptree.Best(ids[:200], queries, 10, np.full(200, np.inf))
        tree.search(best, factor)
        exact = best.ids if exact is None else exact
        met.append(best.met)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.ids.tolist(), exact.tolist())]))
    assert met[0] > met[1] > met[2] and met[0] < 200 * 4000 and recall[0] == 1 and min(recall) >= 0.9
    for i in range(200):  # factor one restores exact search
        d = vptree.distances(points, queries[i])
        d[i] = np.inf
        assert exact[i].tolist() == np.lexsort((ids, d))[:10].tolist()


def test_a_factor_below_one_is_refused(spark):
    one = spark.createDataFrame([(0, [1.0])], SCHEMA)
    with pytest.raises(ValueError):
        vptree.search(vptree.build(one), one, factor=0.5)
