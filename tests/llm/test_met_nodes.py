"""What meets under a key of the near-duplicate stage: accidents make no rows, settled pairs neither."""

import numpy as np
import pyarrow as pa

from gritstone.llm import shingles

SCHEMA = "node long, first long, size int, sketch array<long>, words binary"


def test_unlike_nodes_of_the_same_codes_do_not_meet(spark):
    """Fourteen nodes share every key; the sketches of eight are alike, one of which is too small."""
    words, drawn = bytes(2 * shingles.FINGERPRINTS * shingles.WORDS), np.random.default_rng(4).integers(-(1 << 63), 1 << 63, (14, 4), np.int64)
    drawn[5:13] = drawn[5] ^ (np.int64(1) << np.arange(8, dtype=np.int64))[:, None]
    rows = [(i, i, 10 if i == 9 else 100, drawn[i].tolist(), words) for i in range(14)]
    met = shingles._met(spark.createDataFrame(rows, SCHEMA), 0.8)
    got = {(r.node, r.least, r.n): r["count"] for r in met.groupBy("node", "least", "n").count().collect()}
    assert got == {(i, 5, 7): 4 * shingles.SLICES for i in range(5, 13) if i != 9}


def test_clusters_hang_together_and_go_on_in_the_next_batch():
    """A chain whose ends are unlike is one cluster, strays are none, wherever the batches end."""
    rng = np.random.default_rng(2)
    code, node, bits = [], [], []
    for c, n in enumerate([1, 2, 30, 2, 5, 300]):
        x = rng.integers(-(1 << 63), 1 << 63, None, np.int64)
        for i in range(n):
            x = x ^ (np.int64(1) << np.int64(2 * i % 63)) ^ (np.int64(1) << np.int64((2 * i + 1) % 63))
            code.append(c), node.append(1000 * c + i), bits.append(x)
    table = pa.table({"code": code, "node": node, "size": pa.array([9] * len(code), pa.int32()), "bits": bits})
    for rows in (1, 7, 1000):
        got = pa.Table.from_batches(list(shingles._clustered(0.8)(iter(table.to_batches(rows)))))
        assert sorted(got["node"].to_pylist()) == [x for x in node if x >= 1000]
        assert all(least == 1000 * c for c, least in zip(got["code"].to_pylist(), got["least"].to_pylist()))
        assert {(c, n) for c, n in zip(got["code"].to_pylist(), got["n"].to_pylist())} == {(1, 2), (2, 30), (3, 2), (4, 5), (5, 300)}


def test_no_rows_for_pairs_that_a_component_or_a_group_has_settled(spark):
    rng = np.random.default_rng(3)
    rows = [(k, n, n // 3 if n < 60 else n, [None, 0, 1][n % 3]) for k in range(20) for n in rng.choice(90, 12, replace=False).tolist()]
    want = set()
    for k in range(20):
        here = [r for r in rows if r[0] == k]
        want |= {(a[1], b[1]) for a in here for b in here if a[1] < b[1] and a[2] != b[2] and (a[3] is None or b[3] is None or a[3] != b[3])}
    got = shingles._unsettled(spark.createDataFrame(rows, "key long, node long, root long, grp long"))
    assert sorted((r.u, r.v) for r in got.collect()) == sorted(want)
    assert "LeftOuter" not in got._jdf.queryExecution().toString()
