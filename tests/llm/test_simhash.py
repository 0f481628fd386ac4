import random

import numpy as np
import xxhash

from gritstone.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    """doc_id -> (fingerprint, component)."""
    fp = {d: brute_fp(t) for d, t in rows}
    of = {d: d for d in fp}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {d: (fp[d], root(d)) for d in ids}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = {d: (f"{f:016x}", c) for d, (f, c) in brute_components(rows).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_keys_meet_within_two_bits():
    rng = random.Random(1)
    golay = simhash.Golay()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << k
        row, key = simhash.fuzzy_keys(np.array([a, b], np.uint64), golay)
        assert set(key[row == 0]) & set(key[row == 1])


def test_code_is_perfect():
    golay = simhash.Golay()
    assert np.count_nonzero(golay.error) == (1 << 11) - 1
    index = np.arange(1 << 12)
    words = index << 11 | golay.of_high
    for error in (0, 1, 0x400001, 0x201008):
        assert np.array_equal(golay.decode(words ^ error), index)


def test_links_are_the_same_by_either_way(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(4)]
    fps = set()
    for b in base:
        for _ in range(60):
            x = b
            for k in rng.sample(range(63), rng.randint(0, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "fp long, first long")

    def components(pairs):
        of = {x: x for x in fps}

        def root(x):
            while of[x] != x:
                x = of[x]
            return x

        for u, v in pairs:
            a, b = sorted((root(u), root(v)))
            of[b] = a
        return {x: root(x) for x in fps}

    want = components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])
    for most in (1, 10_000):
        got = [(r.u, r.v) for r in simhash.links(df, most).collect()]
        assert all((u ^ v).bit_count() <= 2 for u, v in got)
        assert components(got) == want


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one", 1), (3, "one", 1), (4, "ONE", 2), (None, "one", 3), (5, "w " * 30_000, 1)], "doc_id long, text string, key long")
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
