import random

import corpus_pipeline
from gritstone.llm import shingles, simhash


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """doc_id -> smallest doc_id of its component, from all pairs of texts."""
    of = {d: d for d, _ in rows}
    sets = {d: brute_sets(t) for d, t in rows}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((root(a), root(b)))
                of[q] = p
    return {d: root(d) for d in ids}


def edited():
    """Texts of 100 words and copies with a changed sentence or a few edited words, some of them too far."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 100, 300]))]
        rows.append(base)
        for edits in (1, 1, 2, 3, 5):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = word()
            rows.append(copy)
        at = rng.randrange(len(base) - 6)
        rows.append(base[:at] + [word() for _ in range(6)] + base[at + 6 :])
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(500, ""), (501, None), (502, "one two"), (503, "ONE  two"), (504, "one three")]


def test_stage_against_brute_force_jaccard(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert len(set(want.values())) < len(rows) - 30  # most of the copies are linked
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == want
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_chunks_of_large_buckets_find_the_same(spark, monkeypatch):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(shingles, "PAIRED", 1)
    monkeypatch.setattr(shingles, "CHUNK_SHINGLES", 250)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == brute_groups(rows)


def test_table_against_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want.values()))


def test_chain_and_least_of_a_bucket(spark):
    """A copy that is far from the least set of its bucket is still compared with the others."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(25):
        copy = list(words)
        for k in range(4 * i, 4 * i + 4):
            copy[k] = f"x{k % 7}{i}"
        words = copy
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == brute_groups(rows)


def test_width_and_similarity_count(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (None, "z")], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(docs).collect()) == [-1, 1, 2]  # 5 of 7
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(docs, similarity=0.7).collect()) == [-1, 1]
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(docs, width=1).collect()) == [-1, 1]  # 9 of 11
