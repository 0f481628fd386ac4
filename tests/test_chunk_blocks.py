"""Section-aware chunks, overlaps of neighbours, groups and text vectors, on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions import vectors as V
from gritstone.operators import chunking as C
from gritstone.operators import governance as G
from gritstone.operators import groups as S
from gritstone.operators import retrieval as R

BLOCKS = "doc long, ord long, text string, kind string, page int, section_path array<string>, char_start long"


def prose(n, word="word"):
    return " ".join(f"{word.capitalize()} number {i} says a thing of some length here." for i in range(n))


def chunked(spark, blocks, **args):
    df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(blocks)], BLOCKS).repartition(3)
    return C.chunk_blocks(df, **({"size": 200, "overlap": 50, "least": 20} | args)).orderBy("chunk_index").collect()


def plainly(units, size, overlap, aware, respect):
    """Windows of (tokens, top) by the rule as it reads."""
    out, start = [], 0
    while start < len(units):
        total, end = 0, start
        while end < len(units):
            if total + units[end][0] > size and end > start:
                break
            if end > start and units[end][1] != units[start][1] and (aware or (respect and total >= size * 0.5)):
                break
            total += units[end][0]
            end += 1
        out.append((start, end))
        if end >= len(units):
            break
        carried, back = 0, end
        while back > start + 1 and carried < overlap:
            carried += units[back - 1][0]
            back -= 1
        start = max(back, start + 1)
    return out


@pytest.mark.parametrize("aware, respect", [(True, True), (False, True), (False, False)])
def test_streamed_windows_are_those_of_the_rule(aware, respect):
    rng = random.Random(3)
    for _ in range(300):
        units = [(rng.choice([1, 5, 20, 60]), rng.choice("aab")) for _ in range(rng.randrange(0, 40))]
        packer, got, at = C.Packer(50, 12, aware, respect), [], 0
        for i, (n, top) in enumerate(units):
            got += packer.feed((i, n, None, [top], None, None))
        if packer.units:
            got.append(packer.finish())
        assert [(w[0][0], w[-1][0] + 1) for w in got] == plainly(units, 50, 12, aware, respect)


def test_provenance(spark):
    got = chunked(spark, [(prose(40), "paragraph", 3, ["3 Model", "3.2 Attention"], 100)])
    assert len(got) > 1 and all((c.page_start, c.page_end, c.section_path) == (3, 3, ["3 Model", "3.2 Attention"]) for c in got)
    assert [c.chunk_index for c in got] == list(range(len(got)))
    text = prose(40)
    assert all(text[c.char_start - 100 : c.char_end - 100] == c.text for c in got)


def test_pages_span_headings_are_left_out_and_slivers_dropped(spark):
    got = chunked(spark, [("3 Model", "heading", 1, None, 0), (prose(4), "paragraph", 1, [], 8), ("  ", "paragraph", 9, [], 0), (prose(4), None, 2, ["A"], None)], size=800)
    assert len(got) == 1 and (got[0].page_start, got[0].page_end, got[0].section_path) == (1, 2, ["A"]) and not got[0].text.startswith("3 Model")
    assert [c.text for c in chunked(spark, [("One short line.", "paragraph", None, None, None)])] == ["One short line."]
    assert chunked(spark, []) == [] == chunked(spark, [(None, "paragraph", 1, [], 0), ("\n", "code", 1, [], 0)])


def test_sections_are_never_merged_when_aware(spark):
    blocks = [(prose(3, "intro"), "paragraph", 1, ["1 Introduction"], 0), (prose(3, "related"), "paragraph", 1, ["2 Related"], 500)]
    got = chunked(spark, blocks, size=800, overlap=10, least=5, strategy=C.HEADING_AWARE)
    assert {c.section_path[0] for c in got} == {"1 Introduction", "2 Related"} and all(("Intro" in c.text) != ("Related" in c.text) or c.chunk_index for c in got)
    assert len(chunked(spark, blocks, size=800)) == 1
    with pytest.raises(ValueError):
        chunked(spark, blocks, strategy="other")


def test_atomic_blocks_stay_whole_and_giant_sentences_are_cut(spark):
    assert [c.units for c in chunked(spark, [("def f():\n    return 1. Then more. And more.", "code", 1, [], 0)])] == [1]
    giant = chunked(spark, [("word " * 3000, "paragraph", 1, [], 0)])
    assert len(giant) > 10 and all(c.token_count <= 240 for c in giant)


def test_longest_overlap_by_brute_force():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("xy") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        assert C.longest_overlap(a, b) == max(n for n in range(min(len(a), len(b)) + 1) if a[len(a) - n :] == b[:n])


def test_chunks_put_together_are_the_source(spark):
    docs = spark.createDataFrame([(1, prose(200)), (2, "ha ha ha. " * 900), (3, None), (4, "One. " + "x" * 9000 + ". Two.")], "id long, text string")
    made = C.chunk(docs)
    units = {r.id: " ".join(r.u) for r in docs.select("id", C.units(F.coalesce("text", F.lit(""))).alias("u")).collect()}
    assert {r.id: r.text for r in C.concatenate(made).collect()} == {k: v for k, v in units.items() if v}
    words = C.neighbour_overlap(made.where("id = 1"))
    assert words.count() == made.where("id = 1").count() - 1 and words.where("words = 0").count() == 0
    assert C.overlap_report(made.where("id = 1")).first().share == 1.0


def test_groups_by_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(12)] for _ in range(12)]
    rows = [(f"r{i:04d}", [w if rng.random() > 0.05 else f"w{rng.randrange(400)}" for w in rng.choice(base)]) for i in range(250)] + [("e1", []), ("e2", []), ("n", None), ("z", ["w1"]), ("z", ["w1"])]
    sets = {i: frozenset(x or ()) for i, x in rows}
    classes = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else i for i in sets}
    reps = sorted(set(classes.values()))
    near = {a: {b for b in reps if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])} for a in reps}
    group = {}
    for a in reps:
        if a not in group:
            seen, todo = {a}, [a]
            while todo:
                todo += [b for b in near[todo.pop()] if b not in seen and not seen.add(b)]
            group |= dict.fromkeys(seen, min(seen))
    want = sorted((i, classes[i], group[classes[i]], len(near[classes[i]])) for i, _ in rows)
    df = spark.createDataFrame(rows, "id string, items array<string>")
    assert any(len(n) > 5 for n in near.values())
    for chunk in (7, 2048):
        assert sorted(map(tuple, S.similar_groups(df, 0.75, chunk).collect())) == want


def test_near_copies_give_a_row_each(spark):
    rows = [(f"q{i:03d}", f"what are the limits of method alpha beta gamma delta epsilon zeta eta theta v{i}") for i in range(400)] + [("o", "What is it?"), ("p", "what  is it?\n")]
    found = S.similar_groups(spark.createDataFrame(rows, "id string, question string").select("id", G.question_items(F.col("question")).alias("items")), 0.75).collect()
    assert len(found) == 402 and {r.group_id for r in found} == {"q000", "o"} and {r.links for r in found} == {399, 0}
    assert {r.class_id for r in found if r.id in "op"} == {"o"}


def test_long_chains_are_one_component(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v").union(spark.range(5).selectExpr("id + 1000 as u", "2000 as v"))
    roots = {}
    for r in S.connected_components(edges).collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [6, 301]
    assert S.connected_components(edges.limit(0)).count() == 0


def by_hand(text, dimension):
    """The embedder as specified, token by token."""
    import hashlib
    import re

    v = np.zeros(dimension)
    for token in re.findall("[a-z0-9]+", (text or "").lower()) or [""]:
        seed = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big")
        for i, b in enumerate(np.random.RandomState(seed & 0xFFFFFFFF).normal(loc=0.0, scale=1.0, size=8)):
            v[(seed % dimension + i) % dimension] += (1.0 if (seed >> 32) % 2 == 0 else -1.0) * float(b)
    return v / np.linalg.norm(v)


def test_text_vectors(spark):
    texts = ["Attention is all you need", "attention IS need", "cats", "", None, "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: np.array(r.v) for r in V.embed(df).collect()}
    assert all(len(got[i]) == 384 and np.allclose(got[i], by_hand(t, 384), atol=1e-12) for i, t in enumerate(texts))
    assert got[0] @ got[1] > got[0] @ got[2] and V.embed(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["cosine", "l2", "ip"])
def test_nearest_by_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(200)] + [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(30)] + [(400, None), (401, [0.0] * 5), (402, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in (0, 7, 205, 231)] + [("none", None)], "qid string, q array<double>")
    score = {
        "ip": lambda a, b: a @ b,
        "cosine": lambda a, b: min(1.0, max(0.0, a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))) if a.any() and b.any() else 0.0,
        "l2": lambda a, b: 1 / (1 + ((a - b) ** 2).sum()),
    }[kind]
    want = []
    for q in (0, 7, 205, 231):
        each = sorted((-round(float(score(np.array(rows[q][1]), np.array(v))), 6), i) for i, v in rows if v and len(v) == 5)
        want += [(f"q{q}", i, r + 1, -s) for r, (s, i) in enumerate(each[:6])]
    for block in (2, 4096):
        got = sorted((r.qid, r.id, r["rank"], round(r.score, 6) + 0.0) for r in R.nearest(vectors, asked, 6, kind, block).collect())
        assert got == sorted(want)
    assert R.nearest(vectors.limit(0), asked, 6).count() == 0 == R.nearest(vectors, asked.limit(0), 6).count()
