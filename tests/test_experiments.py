"""Paired intervals and decisions, blended ranks, query pools; headings, wrapped blocks and titles, on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import experiments as X
from gritstone.operators import titles as H

DIFFS = "setting string, id long, diff double"


def intervals(spark, rows, **args):
    return {r.setting: r for r in X.decide(X.paired_intervals(spark.createDataFrame(rows, DIFFS).repartition(3), **args)).collect()}


def test_intervals_agree_with_resampling_by_index(spark):
    rng = np.random.default_rng(3)
    diffs = rng.choice([-1.0, 0.0, 0.0, 1.0, 1.0], 400)
    got = intervals(spark, [("a", i, float(d)) for i, d in enumerate(diffs)])["a"]
    means = np.sort(rng.choice(diffs, (4000, 400)).mean(axis=1))
    assert got.n == 400 and abs(got.mean - diffs.mean()) < 1e-12
    assert abs(got.low - means[100]) < 0.02 and abs(got.high - means[3899]) < 0.02


def test_decisions(spark):
    rows = [("up", i, 0.5 + 0.01 * (i % 3)) for i in range(50)] + [("down", i, -0.5) for i in range(50)] + [("mixed", i, float((-1) ** i)) for i in range(50)] + [("nulls", 1, None)]
    got = intervals(spark, rows, resamples=200)
    assert {k: r.change for k, r in got.items()} == {"up": True, "down": False, "mixed": False}
    assert got["down"].high < 0 and got["mixed"].low < 0 < got["mixed"].high
    assert intervals(spark, rows, resamples=200) == got and intervals(spark, []) == {}
    assert intervals(spark, [("one", 7, 1.0)], resamples=50)["one"].low == 1.0


def test_settings_against_the_baseline(spark):
    metrics = spark.createDataFrame([("base", 1, 0.5, 1.0), ("base", 2, 0.0, 0.0), ("new", 1, 1.0, 1.0), ("new", 2, 0.0, 0.5), ("new", 3, 1.0, 1.0)], "label string, qid long, recall double, mrr double")
    got = sorted(map(tuple, X.against_baseline(metrics, "base", "recall", "mrr").collect()))
    assert got == [("base|mrr", 1, 0.0), ("base|mrr", 2, 0.0), ("base|recall", 1, 0.0), ("base|recall", 2, 0.0), ("new|mrr", 1, 0.0), ("new|mrr", 2, 0.5), ("new|recall", 1, 0.5), ("new|recall", 2, 0.0)]


def test_blended_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 5, 1)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "qid long, id long, rank int")
    got = {(r.qid, r.id): r.score for r in X.blend_ranks(a, b, 10).collect()}
    want = {(1, 10): 1 / 11 + 1 / 13, (1, 20): 1 / 12 + 1 / 11, (1, 30): 1 / 13 + 1 / 12, (2, 5): 1 / 11 + 1 / 11}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_identifiers(spark):
    text = "Uses gpt-4o and bge-reranker.v2 with camelCase, GPT4, BERT, co-op, the gpt-4o again; a1 plain"
    assert spark.createDataFrame([(text,)], "t string").select(X.identifiers(F.col("t"))).first()[0] == ["gpt-4o", "bge-reranker.v2", "camelCase", "co-op"]


def test_quotas_refill_from_one_another(spark):
    rng = random.Random(1)
    rows = [("a", rng.randrange(1000), i) for i in range(40)] + [("b", rng.randrange(1000), i) for i in range(3)] + [("c", rng.randrange(1000), i) for i in range(9)] + [("other", 1, 1)]
    df = spark.createDataFrame(rows, "family string, at long, id long")
    got = X.fill_quotas(df, {"a": 10, "b": 10, "c": 5, "d": 2}).collect()
    own = {f: sorted((r.at, r.id) for r in got if r.family == f) for f in "abc"}
    assert len(got) == 27 and {f: len(x) for f, x in own.items()} == {"a": 15, "b": 3, "c": 9}
    assert all(own[f] == sorted((a, i) for g, a, i in rows if g == f)[: len(own[f])] for f in own) and sum(r.refill for r in got) == 9
    assert X.fill_quotas(df, {"a": 5, "c": 5}).groupBy("family").count().collect() == X.fill_quotas(df.where("family in ('a', 'c')"), {"a": 5, "c": 5}).groupBy("family").count().collect()
    assert X.fill_quotas(df.where("family = 'b'"), {"a": 2, "b": 2}).count() == 3 and X.fill_quotas(df.limit(0), {"a": 2}).count() == 0


def test_candidates_are_of_long_chunks_and_whole_queries(spark):
    long = "The encoder-v2 maps several sentences into vectors of fixed length. " * 12
    df = spark.createDataFrame([(1, 1, long), (2, 1, "too short"), (3, 2, None), (4, 2, "zz " * 300)], "id long, doc long, text string")
    got = {(r.family, r.id): r.query for r in X.candidates(df).collect()}
    assert set(got) == {("identifier", 1), ("term_bag", 1), ("verbatim_sentence", 1)} and got["identifier", 1].endswith("encoder-v2")


def test_abstract_queries(spark):
    claim = "We claim that a sentence of an abstract is found again in the body of the same paper."
    rows = [(1, 1, "Abstract", claim), (2, 1, "Body", "x"), (3, 1, None, "y"), (4, 1, "1 Intro", None), (5, 2, "abstract", claim), (6, 2, "Body", "x"), (7, 3, "Abstract", "Short."), (8, 3, "B", "x"), (9, 3, "B", "x"), (10, 3, "B", "x"), (11, 4, "B", "x")]
    got = X.abstract_queries(spark.createDataFrame(rows, "id long, doc long, section string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, claim, [2, 3, 4], [1])]


def level(spark, text, size=10.0, bold=False, font="Regu", body=10.0):
    df = spark.createDataFrame([(text, size, bold, font, body)], "t string, s double, b boolean, f string, y double")
    return df.select(H.heading_level(F.col("t"), F.col("s"), F.col("y"), F.col("b"), F.col("f"), F.lit("Regu"))).first()[0]


@pytest.mark.parametrize(
    "text, args, want",
    [
        ("3 Model Architecture", {}, 1), ("3.2.1 Scaled Attention", {}, 3), ("13 relations", {}, None), ("1 ≤2 sup", {}, None), ("87 Large Numbers", {}, None), ("4 RESULTS AND MORE", {}, 1),
        ("2 The way of an idea into prose", {}, None), ("5 The Net", {}, 1), ("1 A = B Holds", {}, None), ("II. BACKGROUND", {}, 1), ("B. Protocol and Metrics", {}, 2), ("A. Clements, D. O. Joly", {}, None),
        ("S. Hirche wrote a rather long sentence that goes on and on over many words here", {}, None), ("Introduction", {}, 1), ("references:", {}, 1), ("Body text.", {"size": 20.0, "bold": True}, None), ("Big Bold", {"size": 14.0, "bold": True}, 1),
        ("Big Bold", {"size": 12.6, "bold": True}, 2), ("Big Bold", {"size": 11.6, "bold": True}, 3), ("Big", {"size": 14.0}, None), ("Medium Font", {"font": "NimbusMedi", "size": 9.0}, 2), ("Medium, Font", {"font": "NimbusMedi"}, None),
        ("Tiny", {"font": "NimbusMedi", "size": 7.0}, None), ("42.9", {"size": 20.0, "bold": True}, None), (None, {"size": 20.0, "bold": True}, None), ("Words", {"body": 0.0, "size": 20.0, "bold": True}, None),
    ],
)
def test_heading_levels(spark, text, args, want):
    assert level(spark, text, **args) == want


def test_runs_keep_the_place_where_they_began(spark):
    def block(i, text, level=None, size=10.0, x0=50.0, y0=0.0, page=1):
        return (1, page, i, text, level, size, x0, float(y0), float(y0 + 10))

    rows = [
        block(0, "A Long Title", 1, 16.0, y0=0), block(1, "Over Two Lines", 1, 16.4, y0=15), block(2, "2. Next", 1, 16.0, y0=30), block(3, "prose goes", y0=50), block(4, "on here.", y0=62), block(5, "then new", y0=75), block(6, "far away", y0=300),
        block(7, "other column", x0=300.0, y0=310), block(8, "above", x0=300.0, y0=20), block(9, "larger", size=12.0, x0=300.0, y0=35), block(0, "next page", y0=45, page=2),
    ]
    df = spark.createDataFrame(rows, "doc long, page int, ord int, text string, level int, size double, x0 double, y0 double, y1 double")
    got = [(r.page, r.ord, r.text, r.lines) for r in H.merge_blocks(df, 600.0, 800.0).orderBy("page", "ord").collect()]
    assert got == [(1, 0, "A Long Title Over Two Lines", 2), (1, 2, "2. Next", 1), (1, 3, "prose goes\non here.", 2), (1, 5, "then new", 1), (1, 6, "far away", 1), (1, 7, "other column", 1), (1, 8, "above", 1), (1, 9, "larger", 1), (2, 0, "next page", 1)]


def test_titles(spark):
    docs = spark.createDataFrame([(1, "s1", " Given ", "Meta"), (2, "s2", "", "Meta Title"), (3, "s3", None, "x.PDF"), (4, "s4", None, "12345"), (5, "s5", None, None)], "doc long, stem string, manifest_title string, meta_title string")
    blocks = spark.createDataFrame([(3, 1, 2, "Largest\n here", 20.0), (3, 1, 5, "Same size", 20.0), (3, 2, 1, "Larger later", 30.0), (4, 1, 1, "  ", 9.0)], "doc long, page int, ord int, text string, size double")
    got = {r.doc: (r.title, r.origin) for r in H.resolve_titles(docs, blocks).collect()}
    assert got == {1: ("Given", "manifest"), 2: ("Meta Title", "metadata"), 3: ("Largest here", "largest"), 4: ("s4", "stem"), 5: ("s5", "stem")}
    lines = spark.createDataFrame([(1, 1, 0, "and Risk", 1), (1, 1, 1, "Assessment:", 1), (1, 1, 2, "body", None), (1, 1, 3, "Abstract", 1), (1, 1, 4, "Risk Assessment", 2), (1, 2, 0, "and Risk", 1), (2, 1, 0, "Any", 1)], "doc long, page int, ord int, text string, level int")
    kept = H.drop_title_lines(lines, spark.createDataFrame([(1, "Models and Risk  Assessment")], "doc long, title string")).where("level is not null").orderBy("doc", "page", "ord").collect()
    assert [(r.doc, r.page, r.ord) for r in kept] == [(1, 1, 3), (1, 1, 4), (1, 2, 0), (2, 1, 0)]
