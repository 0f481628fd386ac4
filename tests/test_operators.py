"""Behaviour of single operators on small frames."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.functions import vectors as V
from gritstone.operators import answers, chunking, evaluation, governance, retrieval
from gritstone.sources import keyword_index, markup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_keep_identifiers(spark):
    assert one(spark, T.tokenize(F.lit("The BGE-small-en-v1.5 and cs.CL, BM25."))) == ["bge-small-en-v1.5", "bge", "small", "en", "v1", "cs.cl", "cs", "cl", "bm25"]
    assert one(spark, T.tokenize(F.lit("not the of"))) == [] and one(spark, T.tokenize(F.lit(""))) == []


def test_markers(spark):
    text = "One【S1†L1-L4】 two [ S2 ] three [S1]​."
    plain = one(spark, T.normalize_markers(F.lit(text)))
    assert plain == "One[S1] two [S2] three [S1]."
    assert one(spark, T.markers(F.lit(plain))) == [1, 2] and one(spark, T.strip_markers(F.lit("A claim. [S1] [S2]"))) == "A claim."


def test_sentences_and_locator(spark):
    assert one(spark, T.sentences(F.lit('He left. "Why?" She said. no. (Yes)'))) == ["He left.", '"Why?', "She said. no.", "(Yes)"]
    assert one(spark, T.locator(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit(1), F.lit(3))) == "T | A > B | pp. 1-3"


def test_similarities(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))
    assert one(spark, V.similarity("cosine", a, b)) == 0.0 and one(spark, V.similarity("l2", a, b)) == pytest.approx(0.2) and one(spark, V.similarity("ip", a, b)) == -1.0
    with pytest.raises(ValueError):
        V.similarity("other", a, b)


def model_bm25(docs, query):
    n, df = len(docs), {}
    for d in docs.values():
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean, avg = sum(idf.values()) / len(idf), sum(map(len, docs.values())) / n
    idf = {t: (0.25 * mean if v < 0 else v) for t, v in idf.items()}
    return {k: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query if t in d) for k, d in docs.items()}


def test_bm25_against_a_plain_model(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(20)]
    docs = {i: [rng.choice(words) for _ in range(rng.randint(1, 30))] for i in range(40)}
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "id long, text string")
    q = spark.createDataFrame([(1, "w1 w1 w2"), (2, "w19 nothing"), (3, ""), (4, None)], "qid long, question string")
    got = {(r.qid, r.id): r.score for r in retrieval.bm25(keyword_index.build(keyword_index.corpus(df, "id", "text")), q).collect()}
    want = {(qid, k): s for qid, ts in ((1, ["w1", "w1", "w2"]), (2, ["w19"])) for k, s in model_bm25(docs, ts).items() if s > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("block", [1, 512])
def test_bm25_top_is_the_head_of_all_scores(spark, tmp_path, block):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "ab"[i % 2], " ".join(rng.choices(["red", "blue", "green", "gold"], k=rng.randint(0, 4)))) for i in range(60)], "id long, grp string, text string")
    index = keyword_index.build(docs, str(tmp_path))
    asked = spark.createDataFrame([(1, "red red blue"), (2, "gold green"), (3, "none"), (4, None)], "qid long, question string")
    hits = retrieval.bm25(index, asked).withColumn("of", F.struct("qid", "grp"))
    plain = lambda df: sorted((r.qid, r.grp, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert plain(retrieval.bm25_top(index, asked, 7, block=block)) == plain(retrieval.ranked(hits, 7, by="of"))


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", "dense", 1, 0.9, 1.0), (1, "b", "dense", 2, 0.5, 0.0), (1, "b", "sparse", 1, 9.0, 1.0), (2, "c", "sparse", 1, 7.0, 1.0)], "qid long, id string, source string, rank int, score double, normalized double")
    got = {(r.qid, r.id): r.score for r in retrieval.fuse(lists).collect()}
    assert got[1, "b"] == pytest.approx(1 / 62 + 1 / 61) and got[1, "a"] == pytest.approx(1 / 61) and got[2, "c"] == 7.0
    got = {(r.qid, r.id): r.score for r in retrieval.weighted_sum(lists, {"dense": 1.0, "sparse": 3.0}).collect()}
    assert got[1, "b"] == pytest.approx(0.75)
    with pytest.raises(ValueError):
        retrieval.fuse(lists, "other")


def test_nearest_in_blocks(spark):
    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(50)], "id long, v array<double>")
    q = v.where("id < 9").selectExpr("id as qid", "v as q")
    key = lambda df: sorted((r.qid, r.id, r["rank"]) for r in df.collect())
    assert key(retrieval.nearest(v, q, 3, block=2)) == key(retrieval.nearest(v, q, 3))


def plain_windows(tokens, size, overlap):
    out, start = [], 0
    while start < len(tokens):
        total, end = 0, start
        while end < len(tokens) and (end == start or total + tokens[end] <= size):
            total += tokens[end]
            end += 1
        out.append((start, end))
        if end >= len(tokens):
            break
        carried, back = 0, end
        while back > start + 1 and carried < overlap:
            back -= 1
            carried += tokens[back]
        start = max(back, start + 1)
    return out


def test_nearest_makes_few_scores_at_once(spark, monkeypatch):
    rng = random.Random(6)
    vectors = spark.createDataFrame([(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(200)], "id long, v array<double>")
    asked = vectors.where("id % 20 = 0").selectExpr("id as qid", "v as q")
    plain = lambda: sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in retrieval.nearest(vectors, asked, 4, "l2").collect())
    whole = plain()
    monkeypatch.setattr(retrieval, "SCORES", 50)
    assert plain() == whole and len(whole) == 40


def test_windows_are_the_greedy_ones():
    rng = random.Random(3)
    for _ in range(500):
        tokens = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        size, overlap = rng.randint(5, 120), rng.randint(0, 30)
        assert list(chunking.windows(tokens, size, overlap)) == plain_windows(tokens, size, overlap)


def test_digits_at_the_end_of_a_sentence_stay(spark):
    text = "Call 10. Call 21\u00a0. (12 or 2) Ends in 2."
    assert one(spark, T.sentences(F.lit("A 0. B 21. C 2"))) == ["A 0.", "B 21.", "C 2"]
    assert one(spark, T.sentences(F.lit("\u00a0A 100 \u3000"))) == ["A 100"]
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    units = docs.select(chunking.units(F.col("text")).alias("u")).first().u
    assert units == ["Call 10.", "Call 21\u00a0.", "(12 or 2) Ends in 2."]


def test_concatenation_holds_units_of_dropped_windows(spark):
    parts = ["A" + "a" * 2598 + ".", "B" + "b" * 30 + ".", "C" + "c" * 2598 + "."]
    docs = spark.createDataFrame([(1, " ".join(parts))], "id long, text string")
    made = chunking.chunk(docs, overlap=0)
    assert [(r.first_unit, r.end_unit, r.skipped) for r in made.orderBy("chunk_index").collect()] == [(0, 1, None), (2, 3, parts[1])]
    assert chunking.concatenate(made).first().text == " ".join(parts)


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    sets = {i: sorted({rng.choice("abcdefgh") for _ in range(rng.randint(0, 7))}) for i in range(80)}
    got = {(r.a, r.b) for r in governance.similar_pairs(spark.createDataFrame(list(sets.items()), "id long, items array<string>"), 0.6).collect()}
    first = {}
    for i, s in sets.items():
        first.setdefault(tuple(s), i)
    want = {(a, b) for a in first.values() for b in first.values() if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert got == want


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, s string, t int")
    assert sorted((r.k, r.s) for r in governance.latest(rows, "k", F.col("t")).collect()) == [(1, "b"), (2, "c")]
    assert sorted((r.k, r.s) for r in governance.upsert(rows.where("t = 1"), rows.where("t = 2"), "k").collect()) == [(1, "b"), (2, "c")]


def test_bootstrap_covers_the_mean(spark):
    got = evaluation.bootstrap_interval(spark.range(400).selectExpr("id", "cast(id % 5 as double) as diff")).first()
    assert got.low < 2 < got.high and got.high - got.low < 0.6


def test_context_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, 10, 1, "x" * 400), (1, 11, 2, "x" * 9000), (1, 12, 3, "x" * 400), (2, 13, 1, "x" * 90000)], "qid long, id long, rank int, text string")
    got = sorted((r.qid, r.id, r.marker) for r in answers.pack_context(hits, 1000).collect())
    assert got == [(1, 10, 1), (1, 12, 2), (2, 13, 1)]


def test_claims_are_checked(spark):
    rows = spark.createDataFrame([("The model reached 3.1 points", "the model has reached 3.1 points"), ("It reached 4.5 points", "it reached 3.1 points"), ("", None)], "claim string, evidence string")
    assert [(r.numbers_ok, r.supported) for r in answers.check_claims(rows).collect()] == [(True, True), (False, False), (True, False)]


PAGE = """<html><head><title>T - Site</title><style>p{}</style></head><body><nav><p>menu</p></nav><article><h1>Top</h1><p>one <b>two<br>three<p>four</p>
<div class="sidebar"><p>ad</p></div><h2>Part</h2><pre>a
  b</pre><ul><li>x</li></ul><table><tr><th>h</th><td>1</td></tr><tr><td>2</td></tr></table><p>...</p></article><footer><p>f</p></footer></body></html>"""


def test_html():
    got = markup.parse_html(PAGE)
    assert [(k, t) for k, t, _ in got] == [("heading", "Top"), ("paragraph", "one two three"), ("paragraph", "four"), ("heading", "Part"), ("code", "a\n  b"), ("list", "x"), ("table", "h | 1\n2")]
    assert markup.parse_html(None) == []


def test_markdown():
    text = "---\nt: 1\n---\n# A\n\nText one\nmore\n\nSub\n---\n```py\n# no\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n- y\n"
    got = markup.parse_markdown(text)
    assert [(k, lv) for k, _, lv in got] == [("heading", 1), ("paragraph", None), ("heading", 2), ("code", None), ("table", None), ("list", None)]
    assert got[1][1] == "Text one more" and re.search("# no", got[3][1])


def test_block_paths(spark):
    rows = markup.markdown_blocks(spark.createDataFrame([(1, "# A\n\n## B\n\nt\n\n# C\n\nu"), (2, None)], "id long, text string")).orderBy("ord").collect()
    assert [(r.text, r.section_path) for r in rows] == [("A", []), ("B", ["A"]), ("t", ["A", "B"]), ("C", []), ("u", ["C"])]
