"""Segments of an index, its key, what its scan reads; upserts."""

import random

import pytest
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators import curation, governance
from gritstone.operators import retrieval as R
from gritstone.sources import keyword_index as X

DOCS = "id long, grp string, text string"


def corpus(n, seed, first=0):
    rng = random.Random(seed)
    return [(first + i, "ab"[i % 2], " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 20)))) for i in range(n)]


def scores(index, q):
    return {(r.qid, r.grp, r.id): round(r.score, 9) for r in R.bm25(index, q).collect()}


def test_segments_weigh_like_an_index_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SEGMENTS", 3)
    q = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4 w4 zz"), (3, None)], "qid long, question string")
    held = {r[0:2]: r for r in corpus(40, 1)}
    index = X.build(spark.createDataFrame(list(held.values()), DOCS), str(tmp_path))
    for step, new in enumerate((corpus(10, 2, 100), corpus(12, 3, 30), [(5, "b", "w1 w1"), (7, "b", "")], corpus(5, 4, 200))):
        held |= {r[0:2]: r for r in new}
        index = X.extend(index, spark.createDataFrame(new, DOCS), str(tmp_path))
        anew = X.build(spark.createDataFrame(list(held.values()), DOCS), str(tmp_path / "anew"))
        assert scores(index, q) == scores(anew, q)
        assert index.segments == (2, 3, 1, 2)[step] and index.manifest.drop("corpus_hash", "segments").first() == anew.manifest.drop("corpus_hash", "segments").first()


def test_an_index_is_found_again_unless_the_tokenizer_changes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(corpus(9, 5), DOCS)
    one, two = X.build(docs, str(tmp_path)), X.build(docs.orderBy(F.desc("id")), str(tmp_path))
    assert one.postings.inputFiles() == two.postings.inputFiles()
    monkeypatch.setattr(T, "STOPWORDS", [*T.STOPWORDS, "w1"])
    other = X.build(docs, str(tmp_path))
    assert other.postings.inputFiles() != one.postings.inputFiles() and other.postings.where("term = 'w1'").count() == 0 < one.postings.where("term = 'w1'").count()
    assert other.manifest.first().tokenizer != one.manifest.first().tokenizer


def test_query_terms_reach_the_scan_and_many_are_joined(spark, tmp_path, monkeypatch, capsys):
    index = X.build(spark.createDataFrame(corpus(30, 6), DOCS), str(tmp_path))
    q = spark.createDataFrame([(1, "w1 w2 w3")], "qid long, question string")
    want = scores(index, q)
    R.bm25(index, q).explain("formatted")
    assert "In(term, [w1,w2,w3])" in capsys.readouterr().out
    monkeypatch.setattr(R, "TERMS", 2)
    assert scores(index, q) == want


def test_empty_corpus_and_questions(spark, tmp_path):
    index = X.build(spark.createDataFrame([], DOCS), str(tmp_path))
    assert scores(index, spark.createDataFrame([(1, "w1")], "qid long, question string")) == {}
    assert index.manifest.first().documents == 0


def test_upserts_keep_the_last_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "id long, status string, at int")
    new = spark.createDataFrame([(2, "b", 5), (2, "z", 4), (3, "c", 1), (3, "c", 1)], "id long, status string, at int")
    assert sorted(map(tuple, governance.upsert(old, new, "id", F.col("at")).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 1)]
    assert sorted(map(tuple, governance.upsert(old, new, "id").collect())) == [(1, "a", 1), (2, "z", 4), (3, "c", 1)]
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [2.0, 0.0])], "id long, v array<double>")
    assert curation.upsert_vectors(vectors.limit(0), vectors, 2).collect() == [(1, [2.0, 0.0])]
    with pytest.raises(Exception, match="dimension"):
        curation.upsert_vectors(vectors.limit(0), vectors, 3).collect()


def test_question_key_strips_all_white_space(spark):
    rows = spark.createDataFrame([("a", " What\tis it? \n"), ("b", "what is it?"), ("c", " WHAT  is it?"), ("d", "other")], "id string, question string")
    assert [tuple(r) for r in governance.duplicate_groups(rows).collect()] == [("what is it?", 3, "a,b,c")]
