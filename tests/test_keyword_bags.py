"""Documents as bags of terms: counted where they are read."""

from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.sources import keyword_index as X

DOCS = "id long, grp string, text string"
ODD = ["a-b.c the-x I.I x--y", "K İx ſ é-éa A_b.", "the of", "", None, "1.0-beta_2 1.0-beta_2 -a- b..c", "Z.z.the.zz"]


def test_terms_and_postings_are_made_without_a_shuffle(spark, capsys):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"w{i % 7} x") for i in range(50)], DOCS)
    X._postings(X.count_terms(docs)).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_a_bag_holds_what_tokenize_gives(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").withColumn("grp", F.lit(""))
    got = {r.id: dict(zip(r.terms, r.f)) for r in X.count_terms(docs).collect()}
    want = {r.id: r.t for r in docs.select("id", T.tokenize(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    assert got == {k: {x: float(t.count(x)) for x in t} for k, t in want.items()}


def test_batches_of_bags_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(X, "BATCH_TERMS", 3)
    docs = spark.createDataFrame([(i, "a", " ".join(f"w{j}" for j in range(i % 6))) for i in range(40)], DOCS)
    assert sorted((r.id, len(r.terms), r.dl) for r in X.count_terms(docs).collect()) == [(i, i % 6, float(i % 6)) for i in range(40)]


def test_a_compound_of_many_parts(spark, tmp_path):
    """A pattern in the JVM overflows its stack on it."""
    index = X.build(spark.createDataFrame([(1, "a", "q." * 50_000 + "q")], DOCS), str(tmp_path))
    assert index.counts.count() == 1


def test_repeated_rows_are_one_document_and_rows_without_a_key_none(spark, tmp_path):
    rows = [(1, "a", "x y"), (1, "a", "y z"), (2, "a", ""), (2, "a", None), (3, "b", "x"), (None, "a", "x"), (4, None, "x")]
    index = X.build(spark.createDataFrame(rows, DOCS), str(tmp_path))
    assert sorted((r.grp, r.id, r.term, r.f, r.dl) for r in index.postings.collect()) == [
        ("a", 1, "", 0.0, 4.0), ("a", 1, "", 0.0, 4.0), ("a", 1, "x", 1.0, 4.0), ("a", 1, "y", 2.0, 4.0), ("a", 1, "z", 1.0, 4.0), ("a", 2, "", 0.0, 0.0), ("a", 2, "", 0.0, 0.0), ("b", 3, "", 0.0, 1.0), ("b", 3, "x", 1.0, 1.0)
    ]
    assert index.bags.count() == 3
