"""Phrases that questions hold, against all pairs, and what is shuffled and counted for them."""

import random

from pyspark.sql import functions as F

from gritstone.operators import attribution as D


def tables(spark, seed):
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice(["a", "b", "é1", "w"]) for _ in range(k))
    names = [(rng.choice([None, *range(9)]) if k % 5 else 100 + k, words(rng.choice([1, 1, 2, 3, 24, 25, 30]))) for k in range(60)] + [(7, ""), (200, "b"), (201, "b"), (202, "b")]
    asked = [(rng.randrange(30), words(rng.choice([1, 2, 5, 40, 60]))) for _ in range(40)] + [(98, ""), (99, None)]
    asked += [(50 + k, f"w {p} w") for k, (_, p) in enumerate(names[:20])]
    pairs = {(q, d) for q, text in asked for d, p in names if p and text and f" {p} " in f" {text} "}
    return spark.createDataFrame(asked, "qid long, q string").repartition(3), spark.createDataFrame(names, "doc long, phrase string"), pairs


def test_phrases_of_any_length_and_documents_of_any_number_of_phrases(spark):
    for seed in range(2):
        asked, names, pairs = tables(spark, seed)
        got = [(r.qid, r.doc) for r in D.phrases_held(asked, names).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs and any(d is None for _, d in pairs)


def test_counts_are_those_of_the_pairs(spark):
    asked, names, _ = tables(spark, 3)
    names = names.where(~F.contains("phrase", F.lit("é")))
    plain = asked.select("qid", F.translate("q", "é", "e").alias("question"))
    pairs = D.named_documents(plain, names).groupBy("qid").agg(F.count("*").alias("n"), F.min("doc").alias("target"))
    assert sorted(map(tuple, D.named_counts(plain, names).collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)


def test_runs_that_are_no_phrase_make_no_rows(spark):
    text = " ".join(f"x{i}" for i in range(500))
    asked = spark.createDataFrame([(1, text), (2, "x499"), (3, "x0 x1 y"), (4, "x1"), (5, "x2 x3")], "qid long, q string").coalesce(1)
    bits, lengths = D.phrase_bits(spark.createDataFrame([("x1 x2", 2), ("x0", 1), ("x2 x3 x4", 3), ("x499 x0", 2)], "run string, n int"))
    assert lengths == [1, 2, 3]
    assert sorted((r.qid, r.run) for r in D.runs_known(asked, lengths, bits).collect()) == [(1, "x0"), (1, "x1 x2"), (1, "x2 x3 x4"), (3, "x0")]


def test_documents_of_one_title_are_counted_without_their_pairs(spark):
    titles = spark.range(400).select(F.col("id").alias("doc"), F.lit("same: title").alias("title"))
    asked = spark.range(300).select(F.col("id").alias("qid"), F.lit("Same title?").alias("question"))
    found = D.named_counts(asked, D.name_index(titles))
    rows = found.collect()
    assert {(r.n, r.target) for r in rows} == {(400, 0)} and len(rows) == 300
    plan, sizes = found._jdf.queryExecution().executedPlan(), []

    def visit(node):
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            sizes.append(metrics.apply("numOutputRows").value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        for child in inner or [node.children().apply(i) for i in range(node.children().size())]:
            visit(child)

    visit(plan)
    assert sizes and max(sizes) <= 900  # 120,000 pairs
