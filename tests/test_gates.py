"""Gates, a second judge, references and versions left out, replayed attribution."""

from gritstone.operators import attribution as D
from gritstone.operators import gates as A

RUN, LIMITS = "metric string, score double", "metric string, threshold double"


def gated(spark, scores, limits, base=None):
    rows = A.gate(spark.createDataFrame(scores, RUN), spark.createDataFrame(limits, LIMITS), spark.createDataFrame(base, RUN) if base is not None else None)
    return {r.metric: r for r in rows.collect()}, A.verdict(rows).first()


def test_thresholds_and_regressions(spark):
    rows, last = gated(spark, [("faith", 0.9), ("relevance", 0.7), ("extra", 0.1), ("null", None)], [("faith", 0.9), ("relevance", 0.8), ("absent", 1.0)], [("faith", 0.92), ("extra", 0.9), ("gone", 1.0)])
    assert set(rows) == {"faith", "relevance", "extra"} and rows["faith"].passes and not rows["relevance"].passes and rows["extra"].passes is None
    assert rows["faith"].regressed is False and rows["extra"].regressed and rows["relevance"].regressed is None
    assert tuple(last) == (2, 2, 1, 1, "FAIL (regression)", A.REGRESSED)


def test_verdicts(spark):
    assert gated(spark, [("a", 0.5)], [("a", 0.6)])[1].code == A.BELOW
    assert gated(spark, [("a", 0.6)], [("a", 0.6)], [("b", 0.1)])[1].code == A.OK
    assert gated(spark, [("a", 0.6)], [("b", 0.6)])[1].code == A.BAD_INPUT == gated(spark, [], [])[1].code


def test_a_second_judge_decides_what_was_escalated(spark):
    first = spark.createDataFrame([(1, True, 0.5, "covered", True), (2, False, 0.3, "low coverage", True), (3, False, 0.0, "figures absent", False), (4, True, 0.5, "covered", True)], "id long, supported boolean, coverage double, reason string, escalate boolean")
    second = spark.createDataFrame([(1, False, 0.12345, "not said"), (2, True, 0.9, None), (3, True, 1.0, "yes")], "id long, supported boolean, score double, reason string")
    got = [tuple(r) for r in A.judged_again(first, second, "id").orderBy("id").collect()]
    assert got == [(1, False, 0.123, "judge: not said", True), (2, True, 0.9, "judge verdict", True), (3, False, 0.0, "figures absent", False), (4, True, 0.5, "covered", True)]


def test_references_are_dropped(spark):
    rows = [(1, 0, "Intro", 1), (1, 1, "text", None), (1, 2, "References:", 1), (1, 3, "[1] a", None), (1, 4, "Appendix", 1), (1, 5, "more", None), (2, 0, "7. References", 1), (2, 1, "[1] b", None), (3, 0, "references", None), (3, 1, None, None)]
    got = A.drop_references(spark.createDataFrame(rows, "doc long, ord long, text string, level int")).orderBy("doc", "ord").collect()
    assert [(r.doc, r.ord) for r in got] == [(1, 0), (1, 1), (1, 4), (2, 0), (3, 0), (3, 1)]


def test_newest_versions(spark):
    rows = [("a/1.2v2", 1), ("a/1.2v10", 2), ("a/1.2", 3), ("b", 4), ("v3", 5)]
    got = sorted((r.paper, r.version, r.id) for r in A.newest_versions(spark.createDataFrame(rows, "key string, id long")).collect())
    assert got == [("", 3, 5), ("a/1.2", 10, 2), ("b", 1, 4)]


def test_replay(spark):
    titles = spark.createDataFrame([(1, "Quixotic: Reading"), (2, "Other Title")], "doc long, title string")
    asked = spark.createDataFrame([(1, "quixotic?"), (2, "quixotic?"), (3, "quixotic and other title"), (4, "none")], "qid long, question string")
    cited = spark.createDataFrame([(1, 0, 2), (2, 0, 1), (3, 0, 2)], "qid long, place int, doc long")
    assert tuple(D.replay(asked, cited, titles).first()) == (4, 2, 1, 1)
    assert tuple(D.replay(asked.limit(0), cited, titles).first()) == (0, 0, 0, 0)
