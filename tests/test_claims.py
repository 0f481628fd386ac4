"""Claim checks against plain models of their rules."""

import re

from pyspark.sql import functions as F

from gritstone.operators import claims as V


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r.x for r in df.orderBy("i").select(fn(F.col("text")).alias("x")).collect()]


def shown(values):
    return {f"{float(v):.5e}" for v in values}


def test_claimed_numbers(spark):
    cases = {
        "(6) The method is used": set(), "6. It gains 2.5 BLEU": {"2.5"}, "2.50 BLEU": {"2.5"}, "Table 2 lists 100 samples": {"100"}, "(1) foo, (2) bar at 45%": {"45"},
        "N = 1 000 people": {"1000"}, "in 2024 2025 words": {"2024", "2025"}, "(92) of them": set(), "of (92) them": {"92"}, "p = .034 and -.5": {"0.034", "-0.5"}, "1e3 or +7": {"1000", "7"}, "v3 and x3": set(), "": set(),
        "3 100-token chunks": {"3", "100"}, "as (i) one and (b) two": set(), "see Section 4.1 and Fig. 3": set(), "12 345 678 rows": {"12345678"},
    }
    for text, got in zip(cases, column(spark, list(cases), V.claimed_numbers)):
        assert set(got) == shown(cases[text]), text


def test_evidence_numbers_are_read_widely(spark):
    got = column(spark, ["Qwen3.6-35B has 363,841 rows", "T-1/2", "Appendix A.3"], V.evidence_numbers)
    assert shown(["3.6", "35", "363841", "-35", "841"]) <= set(got[0])
    assert shown(["-1", "1", "2"]) <= set(got[1]) and shown(["3"]) <= set(got[2]) and shown(["0.3"]).isdisjoint(got[2])


def test_split_claims(spark):
    text = "One is so [S1]. Two, e.g. this, holds. [S2][S3] No. 3 is e.g. here! Mail a.b@c.d.edu now. . . . [S1] Tail without end"
    got = column(spark, [text, "", None, "... .", "Ab bc cd【S4†L1】. See Fig. 3. The model"], V.split_claims)
    assert [(c.claim, c.markers) for c in got[0]][:2] == [("One is so.", [1]), ("Two, e.g. this, holds.", [2, 3])]
    assert got[0][-1].claim.endswith("Tail without end") and "".join(c.claim for c in got[0]).count("Mail a.b@c.d.edu now.") == 1
    assert got[1] == [] and got[2] == [] and got[3] == []
    assert [c.claim for c in got[4]] == ["Ab bc cd.", "See Fig. 3.", "The model"] and got[4][0].markers == [4]


def test_verdicts(spark):
    rows = [
        ("The model improves recall by 3.1 points", "The model improves recall by 3.1 points.", "covered"), ("The model improves recall by 2.5 points", "The model improves recall by 3.1 points.", "figures absent"),
        ("The model does not improve recall", "The model improves recall a lot", "negates the passage"), ("The model does not use E", "The model uses one, and zero otherwise", "low coverage"),
        ("Anything", "", "no citation"), ("Anything", None, "no citation"), (None, "text", "low coverage"), ("bananas grow slowly upstairs", "The model improves recall", "low coverage"), ("A rate of −0.5 helps", "a rate of -0.5 helps", "covered"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, claim string, evidence string, want string")
    got = V.judge(df).orderBy("i").collect()
    assert [r.reason for r in got] == [r.want for r in got]
    assert [r.supported for r in got] == [r.want == "covered" for r in got]
    assert got[3].ambiguous and got[3].negation_ok and not got[2].negation_ok


def test_whole_conversations_by_plain_rules(spark):
    from gritstone.jobs import curate
    from gritstone.functions import text as T

    rows = [r for r in curate.evidence(spark, "/root/testdata/sf0.001").collect()]
    got = {(r.conv_id, r.turn, r.claim_no): r for r in curate.lexical_verdicts(spark, "/root/testdata/sf0.001").collect()}
    said = {(r.conv_id, r.turn, r.claim_no): r.claim for r in curate.claims(spark, "/root/testdata/sf0.001").collect()}
    assert said.keys() == got.keys() and len(got) > 0
    held = {(r.conv_id, r.turn): r.evidence or "" for r in rows}
    words = lambda t: {w.lower() for w in re.findall(V.WORD, t) if len(w) > 2} - set(T.CLAIM_STOPWORDS)
    for key, claim in said.items():
        want, have = words(claim), words(held[key[:2]])
        assert abs(got[key].coverage - (len(want & have) / len(want) if want else 0)) < 1e-6


def test_defined_results_instead_of_errors(spark):
    from gritstone.operators import answers, evaluation

    three = spark.createDataFrame([(i, 0.5) for i in range(3)], "id long, diff double")
    r = evaluation.bootstrap_interval(three).first()
    assert r.low == r.high == 0.5
    none = evaluation.bootstrap_interval(three.limit(0)).first()
    assert none.low is None and none.high is None
    assert evaluation.auroc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")).first().auroc is None
    q = spark.createDataFrame([(1, "?!"), (2, "the word")], "qid long, question string")
    c = spark.createDataFrame([(1, 1, "A sentence."), (2, 1, "The word stands.")], "qid long, marker long, text string")
    assert {x.qid: x.answer for x in answers.extract_answers(c, q).collect()} == {1: None, 2: "The word stands. [S1]"}
