"""Contexts and their inverse, citations, the refusal chain and attribution, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from gritstone.operators import attribution as D
from gritstone.operators import grounding as G

HITS = "qid long, id long, rank int, locator string, text string"


def parse(spark, prompt):
    rows = spark.createDataFrame([(prompt,)], "p string").select(F.explode(G.parse_context(F.col("p"))).alias("b")).select("b.*").collect()
    return [tuple(r) for r in rows]


def test_context_has_a_block_for_each_passage(spark):
    hits = spark.createDataFrame([(1, 7, 2, "Other | p. 1", "  Second.\n"), (1, 5, 1, "Paper | 3.2 Attention (new) | p. 4", "First."), (2, 9, 1, None, None)], HITS)
    rows = {r.qid: r for r in G.render_context(hits).collect()}
    assert rows[1].context == "[S1] (Paper | 3.2 Attention (new) | p. 4)\nFirst.\n\n[S2] (Other | p. 1)\nSecond."
    assert (rows[1].used, rows[1].dropped) == ([5, 7], []) and rows[1].tokens == (48 // 4 + 1) + (27 // 4 + 1)
    assert rows[2].context == "[S1] ()\n" and G.render_context(hits, locators=False).where("qid = 1").first().context.startswith("[S1]\nFirst.")


def test_what_does_not_fit_is_dropped_but_a_first_passage_is_cut(spark):
    long, short = "word " * 400, "Short."
    hits = spark.createDataFrame([(1, 1, 1, "a", short), (1, 2, 2, "b", long), (1, 3, 3, "c", short), (2, 4, 1, "d", long), (2, 5, 2, "e", short)], HITS)
    rows = {r.qid: r for r in G.render_context(hits, budget=55).collect()}
    assert (rows[1].used, rows[1].dropped) == ([1, 3], [2]) and "[S2] (c)" in rows[1].context
    assert rows[2].used == [4] and rows[2].dropped == [5] and len(rows[2].context) == len("[S1] (d)\n") + 4 * 50


def test_context_round_trip(spark):
    hits = spark.createDataFrame([(1, i, i, f"T{i} | Results (RE3 & RE5) | p. {i}", f"Passage {i}.\n\nMore [4, 15] of it {i}.") for i in range(1, 5)], HITS)
    made = G.render_context(hits)
    blocks = made.select(F.explode(G.parse_context(F.concat("context", F.lit("\n\nQuestion: [S1] who?\nAnswer:")))).alias("b")).select("b.*").collect()
    assert [(b.marker, b.header, b.body) for b in blocks] == [(i, f"(T{i} | Results (RE3 & RE5) | p. {i})", f"Passage {i}.\n\nMore [4, 15] of it {i}.") for i in range(1, 5)]


@pytest.mark.parametrize(
    "prompt, want",
    [
        ("", []),
        ("no blocks [S1] inline", []),
        ("[S1] (a)\n", []),
        ("  [S2]\tx\nbody\n\nCLAIMS to check:\n1. [S9] y", [(2, "x", "body")]),
        ("[S1] (a)\none\n[S2] (b)\ntwo\n[S1] (c)\nthree", [(1, "(c)", "three"), (2, "(b)", "two")]),
        ("[S1] (a)\nQuestion: stays\nnext", [(1, "(a)", "Question: stays\nnext")]),
        ("[S3] (a)\r\nb\u001ec d", [(3, "(a)\r", "b c d")]),
    ],
)
def test_parsed_blocks(spark, prompt, want):
    assert parse(spark, prompt) == want


def test_citations_resolve_in_order_of_first_appearance(spark):
    answers = spark.createDataFrame([(1, "One 【S2】. Two [S7][S1]. Again [ s2 ]. Ref [4]."), (2, None), (3, "none")], "qid long, answer string")
    used = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 30)], "qid long, marker int, id long")
    got = [(r.qid, r.place, r.marker, r.id, r.known) for r in G.resolve_citations(answers, used).orderBy("qid", "place").collect()]
    assert got == [(1, 1, 2, 20, True), (1, 2, 7, None, False), (1, 3, 1, 10, True)]


FACTS = "qid long, passages long, best double, answer string, misattribution string, claims long, supported long, unresolved long, uncited long"


def test_the_first_failing_rule_decides_and_later_ones_stay_unevaluated(spark):
    rows = [
        (1, 0, None, None, None, None, None, None, None), (2, 3, 0.1, G.SENTINEL, "x", 4, 0, 1, 1), (3, 3, 0.9, f"so {G.SENTINEL}.", "x", 4, 0, 1, 1), (4, 3, None, "a", "names another", 4, 0, 1, 1),
        (5, 3, 0.5, "a", None, 4, 1, 1, 1), (6, 3, 0.5, " a 【S1】 ", None, 4, 2, 1, 0), (7, 3, 0.5, None, None, None, None, None, None), (8, 3, 0.5, "a", None, 0, 0, 0, 0), (9, None, None, None, None, None, None, None, None),
    ]
    facts = spark.createDataFrame(rows, FACTS)
    never = ("x", F.when(F.col("qid").isin(7), False).otherwise(F.raise_error(F.lit("evaluated"))).cast("boolean"), F.lit("x"))
    rules = G.retrieval_rules(0.3) + G.reply_rules() + G.attribution_rules() + G.support_rules(0.5)
    got = {r.qid: r for r in G.finalize(G.decide(facts, rules), "No.").collect()}
    assert [got[i].status for i in range(1, 10)] == [G.NO_CONTEXT, G.NO_CONTEXT, G.BY_MODEL, G.MISATTRIBUTED, G.LOW_SUPPORT, G.ANSWERED, G.ANSWERED, G.LOW_SUPPORT, G.NO_CONTEXT]
    assert got[2].reason.startswith("best passage scored 0.10 for relevance to this question, below the 0.30") and got[5].reason == "only 25% of claims are supported by the retrieved passages (threshold 50%)"
    assert got[6].text == "a [S1]" and got[6].usage == {"unresolved_citations": 1, "claims_checked": 4, "claims_supported": 2} and got[5].text == "No." and got[5].usage == {} and got[7].usage == {}
    assert {r.qid for r in G.undecided(facts, rules).collect()} == {6, 7}
    assert G.decide(facts.where("qid in (1, 9)"), [*G.retrieval_rules(0.3), never]).where(F.col("status") == G.NO_CONTEXT).count() == 2


TITLES = [(1, "Paint-Anything: Fast Édits"), (2, "Transformers"), (3, "Transformers: A Survey"), (4, "Quixotic: Reading"), (5, "Survey: of Many"), (6, None), (7, "")]


@pytest.mark.parametrize(
    "question, named",
    [
        ("What does “PAINT anything” use?", {1}), ("paint anything: fast edits!", {1}), ("repaint anything", set()), ("Is quixotic good?", {4}), ("a survey", set()), ("transformers?", {2}),
        ("transformers a survey", {2, 3}), ("Quixotic or Paint Anything", {1, 4}), ("", set()), (None, set()),
    ],
)
def test_named_documents(spark, question, named):
    index = D.name_index(spark.createDataFrame(TITLES, "doc long, title string"))
    assert {r.doc for r in D.named_documents(spark.createDataFrame([(1, question)], "qid long, question string"), index).collect()} == named


def test_runs_meet_phrases_of_any_length_without_the_question(spark):
    long = " ".join(f"w{i}" for i in range(40))
    names = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, long), (4, long + " more"), (5, ""), (6, "a b")], "doc long, phrase string")
    asked = spark.createDataFrame([(1, "x a b y"), (2, "ab a"), (3, f"a {long} b"), (4, ""), (5, None), (6, "b")], "qid long, q string")
    held = D.phrases_held(asked, names)
    assert sorted((r.qid, r.doc) for r in held.collect()) == [(1, 1), (1, 6), (3, 3)]
    joins = held.where("doc >= 0")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [run" not in joins and "SortMergeJoin [run" in joins


def test_only_answers_from_other_documents_than_the_named_one_are_misattributed(spark):
    titles = spark.createDataFrame(TITLES, "doc long, title string")
    asked = spark.createDataFrame([(1, "Is quixotic good?"), (2, "Is quixotic good?"), (3, "Quixotic or paint anything?"), (4, "who?"), (5, "quixotic")], "qid long, question string")
    cited = spark.createDataFrame([(1, 2, 2), (1, 1, 3), (1, 0, 4), (1, 3, 3), (2, 0, 4), (3, 0, 2), (4, 0, 2)], "qid long, place int, doc long")
    got = D.misattributed(asked, cited, titles).collect()
    assert [(r.qid, r.doc, r.wrong) for r in got] == [(1, 4, ["Transformers: A Survey", "Transformers"])]
    assert got[0].reason == 'the question asks about "Quixotic: Reading" but the answer cites a different document: "Transformers: A Survey"; "Transformers"'


def test_a_phrase_is_keyed_on_its_rarest_token(spark):
    titles = spark.createDataFrame([(i, f"the common {i} title") for i in range(50)], "doc long, title string")
    keys = {r.doc: r.key for r in D.name_index(titles).collect()}
    assert keys == {i: str(i) for i in range(50)}
    assert D.title_tokens(titles).where("df = 50").count() == 3
