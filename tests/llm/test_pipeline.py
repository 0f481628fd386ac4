import zlib

import numpy as np

import corpus_pipeline
from gritstone.llm import common, decontaminate, mixing, simhash, toxicity
from tests.llm.test_decontaminate import brute_hits
from tests.llm.test_shingles import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    state = [r.asDict() for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    net = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = net.scores([r["text"] for r in state])
    want = {r["doc_id"] for r, s in zip(state, scores) if s < toxicity.THRESHOLD}
    now = common.materialize(corpus_pipeline.reject_toxic(spark, docs, SF), "t")
    assert now.columns == columns and {r.doc_id for r in now.collect()} == want
    state = [r for r in state if r["doc_id"] in want]

    want = set(brute_groups([(r["doc_id"], r["text"]) for r in state]).values())
    now = common.materialize(corpus_pipeline.keep_one_of_near_duplicates(spark, now, SF), "t")
    assert now.columns == columns and sorted(r.doc_id for r in now.collect()) == sorted(want)

    before = {r.doc_id: r.text for r in now.collect()}
    now = common.materialize(corpus_pipeline.remove_benchmark_passages(spark, now, SF), "t")
    after = {r.doc_id: r for r in now.collect()}
    assert now.columns == columns
    for doc, text in before.items():
        if not brute_hits(text, bench)[0]:
            assert after[doc].text == text
        elif doc in after:
            assert not brute_hits(after[doc].text, bench)[0] and len(after[doc].text) < len(text)
    assert all(r.n_chars == len(r.text) for r in after.values())

    weights = {r.doc_id: r for r in mixing.calibrate(now).collect()}
    mixed = common.materialize(corpus_pipeline.mix_sources(spark, now, SF), "t")
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {d for d, r in weights.items() if r.selected}

    from tests.llm.test_tokens import brute

    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.write_tokens(spark, mixed, SF).collect()}
    assert got == brute([(r.doc_id, r.text) for r in mixed.collect()])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == got


def test_one_stays_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "y"), (None, None, "z")], "doc_id long, text string, fp string")
    got = simhash.keep_one(df).collect()
    assert sorted((r.doc_id or -1, r.fp) for r in got) == [(-1, "z"), (1, "x")]


def test_rows_of_one_id_and_other_texts_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "g h i j k l", "y"), (2, "G h i j k l", "z"), (1, None, "n")], "doc_id long, text string, node string")
    assert sorted(r.node for r in simhash.keep_one(df).collect()) == ["n", "x", "y"]


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity_score string, spans string, `key` string"
    rows = [(None, None, None, None, None, "a", "b", "c"), (1, "", "en", "s", 0, "a", "b", "c"), (2, "some plain words here", None, None, 21, "a", "b", "c"), (2, "some plain words here", None, None, 21, "a", "b", "c")]
    for n, name in ((4, "rows"), (0, "none")):
        sf = tmp_path / name
        docs = spark.createDataFrame(rows, schema).limit(n)
        docs.write.parquet(str(sf / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        spark.createDataFrame([(None, "x")] * (n // 4), "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
        now = spark.read.parquet(str(sf / "documents.parquet"))
        for stage, fn in corpus_pipeline.STAGES[:3]:
            now = common.materialize(fn(spark, now, str(sf)), "t")
            assert now.columns == docs.columns
        assert now.count() == (3 if n else 0)
        got = corpus_pipeline.run(spark, str(sf)).collect()
        assert len(got) <= n and all(r.n_tokens >= 1 for r in got)


def test_digest_helpers():
    assert decontaminate.items_digest(["2", "10"]) == decontaminate.items_digest(["10", "2"])
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0")
