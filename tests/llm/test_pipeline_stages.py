"""The chain of stages with near-duplicates by brute-force Jaccard similarity."""

import corpus_pipeline
from gritstone.llm import common, mixing
from tests.llm.test_decontaminate import brute_hits
from tests.llm.test_shingles import brute_groups
from tests.llm.test_tokens import brute

SF = "/root/testdata/sf0.001"


def test_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = common.materialize(corpus_pipeline.reject_toxic(spark, docs, SF), "t")
    want = set(brute_groups([(r.doc_id, r.text) for r in now.collect()]).values())
    now = common.materialize(corpus_pipeline.keep_one_of_near_duplicates(spark, now, SF), "t")
    assert now.columns == docs.columns and sorted(r.doc_id for r in now.collect()) == sorted(want)
    now = common.materialize(corpus_pipeline.remove_benchmark_passages(spark, now, SF), "t")
    assert all(not brute_hits(r.text, bench)[0] and r.n_chars == len(r.text) for r in now.collect())
    weights = {r.doc_id: r for r in mixing.calibrate(now).collect()}
    mixed = common.materialize(corpus_pipeline.mix_sources(spark, now, SF), "t")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {d for d, r in weights.items() if r.selected}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.write_tokens(spark, mixed, SF).collect()}
    assert got == brute([(r.doc_id, r.text) for r in mixed.collect()])
