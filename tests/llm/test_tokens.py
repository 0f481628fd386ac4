import random
import zlib

import numpy as np

from gritstone.llm import tokens
from gritstone.llm.common import vocabulary_path


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    out, start = {}, 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\n b ", "　 x  y", "it's  \t we'll 'll", "x <|endoftext|> y", "a\x1c b", "  ", "é à  ", "a   b", "\n a", "a\x85 b \x85", "one.\nTwo, three|four", "x" * 5000, "a\n\nb", "one.\n\ntwo three", "abc\n\n\n\nd e", "a \n\nb", "a\t\nb", "1\n\n2", "\u3000\nb"]


def test_blocks_match_the_tokenizer(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 3)] + [(1000, None), (1001, "the end of the end of the end " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x").selectExpr("doc_id", "text", "1 as shard", "2 as block")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_blocks(tokens.write_blocks(df, block_ids=500)).collect()}
    assert got == brute(rows)


def test_random_texts_match_the_tokenizer():
    encoder = tokens.Encoder(vocabulary_path(), memory=5000)
    rng = random.Random(8)
    bits = ["\n", "\n\n", "\t", "\u3000", " ", " ", "  ", "\r\n", "7", "42", "a", "the", "Next", "é", "²", "_", ".", ",", "|", "'s", "'ll", "n't", "-", "\x1c", "\x85", "日", "́", "<|"]
    for _ in range(50):
        texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1000)]
        want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for text, ids, w in zip(texts, encoder.encode(texts), want):
            assert ids.tolist() == w.ids, repr(text)


def test_null_and_equal_ids(spark):
    rows = [(None, "b"), (None, "a"), (3, "z"), (3, None), (3, "z")]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens.read_blocks(tokens.write_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))).collect())
    assert got == [(0, None, 2), (2, None, 2), (4, 3, 1), (5, 3, 2), (7, 3, 2)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.op8_tokens(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_blocks(tokens.write_blocks(df)).collect() == []


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 7, rng.integers(0, 400)).astype("<u2") for _ in range(50)] + [np.zeros(999, "<u2")]
    raw = tokens.pack_block(docs, 2, 100)
    block = tokens.Block(raw)
    assert len(block.rules) > 0
    for k, (doc, got) in enumerate(zip(docs, block.documents())):
        assert np.array_equal(np.append(doc, 2), got)
        assert np.array_equal(block.document(k), got)
    assert all(block.length[100 + i] == block.length[a] + block.length[b] for i, (a, b) in enumerate(block.rules.tolist()))


def test_one_symbol_runs():
    seq, last, rules = tokens.compress(np.zeros(9, np.int64), np.arange(9) == 8, 10, min_count=2)
    assert len(seq) < 9 and last[-1] and last.sum() == 1 and len(rules)
