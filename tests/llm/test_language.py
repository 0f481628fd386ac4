import math
import random

import numpy as np

from gritstone.llm import language as la


def say(lang, n, rng):
    parts = {"aa": ("kra", "tok", "mip", "ßu"), "bb": ("lio", "ena", "sué", "ri"), "cc": ("ngo", "wa", "hei", "ze")}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, say("abc"[i % 3] * 2, rng.choice([4, 30, 200]), rng), "abc"[i % 3] * 2) for i in range(n)]


def test_held_out_accuracy_and_calibration(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_score string")
    model = la.fit(docs)
    test = corpus(200, 2)
    got = [model.predict(t) for _, t, _ in test]
    assert np.mean([a == b for (a, _), (_, _, b) in zip(got, test)]) > 0.97
    assert 0 < (model.table != 0).mean() < 0.2 and all(0 <= s <= 1 for _, s in got)


def test_document_frequencies_cover_all_learnable_rows(spark):
    rows = corpus(90, 3) + [(100, None, "aa"), (101, "x", None), (None, "kra", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = la.learnable(docs)
    df, n = la.document_frequencies(kept)
    own = kept.collect()
    want = np.zeros(1 << la.BITS, np.int64)
    for r in own:
        want[np.unique(la.codes(la.normalize(r.text)))] += 1
    assert n == len(own) and np.array_equal(df, want)
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in own)


def test_long_texts_are_scored_whole(monkeypatch):
    rng = random.Random(4)
    model = la.Model(["a", "b"], rng_table(5), np.ones(1 << la.BITS, np.float32), np.zeros(2))
    plain = la.normalize(say("aa", 3000, rng))
    whole = model.table[la.codes(plain)].sum(axis=0) / len(la.codes(plain))
    assert np.allclose(model.logits(plain), whole, atol=1e-5)
    monkeypatch.setattr(la, "PART", 100)
    assert np.allclose(model.logits(plain), whole, atol=1e-5)


def rng_table(seed):
    return np.random.default_rng(seed).normal(size=(1 << la.BITS, 2)).astype(np.float32)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "12 !? _ ² ½ ①", "aa"), (None, "kra", None), (5, "É", "bb"), (5, "É", "bb")], "doc_id long, text string, lang string")
    model = la.fit(docs)
    got = la.identify(docs, model).collect()
    assert len(got) == 6 and all(r.lang_pred == "und" and r.lang_score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert la.fit(docs.limit(0)).predict("text") == ("und", 0.0)
    assert la.identify(docs.limit(0), model).collect() == []


def plainly(model, text):
    """The TF-IDF sum and the softmax, n-gram by n-gram; numbers that aren't digits count as word characters elsewhere only."""
    import unicodedata

    words = "".join(c if unicodedata.category(c)[0] in "LM" and (c.isalnum() or c == "_") else " " for c in (text or "").lower()).split()
    if not words or not model.langs:
        return "und", 0.0
    points, total, mass = [ord(c) + 1 for c in f" {' '.join(words)} "], [0.0] * len(model.langs), 0.0
    for size in (1, 2, 3):
        for at in range(len(points) - size + 1):
            code = 0
            for p in points[at : at + size]:
                code = (code << 21 | p) % 2**64
            bucket = code * 0x9E3779B97F4A7C15 % 2**64 >> 64 - la.BITS
            mass += float(model.idf[bucket])
            total = [t + float(w) for t, w in zip(total, model.table[bucket])]
    z = [(t / mass + b) / model.temperature for t, b in zip(total, model.bias)]
    p = [math.exp(x - max(z)) for x in z]
    k = p.index(max(p))
    return model.langs[k], p[k] / sum(p)


def test_predictions_by_a_plain_sum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = la.fit(docs)
    for text in [r.text for r in docs.collect() if len(r.text or "") < 4000][:60] + ["Ⅷ a²b ½", "²", None, "naïve Ünïcode ß 三"]:
        lang, score = model.predict(text)
        want = plainly(model, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_temperature_lies_inside_its_range_and_lowers_the_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 4000)
    logit = rng.normal(size=(4000, 4)) + 2.0 * np.eye(4)[y]
    first, held = slice(0, 2000), slice(2000, 4000)
    for scale in (0.02, 1.0, 50.0):
        t = la.temperature_of(scale * logit[first], y[first])
        assert abs(math.log(t / (scale / 2))) < 0.3  # two of four standard deviations: the true scale is 2
        if scale != 1.0:
            assert la.log_loss(scale * logit[held], y[held], t) < la.log_loss(scale * logit[held], y[held], 1.0)
    sure = 0.001 * np.eye(4)[y[:80]]  # all right: certainty is bounded by the documents seen
    t = la.temperature_of(sure, y[:80])
    assert t < 0.001 and np.isclose(math.exp(0.001 / t) / (math.exp(0.001 / t) + 3), 81 / 82, atol=0.005)


def test_fitted_temperature_is_calibrated_on_held_out_documents(spark):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = la.fit(docs)
    held = [r for r in docs.where("lang is not null and text is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and la.normalize(r.text)][:800]
    logit, y = np.stack([model.logits(la.normalize(r.text)) for r in held]), np.array([model.langs.index(r.lang) for r in held])
    losses = [la.log_loss(logit, y, t * model.temperature) for t in (0.1, 1.0, 10.0)]
    assert losses[1] == min(losses) and losses[1] < la.log_loss(logit, y, 1.0)


def test_query_by_brute_force(spark):
    """Every row of the query is the fitted model's word on its text; held-out rows are told apart and mostly right."""
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    model = la.fit(docs)
    got = {r.doc_id: r for r in la.op6_language(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = model.predict(r.text)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and abs(got[r.doc_id].score - score) < 1e-9
        assert (lang == "und") == (not any(c.isalpha() for c in r.text or ""))
    held = [r for r in rows if got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und" and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) > 0.9 * len(held)


def test_many_languages_are_all_learned(spark):
    rng = random.Random(6)
    rows = [(k * 40 + i, f"{chr(0x4E00 + k)} " * rng.randint(3, 9), f"l{k}") for k in range(600) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(la.fit(docs, max_sample=1200).langs) > 595
