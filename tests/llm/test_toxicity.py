import random

import numpy as np
import pytest

from gritstone.llm import toxicity as tx


def corpus(n, seed):
    """Clean texts, and texts with a few words of an insulting stem; some of them long."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("rtnls") for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([5, 40, 200]))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), "grumpf" + word())
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def network():
    rows = corpus(600, 1)
    return tx.train([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy(network):
    rows = corpus(300, 2)
    p = network.scores([r[1] for r in rows]) >= tx.THRESHOLD
    y = np.array([r[2] for r in rows]) == 1
    assert (p & y).sum() / y.sum() > 0.9 and (p & ~y).sum() / (~y).sum() < 0.03


def test_one_passage_in_a_long_text_counts(network):
    clean = [r[1] for r in corpus(400, 3) if not r[2]]
    long = " ".join(clean[:60])
    assert network.scores([long + " grumpfara grumpfeti grumpfilo " + long])[0] > network.scores([long + long])[0] + 0.5


def test_a_passage_counts_wherever_it_stands(network):
    lead = [r[1].split() for r in corpus(400, 3) if not r[2] and len(r[1].split()) == 200][0]
    texts = [" ".join(lead[:k] + "grumpfara grumpfeti grumpfilo".split() + lead) for k in range(tx.WINDOW)]
    assert (network.scores(texts) >= tx.THRESHOLD).all()


def test_query_by_brute_force(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = tx.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in tx.op5_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r, p in zip(rows, net.scores([r.text for r in rows])):
        g = got[r.doc_id]
        assert abs(g.score - p) < 1e-5 and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and g.predicted == (g.score >= 0.7)


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        w = tx.Words([" ".join(f"w{i}" for i in range(n))])
        windows, _ = w.windows()
        assert set(range(n)) <= set(windows.ravel().tolist()) and windows.shape[1] == tx.WINDOW


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    rows = corpus(12, 4)
    w = tx.Words([r[1] for r in rows])
    windows, owner = w.windows()
    windows, y = windows[:6], np.array([rows[k][2] for k in owner[:6]], np.float32)
    p = {"word": rng.normal(0, 0.5, (tx.WORD_BUCKETS, tx.DIM)), "gram": rng.normal(0, 0.5, (tx.GRAM_BUCKETS, tx.DIM))}
    for d in "fb":
        p |= {"in" + d: rng.normal(0, 0.4, (2 * tx.DIM, 3 * tx.HIDDEN)), "bias" + d: rng.normal(0, 0.1, 3 * tx.HIDDEN), "gate" + d: rng.normal(0, 0.4, (tx.HIDDEN, 2 * tx.HIDDEN)), "cand" + d: rng.normal(0, 0.4, (tx.HIDDEN, tx.HIDDEN))}
    p |= {"att": rng.normal(0, 0.4, (2 * tx.HIDDEN, tx.HIDDEN)), "query": rng.normal(0, 0.4, tx.HIDDEN), "out": rng.normal(0, 0.5, 2 * tx.HIDDEN), "out0": np.array(0.1)}
    net = tx.Network({k: v.astype(np.float32) for k, v in p.items()})

    def loss():
        z = net.logits(w, windows).astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    net.x = net.inputs(w)
    grads = tx._gradients(net, w, windows, y)
    grads.pop("x")
    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old = float(net.p[name][at])
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), abs=2e-3), name


def test_query_columns_and_edge_cases(spark):
    rows = [(i, t, lab) for i, t, lab in corpus(120, 5)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "a b", "x"), (500, None, "x"), (501, "", "x"), (501, "", "x"), (502, "w " * 40_000, "x")], "doc_id long, text string, toxicity_score string")
    labels = spark.createDataFrame([(i, lab) for i, _, lab in rows] + [(None, 1), (3, None), (0, 0), (999, 1)], "doc_id long, toxic int")
    got = tx.score(docs.drop("toxicity_score"), tx.fit(docs, labels)).collect()
    assert len(got) == 125 and all(0 <= r.toxicity_score <= 1 for r in got)
    assert len({r.toxicity_score for r in got if r.doc_id in (500, 501)}) == 1
    none = tx.fit(docs, labels.limit(0))
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.toxicity_score for r in kept.collect()} == {"x"}
    assert {r.toxicity_score for r in tx.score(docs.drop("toxicity_score"), none).collect()} == {0.0}
    assert tx.score(docs.drop("toxicity_score").limit(0), none).collect() == []


def test_held_out_rows_teach_nothing(spark):
    import zlib

    docs = spark.createDataFrame([(i, "t") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    ids = {r.doc_id for r in tx.training_rows(docs, labels).collect()}
    assert ids == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert tx.training_rows(docs, labels, 5).count() == 10
