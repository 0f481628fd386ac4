import duckdb
import pytest
from pyspark.sql import functions as F

from gritstone.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, topic string, weight string"


def rows(n=400):
    out = [(i, "word " * (1 + i % 90) + (" | " if i % 5 == 0 else ""), "en" if i % 3 else "de", f"s{min(i % 10, 3)}", "a", "b", "c") for i in range(n)]
    return out + [(None, "text", None, None, "a", "b", "c"), (900, None, "en", "s1", "a", "b", "c"), (901, "", "fr", "s9", "a", "b", "c"), (5, out[5][1], "en", "s3", "a", "b", "c")]


def expected(got, axis, by="probability"):
    """Share of the expected (or selected) tokens by value of an axis."""
    total, out = sum(r.n_tokens * getattr(r, by) for r in got), {}
    for r in got:
        out[r[axis]] = out.get(r[axis], 0) + r.n_tokens * getattr(r, by) / total
    return out


def wanted(got, axis, temper=mixing.TEMPER):
    tokens = {}
    for r in got:
        tokens[r[axis]] = tokens.get(r[axis], 0) + r.n_tokens
    share = {v: n / sum(tokens.values()) for v, n in tokens.items() if n}
    ratio = {v: x ** (temper - 1) / sum(y**temper for y in share.values()) for v, x in share.items()}
    most = min(mixing.BOOST, max(1.0, *(r for r in ratio.values() if sum(share[w] for w in share if ratio[w] >= r) > mixing.RARE)))
    low, high = 0.0, 1e9
    for _ in range(200):  # the level by halving
        level = (low + high) / 2
        want = {v: min(most * x, level * x**temper) for v, x in share.items()}
        low, high = (level, high) if sum(want.values()) < 1 else (low, level)
    return want


def test_margins_reach_their_targets(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    targets = {"source": {"s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0, "absent": 5.0}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.calibrate(df, targets, rounds=48).collect()
    assert all(0 <= r.probability <= 1 for r in got)
    shares = expected(got, "source")
    for s in ("s0", "s1", "s2", "s3"):
        assert shares[s] == pytest.approx(0.25, abs=0.005)
    assert expected(got, "lang")["de"] == pytest.approx(0.5, abs=0.005)


def test_sampled_shares_of_a_corpus(spark):
    """Of the documents that are really kept, every axis has its shares."""
    got = mixing.calibrate(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    for axis in mixing.AXES:
        want, said, kept = wanted(got, axis), expected(got, axis), expected(got, axis, "selected")
        assert max(abs(want[v] - said.get(v, 0)) for v in want) < 0.001
        total = sum(r.n_tokens * r.probability for r in got)
        for v in want:  # a few texts are a thousand times the others: four deviations of the draw beside the 0.01
            draw = sum(r.n_tokens**2 * r.probability * (1 - r.probability) * ((r[axis] == v) - want[v]) ** 2 for r in got) ** 0.5 / total
            assert abs(want[v] - kept.get(v, 0)) < max(0.01, 4 * draw)
    assert sum(r.n_tokens for r in got if r.selected) > 0.4 * sum(r.n_tokens for r in got)


def test_sample_keeps_columns_and_follows_probabilities(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    all_ = mixing.calibrate(df).collect()
    kept = mixing.sample(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in all_ if r.selected)
    zero = {r.doc_id: r for r in all_}[900]
    assert zero.n_tokens == 0 and zero.source == "s1"


@pytest.mark.parametrize("tokens", [(10**9, 10**9, 10**9), (10**9, 10**9, 4 * 10**9), (10**9, 3 * 10**8, 10**6)])
def test_a_stray_value_leaves_the_sample_as_it_is(spark, tokens):
    cells = [("a", "en", "prose"), ("b", "de", "prose"), ("c", "en", "table")]
    schema = "source string, lang string, topic string, tokens long"

    def kept(rows):
        raked = mixing.rake(spark.createDataFrame(rows, schema))
        got = raked.collect()
        return sum(r.tokens * r.probability for r in got) / sum(r.tokens for r in got), mixing.residual(raked)

    plain = [(*c, t) for c, t in zip(cells, tokens)]
    before, gap = kept(plain)
    after, stray_gap = kept(plain + [("stray", "en", "prose", 200)])
    assert before >= 0.9 / mixing.BOOST - 1e-9 and abs(after - before) < 0.01 * before
    assert abs(gap - stray_gap) < 0.001


def test_residual_of_a_corpus_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = mixing.calibrate(docs).groupBy(*mixing.AXES).agg(F.sum("n_tokens").alias("tokens"), F.max("probability").alias("probability"))
    assert mixing.residual(found) < 0.001


def test_shuffled_sums_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = sorted((r.doc_id or -1, round(r.probability, 9)) for r in mixing.calibrate(df, rounds=6).collect())
    monkeypatch.setattr(mixing, "ONE_PARTITION", 0)
    assert sorted((r.doc_id or -1, round(r.probability, 9)) for r in mixing.calibrate(df, rounds=6).collect()) == want


def test_sql_agrees_on_nulls_and_empty_texts(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(mixing.OP3_SQL)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, mixing.op3_mixing(spark, str(tmp_path)).select(*[d[0] for d in cur.description]).collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.calibrate(df).collect() == [] and mixing.sample(df).collect() == []
