import random
import re

from gritstone.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, bench):
    """(hit words, items) by comparing every window at every place."""
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        if item is None or not b:
            continue
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                items.add(str(item))
    return len(hit), items


def test_random_small_vocabulary(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["Aa", "b", "É", "c9", "d"]) for _ in range(n))
    bench = [(i, say(rng.randint(0, 25))) for i in range(12)] + [(50, None), (None, "b b b"), (3, say(12))]
    docs = [(i, say(rng.randint(0, 200)), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (101, "", "x"), (None, say(50), "x"), (102, say(30_000), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (dc.BLOCK_CHARS, 150):
        got = dc.find_contamination(d, b, block_chars=block).collect()
        assert len(got) == len(docs)
        for r in got:
            n, items = brute_hits(r.text, bench)
            assert sum(x.end - x["first"] for x in r.spans) == n and set(r["items"]) == items and r.n_words == len(words(r.text))


def test_cleaning(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "before " * 60 + "W0, w1 " + " ".join(f"w{i}" for i in range(2, 14)) + "! after " * 60, 7), (2, item, 7), (3, "clean é text", 7), (4, None, 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.remove_contamination(d, b).collect()}
    assert sorted(got) == [1, 3, 4] and got[3].text == "clean é text" and got[3].n_chars == 7
    assert got[1].text == "before " * 60 + "! after " * 60 and got[1].n_chars == len(got[1].text)


def test_cleaning_is_the_same_for_every_block_size(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["a", "b", "É", "c9"]) for _ in range(n))
    bench = [(i, say(rng.randint(3, 14))) for i in range(9)] + [(50, None), (None, "b b b")]
    docs = [(i, " ".join(x for _ in range(6) for x in (say(rng.randint(0, 9)), rng.choice([t for _, t in bench if t]))), 0, "x") for i in range(40)]
    halves = " ".join(f"p{i}" for i in range(20)) + " and more " + " ".join(f"q{i}" for i in range(20))  # two items of a third of the words each
    bench += [(60, " ".join(f"p{i}" for i in range(20))), (61, " ".join(f"q{i}" for i in range(20)))]
    docs += [(100, halves + " tail" * 20, 0, "x"), (101, halves + " tail" * 50, 0, "x"), (102, None, None, "x"), (103, "", 0, "x"), (101, halves + " tail" * 50, 0, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, spans string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    want = sorted(map(tuple, dc.remove_contamination(d, b).collect()), key=key)
    assert sorted(map(tuple, dc.remove_contamination(d, b, block_chars=60).collect()), key=key) == want
    left = {r[0]: r[1] for r in want}
    assert 100 not in left and left[101].count("tail") == 50 and "p1" not in left[101] and sum(r[0] == 101 for r in want) == 2
    assert all(not brute_hits(t, bench)[0] for t in left.values())
    assert sorted(map(tuple, dc.remove_contamination(d, b.limit(0)).collect()), key=key) == sorted(docs, key=key)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.find_contamination(d.limit(0), b).collect() == []
    assert dc.find_contamination(d, b.limit(0)).first().spans == []
    assert dc.find_contamination(d, b).first()["items"] == ["1"]
