import random

import numpy as np

from gritstone.llm import runindex as ri


def brute(rows):
    """(n_bytes, removed spans, kept) of each row, by comparing all windows."""
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raws:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            key = float("inf") if d is None else d
            first[w] = min(first.get(w, key), key)
    out = []
    for d, b in raws:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (float("inf") if d is None else d):
                gone[i : i + 50] = [True] * 50
        spans, kept = [], bytes(x for x, g in zip(b, gone) if not g)
        for i, g in enumerate(gone):
            if g and (not i or not gone[i - 1]):
                spans.append([i, i + 1])
            elif g:
                spans[-1][1] = i + 1
        out.append((d, len(b), [tuple(s) for s in spans], kept))
    return out


def fixture(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    line, rows = say(49) + "|" + say(200), []
    for i in range(60):
        parts = [say(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 150)
            parts += [line[a : a + rng.randint(20, 120)], say(rng.randint(0, 80))]
        rows.append((rng.randint(0, 80), "".join(parts)))
    rows += [(5, "x" * 500), (6, "x" * 120), (7, "x" * 49), (8, None), (9, ""), (10, rows[0][1]), (10, rows[0][1]), (None, rows[1][1]), (None, "unique" * 4), (11, "ab" * 300), (12, "é" * 25), (13, "é" * 25), (90, "\x00" * 60), (91, "\x00" * 51)]
    return rows


def test_against_all_windows(spark):
    for seed, block, hot in ((1, 1 << 20, 512), (2, 700, 512), (3, 700, 1)):
        rows = fixture(seed)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block long").repartition(3)
        got = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in ri.remove_repeats(df, block, hot, 5).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_long_text_over_several_parts(monkeypatch):
    monkeypatch.setattr(ri, "_STEP", 256)
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 99, 3000).astype(np.uint8))
    import zstandard

    block = ri.Block([1, 2], [2000, 1000], zstandard.ZstdCompressor().compress(raw))
    first, count, hashes, doc, anchor = block.contexts()
    assert (anchor >= count - 1).all() and (anchor + ri.K <= 50).all()
    assert count.sum() == 2000 - 49 + 1000 - 49
    seen = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)])
    assert len(set(seen.tolist())) == len(seen)


def texts_of(rows):
    return ri.Texts(np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows], np.int64))


def test_matching_statistics():
    rng = random.Random(4)
    say = lambda k: bytes(rng.choices(b"ab", k=k))
    own = [say(rng.randint(1, 79)) for _ in range(60)]
    asked = [say(rng.randint(1, 79)) for _ in range(40)] + [own[3][2:60], own[5], b"xyz", own[7] + b"x" + own[8][:20]]
    index, queries = ri.RunLengthIndex(texts_of(own)), texts_of(asked)
    assert len(index.run_start) < len(index.texts.symbols) == int(index.run_size.sum())
    lengths, samples = index.matching_statistics(queries)
    text = index.texts.symbols.tobytes()
    for q, end in zip(asked, queries.ends.tolist()):
        coded = bytes(x + 1 for x in q)
        for i in range(len(q)):
            place = end - len(q) + i
            want = max(n for n in range(len(q) - i + 1) if any(q[i : i + n] in o for o in own))
            assert lengths[place] == want
            assert text[samples[place] : samples[place] + want] == coded[i : i + want]


def windows_case():
    rng = random.Random(2)
    texts = sorted({b"y" * rng.randint(0, 3) + bytes(rng.choices(b"ab", k=3)) + b"-the-anchor-of-all!!" + bytes(rng.choices(b"ab", k=4)) * 9 for _ in range(300)})
    texts = sorted({t[: t.index(b"-the") + 50] for t in texts if len(t) >= 50})  # every window holds the anchor
    anchors = np.array([t.index(b"-the") for t in texts])
    return texts, anchors, np.zeros(len(texts), np.int64), np.array([rng.randint(0, 90) for _ in texts])


def earlier_by_brute_force(texts, ids):
    return [min([int(ids[j]) for j, u in enumerate(texts) if t[i : i + 50] in u]) < ids[k] for k, t in enumerate(texts) for i in range(len(t) - 49)]


def test_windows_of_earlier_texts():
    texts, anchors, groups, ids = windows_case()
    found, first = ri.earlier_ids(texts, anchors, groups, ids)
    own = np.repeat(ids, [len(t) - 49 for t in texts])
    assert (found < own).tolist() == earlier_by_brute_force(texts, ids) and (found <= own).all() and (found < own).any()


def test_wrong_samples_give_wrong_marks(monkeypatch):
    texts, anchors, groups, ids = windows_case()
    build = ri.RunLengthIndex.__init__

    def wrong(self, of):
        build(self, of)
        self.first_sample, self.last_sample = np.roll(self.first_sample, 1), np.roll(self.last_sample, 1)

    monkeypatch.setattr(ri.RunLengthIndex, "__init__", wrong)
    found, _ = ri.earlier_ids(texts, anchors, groups, ids)
    assert (found < np.repeat(ids, [len(t) - 49 for t in texts])).tolist() != earlier_by_brute_force(texts, ids)


def test_empty_table(spark):
    assert ri.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_buckets_stay_below_what_spark_allows():
    assert ri.buckets_of(0, 8) == 8 and ri.buckets_of(10**10, 8) == 10**10 // ri.BUCKET_BYTES and ri.buckets_of(10**14, 200) == ri.MAX_BUCKETS < 100_000


def test_contexts_cover_each_window_once_where_texts_are_short(monkeypatch):
    import zstandard

    monkeypatch.setattr(ri, "_STEP", 64)
    rng = np.random.default_rng(5)
    sizes = [0, 0, *rng.integers(0, 120, 80).tolist(), 50, 49, 0, 51]
    block = ri.Block(list(range(len(sizes))), sizes, zstandard.ZstdCompressor().compress(bytes(rng.integers(97, 123, sum(sizes)).astype(np.uint8))))
    first, count, hashes, doc, anchor = block.contexts()
    seen = sorted(np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)]).tolist())
    begin = block.ends - np.array(sizes)
    assert seen == [w for b, e in zip(begin.tolist(), block.ends.tolist()) for w in range(b, e - 49)]
    assert ((first >= begin[doc]) & (first + count + 49 <= block.ends[doc]) & (anchor >= count - 1)).all()
    grams = {}
    for h, a in zip(hashes.tolist(), (first + anchor).tolist()):
        assert grams.setdefault(h, block.raw[a : a + ri.K]) == block.raw[a : a + ri.K]


def test_marks_are_laid_without_contexts(monkeypatch):
    import zstandard

    squeeze = zstandard.ZstdCompressor().compress
    monkeypatch.setattr(ri.Block, "contexts", lambda self: 1 / 0)
    block = ri.Block([3, 7], [100, 100], squeeze(bytes(200)))
    places = squeeze(np.array([10, 110, 1, 0, 0, 1], np.int32).tobytes())  # entry 0 at 10 and 120, entry 1 at 121
    rows = [{"numbers": b"", "sizes": b"", "ids": b"", "places": places}, {"numbers": np.array([0], np.int32).tobytes(), "sizes": b"\x02", "ids": np.array([3, 9], np.int64).tobytes(), "places": None}]
    assert np.flatnonzero(ri._gone(block, rows)).tolist() == list(range(120, 170))


def test_shards_grow_before_their_rows_outgrow_the_texts():
    assert ri.shards_of(0) == 1 and ri.shards_of(1 << 30) == 257 and ri.shards_of(4 << 30) == 513 and ri.shards_of(10 << 30) == 641


def test_suffix_order_by_sorted_suffixes(monkeypatch):
    rng = random.Random(6)
    texts = texts_of([bytes(rng.choices(b"ab", k=rng.randint(1, 90))) for _ in range(80)] + [b"a" * 80] * 3 + [b"a" * 7, b"", b"a" * 8, b"a" * 9])
    raw, ends = texts.symbols.tobytes(), texts.ends.tolist()
    want = sorted(range(len(raw)), key=lambda p: (raw[p : next(e for e in ends if e >= p)], p))
    assert ri._suffix_order(texts.words, texts.left).tolist() == want

    class Long(int):
        def bit_length(self):
            return 32

    monkeypatch.setattr(ri, "len", lambda x: Long(x.__len__()), raising=False)  # as if a place took 32 bits
    assert ri._suffix_order(texts.words, texts.left).tolist() == want
