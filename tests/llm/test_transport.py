import hashlib

import pytest

from gritstone.llm import transport as ts

TEXTS = [None, "", "a", "x" * 64, "é" * 33, "word " * 50, "long text " * 900, "z" * 4096, "z" * 4097, "q" * 40000, "\x00\x01G" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    n, payload = ts.payload_of(text)
    assert n == len((text or "").encode()) and len(payload) % 64 == 0 and len(payload) >= 64
    media = ts.write_stream(payload)
    got = ts.read_stream(media)
    assert got.whole and got.payload == payload and len(media) % 188 == 0
    assert got.timestamps == [k * ts.TICKS for k in range(-(-len(payload) // ts.PES_BYTES))]
    assert got.access_points == list(range(0, len(got.timestamps), ts.ACCESS_EVERY))
    assert got.clocks == [k * ts.TICKS for k in got.access_points]


def test_every_size():
    for n in range(64, 64 * 140, 64):
        assert ts.read_stream(ts.write_stream(bytes(range(1, 65)) * (n // 64))).payload == bytes(range(1, 65)) * (n // 64)


def test_faults_are_seen():
    media = ts.write_stream(ts.payload_of("some text " * 600)[1])
    lost = media[: 188 * 5] + media[188 * 6 :]
    assert ts.read_stream(lost).counter_errors == 1 and not ts.read_stream(lost).whole
    assert not ts.read_stream(media[:-1]).whole and not ts.read_stream(b"").whole
    twice = media[: 188 * 6] + media[188 * 5 :]
    assert ts.read_stream(twice).whole and ts.read_stream(twice).duplicates == 1


def test_no_damaged_byte_passes_or_raises():
    """Any byte changed: the payload is right, or the stream isn't whole (stuffing, clocks and reserved bits mean nothing)."""
    payload = ts.payload_of("some téxt " * 700)[1]
    media = ts.write_stream(payload)
    for at in range(len(media)):
        for flip in (1, 0x80, 0xFF):
            damaged = bytearray(media)
            damaged[at] ^= flip
            got = ts.read_stream(bytes(damaged))
            assert got.payload == payload or not got.whole, (at, flip)


def test_reading_from_an_access_point():
    payload = ts.payload_of("".join(f"line {i}\n" for i in range(20_000)))[1]
    media = ts.write_stream(payload)
    whole = ts.read_stream(media)
    assert len(whole.access_packets) == len(whole.access_points) > 4
    for point, packet in zip(whole.access_points, whole.access_packets):
        got = ts.read_from(media, packet)
        assert got.whole and got.payload == payload[point * ts.PES_BYTES :] and got.timestamps == whole.timestamps[point:]


def test_features_tell_contents_apart():
    assert ts.content_features(b"ab" * 64) != ts.content_features(b"ac" * 64)
    assert "entropy=1.0000" in ts.content_features(b"ab" * 64) and "entropy=0.0000" in ts.content_features(bytes(64))


def test_crc_is_the_standard_one():
    assert ts.crc_mpeg(b"123456789") == 0x0376E6E7


def test_query(spark):
    rows = {r.doc_id: r for r in ts.op4_transport(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, payload = ts.payload_of(d.text)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), ts.tail_crc(payload))
        assert r.whole and r.feature == ts.content_features(payload) and len(r.timestamps) == -(-len(payload) // ts.PES_BYTES)


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, "m"), (1, "", "n"), (1, "", "n")], "doc_id long, text string, media string")
    got = ts.read_media(ts.store_media(df)).collect()
    assert len(got) == 3 and all(r.whole and len(r.payload) == 64 for r in got)
    assert ts.read_media(ts.store_media(df.limit(0))).collect() == []
