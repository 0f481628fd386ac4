"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

A payload is cut into packetised elementary stream (PES) packets of a private data stream, each
with a presentation timestamp and the CRC of the packet before it, and carried in 188-byte transport
packets beside a programme association and a programme map table; a last PES packet without data
closes the chain of CRCs. Every ``ACCESS_EVERY``-th PES packet begins a random-access point: its
first transport packet says so and carries a clock reference. The reader parses the tables (with
their CRC), checks the continuity counters, leaves legal duplicate packets out, reassembles the PES
packets by their lengths, checks their CRCs and returns payload, timestamps and random-access points;
``read_from`` starts at one of these.

The payload of a text is its UTF-8, then zero bytes up to a positive multiple of 64. Equal texts
give equal streams. Streams are written as a table before they are read.

Edge cases: null and empty texts give 64 zero bytes; texts of any length are whole; an empty table
gives no rows; a packet that is lost, out of order or damaged shows as a continuity or CRC error or
as a stream that is not whole, and no damage raises an error; repeated documents each keep their row;
other columns take no part, whatever their names.
"""

from __future__ import annotations

import binascii
import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import map_rows, materialize

#: Fixed values of the format.
SYNC, PACKET, PAT_PID, PAT_ID, PMT_ID = 0x47, 188, 0x0000, 0x00, 0x02
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
#: Choices of this writer.
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
PES_BYTES, TICKS, ACCESS_EVERY = 4096, 3600, 8


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    size = len(body) + 9
    raw = bytes((table, 0xB0 | size >> 8, size & 255, number >> 8, number & 255, 0xC1, 0, 0)) + body
    return raw + crc_mpeg(raw).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes((SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0))
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


TABLES = _table_packet(PAT_PID, _section(PAT_ID, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(PMT_ID, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes((PRIVATE_TYPE,)) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes((0x21 | t >> 29 & 0x0E, t >> 22 & 255, 0x01 | t >> 14 & 0xFE, t >> 7 & 255, 0x01 | t << 1 & 0xFE))


def _pes(data: bytes, ticks: int | None, before: bytes | None) -> bytes:
    """A PES packet of ``data``; ``before`` is the data of the packet before, of which it holds the CRC."""
    fields = (b"" if ticks is None else _stamp(ticks)) + (b"" if before is None else binascii.crc_hqx(before, 0).to_bytes(2, "big"))
    flags = 0x80 * (ticks is not None) | 0x02 * (before is not None)
    return b"\x00\x00\x01" + bytes((PRIVATE_STREAM,)) + (len(data) + len(fields) + 3).to_bytes(2, "big") + bytes((0x84, flags, len(fields))) + fields + data


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload: tables first, then one PES packet after the other."""
    out, counter, before = [TABLES], 0, None
    for k, at in enumerate(range(0, len(payload) + PES_BYTES, PES_BYTES)):
        data = payload[at : at + PES_BYTES]
        pes = _pes(data, k * TICKS if data else None, before)
        access, before = bool(data) and k % ACCESS_EVERY == 0, data
        # adaptation field of the first packet: flags and, at a random-access point, the clock reference
        field_ = bytes((7, 0x50)) + ((k * TICKS & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big") if access else b""
        lead = PACKET - 4 - len(field_)
        first, rest = pes[:lead], pes[lead:]
        if len(first) < lead:  # stuffing goes into an adaptation field
            field_ = _stuffed(field_, PACKET - 4 - len(first))
        out.append(_head(True, bool(field_), counter) + field_ + first)
        counter = counter + 1 & 15
        whole = len(rest) // (PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, :3] = (SYNC, MEDIA_PID >> 8, MEDIA_PID & 255)
            packets[:, 3] = 0x10 | counter + np.arange(whole) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, PACKET - 4)
            out.append(packets.tobytes())
            counter = counter + whole & 15
        if tail := rest[whole * (PACKET - 4) :]:
            out.append(_head(False, True, counter) + _stuffed(b"", PACKET - 4 - len(tail)) + tail)
            counter = counter + 1 & 15
    return b"".join(out)


def _head(start: bool, adapted: bool, counter: int) -> bytes:
    return bytes((SYNC, 0x40 * start | MEDIA_PID >> 8, MEDIA_PID & 255, (0x30 if adapted else 0x10) | counter))


def _stuffed(field_: bytes, size: int) -> bytes:
    if size == 1:
        return b"\x00"
    body = field_[1:] or b"\x00"
    return bytes((size - 1,)) + body + b"\xff" * (size - 1 - len(body))


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    timestamps: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)
    access_packets: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    duplicates: int = 0
    counter_errors: int = 0
    crc_errors: int = 0
    whole: bool = False


def _read_section(raw: bytes, got: Stream) -> bytes:
    at = 1 + raw[0]
    size = (raw[at + 1] & 15) << 8 | raw[at + 2] if at + 3 <= len(raw) else 0
    section = raw[at : at + 3 + size]
    if size < 9 or len(section) < 3 + size or crc_mpeg(section):
        got.crc_errors += 1
        return b""
    return section[8:-4]


def _read_tables(p: np.ndarray, pid: np.ndarray, got: Stream) -> None:
    for k in np.flatnonzero(pid == PAT_PID).tolist():
        body = _read_section(p[k, 4:].tobytes(), got)
        got.programs |= {body[i] << 8 | body[i + 1]: (body[i + 2] & 31) << 8 | body[i + 3] for i in range(0, len(body) - 3, 4)}
    for of in set(got.programs.values()):
        for k in np.flatnonzero(pid == of).tolist():
            body = _read_section(p[k, 4:].tobytes(), got)
            i = 4 + ((body[2] & 15) << 8 | body[3]) if len(body) >= 4 else len(body)
            while i + 5 <= len(body):
                got.streams[(body[i + 1] & 31) << 8 | body[i + 2]] = body[i]
                i += 5 + ((body[i + 3] & 15) << 8 | body[i + 4])


def read_stream(media: bytes, seek: bool = False) -> Stream:
    """Parses a stream of any such programme: the media stream's PID is found by the tables. With ``seek`` it may
    begin after its first PES packet, which alone has no CRC of one before."""
    n = len(media) // PACKET
    got = Stream(packets=n)
    p = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    if n * PACKET != len(media) or (p[:, 0] != SYNC).any():
        return got
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    _read_tables(p, pid, got)
    media_pids = [x for x, kind in got.streams.items() if kind == PRIVATE_TYPE]
    if len(media_pids) != 1:
        return got
    place = np.flatnonzero(pid == media_pids[0])
    own = p[place]
    if len(own) > 1:  # a packet may be sent twice
        again = np.append(False, (own[1:] == own[:-1]).all(axis=1))
        got.duplicates = int(again.sum())
        place, own = place[~again], own[~again]
    got.counter_errors = int(np.count_nonzero(np.diff((own[:, 3] & 15).astype(np.int64)) % 16 != 1))
    adapted = own[:, 3] & 0x20 > 0
    skip = np.minimum(np.where(adapted, 5 + own[:, 4].astype(np.int64), 4), PACKET)
    skip[own[:, 3] & 0x10 == 0] = PACKET  # no payload in it
    elementary = own[np.arange(PACKET) >= skip[:, None]].tobytes()
    starts = np.flatnonzero(own[:, 1] & 0x40)
    ends = np.cumsum(PACKET - skip)
    parts, good, before = [], len(starts) > 0 and starts[0] == 0, None
    for k, s in enumerate(starts.tolist()):
        lo = int(ends[s - 1]) if s else 0
        hi = int(ends[starts[k + 1] - 1]) if k + 1 < len(starts) else len(elementary)
        pes = elementary[lo:hi]
        stamped, checked = (pes[7] & 0x80 > 0, pes[7] & 0x02 > 0) if len(pes) >= 9 else (False, False)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or (pes[4] << 8 | pes[5]) != len(pes) - 6 or not 5 * stamped + 2 * checked <= pes[8] <= len(pes) - 9:
            good, before = False, None
            continue
        data = pes[9 + pes[8] :]
        at = 9 + 5 * stamped
        if checked and before is None and not parts and not seek:
            good = False
        if checked and before is not None and int.from_bytes(pes[at : at + 2], "big") != binascii.crc_hqx(before, 0):
            got.crc_errors += 1
        before = data
        if adapted[s] and own[s, 4] and own[s, 5] & 0x40:
            got.access_points.append(len(got.timestamps))
            got.access_packets.append(int(place[s]))
            if own[s, 4] >= 7 and own[s, 5] & 0x10:
                got.clocks.append(int.from_bytes(own[s, 6:12].tobytes(), "big") >> 15)
        if stamped:
            got.timestamps.append((pes[9] & 0x0E) << 29 | pes[10] << 22 | (pes[11] & 0xFE) << 14 | pes[12] << 7 | pes[13] >> 1)
        parts.append(data)
    got.payload = b"".join(parts)
    closed = before is not None and not parts[-1]  # the last packet's CRC is in an empty one
    got.whole = bool(good) and closed and not got.counter_errors and not got.crc_errors
    return got


def read_from(media: bytes, access_packet: int) -> Stream:
    """What a stream holds from a random-access point on, of which ``access_packet`` is the transport packet."""
    return read_stream(media[: len(TABLES)] + media[access_packet * PACKET :], seek=True)


def content_features(payload: bytes) -> str:
    """Of the bytes read back: how many differ, their entropy in bits, mean, share of the commonest, of those from 0x80
    on and of line ends, and the least and greatest entropy of a PES packet's bytes."""
    b = np.frombuffer(payload, np.uint8)
    if not len(b):
        return "distinct=0"

    def entropy(n: np.ndarray) -> float:
        p = n[n > 0] / n.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0

    n = np.bincount(b, minlength=256)
    parts = [entropy(np.bincount(b[at : at + PES_BYTES])) for at in range(0, len(b), PES_BYTES)]
    return f"distinct={np.count_nonzero(n)} entropy={entropy(n):.4f} mean={b.mean():.3f} commonest={n.max() / len(b):.4f} high={n[128:].sum() / len(b):.4f} lines={n[10] / len(b):.4f} least={min(parts):.4f} greatest={max(parts):.4f}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media`` (the transport stream) of every document."""

    def run(rows: dict) -> dict:
        made = [payload_of(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_bytes": [n for n, _ in made], "media": [write_stream(p) for _, p in made]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


READ = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, feature string, packets int, timestamps array<bigint>, "
    "access_points array<int>, access_packets array<int>, duplicates int, counter_errors int, crc_errors int, whole boolean"
)


def read_media(media: DataFrame) -> DataFrame:
    """What the streams in column ``media`` hold (columns READ); access packets are those that ``read_from`` takes."""

    def run(rows: dict) -> dict:
        got = [read_stream(m) for m in rows["media"]]
        out = {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "media_bytes": [len(m) for m in rows["media"]], "media_sha256": [hashlib.sha256(m).hexdigest() for m in rows["media"]], "feature": [content_features(g.payload) for g in got]}
        return out | {n: [getattr(g, n) for g in got] for n in ("payload", "packets", "timestamps", "access_points", "access_packets", "duplicates", "counter_errors", "crc_errors", "whole")}

    return map_rows(media.select("doc_id", "n_bytes", "media"), run, READ)


def op4_transport(spark, sf_dir: str) -> DataFrame:
    got = read_media(materialize(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "transport-media"))
    tail = F.expr("crc32(substring(payload, length(payload) - 63, 64))")
    return got.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
        "packets", "timestamps", "access_points", "access_packets", "counter_errors", "crc_errors", "whole",
    )


def tail_crc(payload: bytes) -> int:
    return zlib.crc32(payload[-64:])
