"""Removal of long repeats with run-length Burrows-Wheeler indexes.

A byte goes where a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. The work is dealt out so that no task sees the corpus:

1. Texts are packed into blocks, dealt once into buckets by block number. Every window of LENGTH
   bytes has an anchor, its K-byte gram of least hash (leftmost of equals). Equal windows have equal
   anchors at equal places.
2. Anchors are counted by hash over all blocks; those of one place only are done with.
3. A stretch of windows with one anchor is a context. The distinct contexts of each block go, by
   anchor, to a shard with the smallest and largest id that hold them there. An anchor found in
   more than ``HOT_BLOCKS`` blocks sends its windows one by one, dealt by their content instead.
4. In a shard the contexts of an anchor are ordered by their smallest id and halved again and again:
   each half of larger ids is streamed backwards against a run-length Burrows-Wheeler index of the
   half of smaller ids. The index keeps runs and the suffix samples at both ends of each run; a
   stream that leaves a run goes on at the end of the nearest run of its symbol, whose sample says
   where that is and, compared with what has matched, how much still matches. The (length, sample)
   pairs so kept are the matching statistics; a length of LENGTH or more marks the window, the
   sample names a document that had it earlier. (A number in place of the anchor's first bytes,
   which all windows of a context hold, keeps matches within their own two halves.)
5. Windows that some document of a block has from an earlier one return to the block with the places
   of its entries, where they are laid over the documents they concern.

Steps 1 to 3 only find candidates (a hash collision adds work, never a removal); the comparison
of step 4 is of bytes.

Edge cases: a null text is empty, an empty table gives no rows; texts of any length are whole;
columns other than doc_id and text take no part, whatever their names; documents with equal ids
don't remove from each other; a null id counts as larger than all; repeated rows of different ids
lose all but the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import bucketed, map_rows, materialize, shuffle_parts

LENGTH, K = 50, 20
SPAN = LENGTH - K + 1
BLOCK_BYTES = 2 << 20
HOT_BLOCKS = 512
SHARD_SYMBOLS = 3 << 19
#: Bytes of all texts for each shard, and for each bucket of blocks.
SHARD_BYTES, BUCKET_BYTES, MAX_BUCKETS = 4 << 20, 16 << 20, 1 << 16
#: From so many shards on they hold more, up to four times ``SHARD_BYTES``: a block has a row for each shard.
SHARDS = 512
_STEP = 1 << 16
_POS = np.uint64((1 << 21) - 1)
_LAST = np.iinfo(np.int64).max


# ---- blocks -------------------------------------------------------------------------------


BLOCKS = "block long, doc_ids array<bigint>, sizes array<int>, data binary"


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int = 8) -> DataFrame:
    """Whole texts side by side, compressed; a longer text has a block of its own."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])
        base, number, ids, texts, size = TaskContext.get().partitionId() << 24, 0, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def done() -> pa.RecordBatch:
            nonlocal number, ids, texts, size
            row = [[base + number], [ids], [[len(t) for t in texts]], [squeeze.compress(b"".join(texts))]]
            number, ids, texts, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                if ids and size + len(raw) > block_bytes:
                    yield done()
                ids.append(doc)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bucketed(rows.mapInArrow(run, BLOCKS), "block", buckets, "runindex_blocks", "uncompressed")


class Block:
    def __init__(self, doc_ids: list[int | None], sizes: list[int], data: bytes):
        self.raw = zstandard.ZstdDecompressor().decompress(data) if sum(sizes) else b""
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.ids = np.array([_LAST if d is None else d for d in doc_ids], np.int64)
        self.ends = np.cumsum(np.array(sizes, np.int64))

    def contexts(self) -> tuple[np.ndarray, ...]:
        """(first window, windows, anchor hash, document number, anchor's place in it) of each stretch with one anchor."""
        parts = [self._part(at) for at in range(0, max(0, len(self.bytes) - LENGTH + 1), _STEP)]
        if not parts:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _part(self, at: int):
        """Contexts that begin with one of ``_STEP`` windows; a stretch over the border gives two."""
        part = self.bytes[at : at + _STEP + LENGTH - 1]
        x = np.ndarray((len(part) - 7,), ">u8", part, 0, (1,)).astype(np.uint64)  # the 8 bytes from each place on
        g = x[: len(part) - K + 1] * np.uint64(0x9E3779B97F4A7C15)
        g ^= x[8 : len(part) - K + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
        g ^= x[K - 8 :] * np.uint64(0x165667B19E3779F9)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        v = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
        for n in (1, 2, 4, 8):
            v = np.minimum(v[:-n], v[n:])
        m = np.minimum(v[: len(part) - LENGTH + 1], v[SPAN - 16 :])
        anchor = (m & _POS).astype(np.int64)
        fits = np.ones(len(anchor), bool)  # windows that no text ends in
        ends = self.ends[np.searchsorted(self.ends, at, side="right") : np.searchsorted(self.ends, at + len(part))] - at
        over = (ends[:, None] - np.arange(1, LENGTH)).ravel()
        fits[over[(over >= 0) & (over < len(anchor))]] = False
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | ~fits[:-1]
        edge = np.flatnonzero(fresh & fits)
        doc = np.searchsorted(self.ends, edge + at, side="right")
        stop = np.minimum(np.append(edge[1:], len(anchor)), self.ends[doc] - LENGTH + 1 - at)
        return edge + at, stop - edge, g[anchor[edge]], doc, anchor[edge] - edge


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's shard and the 32 bits by which the shard knows it."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _key(part: np.ndarray, low: np.ndarray) -> np.ndarray:
    return part.astype(np.uint64) << np.uint64(32) | low


def _side_by_side(rows: list[bytes], kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """What lies in all rows and the row of each."""
    return np.frombuffer(b"".join(rows), kind), np.repeat(np.arange(len(rows)), [len(r) // np.dtype(kind).itemsize for r in rows])


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(sorted_keys)))


# ---- anchors that several places share -------------------------------------------------------


def shared_anchors(blocks: DataFrame, parts: int, hot_blocks: int) -> DataFrame:
    """(block, part, shared, hot): the 32-bit anchors of each block that are found elsewhere too."""

    def anchors(rows: dict) -> dict:
        out = {"part": [], "block": [], "twice": [], "once": []}
        for number, ids, sizes, data in zip(rows["block"], rows["doc_ids"], rows["sizes"], rows["data"]):
            _, _, hashes, doc, _ = Block(ids, sizes, data).contexts()
            key = _key(*_dealt(hashes, parts))
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            edge, size = _runs(key)
            several = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge) if len(edge) else np.zeros(0, bool)
            part, low = (key[edge] >> np.uint64(32)).astype(np.int64), key[edge].astype(np.uint32)
            twos = np.concatenate(([0], np.cumsum(several)))
            twice, once = low[several].tobytes(), low[~several].tobytes()
            edge, size = _runs(part)
            for p, a, b, c, d in zip(part[edge].tolist(), edge.tolist(), (edge + size).tolist(), twos[edge].tolist(), twos[edge + size].tolist()):
                out["part"].append(p)
                out["block"].append(number)
                out["twice"].append(twice[4 * c : 4 * d])
                out["once"].append(once[4 * (a - c) : 4 * (b - d)])
        return out

    def count(table: pa.Table) -> pa.Table:
        part, block = table["part"][0].as_py(), table["block"].to_pylist()
        (twice, of_twice), (once, of_once) = (_side_by_side(table[c].to_pylist()) for c in ("twice", "once"))
        own, of = np.concatenate((twice, once)), np.concatenate((of_twice, of_once))
        edge, n = _runs(np.sort(own))
        values, many = np.sort(own)[edge], n > hot_blocks
        shared, hot = np.union1d(values[(n > 1) & ~many], np.setdiff1d(np.unique(twice), values[many])), values[many]
        order = np.argsort(of, kind="stable")
        own, of = own[order], of[order]
        out = {}
        for name, some in (("shared", shared), ("hot", hot)):
            which = _isin(own, some)
            raw, ends = own[which].tobytes(), 4 * np.cumsum(np.bincount(of[which], minlength=len(block)))
            out[name] = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        used = [k for k in range(len(block)) if out["shared"][k] or out["hot"][k]]
        return pa.table({"block": pa.array([block[k] for k in used], pa.int64()), "part": pa.array([part] * len(used), pa.int32()), **{c: pa.array([out[c][k] for k in used], pa.binary()) for c in ("shared", "hot")}})

    found = map_rows(blocks, anchors, "part int, block long, twice binary, once binary")
    return found.groupBy("part").applyInArrow(count, "block long, part int, shared binary, hot binary")


def _isin(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


# ---- contexts of a block that go to shards ----------------------------------------------------


class Entries:
    """The distinct shared contexts of a block, in an order that the block and its tables fix."""

    def __init__(self, block: Block, parts: int, shared: list[tuple[int, bytes, bytes]]):
        first, count, hashes, doc, anchor = block.contexts()
        part, low = _dealt(hashes, parts)
        key, of_row = _key(part, low), np.array([s[0] for s in shared], np.int64)

        def mine(k: int) -> np.ndarray:
            lows, row = _side_by_side([s[k] for s in shared])
            return np.sort(_key(of_row[row], lows))

        cold, hot = _isin(key, mine(1)), _isin(key, mine(2))
        # a hot anchor's windows, one by one, dealt by their content
        n = count[hot]
        window = np.repeat(first[hot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        raw = block.raw
        content = np.array([int.from_bytes(hashlib.blake2b(raw[w : w + LENGTH], digest_size=8).digest(), "little") for w in window.tolist()], np.uint64)
        self.first = np.concatenate((first[cold], window))
        self.count = np.concatenate((count[cold], np.ones(len(window), np.int64)))
        self.doc = np.concatenate((doc[cold], np.repeat(doc[hot], n)))
        dealt_part, dealt_low = _dealt(np.concatenate((hashes[cold], content)), parts)
        number: dict[tuple[int, int, bytes], int] = {}
        self.entry = np.array(
            [number.setdefault((p, h, raw[a : a + c + LENGTH - 1]), len(number)) for p, h, a, c in zip(dealt_part.tolist(), dealt_low.tolist(), self.first.tolist(), self.count.tolist())], np.int64
        )
        self.contexts = list(number)
        self.anchor = np.zeros(len(number), np.uint8)
        self.anchor[self.entry] = np.concatenate((anchor[cold], np.repeat(first[hot] + anchor[hot], n) - window))
        self.low_id = np.full(len(number), _LAST, np.int64)
        self.high_id = np.full(len(number), np.iinfo(np.int64).min, np.int64)
        np.minimum.at(self.low_id, self.entry, block.ids[self.doc])
        np.maximum.at(self.high_id, self.entry, block.ids[self.doc])


#: Shards that only pass the places of entries on.
PLACES = 1 << 16
ENTRIES = "part int, block long, numbers binary, lows binary, anchors binary, sizes binary, texts binary, low_ids binary, high_ids binary"


def send_contexts(joined: DataFrame, parts: int) -> DataFrame:
    def run(rows: dict) -> dict:
        out = {n: [] for n in ("part", "block", "numbers", "lows", "anchors", "sizes", "texts", "low_ids", "high_ids")}
        squeeze = zstandard.ZstdCompressor(level=3)
        for number, ids, sizes, data, shared in zip(rows["block"], rows["doc_ids"], rows["sizes"], rows["data"], rows["shared"]):
            e = Entries(Block(ids, sizes, data), parts, [(s["part"], s["shared"], s["hot"]) for s in shared])
            part = np.array([c[0] for c in e.contexts], np.int64)
            order = np.argsort(part, kind="stable")
            texts = [e.contexts[k][2] for k in order.tolist()]
            lows = np.array([e.contexts[k][1] for k in order.tolist()], np.uint32)
            flat = {"numbers": order.astype(np.int32), "lows": lows, "anchors": e.anchor[order], "sizes": np.fromiter(map(len, texts), np.uint8, len(texts)), "low_ids": e.low_id[order], "high_ids": e.high_id[order]}
            edge, size = _runs(part[order])
            out["part"] += part[order[edge]].tolist()
            out["block"] += [number] * len(edge)
            for a, b in zip(edge.tolist(), (edge + size).tolist()):
                for name, x in flat.items():
                    out[name].append(x[a:b].tobytes())
                out["texts"].append(squeeze.compress(b"".join(texts[a:b])))
            # where the block's entries are returns to it with what is found
            place = np.argsort(e.first)
            for name in out:
                out[name].append({"part": -1 - (number + 7919 * (number >> 24)) % PLACES, "block": number, "texts": squeeze.compress(np.concatenate((np.diff(e.first[place], prepend=0), e.entry[place])).astype(np.int32).tobytes())}.get(name))
        return out

    return map_rows(joined.select("block", "doc_ids", "sizes", "data", "shared"), run, ENTRIES)


# ---- the index of a shard ----------------------------------------------------------------------


def _begins(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the run of equals begins that each place lies in."""
    fresh = np.ones(len(sorted_keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(sorted_keys)), 0))


def _tied(begins: np.ndarray) -> np.ndarray:
    """Whether a run has more than this place."""
    same = begins[1:] == begins[:-1]
    return np.append(same, False) | np.append(False, same)


def _suffix_order(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes by their symbols, then by place. A rank is the number of lesser suffixes: by 8 symbols, then by twice as
    many again and again for those alone that are tied and go on."""
    bits = len(words).bit_length()
    order = np.argsort(words)
    begins = _begins(words[order])
    rank = np.empty(len(words), np.int64)
    rank[order] = begins
    go, k = order[_tied(begins)], 8
    while len(go := go[left[go] >= k]):
        if 3 * bits <= 63:  # values are sorted faster than places
            key = np.sort(rank[go] << 2 * bits | rank[go + k] << bits | go)
            go, key = key & (1 << bits) - 1, key >> bits
            own, of = _begins(key), _begins(key >> bits)
        else:
            key = rank[go] << 32 | rank[go + k]
            o = np.argsort(key)
            go, key = go[o], key[o]
            own, of = _begins(key), _begins(key >> 32)
        rank[go] += own - of
        go, k = go[_tied(own)], 2 * k
    alone = np.bincount(rank, minlength=len(rank))[rank] == 1
    order[rank[alone]] = np.flatnonzero(alone)
    same = np.flatnonzero(~alone)
    key = np.sort(rank[same] << bits | same)
    begins = _begins(key >> bits)
    order[(key >> bits) + np.arange(len(key)) - begins] = key & (1 << bits) - 1
    return order


class Texts:
    """Byte strings side by side, each closed by a terminator: symbols (byte + 1, 0 the terminator) and 8-symbol words."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes + 1) - 1
        n = int(self.ends[-1]) + 1 if len(sizes) else 0
        self.symbols = np.zeros(n, np.uint8)
        closed = np.zeros(n, bool)
        closed[self.ends] = True
        self.symbols[~closed] = flat + np.uint8(1)  # UTF-8 has no byte 255
        self.left = np.repeat(self.ends, sizes + 1) - np.arange(n)
        word = np.concatenate((self.symbols, np.zeros(8, np.uint8))).astype(np.uint64)
        for k in (1, 2, 4):
            word = word[:-k] << np.uint64(8 * k) | word[k:]
        word = word[:n]
        short = self.left < 8  # nothing of the next text
        word[short] &= ~(~np.uint64(0) >> (np.uint64(8) * self.left[short].astype(np.uint64)))
        self.words = word

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place)


class RunLengthIndex:
    """Run-compressed BWT of texts of up to 128 bytes, with the suffix samples at both ends of every run.

    Suffixes are ordered by their bytes and then by text; of that order only what stands at run ends is kept.
    """

    def __init__(self, texts: Texts):
        self.texts, t = texts, texts.symbols
        order = _suffix_order(texts.words, texts.left)
        before = t[order - 1]
        self.run_start, self.run_size = _runs(before)
        self.run_symbol = before[self.run_start].astype(np.int64)
        self.first_sample, self.last_sample = order[self.run_start], order[self.run_start + self.run_size - 1]
        self.by_symbol = np.argsort(self.run_symbol, kind="stable")
        self.run_target = np.empty(len(self.run_start), np.int64)
        self.run_target[self.by_symbol] = np.cumsum(self.run_size[self.by_symbol]) - self.run_size[self.by_symbol]
        self.symbol_start = self.run_symbol[self.by_symbol] << 40 | self.run_start[self.by_symbol]

    def matching_statistics(self, queries: Texts) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the queries the length of the longest match that begins there and where it is in the texts."""
        lengths, samples = np.zeros(len(queries.symbols), np.int64), np.zeros(len(queries.symbols), np.int64)
        order = np.argsort(-queries.sizes, kind="stable")  # those still alive at a step come first
        ends, sizes = queries.ends[order], queries.sizes[order]
        alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        home = int(self.texts.ends[0])  # the first text's terminator is the first suffix
        at, sample, length = np.zeros(len(order), np.int64), np.full(len(order), home), np.zeros(len(order), np.int64)
        for step, n in enumerate(alive.tolist(), 1):
            place = ends[:n] - step
            symbol = queries.symbols[place].astype(np.int64)
            a = at[:n]
            run = np.searchsorted(self.run_start, a, side="right") - 1
            miss = np.flatnonzero(self.run_symbol[run] != symbol)
            lost = self._jump(miss, symbol[miss], place[miss] + 1, queries, run, a, sample, length) if len(miss) else miss
            moved = self.run_target[run] + a - self.run_start[run]
            at[:n], sample[:n], length[:n] = moved, sample[:n] - 1, length[:n] + 1
            if len(lost):
                at[lost], sample[lost], length[lost] = 0, home, 0
            lengths[place], samples[place] = length[:n], sample[:n]
        return lengths, samples

    def _jump(self, miss, symbol, place, queries: Texts, run, at, sample, length) -> np.ndarray:
        """Moves streams to the run end, of the two nearest ones of their symbol, that shares most with what has matched;
        returns the streams that have none."""
        n, below = len(miss), np.searchsorted(self.symbol_start, symbol << 40 | at[miss])
        near = np.concatenate((below - 1, below))  # the run above, then the run below
        inside = (near >= 0) & (near < len(self.by_symbol))
        to = self.by_symbol[np.where(inside, near, 0)]
        inside &= self.run_symbol[to] == np.concatenate((symbol, symbol))
        above = np.arange(2 * n) < n
        samples = np.where(above, self.last_sample[to], self.first_sample[to])
        shared = np.full(2 * n, -1, np.int64)
        ok = np.flatnonzero(inside)
        which = ok % n
        shared[ok] = self._common(samples[ok], queries, place[which], length[miss[which]])
        best = np.arange(n) + n * (shared[n:] > shared[:n])
        found = shared[best] >= 0
        kept, best = miss[found], best[found]
        run[kept], sample[kept], length[kept] = to[best], samples[best], shared[best]
        at[kept] = self.run_start[to[best]] + np.where(above[best], self.run_size[to[best]] - 1, 0)
        length[miss[~found]] = 0
        return miss[~found]

    def _common(self, own: np.ndarray, queries: Texts, place: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many symbols, ``limit`` at most, agree from a place of the texts and a place of the queries on."""
        out, live, k = limit.copy(), np.flatnonzero(limit > 0), 0
        while len(live):
            x = self.texts.words[own[live] + k] ^ queries.words[place[live] + k]
            off = np.flatnonzero(x)
            y = x[off]
            bits = np.frexp((y & ~(y >> np.uint64(1))).astype(np.float64))[1]  # no rounding can lift the highest bit
            out[live[off]] = np.minimum(k + (64 - bits) // 8, limit[live[off]])
            k += 8
            live = live[(x == 0) & (limit[live] > k)]
        return out


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch of ``sizes``."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


def earlier_ids(texts: list[bytes], anchors: np.ndarray, groups: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window of distinct texts the id of a text of its group that has it too, a smaller one than the text's
    own if any has; and where each text's windows begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    first = np.cumsum(windows) - windows
    found = np.repeat(ids, windows)
    order = np.lexsort((ids, groups))
    g, i = groups[order], ids[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = g[1:] != g[:-1]
    step = np.cumsum(fresh | np.append(True, i[1:] != i[:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = step - np.maximum.accumulate(np.where(fresh, step, 0))
    highest = np.zeros(int(groups.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, groups, rank)
    highest = highest[groups]
    open_ = np.ones(len(texts), bool)

    def taken(which: np.ndarray, node: np.ndarray) -> Texts:
        own = flat[_spread(begin[which], sizes[which])]
        at = np.cumsum(sizes[which]) - sizes[which] + anchors[which]
        for k in range(4):
            own[at + k] = node >> 7 * k & 127
        return Texts(own, sizes[which])

    def ask(told: list[tuple[np.ndarray, np.ndarray]], asked: list[tuple[np.ndarray, np.ndarray]]) -> None:
        (tells, of_tells), (asks, of_asks) = (tuple(map(np.concatenate, zip(*x))) for x in (told, asked))
        index, queries = RunLengthIndex(taken(tells, of_tells)), taken(asks, of_asks)
        lengths, samples = index.matching_statistics(queries)
        w = windows[asks]
        places = _spread(queries.ends - queries.sizes, w)
        hit = np.flatnonzero(lengths[places] >= length)
        out = _spread(first[asks], w)
        found[out[hit]] = ids[tells[index.texts.text_of(samples[places[hit]])]]
        open_[asks] = np.maximum.reduceat((found[out] == np.repeat(ids[asks], w)).astype(np.int8), np.cumsum(w) - w) > 0

    told, asked, nodes, symbols = [], [], 0, 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        near = np.flatnonzero(highest >> bit > 0)
        upper = rank[near] >> bit & 1 == 1
        node = np.unique(groups[near] << 32 | rank[near] >> bit + 1, return_inverse=True)[1]
        asks = np.flatnonzero(upper & open_[near])
        has = np.zeros(len(near), bool)
        has[node[asks]] = True
        tells = np.flatnonzero(~upper & has[node])
        if len(asks):
            told.append((near[tells], node[tells] + nodes))
            asked.append((near[asks], node[asks] + nodes))
            nodes, symbols = nodes + len(near), symbols + int(sizes[near].sum())
        if told and (symbols > SHARD_SYMBOLS or not bit):  # several halvings share an index, up to a size
            ask(told, asked)
            told, asked, nodes, symbols = [], [], 0, 0
    return found, first


MARKS = "block long, numbers binary, sizes binary, ids binary, places binary"


def match_shard(table: pa.Table) -> pa.Table:
    """For entries of each block: ids of earlier documents with their windows, where an entry has use for them."""
    if table["part"][0].as_py() < 0:
        nothing = pa.array([b""] * len(table), pa.binary())
        return pa.table({"block": table["block"], "numbers": nothing, "sizes": nothing, "ids": nothing, "places": table["texts"]})
    rows = table.select(["block", "numbers", "lows", "anchors", "sizes", "texts", "low_ids", "high_ids"]).to_pydict()
    blocks = rows["block"]
    wide = zstandard.ZstdDecompressor()
    read = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
    raw, ends = b"".join(map(wide.decompress, rows["texts"])), np.cumsum(read("sizes", np.uint8).astype(np.int64)).tolist()
    texts = [raw[a:b] for a, b in zip([0, *ends], ends)]
    del raw
    number, low, anchor, low_id, high_id = read("numbers", np.int32), read("lows", np.uint32), read("anchors", np.uint8), read("low_ids", np.int64), read("high_ids", np.int64)
    of = np.repeat(np.arange(len(blocks)), [len(x) for x in rows["sizes"]])
    order = np.argsort(low, kind="stable")
    symbols = np.cumsum(np.array([len(texts[k]) + 1 for k in order.tolist()]))
    edge, size = _runs(low[order])
    out = {"block": [], "numbers": [], "sizes": [], "ids": []}
    kept: list[list] = [[[], [], []] for _ in blocks]
    a = 0
    while a < len(edge):
        # as many anchors as fit a shard's index, one at least
        base = symbols[edge[a] - 1] if edge[a] else 0
        b = max(a + 1, int(np.searchsorted(symbols[edge + size - 1], base + SHARD_SYMBOLS, side="right")))
        own = order[edge[a] : edge[b - 1] + size[b - 1]]
        _match(own, texts, low, anchor, number, low_id, high_id, of, kept)
        a = b
    for k, (n, s, i) in enumerate(kept):
        if n:
            for name, x in zip(out, (blocks[k], b"".join(n), b"".join(s), b"".join(i))):
                out[name].append(x)
    return pa.table({"block": pa.array(out["block"], pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in ("numbers", "sizes", "ids")}, "places": pa.nulls(len(out["block"]), pa.binary())})


def _match(own: np.ndarray, texts, low, anchor, number, low_id, high_id, of, kept) -> None:
    distinct: dict[bytes, int] = {}
    text_of = np.array([distinct.setdefault(texts[k], len(distinct)) for k in own.tolist()], np.int64)
    least = np.full(len(distinct), _LAST, np.int64)
    np.minimum.at(least, text_of, low_id[own])
    a, lows = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    a[text_of], lows[text_of] = anchor[own], low[own]
    named: dict[tuple[int, bytes], int] = {}
    groups = np.array([named.setdefault((h, t[x : x + K]), len(named)) for t, x, h in zip(distinct, a.tolist(), lows.tolist())], np.int64)
    found, begin = earlier_ids(list(distinct), a, groups, least)
    windows = np.fromiter(map(len, distinct), np.int64, len(distinct)) - LENGTH + 1
    earliest = np.minimum.reduceat(found, begin)
    useful = np.flatnonzero(earliest[text_of] < high_id[own])
    which = own[useful]
    block_order = np.argsort(of[which], kind="stable")
    useful, which = useful[block_order], which[block_order]
    edge, size = _runs(of[which])
    t = text_of[useful]
    ends = np.cumsum(windows[t])
    numbers, sizes, ids = number[which].astype(np.int32), windows[t].astype(np.uint8), found[_spread(begin[t], windows[t])]
    for k, a, b, c, d in zip(of[which[edge]].tolist(), edge.tolist(), (edge + size).tolist(), (ends[edge] - windows[t[edge]]).tolist(), ends[edge + size - 1].tolist()):
        for kind, x in zip(kept[k], (numbers[a:b], sizes[a:b], ids[c:d])):
            kind.append(x.tobytes())


# ---- back in the blocks ------------------------------------------------------------------------


RESULT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def lay_marks(joined: DataFrame) -> DataFrame:
    """Every document with the byte spans removed and the bytes kept (columns RESULT)."""

    def run(rows: dict) -> dict:
        out = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        for ids, sizes, data, marks in zip(rows["doc_ids"], rows["sizes"], rows["data"], rows["marks"]):
            block = Block(ids, sizes, data)
            gone = _gone(block, marks) if marks else np.zeros(len(block.bytes), bool)
            for doc, a, b in zip(ids, (block.ends - sizes).tolist(), block.ends.tolist()):
                own = gone[a:b]
                flips = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                out["doc_id"].append(doc)
                out["n_bytes"].append(b - a)
                out["spans"].append([{"start": s, "end": e} for s, e in flips.reshape(-1, 2).tolist()])
                out["kept"].append(block.bytes[a:b][~own].tobytes() if len(flips) else block.raw[a:b])
        return out

    return map_rows(joined.select("doc_ids", "sizes", "data", "marks"), run, RESULT)


def _gone(block: Block, marks) -> np.ndarray:
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(next(m["places"] for m in marks if m["places"] is not None)), np.int32)
    first, entry = np.cumsum(places[: len(places) // 2].astype(np.int64)), places[len(places) // 2 :].astype(np.int64)
    number, size, ids = (np.frombuffer(b"".join(m[c] for m in marks), kind) for c, kind in (("numbers", np.int32), ("sizes", np.uint8), ("ids", np.int64)))
    n, at = np.zeros(int(entry.max(initial=0)) + 1, np.int64), np.zeros(int(entry.max(initial=0)) + 1, np.int64)
    n[number] = size
    at[number] = np.cumsum(n[number]) - n[number]
    own = n[entry] > 0
    first, entry = first[own], entry[own]
    w = n[entry]
    place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    earliest = ids[np.repeat(at[entry], w) + place]
    hit = earliest < np.repeat(block.ids[np.searchsorted(block.ends, first, side="right")], w)
    start = (np.repeat(first, w) + place)[hit]
    cover = np.bincount(start, minlength=len(block.bytes) + LENGTH + 1)
    return (np.cumsum(cover[: len(block.bytes)] - np.concatenate((np.zeros(LENGTH, np.int64), cover[: max(0, len(block.bytes) - LENGTH)]))[: len(block.bytes)])) > 0


def buckets_of(size: int, least: int) -> int:
    """Buckets for texts of ``size`` bytes; from ``MAX_BUCKETS`` on, short of Spark's own limit of 100,000, buckets grow instead."""
    return min(MAX_BUCKETS, max(least, size // BUCKET_BYTES))


def shards_of(size: int) -> int:
    """Shards for texts of ``size`` bytes."""
    return 1 + size // min(4 * SHARD_BYTES, max(SHARD_BYTES, size // SHARDS))


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, removed spans and kept bytes of every document (columns RESULT).

    Shards and buckets are as many as the bytes of all texts ask for, so that each stays of one size.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts, buckets = parts or shards_of(size), buckets_of(size, shuffle_parts(docs.sparkSession))
    blocks = pack_blocks(docs, block_bytes, buckets)
    shared = shared_anchors(blocks, parts, hot_blocks)
    of_block = bucketed(shared.groupBy("block").agg(F.collect_list(F.struct("part", "shared", "hot")).alias("shared")), "block", buckets, "runindex_shared")
    entries = send_contexts(blocks.join(of_block, "block"), parts)
    marks = materialize(entries.groupBy("part").applyInArrow(match_shard, MARKS), "runindex-marks")
    found = marks.groupBy("block").agg(F.collect_list(F.struct("numbers", "sizes", "ids", "places")).alias("marks"))
    return lay_marks(blocks.join(found, "block", "left"))


def op2_runindex(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, unnest(range(0, length(h) // 2)) AS i, h FROM d
), b AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 100 <= length(h) THEN md5_number(substr(h, 2 * i + 1, 100)) END AS w FROM p
), m AS (
  SELECT *, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS rep FROM b
), g AS (
  SELECT doc_id, i, x, coalesce(bool_or(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM m
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(gone::INT), 0) AS BIGINT) AS n_removed, CAST(coalesce(sum(opens::INT), 0) AS BIGINT) AS n_spans,
       sha256(coalesce(unhex(string_agg(CASE WHEN gone THEN '' ELSE x END, '' ORDER BY i)), ''::BLOB)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, h
"""
