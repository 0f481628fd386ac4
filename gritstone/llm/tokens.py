"""Token-ID output in Re-Pair compressed blocks.

Documents are encoded with a public byte-level BPE vocabulary, closed with an end id, laid out in
ascending doc_id order and written as blocks. Within a block (the shard of the method) frequent
pairs of ids are replaced by nonterminals again and again; a block stores its rules, the length
each rule expands to, and the symbols of every document, which never cross a document's border.
Any document is decoded alone: its symbols are found by offset and expanded by the rules.

Encoding keeps a bounded memory of pieces. A text may be cut before each blank that a visible
character follows, since the vocabulary's splitting pattern always starts a piece there; unseen
pieces are encoded by the tokenizer together, and known ones are looked up. Texts that hold a
special token's string are encoded whole.

Edge cases: null and empty texts give the end id alone; a null doc_id sorts first; equal ids are
ordered by text, and equal rows each have their place; texts of any length are encoded whole and may make a block of their own;
an empty table gives no block; other columns, whatever their names, take no part. Ids must be below 2**31.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm.common import doc_texts, map_rows, materialize, slices, vocabulary_path

END_ID = 2
BLOCK_IDS = 1 << 21
MAX_ROUNDS, RULES_A_ROUND, MIN_COUNT = 3, 4096, 64
#: Pieces remembered in each of two halves: a worker's memory holds some 200 bytes for each.
MEMORY_PIECES = 250_000
_CUT = re.compile(r"(?= [^ \s])")
_MARKS = frozenset(".,;:!?|")
#: Borders of the splitting pattern within a piece: a letter before a mark or line end, a line end before a
#: letter, and the last line end of a run of white space, which the pattern sets apart from what it follows.
_PARTS = re.compile(r"(?<=[^\W\d_])(?=[.,;:!?|\n])|(?<=[.,;:!?|])(?=\n)|(?<=\s)(?=\n[^\W\d_])|(?<=\n)(?=[^\W\d_])")


class Encoder:
    """The tokenizer with a bounded memory of the pieces between blanks."""

    def __init__(self, path: str, memory: int = MEMORY_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        size = self.tokenizer.get_vocab_size()
        self.bytes = np.zeros(size, np.int64)
        for i in range(size):
            if i not in added:
                self.bytes[i] = len(self.tokenizer.id_to_token(i))  # byte-level: a character for each byte
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memory = memory

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of unseen pieces: made of the ids of their words where those are known."""
        known, before, parts_of, unseen = self.known, self.older.get, [], []
        for p in pieces:
            ids = before(p)
            if ids is not None:
                known[p] = ids
            elif p[-1:] in _MARKS and p[-2:-1].isalpha() and "\n" not in p:
                parts_of.append((p, (p[:-1], p[-1])))
            elif "\n" in p:
                parts_of.append((p, _PARTS.split(p)))
            else:
                unseen.append(p)
        more = {x for _, parts in parts_of for x in parts}.difference(known)
        known |= {x: ids for x in more if (ids := before(x)) is not None}
        self._encode_unseen([*unseen, *more.difference(known).difference(unseen)])
        for p, parts in parts_of:
            known[p] = b"".join([known[x] for x in parts])

    def _encode_unseen(self, pieces: list[str]) -> None:
        """Pieces of a blank and a visible character are encoded in a row: each starts where the pattern cuts."""
        joins = [p[:1] == " " and p[1:2].strip() != "" for p in pieces]
        alone = [p for p, j in zip(pieces, joins) if not j]
        self.known |= {p: ids.tobytes() for p, ids in zip(alone, self._whole(alone))}
        pieces = [p for p, j in zip(pieces, joins) if j]
        step = 20_000
        for at in range(0, len(pieces), step):
            part = pieces[at : at + step]
            ids = self._whole(["".join(part)])[0]
            ends = np.cumsum(self.bytes[ids])
            want = np.cumsum(np.fromiter([len(p) if p.isascii() else len(p.encode()) for p in part], np.int64, len(part)))
            cut = np.searchsorted(ends, want) + 1
            if not np.array_equal(ends[cut - 1], want):
                raise ValueError("a token crosses a piece's border: this vocabulary needs whole texts")
            raw, width = ids.tobytes(), self.dtype.itemsize
            at_byte = 0
            for piece, end in zip(part, (cut * width).tolist()):
                self.known[piece] = raw[at_byte:end]
                at_byte = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: distinct pieces of all texts are looked up, then laid out in order."""
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        for k, ids in zip(whole, self._whole([texts[k] for k in whole])):
            out[k] = ids
        if len(self.known) > self.memory:
            self.older, self.known = self.known, {}  # pieces in use come back from the older half
        plain, odd = [], []
        for k, t in enumerate(texts):
            if out[k] is None:
                (odd if not t or _FIRST in t or "  " in t or t[-1] == " " or _ODD.search(t) else plain).append(k)
        split = [self.pieces(texts[k]) for k in odd]
        parts = pc.split_pattern(pa.array([_FIRST + texts[k] for k in plain], pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        # between blanks a piece lacks its blank; the first of a text has its mark instead
        blank = pa.scalar(" ", pa.large_string())
        distinct = pc.replace_substring(pc.binary_join_element_wise(blank, coded.dictionary, pa.scalar("", pa.large_string())), " " + _FIRST, "").to_pylist()
        unseen = set(distinct).union(*split).difference(self.known)
        self.known[""] = b""
        if unseen := unseen.difference(("",)):
            self._learn(unseen)
        get = self.known.__getitem__
        for k, s in zip(odd, split):
            out[k] = np.frombuffer(b"".join(map(get, s)), self.dtype)
        found = list(map(get, distinct))
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int32, len(found)) // np.int32(self.dtype.itemsize)
        begin = np.cumsum(size, dtype=np.int32) - size
        index = coded.indices.to_numpy()
        n = size[index]
        ends = np.cumsum(n, dtype=np.int32)  # a slice's ids are far below 2**31
        place = np.repeat(begin[index] - (ends - n), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = flat[place]
        cut = np.concatenate(([0], ends))[parts.offsets.to_numpy()]
        for k, x, y in zip(plain, cut[:-1].tolist(), cut[1:].tolist()):
            out[k] = ids[x:y]
        return out

    @staticmethod
    def pieces(text: str) -> list[str]:
        return [p for p in _CUT.split(text) if p]


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """This worker's encoder: its memory serves all tasks that the worker runs."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary_path(vocabulary))
    return _encoders[vocabulary]


#: Marks the first piece of a text.
_FIRST = "\x01"
#: A blank before another kind of white space (or a blank line's end) is no place to cut.
_ODD = re.compile(r" \s")


_SLOT_BITS = 18


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)


def compress(symbols: np.ndarray, last: np.ndarray, first_rule: int, max_rounds: int = MAX_ROUNDS, rules_a_round: int = RULES_A_ROUND, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, ``last`` flags of them, rules as pairs). ``last`` marks each document's end.

    A round replaces its most frequent pairs at once; where two chosen pairs overlap, the more
    frequent one wins and, of equals, the left one. Rounds end when no pair is frequent enough.
    """
    rules = np.zeros((0, 2), np.int64)
    wide = np.int64 if first_rule + max_rounds * rules_a_round > 1 << 16 else np.uint32
    seq = symbols.astype(wide)
    for _ in range(max_rounds):
        if len(seq) < 2:
            break
        base = first_rule + len(rules)
        pair = seq[:-1] * wide(base) + seq[1:]
        inside = ~last[:-1]
        seen = np.sort(pair[inside])
        if not len(seen):
            break
        edge = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1], [True])))
        count = np.diff(edge)
        often = np.flatnonzero(count >= min_count)
        if not len(often):
            break
        order = often[np.argsort(-count[often], kind="stable")[:rules_a_round]]
        chosen = seen[edge[order]]
        slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        slots[_slot(chosen[::-1])] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)
        kept = slots[_slot(chosen)] == np.arange(len(chosen))  # of pairs that share a slot the most frequent is chosen
        chosen = chosen[kept]
        none = np.int32(len(chosen))
        slots[:] = none
        slots[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        rank = slots[_slot(pair)]
        rank[~inside | (np.append(chosen, chosen[:1])[rank] != pair)] = none
        before, after = np.append(none, rank[:-1]), np.append(rank[1:], none)
        at = np.flatnonzero((rank < none) & (rank < before) & (rank <= after))
        seq[at] = (base + rank[at]).astype(wide)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        seq, last = seq[keep], last[keep]
        rules = np.concatenate((rules, np.stack((chosen // wide(base), chosen % wide(base)), axis=1).astype(np.int64)))
    return seq, last, rules


MAGIC = b"RPB1"


def pack_block(docs: list[np.ndarray], end_id: int, first_rule: int) -> bytes:
    """A block: header, ids and symbols of each document, rules, expansion lengths, symbols."""
    ids = np.concatenate([np.concatenate((d, [end_id])) for d in docs]).astype(np.int64)
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    seq, last, rules = compress(ids, last, first_rule)
    length = np.ones(first_rule + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        length[first_rule + k] = length[a] + length[b]
    n_symbols = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))
    wide = first_rule + len(rules) > 1 << 16
    head = struct.pack("<4sIIIQB", MAGIC, first_rule, len(docs), len(rules), len(seq), wide)
    return b"".join((head, sizes.astype("<u4").tobytes(), n_symbols.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), length[first_rule:].astype("<u4").tobytes(), seq.astype("<u4" if wide else "<u2").tobytes()))


class Block:
    """Reads a block; ``document(k)`` decodes one document alone."""

    def __init__(self, raw: bytes):
        magic, self.first_rule, n, r, s, wide = struct.unpack_from("<4sIIIQB", raw)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize("<4sIIIQB")
        self.n_tokens, at = np.frombuffer(raw, "<u4", n, at), at + 4 * n
        self.n_symbols, at = np.frombuffer(raw, "<u4", n, at), at + 4 * n
        self.rules, at = np.frombuffer(raw, "<u4", 2 * r, at).reshape(r, 2), at + 8 * r
        lengths, at = np.frombuffer(raw, "<u4", r, at), at + 4 * r
        self.symbols = np.frombuffer(raw, "<u4" if wide else "<u2", s, at)
        self.ends = np.cumsum(self.n_symbols, dtype=np.int64)
        self.length = np.concatenate((np.ones(self.first_rule, np.int64), lengths))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        out = symbols.astype(np.int64)
        while len(at := np.flatnonzero(out >= self.first_rule)):
            pairs = self.rules[out[at] - self.first_rule]
            size = np.ones(len(out), np.int64)
            size[at] = 2
            out = np.repeat(out, size)
            place = np.cumsum(size)[at] - 2
            out[place], out[place + 1] = pairs[:, 0], pairs[:, 1]
        return out.astype("<u4")

    def document(self, k: int) -> np.ndarray:
        end = int(self.ends[k])
        return self.expand(self.symbols[end - int(self.n_symbols[k]) : end])

    def documents(self) -> Iterator[np.ndarray]:
        ids, at = self.expand(self.symbols), 0
        for n in self.n_tokens.tolist():
            yield ids[at : at + n]
            at += n


BLOCKS = "shard int, block int, doc_ids array<bigint>, n_ids long, data binary"


def write_blocks(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and compress; returns the written table of blocks in ascending doc_id order (BLOCKS)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        first_rule = encoder.tokenizer.get_vocab_size()
        shard = TaskContext.get().partitionId()
        ids, kept, size, block = [], [], 0, 0

        def done() -> pa.RecordBatch:
            nonlocal ids, kept, size, block
            row = [[shard], [block], [ids], [size], [pack_block(kept, end_id, first_rule)]]
            ids, kept, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()))], names=["shard", "block", "doc_ids", "n_ids", "data"])

        for batch in batches:
            for part in slices(batch, 10_000):
                rows = part.to_pydict()
                for doc, enc in zip(rows["doc_id"], encoder.encode([t or "" for t in rows["text"]])):
                    if kept and size + len(enc) >= block_ids:
                        yield done()
                    ids.append(doc)
                    kept.append(enc)
                    size += len(enc) + 1
        if kept:
            yield done()
        pa.default_memory_pool().release_unused()  # a worker outlives its task, and its arrays' memory would stay with it

    ordered = doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, BLOCKS), "token-blocks", "uncompressed")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the blocks alone."""

    def run(rows: dict) -> dict:
        out = {"doc_id": [], "shard": [], "block": [], "within": [], "n_tokens": [], "ids_crc32": []}
        for shard, block, ids, raw in zip(rows["shard"], rows["block"], rows["doc_ids"], rows["data"]):
            at = 0
            for doc, tokens in zip(ids, Block(raw).documents()):
                for name, value in zip(out, (doc, shard, block, at, len(tokens), zlib.crc32(tokens.tobytes()))):
                    out[name].append(value)
                at += len(tokens)
        return out

    one = map_rows(blocks.select("shard", "block", "doc_ids", "data"), run, "doc_id long, shard int, block int, within long, n_tokens long, ids_crc32 long")
    # offsets: shards first (as many rows as partitions were written), then the blocks of each
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("of_shard"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("shard", "block", inside.alias("of_block")).join(shards, "shard").select("shard", "block", (F.col("of_shard") + F.col("of_block")).alias("at"))
    return one.join(starts, ["shard", "block"]).select("doc_id", (F.col("at") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    return read_blocks(write_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")))
