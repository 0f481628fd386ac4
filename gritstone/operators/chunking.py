"""Documents, or their blocks, to sentences and overlapping token windows.

A document as one row needs no shuffle: units are found by SQL functions, and a small fold per row
places the windows. Blocks with kinds, pages and sections are dealt by document and streamed in order
through a packer that holds one window, however long the document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType

from gritstone.functions import text as T

SIZE, OVERLAP, LEAST = 650, 100, 50
# Kinds of blocks that are never cut at sentences; the strategies.
ATOMIC = ("code", "table", "formula")
TOKEN_WINDOW, HEADING_AWARE = "token_window", "heading_aware"


def units(text: Column, size: int = SIZE) -> Column:
    """Sentences; one of more than ``size`` tokens in slices of 4 * ``size`` characters."""
    step = 4 * size

    def cut(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(s), F.lit(step)), lambda i: F.substr(s, i, F.lit(step)))
        return F.when(T.count_tokens(s) > size, F.filter(parts, lambda p: T.trim_blanks(p) != "")).otherwise(F.array(s))

    return F.flatten(F.transform(T.sentences(text), cut))


def windows(tokens: list[int], size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of unit windows: as many as fit ``size``, one at least; each next window goes back
    over whole units until ``overlap`` tokens are carried, but always advances."""
    sums = [0, *accumulate(tokens)]
    start, n = 0, len(tokens)
    while start < n:
        end = max(start + 1, bisect_right(sums, sums[start] + size) - 1)
        yield start, end
        if end >= n:
            return
        back = bisect_right(sums, sums[end] - overlap) - 1
        start = max(start + 1, min(back, end))


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, text) -> id, chunk_index, text, token_count, first_unit, end_unit, carried, skipped. A window of fewer than
    ``least`` tokens is dropped unless it is the document's first; ``carried`` are the characters at a
    chunk's beginning that the one before ends with, ``skipped`` the units before it that only dropped windows held (null: none)."""
    listed = docs.select("id", units(F.coalesce("text", F.lit("")), size).alias("units"))
    schema = pa.schema([("id", pa.int64()), ("chunk_index", pa.int64()), ("text", pa.string()), ("token_count", pa.int64()), ("first_unit", pa.int64()), ("end_unit", pa.int64()), ("carried", pa.int64()), ("skipped", pa.string())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = last = 0
                for a, b in windows([max(1, len(p) // 4) for p in parts], size, overlap):
                    text = " ".join(parts[a:b])
                    n = max(1, len(text) // 4)
                    if n >= least or not index:
                        for column, value in zip(rows, (key, index, text, n, a, b, sum(len(p) + 1 for p in parts[a:last]), " ".join(parts[last:a]) if index and last < a else None)):
                            column.append(value)
                        index, last = index + 1, b
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema)], schema=schema)

    return listed.mapInArrow(run, "id long, chunk_index long, text string, token_count long, first_unit long, end_unit long, carried long, skipped string")


def block_units(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc, ord, text, kind, page, section_path, char_start) -> doc, ord, place, text, tokens, page, section_path, char_start, char_end.

    Sentences of all blocks but headings and blank ones; a block of an ``ATOMIC`` kind is one unit. A unit of
    more than ``size`` tokens is cut in slices, which share its start.
    """
    body = blocks.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("coalesce(kind, 'paragraph') <> 'heading' and text <> ''")
    pieces = F.when(F.col("kind").isin(*ATOMIC), F.array("text")).otherwise(T.sentences(F.col("text")))
    length = F.length(F.col("piece")).cast("long")
    before = Window.partitionBy("doc", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    each = body.select("doc", "ord", "page", "section_path", "char_start", F.posexplode(pieces).alias("at", "piece"))
    placed = each.withColumn("start", F.col("char_start") + F.coalesce(F.sum(length + 1).over(before), F.lit(0)))
    step = 4 * size
    slices = F.transform(F.sequence(F.lit(1), F.length("piece"), F.lit(step)), lambda i: F.substr("piece", i, F.lit(step)))
    cut = F.when(T.count_tokens("piece") > size, F.filter(slices, lambda p: T.strip(p) != "")).otherwise(F.array("piece"))
    out = placed.select("doc", "ord", "at", "page", "section_path", "start", F.posexplode(cut).alias("slice", "text"))
    return out.select(
        "doc", "ord", (F.col("at").cast("long") * (1 << 31) + F.col("slice")).alias("place"), "text", T.count_tokens("text").alias("tokens"), F.col("page").cast("long").alias("page"), "section_path",
        F.col("start").alias("char_start"), (F.col("start") + F.length("text")).alias("char_end"),
    )


class Packer:
    """Windows of one document's units, fed one by one; between two feeds it holds the open window only.

    A window ends before a unit that it has no room for, or before one of another top section: always
    if ``aware``, else once the window has half its size and ``respect`` is set. The next window
    goes back over whole units until ``overlap`` tokens are carried, but always advances.
    """

    def __init__(self, size: int, overlap: int, aware: bool, respect: bool):
        self.size, self.overlap, self.aware, self.respect = size, overlap, aware, respect
        self.units: list[tuple] = []
        self.end = self.total = 0

    def feed(self, unit: tuple) -> Iterator[list[tuple]]:
        """``unit``: (text, tokens, page, section_path, char_start, char_end)."""
        self.units.append(unit)
        while self.end < len(self.units):
            tokens, path = self.units[self.end][1:4:2]
            if self.end:
                crossed = (path or [""])[0] != (self.units[0][3] or [""])[0]
                if self.total + tokens > self.size or (crossed and (self.aware or (self.respect and self.total >= self.size * 0.5))):
                    yield self.units[: self.end]
                    back, carried = self.end, 0
                    while back > 1 and carried < self.overlap:
                        back -= 1
                        carried += self.units[back][1]
                    self.units, self.end, self.total = self.units[back:], 0, 0
                    continue
            self.total += tokens
            self.end += 1

    def finish(self) -> list[tuple]:
        return self.units


_CHUNKS = "doc long, chunk_index long, text string, token_count long, units long, page_start long, page_end long, section_path array<string>, char_start long, char_end long"


def chunk_blocks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, strategy: str = TOKEN_WINDOW, respect_headings: bool = True) -> DataFrame:
    """Blocks as for ``block_units`` -> chunks with the pages, offsets and first section of their units.

    A chunk of fewer than ``least`` tokens is dropped unless it is its document's first. Null pages, offsets and
    sections are unknown ones and don't count; a document without a unit has no chunk; ties of ord are one block's parts.
    """
    if strategy not in (TOKEN_WINDOW, HEADING_AWARE):
        raise ValueError(f"unknown strategy {strategy}")
    ordered = block_units(blocks, size).repartition("doc").sortWithinPartitions("doc", "ord", "place")
    schema = pa.schema([("doc", pa.int64()), ("chunk_index", pa.int64()), ("text", pa.string()), *((n, pa.int64()) for n in ("token_count", "units", "page_start", "page_end")), ("section_path", pa.list_(pa.string())), ("char_start", pa.int64()), ("char_end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        packer, doc, index = None, None, 0

        def emit(window: list[tuple]) -> None:
            nonlocal index
            text = " ".join(u[0] for u in window).strip()
            n = max(1, len(text) // 4)
            if text and (n >= least or not index):
                pages, starts, ends = ([u[k] for u in window if u[k] is not None] for k in (2, 4, 5))
                path = next((u[3] for u in window if u[3]), [])
                rows.append((doc, index, text, n, len(window), min(pages, default=None), max(pages, default=None), path, min(starts, default=None), max(ends, default=None)))
                index += 1

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc", "text", "tokens", "page", "section_path", "char_start", "char_end")]
            for key, *unit in zip(*columns):
                if packer is None or key != doc:
                    if packer is not None:
                        emit(packer.finish())
                    packer, doc, index = Packer(size, overlap, strategy == HEADING_AWARE, respect_headings), key, 0
                for window in packer.feed(tuple(unit)):
                    emit(window)
            if rows:
                yield out()
        if packer is not None:
            emit(packer.finish())
        if rows:
            yield out()

    return ordered.mapInArrow(run, _CHUNKS)


@F.pandas_udf(LongType())
def _shared_words(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for before, text in parts:
        yield pd.Series([None if a is None or b is None else longest_overlap(a.split(), b.split()) for a, b in zip(before, text)], dtype="Int64")


def longest_overlap(a: list[str], b: list[str]) -> int:
    """How many items end ``a`` and begin ``b``: the value that the prefix function of ``b`` has at the end of ``a``."""
    if not b:
        return 0
    border, k = [0] * len(b), 0
    for i in range(1, len(b)):
        while k and b[i] != b[k]:
            k = border[k - 1]
        k += b[i] == b[k]
        border[i] = k
    k = 0
    for word in a:
        if k == len(b):
            k = border[k - 1]
        while k and word != b[k]:
            k = border[k - 1]
        k += word == b[k]
    return k


def neighbour_overlap(chunks: DataFrame) -> DataFrame:
    """(id, chunk_index, text) -> id, chunk_index, words of every chunk but a document's first: the longest run of words
    that ends the chunk before and begins this one. Null texts share nothing (null)."""
    before = F.lag("text").over(Window.partitionBy("id").orderBy("chunk_index"))
    near = chunks.select("id", "chunk_index", "text", before.alias("before"), F.lag("chunk_index").over(Window.partitionBy("id").orderBy("chunk_index")).alias("last"))
    return near.where("last is not null").select("id", "chunk_index", _shared_words("before", "text").alias("words"))


def overlap_report(chunks: DataFrame) -> DataFrame:
    """pairs of adjacent chunks, share of them that overlap, mean words of an overlap."""
    return neighbour_overlap(chunks).agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("words") > 0).cast("double")), 6).alias("share"), F.round(F.avg(F.when(F.col("words") > 0, F.col("words"))), 6).alias("mean_words"))


def concatenate(chunks: DataFrame) -> DataFrame:
    """(id, chunk_index, text, carried, skipped) -> id, text: a document's units up to its last chunk again, each once, joined by blanks.

    A chunk may hold nothing new (its last unit leaves no room for a long one that follows); units between two chunks
    may be in neither (their window was dropped), and come from ``skipped``.
    """
    rest = F.when(F.col("carried") > 0, F.substr("text", (F.col("carried") + 1).cast("int"))).otherwise(F.col("text"))
    own = F.concat_ws(" ", "skipped", rest)
    listed = F.sort_array(F.collect_list(F.struct("chunk_index", own.alias("own"))))
    return chunks.where("carried <= length(text)").groupBy("id").agg(F.array_join(F.transform(listed, lambda x: x["own"]), " ").alias("text"))


def report(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("id").alias("documents"), F.min("token_count").alias("least_tokens"), F.max("token_count").alias("most_tokens"), F.round(F.avg("token_count"), 6).alias("mean_tokens")
    )

