"""Benchmark decontamination by a generalised suffix automaton of the benchmark's items.

The automaton is built over the item's normalised words. Document words are streamed through
it; at each word the state and the longest matching length say which windows end there.

Only benchmark items are broadcast, in blocks whose characters are bounded by ``block_chars``:
a benchmark beyond that bound is passed over the documents block by block, with the state
written to the shared folder in between.

Edge cases: a null or empty text has no words and stays unhit; an item without words or with a
null item_id is ignored; repeated documents are judged row by row; repeated items count once; an empty benchmark hits nothing, empty
documents give no rows; texts of any length are streamed whole; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import doc_texts, map_rows, materialize

WINDOW = 10
BLOCK_CHARS = 4_000_000
#: ASCII bytes that are no letter or digit become spaces, A-Z become a-z, bytes from 0x80 on stay.
_NORMAL = bytes(b | 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids that knows the items of each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = []
        for item, words in items:
            if words:
                rows.append((item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        for _, ids in rows:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        #: by state: the windows of its class as (words, items)
        self.windows: list[list[tuple[int, set[str]]]] = [[] for _ in self.length]
        for item, ids in rows:
            state, n = 0, 0
            for w in ids:
                state, n = self.next[state][w], n + 1
                if n >= window:
                    self._note(state, window, item)
            if n < window:
                self._note(state, n, item)
        self.shortest = min((min(window, len(ids)) for _, ids in rows), default=0)
        self._ends: dict[int, list[tuple[int, frozenset[str]]]] = {}

    def _note(self, state: int, words: int, item: str) -> None:
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        for size, items in self.windows[state]:
            if size == words:
                items.add(item)
                return
        self.windows[state].append((words, {item}))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def ends(self, state: int) -> list[tuple[int, frozenset[str]]]:
        """Windows that end where ``state`` is reached, as (words, items)."""
        if state not in self._ends:
            found, s = [], state
            while s > 0:
                found += [(n, frozenset(x)) for n, x in self.windows[s]]
                s = self.link[s]
            self._ends[state] = found
        return self._ends[state]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set[str]]:
        """Hit spans as (first word, end word, longest matching length at the end), and the items."""
        spans, items = [], set()
        if not self.shortest:
            return spans, items
        ids = list(map(self.vocab.get, words))
        nxt, link, length, shortest = self.next, self.link, self.length, self.shortest
        state = n = 0
        for i, w in enumerate(ids):
            if w is None:
                state = n = 0
                continue
            while w not in nxt[state] and state:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
                if n >= shortest:
                    for size, of in self.ends(state):
                        if size <= n:
                            spans.append((i + 1 - size, i + 1, n))
                            items |= of
            else:
                state = n = 0
        return spans, items


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("words")).where("item is not null and words is not null")
    chars = items.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    return [items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b) for b in range(n)]


MATCHES = "doc_id long, text string, n_words long, spans array<struct<first:int,end:int>>, longest int, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every document with its hit word spans, longest match and the items found (columns MATCHES)."""
    spark = docs.sparkSession
    state = doc_texts(docs).selectExpr("doc_id", "text", "0L as n_words", "cast(array() as array<struct<first:int,end:int>>) as spans", "0 as longest", "cast(array() as array<string>) as items")
    blocks = _blocks(benchmark, block_chars)
    for k, block in enumerate(blocks):
        shared = _shared(spark, block, window)

        def stream(rows: dict, shared=shared) -> dict:
            aut = shared.value
            out = {"n_words": [], "spans": [], "longest": [], "items": []}
            for text, old, longest, known in zip(rows["text"], rows["spans"], rows["longest"], rows["items"]):
                words = words_of(text)
                spans, items = aut.match(words)
                out["n_words"].append(len(words))
                out["spans"].append([{"first": a, "end": b} for a, b in union_spans([(x["first"], x["end"]) for x in old] + [x[:2] for x in spans])])
                out["longest"].append(max([longest, *(x[2] for x in spans)]))
                out["items"].append(sorted(items.union(known)))
            return {"doc_id": rows["doc_id"], "text": rows["text"], **out}

        state = map_rows(state, stream, MATCHES)
        if k + 1 < len(blocks):
            state = materialize(state, "decontaminate")
    return state


def remove_contamination(docs: DataFrame, benchmark: DataFrame, max_words: int = WINDOW, max_coverage: float = 0.5, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without spans in which ``max_words`` words or more match an item (a shorter item: all its words).

    A round finds the spans of all benchmark blocks in a text and cuts their union out; rounds go on until
    no text holds such a span, so that the result is the same for every ``block_chars``. A document is
    dropped as a whole once the words cut are more than ``max_coverage`` of those it came with. Columns
    stay, whatever their names; ``n_chars`` follows the text. Null and empty texts stay as they are,
    repeated rows are judged one by one, and an empty benchmark removes nothing.
    """
    spark, fields = docs.sparkSession, docs.schema.fields
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    blocks = _blocks(benchmark, block_chars)
    names = [f.name for f in fields]
    total, cut, spans, open_ = (_free(n, names) for n in ("total", "cut", "spans", "open"))
    schema = own + f"`{total}` long, `{cut}` long, `{spans}` array<struct<first:int,end:int>>, `{open_}` boolean"
    now = docs.select("*", F.lit(None).cast("long").alias(total), F.lit(0).cast("long").alias(cut), F.array().cast("array<struct<first:int,end:int>>").alias(spans), F.lit(True).alias(open_))

    def find(rows: dict, shared) -> dict:
        for i, (text, known) in enumerate(zip(rows["text"], rows[open_])):
            if known:
                found = [(a, b) for a, b, n in shared.value.match(words_of(text))[0] if n >= min(max_words, b - a)]
                rows[spans][i] = [{"first": a, "end": b} for a, b in union_spans(found + [(x["first"], x["end"]) for x in rows[spans][i]])]
        return rows

    def remove(rows: dict) -> dict:
        keep = []
        for i, found in enumerate(rows[spans]):
            if rows[total][i] is None:
                rows[total][i] = len(words_of(rows["text"][i]))
            rows[cut][i] += sum(x["end"] - x["first"] for x in found)
            if rows[cut][i] <= max_coverage * rows[total][i]:
                keep.append(i)
                rows[open_][i], rows[spans][i] = bool(found), []
                if found:
                    rows["text"][i] = _without(rows["text"][i], [(x["first"], x["end"]) for x in found])
                    if "n_chars" in rows:
                        rows["n_chars"][i] = len(rows["text"][i])
        return {c: [v[i] for i in keep] for c, v in rows.items()}

    if len(blocks) == 1:  # all spans of a text are known at once: its rounds need no pass over the others

        shared = _shared(spark, blocks[0], window)

        def rounds(rows: dict) -> dict:
            while any(rows[open_]):
                rows = remove(find(rows, shared))
            return rows

        now = map_rows(now, rounds, schema)
    else:
        while True:
            for block in blocks:
                shared = _shared(spark, block, window)
                now = materialize(map_rows(now, lambda rows, shared=shared: find(rows, shared), schema), "decontaminate")
                shared.destroy()  # one block at a time is in memory
            now = materialize(map_rows(now, remove, schema), "decontaminate")
            if now.where(F.col(open_)).isEmpty():
                break
    return now.select(*(F.col(f"`{n}`") for n in names))


def _shared(spark, block: DataFrame, window: int):
    """The automaton of a block of items, whose characters are bounded, on all executors."""
    return spark.sparkContext.broadcast(SuffixAutomaton([(r.item, words_of(r.words)) for r in block.collect()], window))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in map(str.lower, taken):
        name += "_"
    return name


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    plain = raw.translate(_NORMAL)
    starts, ends, at = [], [], 0
    for w in plain.split():
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["first"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), keys AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw
), dw AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM keys) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, dk.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw) dk JOIN keys USING (n, k)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
