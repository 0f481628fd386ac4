"""Hard-negative mining with bounds along a spanning tree of the anchors.

Vectors become integers, floor(256 x), so that scores (inner products) are exact. Of an anchor's rows of
the same label the first ``POSITIVES`` are its positives; a negative of a positive has another label and
a score from 50 to 95 per cent of the positive's, and the first ``NEGATIVES`` of those are wanted.

Anchors pass in blocks of ``ANCHOR_BLOCK``; a block's anchors are joined by a minimum spanning tree. A
score differs between two anchors by at most their distance times the candidate's norm, so a candidate's
bounds at a child are those at its parent, widened by edge times norm. Where the bounds
reach one of the anchor's windows (for positives: the fifth best so far; for negatives: the range of a
positive's window that is above the third best so far) the candidate is scored, which makes its bounds
meet again; elsewhere it is passed over. Tasks keep what an anchor and a positive may still want, rows in
hand being the batches as read; nothing but that is shuffled.

Edge cases: rows without an id or a label, and vectors that are null, empty or hold null or non-finite
components take no part, nor do vectors of a norm of 2 ** 31 or more as integers, whose scores a long
might not hold; vectors of different lengths never meet; ties go to the smaller id; rows that repeat an
anchor's id are neither its positives nor its negatives, and the anchor is the least vector of that id,
then the least label; other repeated rows count each for itself; an empty table gives no rows; other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm.common import materialize, scratch_dir
from gritstone.llm.vectors import blocks_of, matrices, slim

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
ANCHOR_BLOCK = 2048
#: Norms below this give scores that a long holds; windows are worked out in Python's own integers.
_NORM = 2.0**31
_LEAST = np.iinfo(np.int64).min


def whole(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, integers): floor(256 x), rows whose norm is too large left out."""
    scaled = np.floor(256.0 * matrix.astype(np.float64))
    kept = np.einsum("ij,ij->i", scaled, scaled) < _NORM * _NORM
    return kept, scaled[kept].astype(np.int64)


def labelled(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label: where 7 divides the id the label is (label + 1) % 10."""
    label = F.col("label").cast("long")
    return slim(vectors, "label").where("label is not null").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def _read(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integers) for each length of vector."""
    ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
    for rows, matrix in matrices(table["embedding"]):
        kept, made = whole(matrix)
        if kept.any():
            yield ids[rows[kept]], labels[rows[kept]], made


class Candidates:
    """Rows of one length with their norms; scores are exact integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.wide = x.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.wide, self.wide))
        self.largest = float(self.norms.max())

    def scores(self, anchor: np.ndarray, size: float, rows: np.ndarray) -> np.ndarray:
        """By doubles where every partial sum is below 2 ** 52, else by longs."""
        every = 2 * len(rows) > len(self.ids)
        if size * self.largest < 2.0**52:
            return (np.dot(self.wide, anchor.astype(np.float64))[rows] if every else np.dot(self.wide[rows], anchor.astype(np.float64))).astype(np.int64)
        return np.dot(self.x[rows], anchor)


class Forest:
    """Minimum spanning tree of anchors, walked so that few parents' bounds are held at once."""

    def __init__(self, x: np.ndarray):
        wide, n = x.astype(np.float64), len(x)
        self.sizes = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        parent, edge = np.full(n, -1), np.full(n, np.inf)
        left, at = np.ones(n, bool), 0
        self.parent, self.edge = parent, np.zeros(n)
        order = []
        for _ in range(n):  # Prim
            left[at] = False
            order.append(at)
            d = np.sqrt(((wide - wide[at]) ** 2).sum(axis=1))
            closer = left & (d < edge)
            edge[closer], parent[closer] = d[closer], at
            if left.any():
                at = int(np.argmin(np.where(left, edge, np.inf)))
        self.edge = np.where(parent < 0, 0.0, edge)
        self.children: list[list[int]] = [[] for _ in range(n)]
        weight = np.ones(n, np.int64)
        for i in reversed(order):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                self.children[parent[i]].append(i)
        for c in self.children:
            c.sort(key=lambda i: weight[i])  # the heaviest last, when the parent's bounds can go
        self.scored = self.passed = 0

    def walk(self, anchors: np.ndarray, rows: Candidates, wanted, met) -> None:
        """``wanted(anchor, low, high)`` gives the rows to score, ``met(anchor, rows, scores)`` takes their scores."""
        if not len(anchors):
            return
        whole_ = np.arange(len(rows.ids))
        stack = [(0, np.full(len(whole_), -np.inf), np.full(len(whole_), np.inf))]
        while stack:
            at, low, high = stack.pop()
            if self.parent[at] >= 0:
                room = self.edge[at] * rows.norms * (1 + 1e-9) + 1e-6
                low, high = low - room, high + room
            need = whole_ if self.parent[at] < 0 else np.flatnonzero(wanted(at, low, high))
            if len(need):
                s = rows.scores(anchors[at], self.sizes[at], need)
                low[need] = high[need] = s
                met(at, need, s)
            self.scored += len(need)
            self.passed += len(whole_) - len(need)
            below = self.children[at]
            for i, child in enumerate(reversed(below)):  # the last pushed is walked first; the heaviest gets the arrays themselves
                stack.append((child, low, high))


def _top(ids: np.ndarray, scores: np.ndarray, held: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate((held[0], ids)), np.concatenate((held[1], scores))
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _anchors(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of each length of vector, one for an id."""
    out = []
    for ids, labels, x in _read(table):
        order = np.lexsort((labels, *x.T[::-1], ids))
        first = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
        out.append((ids[first], labels[first], x[first]))
    return out


def positives_of(rows: DataFrame, anchors: list, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score of the k first rows of an anchor's label; one tree for each label."""
    schema = "anchor_id long, positive_id long, positive_score long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {(x.shape[1], label): (ids[labels == label], x[labels == label]) for ids, labels, x in anchors for label in np.unique(labels).tolist()}
        forests = {key: Forest(x) for key, (_, x) in sets.items()}
        held = {key: [_NONE] * len(ids) for key, (ids, _) in sets.items()}
        for batch in batches:
            for ids, labels, x in _read(pa.Table.from_batches([batch])):
                for label in np.unique(labels).tolist():
                    key = (x.shape[1], label)
                    if key not in sets:
                        continue
                    own = np.flatnonzero(labels == label)
                    found, (names, anchor_x) = held[key], sets[key]
                    rows_ = Candidates(ids[own], labels[own], x[own])

                    def wanted(at, low, high, found=found):
                        return high >= (found[at][1][-1] if len(found[at][1]) == k else _LEAST)

                    def met(at, need, s, found=found, rows_=rows_, names=names):
                        other = rows_.ids[need] != names[at]
                        if len(found[at][1]) == k:
                            other &= s >= found[at][1][-1]
                        found[at] = _top(rows_.ids[need][other], s[other], found[at], k)

                    forests[key].walk(anchor_x, rows_, wanted, met)
        for key, (names, _) in sets.items():
            got = [(n, i, s) for n, (i, s) in zip(names, held[key])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, [len(i) for _, i, _ in got])), pa.array(np.concatenate([i for _, i, _ in got])), pa.array(np.concatenate([s for _, _, s in got]))],
                ["anchor_id", "positive_id", "positive_score"],
            )

    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return rows.mapInArrow(run, schema).withColumn("place", rank).where(F.col("place") <= k)


def negatives_of(rows: DataFrame, anchors: list, positives: list, k: int = NEGATIVES, low_per: int = LOW, high_per: int = HIGH) -> DataFrame:
    """anchor_id, place, negative_id, negative_score: the k first rows in each positive's window; one tree for all labels.

    ``positives``: (anchor_id, place, positive_score), those of the block's anchors.
    """
    schema = "anchor_id long, place int, negative_id long, negative_score long"
    windows: dict[int, list[tuple[int, int, int]]] = {}
    for anchor, place, score in positives:  # whole scores n with low * p <= 100 * n <= high * p
        lowest, highest = -(-low_per * score // 100), high_per * score // 100
        if lowest <= highest:
            windows.setdefault(anchor, []).append((place, lowest, highest))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = [Forest(x) for _, _, x in anchors]
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, labels, x in _read(pa.Table.from_batches([batch])):
                rows_ = Candidates(ids, labels, x)
                for (names, own, anchor_x), forest in zip(anchors, forests):
                    if anchor_x.shape[1] != x.shape[1]:
                        continue

                    def open_(at: int, names=names) -> list[tuple[int, int, int]]:
                        """The windows of an anchor from the k-th best so far on."""
                        name, out = int(names[at]), []
                        for place, lowest, highest in windows.get(name, ()):
                            got = held.get((name, place), _NONE)[1]
                            out.append((place, max(lowest, int(got[-1])) if len(got) == k else lowest, highest))
                        return out

                    def wanted(at, low, high, own=own, open_=open_):
                        need = np.zeros(len(low), bool)
                        for _, lowest, highest in open_(at):
                            need |= (high >= lowest) & (low <= highest)
                        return need & (rows_.labels != own[at])

                    def met(at, need, s, names=names, own=own, open_=open_):
                        sound = (rows_.labels[need] != own[at]) & (rows_.ids[need] != names[at])
                        for place, lowest, highest in open_(at):
                            inside = sound & (s >= lowest) & (s <= highest)
                            if inside.any():
                                key = (int(names[at]), place)
                                held[key] = _top(rows_.ids[need][inside], s[inside], held.get(key, _NONE), k)

                    forest.walk(anchor_x, rows_, wanted, met)
        if held:
            sizes = [len(i) for i, _ in held.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([a for a, _ in held], sizes)), pa.array(np.repeat(np.array([p for _, p in held], np.int32), sizes)), pa.array(np.concatenate([i for i, _ in held.values()])), pa.array(np.concatenate([s for _, s in held.values()]))],
                ["anchor_id", "place", "negative_id", "negative_score"],
            )

    return rows.mapInArrow(run, schema)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both tables have vec_id, embedding, label."""
    spark = vectors.sparkSession
    path = f"{scratch_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for some in blocks_of(anchors, block):
        own = _anchors(some.toArrow())
        first = materialize(positives_of(vectors, own, positives), "negatives-positives")
        found = negatives_of(vectors, own, [tuple(r) for r in first.select("anchor_id", "place", "positive_score").collect()], negatives, low, high)
        joined = found.join(first, ["anchor_id", "place"])
        rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
        ranked = joined.withColumn("rank", rank).where(F.col("rank") <= negatives)
        ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    rows = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mine(rows, rows.where("vec_id % 50 = 0"))


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON len(a.x) = len(c.x) AND a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}
"""
