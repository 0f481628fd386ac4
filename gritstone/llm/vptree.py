"""Approximate nearest neighbours by vantage-point trees per shard.

Rows are dealt to the nearest of up to ``MAX_CELLS`` pivots (taken from a sample of ``SAMPLE`` rows, the
least by a hash of their ids) and a crowded cell's rows in turn to shards of about ``SHARD_ROWS``. One task
builds a shard's tree: at each node the point farthest from the node's mean is the vantage point, the
nearer half of the rows by distance to it is the inside, and the distances at the borders of both halves
are kept. A tree is balanced whatever the distances, so copies of one vector cost nothing extra.

A search carries blocks of queries down all trees at once. A half can hold nothing nearer than
d - hi (or lo - d) by the triangle inequality; it is left out when that bound times ``factor`` exceeds
the k-th best distance so far, which starts from the sample. Factor 1 leaves out nothing that counts
and so is exact; greater factors leave out more. Distances of candidates are computed from the original
vectors in double precision, component by component in order.

Edge cases: rows without an id and vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as queries nor as candidates; vectors of different lengths never meet;
each row is a candidate of its own, rows of the query's id are not, and query rows that repeat an id are
searched once, by the least vector; ties go to the smaller id; fewer than k candidates give fewer
rows; an empty table gives none; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm.common import materialize, scratch_dir
from gritstone.llm.vectors import blocks_of, matrices, slim

K, FACTOR = 10, 1.0
SHARD_ROWS, MAX_CELLS, SAMPLE, LEAF, QUERY_BLOCK = 8192, 256, 2048, 64, 4096
_SLACK = 1e-9
_SHARD = "dim int, shard string, ids binary, vectors binary, vantages binary, borders binary, width int"


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added up in the order of the components."""
    gaps = points.astype(np.float64) - query.astype(np.float64)
    return np.sqrt(np.cumsum(gaps * gaps, axis=-1)[..., -1])


class Tree:
    """Rows in the order of the leaves; nodes in preorder with their vantage point and (hi inside, lo outside, hi outside)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, vantages: np.ndarray, borders: np.ndarray):
        self.ids, self.points, self.vantages, self.borders = ids, points, vantages, borders
        wide = points.astype(np.float64)
        self.squares = np.einsum("ij,ij->i", wide, wide)

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order, vantages, borders = np.arange(len(ids)), [], []

        def split(a: int, b: int) -> None:
            if b - a <= leaf:
                return
            own = points[order[a:b]].astype(np.float64)
            vantage = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            d, mid = distances(own, vantage), (a + b) // 2
            by = np.argpartition(d, mid - a)
            order[a:b], d = order[a:b][by], d[by]
            inside, outside = d[: mid - a], d[mid - a :]
            vantages.append(vantage.astype(points.dtype))
            borders.append((inside.max(), outside.min(), outside.max()))
            split(a, mid)
            split(mid, b)

        split(0, len(ids))
        return cls(ids[order], points[order], np.array(vantages, points.dtype).reshape(-1, points.shape[1]), np.array(borders, np.float64).reshape(-1, 3))

    def search(self, best: Best, factor: float, leaf: int = LEAF) -> None:
        """Every query of ``best`` meets the rows of this tree."""
        at = 0

        def visit(a: int, b: int, active: np.ndarray) -> None:
            nonlocal at
            if b - a <= leaf:
                if len(active):
                    best.offer(active, self.ids[a:b], self.points[a:b], self.squares[a:b])
                return
            node, at = at, at + 1
            hi_in, lo_out, hi_out = self.borders[node]
            mid = (a + b) // 2
            if len(active):
                d = distances(best.queries[active], self.vantages[node])
            else:
                d = np.zeros(0)
            for x, y, bound in ((a, mid, d - hi_in), (mid, b, np.maximum(lo_out - d, d - hi_out))):
                visit(x, y, active[bound * factor <= best.limit(active)])

        visit(0, len(self.ids), np.arange(len(best.queries)))


class Best:
    """The k best (distance, id) of each query so far, and what the k-th can be at most."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, start: np.ndarray):
        self.of, self.queries, self.k = ids, queries.astype(np.float64), k
        self.squares = np.einsum("ij,ij->i", self.queries, self.queries)
        self.d = np.full((len(ids), k), np.inf)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.start, self.met = start, 0

    def limit(self, active: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[active, -1], self.start[active]) * (1 + _SLACK) + _SLACK

    def offer(self, active: np.ndarray, ids: np.ndarray, points: np.ndarray, squares: np.ndarray) -> None:
        self.met += len(active) * len(ids)
        rough = self.squares[active][:, None] + squares[None, :] - 2 * (self.queries[active] @ points.T.astype(np.float64))
        room = self.limit(active) ** 2 + 1e-12 * (self.squares[active] + squares.max())  # what the rough squares may be off by
        q, c = np.nonzero((rough <= room[:, None]) & (self.of[active][:, None] != ids[None, :]))
        if len(q):
            self.merge(active[q], distances(points[c], self.queries[active[q]]), ids[c])

    def merge(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(q)
        q = np.concatenate((q, np.repeat(touched, self.k)))
        d, ids = np.concatenate((d, self.d[touched].ravel())), np.concatenate((ids, self.ids[touched].ravel()))
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        first = np.searchsorted(q, touched)
        take = first[:, None] + np.arange(self.k)
        self.d[touched], self.ids[touched] = d[take], ids[take]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(np.isfinite(self.d))
        return self.of[q], self.ids[q, r], self.d[q, r]


class Index(NamedTuple):
    """``shards``: a row for each tree; ``sample``: (ids, matrix) of the sample for each length of vector."""

    shards: DataFrame
    sample: dict[int, tuple[np.ndarray, np.ndarray]]
    leaf: int


def _sound(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vector, without zero vectors."""
    ids = table["vec_id"].to_numpy()
    for rows, matrix in matrices(table["embedding"]):
        some = matrix.any(axis=1)
        if some.any():
            yield ids[rows[some]], matrix[some]


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, leaf: int = LEAF) -> Index:
    rows = slim(vectors)
    held = {m.shape[1]: (ids, m) for ids, m in _sound(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow())}
    cells = min(MAX_CELLS, -(-rows.count() // shard_rows))
    pivots = {dim: m[:cells].astype(np.float64) for dim, (_, m) in held.items()}

    def dealt(batches: Iterable[pa.RecordBatch], parts: dict | None) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for ids, matrix in _sound(pa.Table.from_batches([batch])):
                dim = matrix.shape[1]
                own = pivots.get(dim, np.zeros((1, dim)))
                cell = np.argmin((own**2).sum(axis=1)[None, :] - 2 * (matrix @ own.T), axis=1)
                if parts is None:
                    found, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), dim, np.int32)), pa.array(found.astype(np.int32)), pa.array(n)], ["dim", "cell", "n"])
                    continue
                many = np.array([parts[dim, c] for c in cell.tolist()])
                part = (turn + np.arange(len(ids))) % many  # rows in turn, so that ids, equal ones too, are spread
                turn += len(ids)
                names = [f"{dim}-{c}-{p}" for c, p in zip(cell.tolist(), part.tolist())]
                packed = pa.array([x.tobytes() for x in matrix], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, np.int32)), pa.array(names), pa.array(ids), packed, pa.array(np.full(len(ids), matrix.itemsize, np.int32))], ["dim", "shard", "vec_id", "packed", "width"])

    counted = rows.mapInArrow(lambda b: dealt(b, None), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n"))
    parts = {(r["dim"], r["cell"]): -(-r["n"] // shard_rows) for r in counted.collect()}  # a row for each cell

    def planted(table: pa.Table) -> pa.Table:
        dim, kind = table["dim"][0].as_py(), np.float32 if table["width"][0].as_py() == 4 else np.float64
        points = np.frombuffer(b"".join(table["packed"].to_pylist()), kind).reshape(-1, dim)
        tree = Tree.build(table["vec_id"].to_numpy(), points, leaf)
        made = {"dim": [dim], "shard": [table["shard"][0].as_py()], **{n: [x.tobytes()] for n, x in (("ids", tree.ids), ("vectors", tree.points), ("vantages", tree.vantages), ("borders", tree.borders))}, "width": [points.itemsize]}
        return pa.table(made, schema=pa.schema([("dim", pa.int32()), ("shard", pa.string()), *((n, pa.binary()) for n in ("ids", "vectors", "vantages", "borders")), ("width", pa.int32())]))

    spread = rows.mapInArrow(lambda b: dealt(b, parts), "dim int, shard string, vec_id long, packed binary, width int")
    return Index(materialize(spread.groupBy("shard").applyInArrow(planted, _SHARD), "vptree", "none"), held, leaf)


def _least(ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*matrix.T[::-1], ids))
    first = order[np.concatenate(([True], np.diff(ids[order]) != 0))] if len(order) else order
    return ids[first], matrix[first]


def _starts(ids: np.ndarray, queries: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """The k-th best distance among the sample: the true one is no greater."""
    if sample is None or not len(sample[0]):
        return np.full(len(ids), np.inf)
    points, wide = sample[1].astype(np.float64), queries.astype(np.float64)
    squares, own = np.einsum("ij,ij->i", points, points), np.einsum("ij,ij->i", wide, wide)
    out = np.full(len(ids), np.inf)
    for a in range(0, len(ids), 512):
        rough = own[a : a + 512, None] + squares[None, :] - 2 * (wide[a : a + 512] @ points.T)
        rough[ids[a : a + 512, None] == sample[0][None, :]] = np.inf
        if k <= len(points):
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            out[a : a + 512] = np.sqrt(np.maximum(kth, 0) + 1e-12 * (own[a : a + 512] + squares.max()))
    return out


def search(index: Index, queries: DataFrame, k: int = K, factor: float = FACTOR, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query (vec_id, embedding).

    Queries pass in blocks of about ``block`` rows, each block's results being written before the next
    begins; a task keeps k rows of each query over all its shards.
    """
    if factor < 1:
        raise ValueError("the factor is 1 or more")
    spark, rows = index.shards.sparkSession, slim(queries)
    path, schema = f"{scratch_dir(spark)}/vptree-found-{uuid.uuid4().hex}", "query_id long, vec_id long, score double"
    for some in blocks_of(rows, block):
        asked = []
        for ids, matrix in _sound(some.toArrow()):
            ids, matrix = _least(ids, matrix)
            asked.append((ids, matrix, _starts(ids, matrix, index.sample.get(matrix.shape[1]), k)))
        leaf = index.leaf

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {m.shape[1]: Best(ids, m, k, start) for ids, m, start in asked}
            for batch in batches:
                for r in range(batch.num_rows):
                    row = {n: batch[n][r].as_py() for n in batch.schema.names}
                    if row["dim"] in best:
                        kind = np.float32 if row["width"] == 4 else np.float64
                        points, vantages = (np.frombuffer(row[n], kind).reshape(-1, row["dim"]) for n in ("vectors", "vantages"))
                        Tree(np.frombuffer(row["ids"], np.int64), points, vantages, np.frombuffer(row["borders"], np.float64).reshape(-1, 3)).search(best[row["dim"]], factor, leaf)
            for b in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in b.found()], ["query_id", "vec_id", "score"])

        found = index.shards.mapInArrow(run, schema)
        _ranked(found, k).drop("rank").write.mode("append").parquet(path)
    return _ranked(spark.read.schema(schema).parquet(path), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_vptree(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build(vectors), vectors.where("vec_id % 100 = 0"))


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (c.x[i] - q.x[i]) * (c.x[i] - q.x[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON len(q.x) = len(c.x) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= {K}
"""
