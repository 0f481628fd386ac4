"""Vector functions as Column expressions, and texts as vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The embedder's dimension, and how many neighbouring components a token moves.
DIMENSION, BUMPS = 384, 8
#: Tokens remembered by a task.
_KNOWN = 1 << 16


def _moves(token: str, dimension: int, normal: bool) -> tuple[np.ndarray, np.ndarray]:
    """The components that a token moves and by how much: signed by a bit of its SHA-256, from the bucket that its first
    eight bytes name. The amounts are normal numbers drawn from that seed, or else 24-bit fractions of the rest of the digest."""
    digest = hashlib.sha256(token.encode()).digest()
    seed = int.from_bytes(digest[:8], "big")
    if normal:
        by = np.random.RandomState(seed & 0xFFFFFFFF).normal(size=BUMPS)
    else:
        by = np.array([int.from_bytes(digest[8 + 3 * i : 11 + 3 * i], "big") for i in range(BUMPS)]) / 2.0**23 - 1.0
    return (seed % dimension + np.arange(BUMPS)) % dimension, by if (seed >> 32) % 2 == 0 else -by


def embed(rows: DataFrame, text: str = "text", dimension: int = DIMENSION, normal: bool = True) -> DataFrame:
    """Adds ``v``: the text's tokens (runs of a-z and digits) hashed into a vector of length one.

    Texts that share tokens lie near each other; a null text or one without tokens is the vector of the empty token.
    A token is hashed once in a task.
    """
    kept = rows.drop("v")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            made = np.zeros((batch.num_rows, dimension))
            for row, own in zip(made, batch.column(batch.schema.get_field_index(text)).to_pylist()):
                tokens = re.findall("[a-z0-9]+", own.lower()) if own else []
                for token in tokens or [""]:
                    if token not in known:
                        if len(known) >= _KNOWN:
                            known.clear()
                        known[token] = _moves(token, dimension, normal)
                    at, by = known[token]
                    row[at] += by
            size = np.sqrt((made * made).sum(axis=1, keepdims=True))
            made /= np.where(size > 0, size, 1.0)
            v = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimension), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, v], [*names, "v"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", v array<double>"
    return kept.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(kind: str, a: Column, b: Column) -> Column:
    """0 to 1: ``cosine`` clamped, ``l2`` as 1 / (1 + squared distance), ``ip`` the dot product as it is."""
    if kind == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))
    if kind == "l2":
        return 1 / (1 + squared_distance(a, b))
    if kind == "ip":
        return dot(a, b)
    raise ValueError(f"unknown distance {kind}")
