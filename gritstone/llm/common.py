"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.sources.scratch import own_folder


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that the cluster names in ``spark.checkpoint.dir``; it goes when the
    application ends.

    Where that is unset, a folder of this process is used on a single machine; on a cluster, whose
    executors would each write to a disk of their own, that is an error.
    """
    return own_folder(spark)


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    A lost executor costs a re-read of that table, never a recomputation of what led to it.
    """
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, tag: str, compression: str = "zstd") -> DataFrame:
    """``materialize`` as a table of ``buckets`` by ``key``: joins on that key leave its rows where they are."""
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", compression).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def spread_join(rows: DataFrame, named: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """``rows`` (with doc_id) joined to ``named`` (one row a key): a key's rows are dealt by (key, salt of doc_id) and
    its name is sent once to each salt in use, so that a key of many rows does not lie in one task."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    in_use = salted.select(key, "__salt").distinct()
    return salted.join(in_use.join(named, key), [key, "__salt"]).drop("__salt")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to as many tasks as run at once where the files give fewer (one row group is one task)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(dict of column -> list) -> dict of column -> list`` for each batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and, unless one row is larger, ``size`` bytes of texts."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(weight), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; other columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on this machine (each task asks for itself)."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
