"""Folders that all executors share: for tables that stay, and for those of one application."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on a single machine, where it is unset, one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gritstone-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def own_folder(spark: SparkSession) -> str:
    """A folder in the shared one for what this application writes in passing: it goes when the application ends."""
    path = f"{shared_folder(spark)}/gritstone-{spark.sparkContext.applicationId}"
    if path not in _made:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(hadoop)
        files.deleteOnExit(hadoop)
        _made.add(path)
    return path


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the application's folder and read back: its lineage ends here, and a lost executor costs a re-read."""
    path = f"{own_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
