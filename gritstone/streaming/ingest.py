"""Incremental ingestion: a stream of document files kept as the latest row of each id.

An extension of the batch library, which has no streams of its own. Each micro-batch is written
beside the earlier ones with its number, so a batch that is run again replaces itself; readers
take the row of the highest batch for each id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.governance import latest


def keep_latest(stream: DataFrame, table: str, checkpoint: str, order: str | None = None):
    """Starts a query that drains what is there and stops; call it again for what came since.

    Of a batch's rows of one id the greatest by ``order`` stays, or by all other columns if it isn't given.
    """

    def write(batch: DataFrame, number: int) -> None:
        by = F.col(order) if order else F.struct(*(c for c in batch.columns if c != "doc_id"))
        latest(batch, "doc_id", by).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each document."""
    return latest(spark.read.parquet(table), "doc_id", F.col("batch")).drop("batch")


def event_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type and window; rows later than ``late`` are left to the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return timed.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
