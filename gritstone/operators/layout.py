"""Page layout: running headers and footers, reading order, merged sections, over block tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

REPEAT, SHORT = 0.5, 100


def furniture(blocks: DataFrame, ratio: float = REPEAT) -> DataFrame:
    """(doc, page, y, text) -> the first or last short block of a page whose key repeats: doc, page, y, zone.

    A key is the lower-case text with digits as ``#``. It repeats on ``ratio`` of the document's pages,
    or on three pages or more that are all odd or all even and ``ratio`` of those. Page numbers always go.
    """
    up, down = Window.partitionBy("doc", "page").orderBy("y"), Window.partitionBy("doc", "page").orderBy(F.desc("y"))
    ends = blocks.withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down)).where((F.length("text") <= SHORT) & ((F.col("a") == 1) | (F.col("z") == 1)))
    zoned = ends.select("doc", "page", "y", F.when(F.col("a") == 1, "header").otherwise("footer").alias("zone"), F.regexp_replace(F.lower(F.trim("text")), "[0-9]", "#").alias("key"), F.trim("text").rlike(r"^(?:page )?[0-9]{1,4}$").alias("number"))
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("n"), F.countDistinct(F.when(F.col("page") % 2 == 0, F.col("page"))).alias("even"))
    keys = zoned.groupBy("doc", "zone", "key").agg(F.countDistinct("page").alias("on"), F.countDistinct(F.when(F.col("page") % 2 == 0, F.col("page"))).alias("on_even")).join(pages, "doc")
    odd = F.col("n") - F.col("even")
    repeats = (F.col("on") >= ratio * F.col("n")) | ((F.col("on") >= 3) & (((F.col("on_even") == 0) & (F.col("on") >= ratio * odd)) | ((F.col("on_even") == F.col("on")) & (F.col("on") >= ratio * F.col("even")))))
    return zoned.join(keys.where(repeats).select("doc", "zone", "key", F.lit(True).alias("hit")), ["doc", "zone", "key"], "left").where(F.col("number") | F.col("hit")).select("doc", "page", "y", "zone")


def reading_order(blocks: DataFrame, width: float) -> DataFrame:
    """(doc, page, x0, x1, y) -> the same with ``place`` on the page. A full-width block is a barrier;
    between barriers the left column is read before the right one."""
    mid, centre, margin = (F.col("x0") + F.col("x1")) / 2, width / 2, 0.04 * width
    wide = (F.col("x1") - F.col("x0")) >= 0.6 * width
    side = F.when(wide, 0).when(mid < centre - margin, 1).when(mid > centre + margin, 2).otherwise(0)
    page = Window.partitionBy("doc", "page")
    sided = blocks.withColumn("side", side)
    two = (F.sum((F.col("side") == 1).cast("int")).over(page) >= 2) & (F.sum((F.col("side") == 2).cast("int")).over(page) >= 2)
    sided = sided.withColumn("side", F.when(two, F.col("side")).otherwise(0))
    band = F.sum((F.col("side") == 0).cast("int")).over(page.orderBy("y", "x0").rowsBetween(Window.unboundedPreceding, 0))
    return sided.withColumn("band", band).withColumn("place", F.row_number().over(page.orderBy("band", "side", "y", "x0")).cast("long")).drop("band", "side")


def body_size(blocks: DataFrame) -> DataFrame:
    """doc, size: the size that most characters have (of equals the smallest)."""
    sums = blocks.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"))
    return sums.groupBy("doc").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("size"))


def offsets(blocks: DataFrame) -> DataFrame:
    """``char_start`` of each block in the text of a document's blocks joined by two newlines."""
    before = F.sum(F.length("text") + 2).over(Window.partitionBy("doc").orderBy("page", "y").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("char_start", F.coalesce(before, F.lit(0)).cast("long"))
