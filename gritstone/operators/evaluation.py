"""Retrieval metrics, sweeps, calibration, refusals, costs and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def query_metrics(hits: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """recall_1, recall_5, recall_10 and mrr_10 of each expected query (qid, id); a query without a hit has zeros."""
    keys = [*by, "qid"]
    first = hits.join(expected.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy(*keys).agg(F.min("rank").alias("first"))
    asked = expected.select("qid").distinct()
    if by:
        asked = asked.crossJoin(F.broadcast(hits.select(*by).distinct()))
    at = F.col("first")
    return asked.join(first, keys, "left").select(
        *keys, *(F.coalesce((at <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}") for k in (1, 5, 10)), F.when(at <= 10, 1.0 / at).otherwise(F.lit(0.0)).alias("mrr_10"))


def mean_metrics(metrics: DataFrame, *by: str) -> DataFrame:
    names = ("recall_1", "recall_5", "recall_10", "mrr_10")
    grouped = metrics.rollup(*by) if by else metrics.groupBy()
    return grouped.agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in names))


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """Counts, precision, recall, accuracy and F1 of a refusal decision; a zero denominator gives null."""
    def n(e: int, a: int):
        return F.sum(((F.col(expected) == e) & (F.col(actual) == a)).cast("long"))

    c = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    return c.withColumns({
        "precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6),
        "accuracy": F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6), "f1": F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6),
    })


def threshold_table(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: positives below it (false refusals) and negatives at or above it (passes)."""
    sums = []
    for k, t in enumerate(thresholds):
        sums += [F.sum(((F.col("label") == 1) & (F.col("score") < t)).cast("long")).alias(f"r{k}"), F.sum(((F.col("label") == 0) & (F.col("score") >= t)).cast("long")).alias(f"p{k}")]
    one = scores.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{k}").alias("false_refusals"), F.col(f"p{k}").alias("passes")) for k, t in enumerate(thresholds)))).alias("x")).select("x.*")


def auroc(scores: DataFrame) -> DataFrame:
    """P(positive > negative) + P(tie) / 2 by sums over distinct scores: no pair is formed. Null without both classes."""
    at = scores.groupBy("score").agg(F.sum((F.col("label") == 1).cast("double")).alias("pos"), F.sum((F.col("label") == 0).cast("double")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return at.withColumn("below", below).agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))), F.sum("pos") * F.sum("neg")), 6).alias("auroc"))


def nearest_rank(scores: DataFrame, shares: tuple[float, ...] = (0.1, 0.25, 0.75)) -> DataFrame:
    """Minimum, nearest-rank quantiles, median and maximum."""
    n = F.count("*")
    sums = scores.groupBy("score").agg(n.alias("n"))
    w = Window.orderBy("score")
    place = sums.withColumn("last", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    def at(share: float):
        index = F.floor(F.lit(share) * (F.col("total") - 1) + 0.5)
        return F.min(F.when(F.col("last") > index, F.col("score")))
    low = F.min(F.when(F.col("last") > F.floor((F.col("total") - 1) / 2), F.col("score")))
    high = F.min(F.when(F.col("last") > F.floor(F.col("total") / 2), F.col("score")))
    return place.agg(F.sum("n").alias("n"), F.min("score").alias("lowest"), *(at(s).alias(f"p{round(s * 100)}") for s in shares), ((low + high) / 2).alias("median"), F.max("score").alias("highest"))


def stratified_split(rows: DataFrame, key: str, stratum: str, share: float = 0.6, seed: str = "split-1") -> DataFrame:
    """``part`` tune or test: the first round(n * share) of each stratum in the order of a seeded hash."""
    order = F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary"))
    n = F.count("*").over(Window.partitionBy(stratum))
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    return rows.withColumn("part", F.when(at <= F.bround(n * F.lit(share)), "tune").otherwise("test"))


def bootstrap_interval(diffs: DataFrame, resamples: int = 1000, seed: int = 1337, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean of ``diff``, by Poisson resampling: every row draws its own count for
    each resample from a hash, so a resample is a sum and no row moves. Without rows both ends are null."""
    def times(resample: Column) -> Column:
        u = F.pmod(F.xxhash64("id", resample, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        out, chance, total, steps = F.lit(8), 0.36787944117144233, 0.0, []
        for k in range(8):
            total += chance
            steps.append((k, total))
            chance /= k + 1
        for k, upto in reversed(steps):
            out = F.when(u < upto, F.lit(k)).otherwise(out)
        return out

    # a row becomes a row for each resample; counts are summed in the task before anything is shuffled
    drawn = diffs.select("diff", F.transform(F.sequence(F.lit(1), F.lit(resamples)), times).alias("n"))
    sums = drawn.select("diff", F.posexplode("n").alias("resample", "n")).where("n > 0").groupBy("resample").agg(F.sum(F.col("n") * F.col("diff")).alias("s"), F.sum("n").alias("n"))
    means = sums.select((F.col("s") / F.col("n")).alias("score"))  # a resample that drew no row has no mean
    ordered = F.sort_array(F.collect_list("score"))  # as many as resamples at most
    low = F.try_element_at("m", F.floor(F.lit(alpha / 2) * F.size("m")).cast("int") + 1)
    high = F.try_element_at("m", F.greatest(F.lit(1), F.floor(F.lit(1 - alpha / 2) * F.size("m")).cast("int")))
    return means.agg(ordered.alias("m")).select(low.alias("low"), high.alias("high"))
