"""Gates on scores: thresholds, regressions against a baseline, a second judge's word, references and versions left out.

Edge cases: metrics without a threshold, or not in both runs, decide nothing; a run of which no metric has a
threshold is bad input; null scores count as absent; ties of versions keep the greatest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.operators.governance import latest

# The drop that is a regression; exit codes of a gate; headings of references.
MOST = 0.02
OK, BELOW, REGRESSED, BAD_INPUT = 0, 1, 2, 3
REFERENCES = ("references", "bibliography")


def gate(scores: DataFrame, thresholds: DataFrame, baseline: DataFrame | None = None, most: float = MOST) -> DataFrame:
    """(metric, score), (metric, threshold), (metric, score) -> metric, score, threshold, delta, passes, base, change, regressed.

    A row for each metric of the run; deltas are rounded to nine decimals, so that a drop of exactly ``most`` is none.
    """
    run = scores.where("score is not null").select("metric", F.col("score").cast("double").alias("score"))
    out = run.join(thresholds.select("metric", F.col("threshold").cast("double").alias("threshold")), "metric", "left")
    before = baseline if baseline is not None else scores.limit(0)
    out = out.join(before.where("score is not null").select("metric", F.col("score").cast("double").alias("base")), "metric", "left")
    delta, change = F.round(F.col("score") - F.col("threshold"), 9), F.round(F.col("score") - F.col("base"), 9)
    return out.select("metric", "score", "threshold", delta.alias("delta"), (delta >= 0).alias("passes"), "base", change.alias("change"), (change < -most).alias("regressed"))


def verdict(gated: DataFrame) -> DataFrame:
    """One row: checked (metrics with a threshold), compared, verdict and exit code; a regression comes before a threshold."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = gated.agg(count(F.col("threshold").isNotNull()).alias("checked"), count(F.col("base").isNotNull()).alias("compared"), count(~F.col("passes")).alias("below"), count(F.col("regressed")).alias("regressions"))
    code = F.when(F.col("checked") == 0, BAD_INPUT).when(F.col("regressions") > 0, REGRESSED).when(F.col("below") > 0, BELOW).otherwise(OK)
    said = F.when(code == BAD_INPUT, "no metric has a threshold").when(code == REGRESSED, "FAIL (regression)").when(code == BELOW, "FAIL (below threshold)").otherwise("PASS")
    return sums.select("checked", "compared", "below", "regressions", said.alias("verdict"), code.alias("code"))


def judged_again(verdicts: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Verdicts (keys, supported, coverage, reason, escalate) with those of a second judge (keys, supported, score, reason)
    in place of the escalated ones that it judged."""
    other = second.select(*keys, F.col("supported").alias("__supported"), F.round("score", 3).alias("__score"), F.col("reason").alias("__reason"), F.lit(True).alias("__judged"))
    joined = verdicts.join(other, list(keys), "left")
    by_judge = F.col("escalate") & F.coalesce(F.col("__judged"), F.lit(False))
    said = F.when(F.coalesce(F.col("__reason"), F.lit("")) != "", F.concat(F.lit("judge: "), F.col("__reason"))).otherwise("judge verdict")
    return joined.withColumns({"supported": F.when(by_judge, F.col("__supported")).otherwise(F.col("supported")), "coverage": F.when(by_judge, F.col("__score")).otherwise(F.col("coverage")), "reason": F.when(by_judge, said).otherwise(F.col("reason"))}).select(*verdicts.columns)


def names_references(heading: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(T.strip(heading), ":+$", ""), "^[0-9. ]+", "")).isin(*REFERENCES)


def drop_references(blocks: DataFrame) -> DataFrame:
    """(doc, ord, text, level) without what follows the first heading of references, and without unnumbered such headings;
    later headings stay."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("level").isNotNull()
    marked = blocks.withColumn("__after", F.max(F.when(heading & names_references(F.col("text")), 1)).over(w).isNotNull())
    bare = F.lower(F.regexp_replace(T.strip("text"), ":+$", "")).isin(*REFERENCES)
    return marked.where(~F.col("__after") | (heading & ~bare)).drop("__after")


def newest_versions(entries: DataFrame, key: str = "key") -> DataFrame:
    """Manifest entries whose key ends in v and a number (none is 1) -> paper, version and the rest, the newest of each paper."""
    version = F.coalesce(F.regexp_extract(key, "v([0-9]+)$", 1).try_cast("int"), F.lit(1))
    rows = entries.select(F.regexp_extract(key, "^(.*?)(v[0-9]+)?$", 1).alias("paper"), version.alias("version"), *entries.columns)
    return latest(rows, "paper", F.struct("version", *(c for c in entries.columns)))
