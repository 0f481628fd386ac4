"""Comparing retrieval settings: paired intervals, the decision for a change, blended ranks, query pools.

Resampling is Poisson's: a query counts once on average in each resample, by a uniform number that comes from two
hashes of its id, (a + r b) mod p for resample r. A task adds up all resamples of its rows by one
matrix product and hands on sums alone. A change is recommended only if the whole interval of the
paired differences lies above nought.

Pools sample chunks in the order of a seeded hash. Families of queries have quotas; what a family cannot
fill is filled by the others. A query carries what is accepted as a hit and what does not count.

Edge cases: null differences don't count; a setting without rows has no interval and is not recommended; texts
without a fitting sentence, term or identifier give no query; ties of the hash go to the smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.operators.ingest import salient_terms, verbatim_query

# Resamples and the part of them outside the interval; queries of a family, tokens and words at least;
# characters of an identifier and of a sentence; body chunks of a document at least.
RESAMPLES, ALPHA = 1000, 0.05
PER_FAMILY, MIN_TOKENS, MIN_WORDS, IDENTIFIER_CHARS, BODY = 60, 120, 3, 5, 3
IDENTIFIER = r"\b(?:[A-Za-z]+[-_.][A-Za-z0-9][A-Za-z0-9\-_.]*|[A-Za-z]+\d[A-Za-z0-9]*|[a-z]+[A-Z][A-Za-z]*)\b"
_PRIME = (1 << 31) - 1
#: Chances of a Poisson count of at most 0, 1, ... 8.
POISSON = np.cumsum([0.36787944117144233 / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(9)])


def _draws(ids: list[str], resamples: int, seed: str) -> np.ndarray:
    """Counts of each id in each resample."""
    words = np.array([[int(d[:8], 16), int(d[8:16], 16)] for d in (hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in ids)], np.int64).reshape(-1, 2) % _PRIME
    u = (words[:, :1] + words[:, 1:] * np.arange(1, resamples + 1)) % _PRIME / _PRIME
    return np.searchsorted(POISSON, u, side="right").astype(np.float64)


def paired_intervals(diffs: DataFrame, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: str = "paired-1") -> DataFrame:
    """(setting, id, diff) -> setting, n, mean, low, high: the percentile interval of the mean difference."""
    rows = diffs.where("diff is not null").select(F.col("setting").cast("string").alias("setting"), F.col("id").cast("string").alias("id"), F.col("diff").cast("double").alias("diff"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            settings, ids, diff = (batch.column(k).to_pylist() for k in range(3))
            for a in range(0, len(ids), 4096):
                counts = _draws(ids[a : a + 4096], resamples, seed)
                names, which = np.unique(np.array(settings[a : a + 4096], object), return_inverse=True)
                for k, name in enumerate(names):
                    own = counts[which == k]
                    made = np.stack((np.array(diff[a : a + 4096])[which == k] @ own, own.sum(axis=0)))
                    sums[name] = sums[name] + made if name in sums else made
        for name, made in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * resamples), pa.array(np.arange(1, resamples + 1)), pa.array(made[0]), pa.array(made[1])], ["setting", "resample", "s", "k"])

    drawn = rows.mapInArrow(run, "setting string, resample long, s double, k double").groupBy("setting", "resample").agg(F.sum("s").alias("s"), F.sum("k").alias("k")).where("k > 0")
    means = drawn.groupBy("setting").agg(F.sort_array(F.collect_list(F.round(F.col("s") / F.col("k"), 9))).alias("m"))  # as many as resamples
    size = F.size("m")
    at = lambda share, less: F.element_at("m", F.greatest(F.lit(1), F.least(size, F.floor(F.lit(share) * size).cast("int") + 1 - less)))
    whole = rows.groupBy("setting").agg(F.count("*").alias("n"), F.avg("diff").alias("mean"))
    return whole.join(means, "setting", "left").select("setting", "n", "mean", at(alpha / 2, 0).alias("low"), at(1 - alpha / 2, 1).alias("high"))


def decide(intervals: DataFrame) -> DataFrame:
    """Adds ``change``: the interval lies above nought. One below it, or across, keeps the baseline."""
    return intervals.withColumn("change", F.coalesce(F.col("low") > 0, F.lit(False)))


def against_baseline(metrics: DataFrame, baseline: str, *names: str) -> DataFrame:
    """(label, qid, metrics) -> setting (label and metric), id, diff: each setting's queries against the baseline's."""
    base = metrics.where(F.col("label") == baseline).select("qid", *(F.col(m).alias(f"base_{m}") for m in names))
    each = metrics.join(base, "qid").select("qid", F.explode(F.array(*(F.struct(F.concat("label", F.lit("|" + m)).alias("setting"), (F.col(m) - F.col(f"base_{m}")).alias("diff")) for m in names))).alias("x"))
    return each.select("x.setting", F.col("qid").alias("id"), "x.diff")


def blend_ranks(first: DataFrame, second: DataFrame, k: float) -> DataFrame:
    """Two lists (qid, id, rank) -> qid, id, score: 1 / (k + rank) of both; an id that a list lacks stands just after its end."""
    a, b = first.select("qid", "id", F.col("rank").alias("a")), second.select("qid", "id", F.col("rank").alias("b"))
    both = a.join(b, ["qid", "id"], "full")
    end = lambda c: F.coalesce(F.col(c), F.coalesce(F.max(c).over(Window.partitionBy("qid")), F.lit(0)) + 1)
    return both.select("qid", "id", (1 / (F.lit(float(k)) + end("a")) + 1 / (F.lit(float(k)) + end("b"))).alias("score"))


def identifiers(text: Column) -> Column:
    """Distinct technical names in order: with a digit, hyphen, dot or capital inside, of five characters or more."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))), lambda w: F.length(w) >= IDENTIFIER_CHARS)


def _number(key: Column, seed: str) -> Column:
    return F.conv(F.left(F.md5(F.concat(F.lit(seed + "|"), key.cast("string")).cast("binary")), F.lit(7)), 16, 10).cast("long")


def one_of(items: Column, key: Column, seed: str) -> Column:
    """An item chosen by a seeded hash of the key; null of an empty array."""
    return F.when(F.size(items) > 0, F.element_at(items, (F.pmod(_number(key, seed), F.size(items)) + 1).cast("int")))


def candidates(chunks: DataFrame, seed: str = "pool-1", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, doc, text) -> family, at, id, doc, query: every query that the chunks of enough tokens give, in a seeded order."""
    text = F.coalesce("text", F.lit(""))
    named = one_of(F.slice(identifiers(text), 1, 10), F.col("id"), seed + "-name")
    terms = salient_terms(text)
    made = {
        "identifier": F.concat(F.lit("what does the paper say about "), named),
        "term_bag": F.when(F.size(terms) >= 5, F.array_join(F.slice(terms, 1, 7), " ")),
        "verbatim_sentence": verbatim_query(text, F.col("id"), seed),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("family"), q.alias("query")) for k, q in made.items())))
    rows = chunks.where(T.count_tokens(text) >= min_tokens).select("id", "doc", each.alias("q"), _number(F.col("id"), seed).alias("at"))
    return rows.select("q.family", "at", "id", "doc", "q.query").where(F.size(F.regexp_extract_all("query", F.lit(r"\S+"), F.lit(0))) >= MIN_WORDS)


def fill_quotas(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(family, at, id, …) sampled without replacement: each family's first rows up to its quota, and what families lack
    of theirs from the others' next rows, in turns."""
    total = sum(quotas.values())
    order = Window.partitionBy("family").orderBy("at", "id")
    quota = F.lit(0)
    for family, n in quotas.items():
        quota = F.when(F.col("family") == family, n).otherwise(quota)
    near = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= total).withColumn("beyond", F.greatest(F.lit(0), F.col("place") - quota)).where(F.col("family").isin(*quotas))
    turn = Window.orderBy("beyond", "family", "at", "id")  # as many rows as families times the total
    return near.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= total).withColumn("refill", F.col("beyond") > 0).drop("place", "beyond", "turn")


def abstract_queries(chunks: DataFrame, limit: int = 50, seed: str = "abstract-1") -> DataFrame:
    """(id, doc, section, text) -> doc, query, accept, exclude: a sentence of a document's abstract, to be found in its body."""
    marked = chunks.withColumn("abstract", F.contains(F.lower(F.coalesce("section", F.lit(""))), F.lit("abstract")))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    first = F.min_by(F.when(F.col("abstract"), F.coalesce("text", F.lit(""))), F.when(F.col("abstract"), F.col("id")))
    grouped = marked.groupBy("doc").agg(ids(~F.col("abstract")).alias("accept"), ids(F.col("abstract")).alias("exclude"), first.alias("text"))
    fit = F.filter(T.sentences(F.col("text")), lambda s: F.length(s).between(60, 300))
    made = grouped.where((F.size("accept") >= BODY) & (F.size("exclude") > 0)).select("doc", one_of(fit, F.col("doc"), seed).alias("query"), "accept", "exclude")
    return made.where("query is not null").orderBy("doc").limit(limit)
