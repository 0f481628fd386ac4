"""Review ledgers, dataset validation and near-duplicate questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T


def latest(ledger: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key: a map-side maximum instead of a sort."""
    rest = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and of ``new`` the last row of each key: by ``order``, else the greatest row."""
    last = latest(new, key, F.struct(*(c for c in new.columns if c != key)) if order is None else order)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def duplicate_groups(questions: DataFrame) -> DataFrame:
    """(id, question) -> question key, n and ids of keys that occur more than once."""
    keyed = questions.select("id", T.question_key("question").alias("question"))
    return keyed.groupBy("question").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), ",").alias("ids")).where("n > 1")


# Function words that questions are compared without.
QUESTION_STOPWORDS = (
    "a an the is are was were be been being of in on at to for with by from as that this these those it its and or but if then does do did what which who how why"
).split()


def question_items(question: Column) -> Column:
    """The words that a question is compared by; one without any is compared as a whole."""
    key = T.question_key(F.coalesce(question, F.lit("")))
    found = F.array_distinct(F.filter(F.regexp_extract_all(key, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(QUESTION_STOPWORDS) & (F.length(w) > 1)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("="), key)))


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(id, items) -> pairs (a, b, jaccard) of distinct sets with Jaccard similarity ``least`` or more.

    Exact prefix filter: with items from rare to frequent, two similar sets share an item among the
    first ``size - ceil(least * size) + 1`` of each, so only those are joined; sizes bound the rest.
    Equal sets are joined once, by their smallest id.
    """
    ordered = sets.where(F.size("items") > 0).withColumn("items", F.sort_array("items")).groupBy("items").agg(F.min("id").alias("id"))
    each = ordered.select("id", F.size("items").alias("n"), "items", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id").orderBy("df", "item")
    prefix = each.join(often, "item").withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("id", "n", "item")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "item"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "item")
    near = a.join(b, "item").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    left, right = ordered.select(F.col("id").alias("a"), F.col("items").alias("ia")), ordered.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    return near.join(left, "a").join(right, "b").withColumn("jaccard", T.jaccard(F.col("ia"), F.col("ib"))).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def cost_by_model(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Sums of calls and tokens of each model, and their cost; prices are dollars per million tokens."""
    sums = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return sums.join(F.broadcast(prices), "model", "left").withColumn("cost", F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("tokens_out") * F.col("price_out") / 1e6).drop("price_in", "price_out")


def running_total(usage: DataFrame, amount: str, by: str, order: str) -> DataFrame:
    """``total`` of all rows up to each, in ``order`` within ``by``."""
    return usage.withColumn("total", F.sum(amount).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
