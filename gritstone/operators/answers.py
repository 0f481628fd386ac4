"""Context packing, extractive answers, citations and claim checks over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.operators.claims import judge

# Tokens of a context; least score, sentences kept and sentences looked at of an answer.
BUDGET = 1200
LEAST, KEEP, SCAN = 0.12, 3, 9
COVERAGE = 0.45


def pack_context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, id, rank, text) -> qid, id, rank, marker, cost of the blocks that fit, in rank order.

    A block that doesn't fit is skipped and later ones may still fit; a first block that doesn't
    is truncated. The fold runs over each query's hits (k of them at most) inside the JVM.
    """
    head = F.concat(F.lit("[S00] ("), F.col("id").cast("string"), F.lit(")\n"))
    cost = T.count_tokens(F.concat(head, F.col("text"))) + 1
    listed = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", cost.alias("cost")))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<rank:int,id:bigint,cost:bigint>>").alias("used"))

    def add(s: Column, x: Column) -> Column:
        fits = s["total"] + x["cost"] <= budget
        first = F.size(s["used"]) == 0
        cost = F.when(fits, x["cost"]).otherwise(F.lit(budget))
        taken = F.concat(s["used"], F.array(F.struct(x["rank"].cast("int").alias("rank"), x["id"].alias("id"), cost.alias("cost"))))
        return F.struct(F.when(fits | first, s["total"] + cost).otherwise(s["total"]).alias("total"), F.when(fits | first, taken).otherwise(s["used"]).alias("used"))

    used = listed.select("qid", F.aggregate("h", start, add)["used"].alias("used"))
    return used.select("qid", F.posexplode("used").alias("at", "x")).select("qid", "x.id", F.col("x.rank").cast("long").alias("rank"), (F.col("at") + 1).cast("long").alias("marker"), "x.cost")


def extract_answers(context: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, marker, text) -> qid, answer: up to KEEP sentences that share words with the question, each
    with its marker. None scores LEAST, or the question has no word: the answer is null (a refusal)."""
    asked = queries.select("qid", T.token_set("question").alias("want"))
    said = context.select("qid", "marker", F.posexplode(T.sentences("text")).alias("at", "sentence")).join(asked, "qid").withColumn("have", T.token_set("sentence")).where(F.size("have") > 0)
    both = F.size(F.array_intersect("want", "have")).cast("double")
    scored = said.withColumn("score", F.round(F.try_divide(both, F.size("want")) + 0.15 * both / F.sqrt(F.size("have").cast("double")), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "marker", "at")
    best = F.max("score").over(Window.partitionBy("qid"))
    short = scored.withColumn("best", best).withColumn("n", F.row_number().over(w)).where((F.col("n") <= SCAN) & (F.col("score") >= F.greatest(F.lit(LEAST), F.col("best") / 2)))
    fresh = short.withColumn("seen", F.row_number().over(Window.partitionBy("qid", F.substring("sentence", 1, 80)).orderBy("n"))).where("seen = 1")
    kept = fresh.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("n"))).where(F.col("k") <= KEEP)
    ended = F.when(F.col("sentence").rlike("[.!?]$"), F.col("sentence")).otherwise(F.concat("sentence", F.lit(".")))
    line = F.concat(ended, F.lit(" [S"), F.col("marker").cast("string"), F.lit("]"))
    answers = kept.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), " ").alias("answer"))
    return queries.select("qid").join(answers, "qid", "left")


def claims(answers: DataFrame) -> DataFrame:
    """(qid, answer) -> qid, claim_no, claim, marker: one row for each marker a sentence ends with."""
    parts = F.filter(F.split(F.regexp_replace("answer", r"(\[S\d{1,3}\]) ", "$1\u001e"), "\u001e"), lambda x: x != "")
    rows = answers.where("answer is not null").select("qid", F.posexplode(parts).alias("at", "claim"))
    return rows.select("qid", (F.col("at") + 1).cast("long").alias("claim_no"), T.strip_markers(F.col("claim")).alias("claim"), F.explode_outer(F.transform(T.markers(F.col("claim")), lambda m: m.cast("long"))).alias("marker"))


def check_claims(cited: DataFrame, least: float = COVERAGE) -> DataFrame:
    """(…, claim, evidence) -> the verdict of ``claims.judge`` on each."""
    return judge(cited, least=least)
