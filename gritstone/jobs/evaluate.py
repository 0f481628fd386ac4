"""Registered evaluation and governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.jobs import retrieve as R
from gritstone.operators import evaluation as E
from gritstone.operators import governance as G
from gritstone.operators import groups as S
from gritstone.operators import retrieval as O
from gritstone.sources import table
from gritstone.sources.scratch import kept

THRESHOLDS = [100.0, 300.0, 600.0, 1200.0, 2400.0, 4800.0]
# Fusion settings of the sweep as (label, method, k, dense weight, sparse weight).
GRID = [(f"rrf_k{k}_d{d}_s{s}", "rrf", float(k), d, s) for k in (20, 60, 100) for d, s in ((0.5, 0.5), (0.7, 0.3), (0.3, 0.7), (0.9, 0.1), (0.1, 0.9))]
GRID += [(f"weighted_s{s / 10:.1f}", "weighted", 60.0, round(1 - s / 10, 1), s / 10) for s in range(11)]
PRICES = [("assistant", 0.15, 0.6), ("user", 0.05, 0.0), ("system", 0.05, 0.0)]
BUDGET = 400.0


def known_items(spark, sf):
    """(qid, id) of documents that hold a benchmark item's text.

    A token inside an item is a token of every document that holds the item: the keyword index gives the documents
    of each item's rarest such token, and these are verified. Items without one that is indexed are compared with all texts.
    """
    tokens = F.regexp_extract_all(F.lower("question"), F.lit(T.TOKEN), F.lit(0))
    inner = F.when(F.size("terms") > 2, F.slice("terms", F.lit(2), F.size("terms") - 2)).otherwise(F.array().cast("array<string>"))
    items = R.questions(spark, sf).where("length(question) > 0").withColumn("terms", tokens).withColumn("inner", F.filter(inner, lambda t: ~t.isin(T.STOPWORDS)))
    docs, index = R.documents(spark, sf).where("text is not null").select("id", "text"), R.keyword_index(spark, sf)
    asked = items.select("qid", F.explode(F.array_distinct("inner")).alias("term"))
    rare = kept(asked.join(index.terms.select("term", "df"), "term").groupBy("qid").agg(F.min_by("term", F.struct("df", "term")).alias("term")), "rare")
    near = kept(index.postings.where("term <> ''").join(rare, "term").select("qid", "id").distinct(), "near")
    texts = near.join(O.texts_of(near, docs), "id").join(items.select("qid", "question"), "qid")
    found = texts.where(F.contains("text", "question")).select("qid", "id")
    bare = docs.crossJoin(F.broadcast(items.where(F.size("inner") == 0))).where(F.contains("text", "question")).select("qid", "id")
    return kept(found.union(bare).distinct(), "known")


def known_item_metrics(spark, sf):
    m = E.query_metrics(R.sparse_top(spark, sf, 10).select("qid", "id", "rank"), known_items(spark, sf))
    return E.mean_metrics(m.withColumn("family", F.pmod("qid", F.lit(4)).cast("string")), "family").withColumn("family", F.coalesce("family", F.lit("ALL")))


def per_query(spark, sf):
    """Metrics of every setting and query in one job: lists are joined with the settings, not looped over."""
    lists = R.both_lists(spark, sf)
    grid = spark.createDataFrame(GRID, "label string, method string, k double, dense double, sparse double")
    w = F.when(F.col("source") == "dense", F.col("dense")).otherwise(F.col("sparse"))
    part = F.when(F.col("method") == "rrf", w / (F.col("k") + F.col("rank"))).otherwise(w * F.col("normalized"))
    fused = lists.crossJoin(F.broadcast(grid)).groupBy("label", "qid", "id").agg(F.sum(part).alias("score"))
    hits = fused.withColumn("rank", F.row_number().over(Window.partitionBy("label", "qid").orderBy(F.round("score", 6).desc(), "id"))).where("rank <= 10")
    return E.query_metrics(hits, known_items(spark, sf), "label")


def fusion_sweep(spark, sf):
    return per_query(spark, sf).groupBy("label").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in ("recall_1", "recall_5", "recall_10", "mrr_10")))


def best_config(spark, sf):
    return fusion_sweep(spark, sf).orderBy(F.desc("recall_5"), F.desc("mrr_10"), "label").limit(1)


def labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")), "doc_id")


def split(spark, sf):
    return E.stratified_split(labelled(spark, sf), "doc_id", "lang").select("doc_id", "lang", "part")


def refusal_confusion(spark, sf):
    return E.confusion(table(spark, sf, "labels").selectExpr("toxic as expected", "1 - quality as actual"), "expected", "actual")


def gate_thresholds(spark, sf):
    return E.threshold_table(labelled(spark, sf).selectExpr("score", "quality as label"), THRESHOLDS)


def score_quantiles(spark, sf):
    return E.nearest_rank(labelled(spark, sf).select("score"))


def auroc(spark, sf):
    return E.auroc(labelled(spark, sf).selectExpr("score", "quality as label"))


def bootstrap(spark, sf):
    """Interval of quality less toxicity over labelled documents."""
    return E.bootstrap_interval(table(spark, sf, "labels").selectExpr("doc_id as id", "cast(quality - toxic as double) as diff"))


def ledger(spark, sf):
    """Decisions: a label, and for each third document a later one that rejects it."""
    base = table(spark, sf, "labels").selectExpr("doc_id as pair_id", "if(quality = 1, 'verified', 'rejected') as status", "1 as decided")
    return base.unionByName(base.where("pair_id % 3 = 0").selectExpr("pair_id", "'rejected' as status", "2 as decided"))


def ledger_latest(spark, sf):
    return G.latest(ledger(spark, sf), "pair_id", F.col("decided"))


def verified(spark, sf):
    good = ledger_latest(spark, sf).where("status = 'verified'").withColumnRenamed("pair_id", "doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(good, "doc_id", "left_semi")


def unknown(spark, sf):
    return table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


def status_counts(spark, sf):
    status = table(spark, sf, "documents").select("doc_id", "lang").join(ledger_latest(spark, sf).withColumnRenamed("pair_id", "doc_id"), "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("draft")))
    sets = status.groupingSets([["lang"], ["status"], []], "lang", "status").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
    return sets.select("lang", "status", "level", "n")


def pairs(spark, sf):
    """Question and answer of each user turn: the next assistant turn of its conversation, if any."""
    turns = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumn("answer", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    return nxt.where("role = 'user'").select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("question"), "answer")


def repeated(spark, sf):
    """Pairs, some of them asked again with other blanks or with a word more."""
    asked = pairs(spark, sf).select("id", "question")
    at = F.substring_index("id", "-", 1).cast("long") % 20
    again = asked.where(at == 0).select(F.concat("id", F.lit("-again")).alias("id"), F.concat(F.lit("  "), "question", F.lit("\n ")).alias("question"))
    return asked.unionByName(again).unionByName(asked.where(at == 1).select(F.concat("id", F.lit("-more")).alias("id"), F.concat("question", F.lit(" indeed")).alias("question")))


def dup_questions(spark, sf):
    return G.duplicate_groups(repeated(spark, sf))


def near_dup_pairs(spark, sf):
    sets = repeated(spark, sf).select("id", T.token_set(F.coalesce("question", F.lit(""))).alias("items"))
    return G.similar_pairs(sets, 0.75).withColumn("jaccard", F.round("jaccard", 6))


def near_dup_groups(spark, sf):
    """Each question's class of equal ones, group of similar ones, and the classes similar to its own."""
    sets = repeated(spark, sf).select("id", G.question_items(F.col("question")).alias("items"))
    return S.similar_groups(sets, 0.75)


def dataset_validation(spark, sf):
    found = pairs(spark, sf)
    blank = F.coalesce(T.strip("answer"), F.lit("")) == ""
    one = found.agg(F.count("*").alias("total"), F.sum(blank.cast("long")).alias("missing_answers"), F.countDistinct(T.question_key("question")).alias("distinct_questions"))
    ratio = F.col("missing_answers") / F.col("total")
    return one.withColumns({"missing_ratio": F.round(ratio, 6), "ratio_in_range": (ratio >= 0.05) & (ratio <= 0.30), "size_in_range": F.col("total").between(50, 200)})


def usage(spark, sf):
    t = T.count_tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("model"), F.when(F.col("role") == "assistant", 0).otherwise(t).cast("long").alias("tokens_in"), F.when(F.col("role") == "assistant", t).otherwise(0).cast("long").alias("tokens_out"))


def cost_by_model(spark, sf):
    return G.cost_by_model(usage(spark, sf), spark.createDataFrame(PRICES, "model string, price_in double, price_out double")).withColumn("cost", F.round("cost", 6))


def budget_breach(spark, sf):
    """The first turn of each conversation at which its tokens exceed the budget."""
    spent = G.running_total(usage(spark, sf).withColumn("spent", F.col("tokens_in") + F.col("tokens_out")), "spent", "conv_id", "turn")
    return spent.where(F.col("total") > BUDGET).groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min("total").alias("total"))


def regression_gate(spark, sf):
    """Mean label of each language in one half against the other: pass, fail or regression."""
    now = labelled(spark, sf).where("doc_id % 2 = 1").groupBy("lang").agg(F.avg("quality").alias("now"))
    base = labelled(spark, sf).where("doc_id % 2 = 0").groupBy("lang").agg(F.avg("quality").alias("base"))
    delta = F.col("now") - F.col("base")
    verdict = F.when(F.col("now").isNull() | F.col("base").isNull(), "n/a").when(delta < -0.02, "regression").when(F.col("now") < 0.85, "fail").otherwise("pass")
    return now.join(base, "lang", "full").select("lang", F.round("now", 6).alias("now"), F.round("base", 6).alias("base"), F.round(delta, 6).alias("delta"), verdict.alias("verdict"))


QUERIES = {
    "q_known_item_metrics": known_item_metrics, "q_fusion_sweep": fusion_sweep, "q_best_config": best_config, "q_stratified_split": split, "q_refusal_confusion": refusal_confusion, "q_gate_thresholds": gate_thresholds,
    "q_score_quantiles": score_quantiles, "q_auroc": auroc, "q_bootstrap": bootstrap, "q_ledger_latest": ledger_latest, "q_verified_semi": verified, "q_unknown_anti": unknown, "q_status_counts": status_counts,
    "q_dup_questions": dup_questions, "q_near_dup_pairs": near_dup_pairs, "q_near_dup_groups": near_dup_groups, "q_dataset_validation": dataset_validation, "q_cost_by_model": cost_by_model, "q_budget_breach": budget_breach, "q_metric_regression_gate": regression_gate,
}

_EXPECTED = "expected AS MATERIALIZED (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)"
_METRICS = "coalesce((first <= 1)::INT::DOUBLE, 0) AS recall_1, coalesce((first <= 5)::INT::DOUBLE, 0) AS recall_5, coalesce((first <= 10)::INT::DOUBLE, 0) AS recall_10, CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END AS mrr_10"
_MEANS = "count(*) AS n, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr_10), 6) AS mrr_10"
_GRID = ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in GRID)
_SWEEP = f"""WITH {R.lists_sql()}, {_EXPECTED}, grid(label, method, k, dw, sw) AS (VALUES {_GRID}),
fused AS (SELECT label, qid, id, sum(CASE WHEN method = 'rrf' THEN (CASE WHEN source = 'dense' THEN dw ELSE sw END) / (k + rank) ELSE (CASE WHEN source = 'dense' THEN dw ELSE sw END) * normalized END) AS score FROM lists, grid GROUP BY ALL),
top AS ({R.top_sql('fused', 10, 'label, qid')}), firsts AS (SELECT label, qid, min(rank) AS first FROM top JOIN expected USING (qid, id) GROUP BY ALL),
m AS (SELECT label, qid, {_METRICS} FROM (SELECT DISTINCT qid FROM expected) CROSS JOIN (SELECT label FROM grid) LEFT JOIN firsts USING (label, qid)), sweep AS (SELECT label, {_MEANS} FROM m GROUP BY label)"""
_LEDGER = "ledger AS (SELECT doc_id AS pair_id, CASE WHEN quality = 1 THEN 'verified' ELSE 'rejected' END AS status, 1 AS decided FROM labels UNION ALL SELECT doc_id, 'rejected', 2 FROM labels WHERE doc_id % 3 = 0), latest AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY decided DESC) = 1)"
_LABELLED = "lab AS (SELECT l.*, lang, n_chars::DOUBLE AS score FROM labels l JOIN documents USING (doc_id))"
_PAIRS = "turns AS (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id || '-' || turn AS id, text AS question, answer FROM turns WHERE role = 'user')"
_REPEATED = "repeated AS (SELECT id, question FROM pairs UNION ALL SELECT id || '-again', '  ' || question || chr(10) || ' ' FROM pairs WHERE CAST(split_part(id, '-', 1) AS BIGINT) % 20 = 0 UNION ALL SELECT id || '-more', question || ' indeed' FROM pairs WHERE CAST(split_part(id, '-', 1) AS BIGINT) % 20 = 1)"
_QKEY = "trim(regexp_replace(lower(question), '\\s+', ' ', 'g'))"
_USAGE = "usage AS (SELECT conv_id, turn, role AS model, CASE WHEN role = 'assistant' THEN 0 ELSE t END AS tokens_in, CASE WHEN role = 'assistant' THEN t ELSE 0 END AS tokens_out FROM (SELECT *, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS t FROM conversations))"

SQL = {
    "q_known_item_metrics": f"WITH {R.bm25_sql()}, {_EXPECTED}, top AS ({R.top_sql('hits', 10)}), firsts AS (SELECT qid, min(rank) AS first FROM top JOIN expected USING (qid, id) GROUP BY qid), m AS (SELECT (qid % 4)::VARCHAR AS family, {_METRICS} FROM (SELECT DISTINCT qid FROM expected) LEFT JOIN firsts USING (qid)) SELECT coalesce(family, 'ALL') AS family, {_MEANS} FROM m GROUP BY ROLLUP (family)",
    "q_fusion_sweep": f"{_SWEEP} SELECT * FROM sweep",
    "q_best_config": f"{_SWEEP} SELECT * FROM sweep ORDER BY recall_5 DESC, mrr_10 DESC, label LIMIT 1",
    "q_stratified_split": f"WITH {_LABELLED} SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('split-1|' || doc_id), doc_id) <= round_even(count(*) OVER (PARTITION BY lang) * 0.6::DOUBLE, 0) THEN 'tune' ELSE 'test' END AS part FROM lab",
    "q_refusal_confusion": "WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c",
    "q_gate_thresholds": f"WITH {_LABELLED} SELECT t AS threshold, count(*) FILTER (quality = 1 AND score < t) AS false_refusals, count(*) FILTER (quality = 0 AND score >= t) AS passes FROM lab, (SELECT unnest({THRESHOLDS})::DOUBLE AS t) GROUP BY t",
    "q_score_quantiles": f"WITH {_LABELLED}, s AS (SELECT list(score ORDER BY score) AS x, count(*) AS n FROM lab) SELECT n, x[1] AS lowest, x[1 + floor(0.1 * (n - 1) + 0.5)::BIGINT] AS p10, x[1 + floor(0.25 * (n - 1) + 0.5)::BIGINT] AS p25, x[1 + floor(0.75 * (n - 1) + 0.5)::BIGINT] AS p75, (x[1 + (n - 1) // 2] + x[1 + n // 2]) / 2 AS median, x[n] AS highest FROM s",
    "q_auroc": f"WITH {_LABELLED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END::DOUBLE), 6) AS auroc FROM lab p, lab n WHERE p.quality = 1 AND n.quality = 0",
    "q_ledger_latest": f"WITH {_LEDGER} SELECT * FROM latest",
    "q_verified_semi": f"WITH {_LEDGER} SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT pair_id FROM latest WHERE status = 'verified')",
    "q_unknown_anti": "SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND lang = 'en')",
    "q_status_counts": f"WITH {_LEDGER}, s AS (SELECT lang, coalesce(status, 'draft') AS status FROM documents LEFT JOIN latest ON pair_id = doc_id) SELECT lang, status, grouping(lang, status)::BIGINT AS level, count(*) AS n FROM s GROUP BY GROUPING SETS ((lang), (status), ())",
    "q_dup_questions": f"WITH {_PAIRS}, {_REPEATED} SELECT {_QKEY} AS question, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM repeated GROUP BY 1 HAVING n > 1",
    "q_near_dup_pairs": f"WITH {_PAIRS}, {_REPEATED}, s AS (SELECT min(id) AS id, x FROM (SELECT id, list_sort({R.SET_SQL.format('coalesce(question, chr(32))')}) AS x FROM repeated) WHERE len(x) > 0 GROUP BY x), j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.x, b.x))::DOUBLE AS i, len(a.x) + len(b.x) AS n FROM s a JOIN s b ON a.id < b.id) SELECT a, b, round(i / (n - i), 6) AS jaccard FROM j WHERE i / (n - i) >= 0.75",
    "q_near_dup_groups": f"""WITH RECURSIVE {_PAIRS}, {_REPEATED}, w AS (SELECT id, k, list_sort(list_distinct(list_filter(regexp_extract_all(k, '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in G.QUESTION_STOPWORDS)}], w)))) AS x FROM (SELECT id, trim(regexp_replace(lower(coalesce(question, '')), '\\s+', ' ', 'g')) AS k FROM repeated)),
c AS MATERIALIZED (SELECT id, x, min(id) OVER (PARTITION BY x) AS class_id FROM (SELECT id, CASE WHEN len(x) > 0 THEN x ELSE ['=' || k] END AS x FROM w)),
s AS MATERIALIZED (SELECT DISTINCT class_id, x FROM c), j AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b FROM s a JOIN s b ON a.class_id <> b.class_id WHERE len(list_intersect(a.x, b.x))::DOUBLE / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) >= 0.75),
r AS (SELECT class_id AS a, class_id AS b FROM s UNION SELECT r.a, j.b FROM r JOIN j ON j.a = r.b)
SELECT id, c.class_id, g.group_id, coalesce(l.links, 0) AS links FROM c JOIN (SELECT a AS class_id, min(b) AS group_id FROM r GROUP BY a) g USING (class_id) LEFT JOIN (SELECT a AS class_id, count(*) AS links FROM j GROUP BY a) l USING (class_id)""",
    "q_dataset_validation": f"WITH {_PAIRS}, o AS (SELECT count(*) AS total, count(*) FILTER (regexp_replace(coalesce(answer, ''), '\\s+', '', 'g') = '') AS missing_answers, count(DISTINCT {_QKEY}) AS distinct_questions FROM pairs) SELECT *, round(missing_answers / total, 6) AS missing_ratio, missing_answers / total BETWEEN 0.05 AND 0.30 AS ratio_in_range, total BETWEEN 50 AND 200 AS size_in_range FROM o",
    "q_cost_by_model": f"WITH {_USAGE}, p(model, a, b) AS (VALUES {', '.join(f'({m!r}, {a}::DOUBLE, {b}::DOUBLE)' for m, a, b in PRICES)}) SELECT model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(tokens_in) * any_value(a) / 1e6 + sum(tokens_out) * any_value(b) / 1e6, 6) AS cost FROM usage LEFT JOIN p USING (model) GROUP BY model",
    "q_budget_breach": f"WITH {_USAGE}, r AS (SELECT conv_id, turn, sum(tokens_in + tokens_out) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS total FROM usage) SELECT conv_id, min(turn) AS turn, min(total) AS total FROM r WHERE total > {BUDGET} GROUP BY conv_id",
    "q_metric_regression_gate": f"WITH {_LABELLED}, n AS (SELECT lang, avg(quality) AS now FROM lab WHERE doc_id % 2 = 1 GROUP BY lang), b AS (SELECT lang, avg(quality) AS base FROM lab WHERE doc_id % 2 = 0 GROUP BY lang) SELECT lang, round(now, 6) AS now, round(base, 6) AS base, round(now - base, 6) AS delta, CASE WHEN now IS NULL OR base IS NULL THEN 'n/a' WHEN now - base < -0.02 THEN 'regression' WHEN now < 0.85 THEN 'fail' ELSE 'pass' END AS verdict FROM n FULL JOIN b USING (lang)",
}
