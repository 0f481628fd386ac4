"""Registered experiments: settings against a baseline, blended ranks, query pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.jobs import answer as A
from gritstone.jobs import evaluate as V
from gritstone.jobs import retrieve as R
from gritstone.operators import evaluation as E
from gritstone.operators import experiments as X
from gritstone.operators import retrieval as O
from gritstone.sources.scratch import kept

BASELINE, METRICS, BLEND = "rrf_k60_d0.5_s0.5", ("recall_5", "mrr_10"), 10.0
RESAMPLES, QUOTAS = 200, {"identifier": 25, "term_bag": 30, "verbatim_sentence": 20, "absent": 5}


def per_query(spark, sf):
    """Metrics of every setting and query, with the part that the query is in."""
    metrics = kept(V.per_query(spark, sf), "per-query")
    asked = metrics.select("qid").distinct().withColumn("family", F.col("qid") % 4)
    return metrics.join(E.stratified_split(asked, "qid", "family").select("qid", "part"), "qid")


def decided(spark, sf):
    """The best setting of the tuning part, and every setting's intervals against the baseline on the rest."""
    rows = per_query(spark, sf)
    best = rows.where("part = 'tune'").groupBy("label").agg(*(F.round(F.avg(m), 9).alias(m) for m in METRICS)).orderBy(*(F.desc(m) for m in METRICS), "label").limit(1).select(F.col("label").alias("best"))
    found = X.decide(X.paired_intervals(X.against_baseline(rows.where("part = 'test'"), BASELINE, *METRICS), RESAMPLES))
    label = F.substring_index("setting", "|", 1)
    return found.crossJoin(F.broadcast(best)).select(label.alias("label"), F.substring_index("setting", "|", -1).alias("metric"), "n", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "low", "high")), "change", (label == F.col("best")).alias("tuned"))


def blended(spark, sf):
    """The shortlist's own order blended with that of its reranking."""
    short = R.sparse_top(spark, sf, R.SHORTLIST).select("qid", "id", "rank")
    reranked = O.rerank(short, R.documents(spark, sf), R.questions(spark, sf), R.SHORTLIST)
    return O.ranked(X.blend_ranks(short, reranked, BLEND), R.K).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def chunks(spark, sf):
    """Ten documents are one, of which the first is the abstract."""
    docs = R.documents(spark, sf)
    return docs.select("id", F.floor(F.col("id") / 10).alias("doc"), F.when(F.col("id") % 10 == 0, "Abstract").otherwise("Methods").alias("section"), "text")


def pool(spark, sf):
    found = X.fill_quotas(X.candidates(chunks(spark, sf)), QUOTAS)
    return found.select("family", "id", "doc", "refill", F.md5(F.col("query").cast("binary")).alias("query_md5"))


def abstracts(spark, sf):
    found = X.abstract_queries(chunks(spark, sf))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("doc", F.md5(F.col("query").cast("binary")).alias("query_md5"), text("accept"), text("exclude"))


QUERIES = {"q_decide": decided, "q_rank_blend": blended, "q_query_pool": pool, "q_abstract_queries": abstracts}

_DRAW = "len(list_filter([" + ", ".join(f"{float(p)!r}::DOUBLE" for p in X.POISSON) + f"], lambda p: p <= ((a + r * b) % {X._PRIME})::DOUBLE / {X._PRIME}))"
_AT = "m[greatest(1, least(len(m), floor({share}::DOUBLE * len(m))::INT + 1 - {less}))]"
_POOL = f"""c AS (SELECT doc_id AS id, doc_id // 10 AS doc, CASE WHEN doc_id % 10 = 0 THEN 'Abstract' ELSE 'Methods' END AS section, text, CAST('0x' || left(md5('pool-1|' || doc_id), 7) AS BIGINT) AS at_ FROM documents),
f AS (SELECT *, list_filter({A._SENT.format("coalesce(text, '')")}, lambda x: length(x) BETWEEN 40 AND 300) AS fit,
  list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}'), lambda w: NOT list_contains({R.STOP_SQL}, w))), lambda w: struct_pack(n := -length(w), w := w))) AS t,
  regexp_extract_all(coalesce(text, ''), '{X.IDENTIFIER}') AS n FROM c WHERE length(text) // 4 >= {X.MIN_TOKENS}),
g AS (SELECT *, list_filter(n, lambda w, i: length(w) >= {X.IDENTIFIER_CHARS} AND list_position(n, w) = i)[1:10] AS names FROM f),
q AS (
  SELECT 'identifier' AS family, at_, id, doc, 'what does the paper say about ' || names[1 + CAST('0x' || left(md5('pool-1-name|' || id), 7) AS BIGINT) % nullif(len(names), 0)] AS query FROM g
  UNION ALL SELECT 'term_bag', at_, id, doc, CASE WHEN len(t) >= 5 THEN array_to_string(list_transform(t[1:7], lambda x: x.w), ' ') END FROM g
  UNION ALL SELECT 'verbatim_sentence', at_, id, doc, fit[1 + at_ % nullif(len(fit), 0)] FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY at_, id) AS place FROM q WHERE len(regexp_extract_all(query, '\\S+')) >= {X.MIN_WORDS}),
b AS (SELECT *, greatest(0, place - CASE family {" ".join(f"WHEN '{k}' THEN {n}" for k, n in QUOTAS.items())} END) AS beyond FROM p)"""

SQL = {
    "q_decide": f"""{V._SWEEP}, parts AS (SELECT qid, CASE WHEN row_number() OVER (PARTITION BY qid % 4 ORDER BY md5('split-1|' || qid), qid) <= round_even(count(*) OVER (PARTITION BY qid % 4) * 0.6::DOUBLE, 0) THEN 'tune' ELSE 'test' END AS part FROM (SELECT DISTINCT qid FROM m)),
pm AS MATERIALIZED (SELECT * FROM m JOIN parts USING (qid)),
best AS (SELECT label FROM pm WHERE part = 'tune' GROUP BY label ORDER BY round(avg(recall_5), 9) DESC, round(avg(mrr_10), 9) DESC, label LIMIT 1),
d AS MATERIALIZED (SELECT x.label, 'recall_5' AS metric, qid, x.recall_5 - y.recall_5 AS diff FROM pm x JOIN pm y USING (qid) WHERE x.part = 'test' AND y.label = '{BASELINE}' UNION ALL SELECT x.label, 'mrr_10', qid, x.mrr_10 - y.mrr_10 FROM pm x JOIN pm y USING (qid) WHERE x.part = 'test' AND y.label = '{BASELINE}'),
k AS MATERIALIZED (SELECT qid, r, {_DRAW} AS k FROM (SELECT DISTINCT qid, CAST('0x' || left(md5('paired-1|' || qid), 8) AS BIGINT) % {X._PRIME} AS a, CAST('0x' || substr(md5('paired-1|' || qid), 9, 8) AS BIGINT) % {X._PRIME} AS b FROM d), (SELECT unnest(range(1, {RESAMPLES + 1})) AS r)),
s AS (SELECT label, metric, r, round(sum(diff * k) / sum(k), 9) AS mean FROM d JOIN k USING (qid) GROUP BY ALL HAVING sum(k) > 0),
i AS (SELECT label, metric, list(mean ORDER BY mean) AS m FROM s GROUP BY ALL), w AS (SELECT label, metric, count(*) AS n, avg(diff) AS mean FROM d GROUP BY ALL)
SELECT label, metric, n, round(mean, 6) + 0.0 AS mean, round({_AT.format(share=X.ALPHA / 2, less=0)}, 6) + 0.0 AS low, round({_AT.format(share=1 - X.ALPHA / 2, less=1)}, 6) + 0.0 AS high, coalesce({_AT.format(share=X.ALPHA / 2, less=0)} > 0, false) AS change, label = (SELECT label FROM best) AS tuned FROM w JOIN i USING (label, metric)""",
    "q_rank_blend": f"WITH {R.bm25_sql()}, short AS ({R.top_sql('hits', R.SHORTLIST)}), {R.F1_SQL}, second AS ({R.top_sql('f1s', R.SHORTLIST, 'qid', 'before')}), bl AS (SELECT qid, id, 1.0::DOUBLE / ({BLEND}::DOUBLE + before) + 1.0::DOUBLE / ({BLEND}::DOUBLE + rank) AS score FROM second) SELECT qid, id, rank, round(score, 6) AS score FROM ({R.top_sql('bl', R.K)})",
    "q_query_pool": f"WITH {_POOL} SELECT family, id, doc, beyond > 0 AS refill, md5(query) AS query_md5 FROM b QUALIFY row_number() OVER (ORDER BY beyond, family, at_, id) <= {sum(QUOTAS.values())}",
    "q_abstract_queries": f"""WITH c AS (SELECT doc_id AS id, doc_id // 10 AS doc, doc_id % 10 = 0 AS abstract, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc, list(id ORDER BY id) FILTER (NOT abstract) AS accept, list(id ORDER BY id) FILTER (abstract) AS exclude, arg_min(text, id) FILTER (abstract) AS text FROM c GROUP BY doc),
s AS (SELECT *, list_filter({A._SENT.format("text")}, lambda x: length(x) BETWEEN 60 AND 300) AS fit FROM g WHERE len(accept) >= {X.BODY} AND len(exclude) > 0)
SELECT doc, md5(fit[1 + CAST('0x' || left(md5('abstract-1|' || doc), 7) AS BIGINT) % len(fit)]) AS query_md5, array_to_string(accept, ',') AS accept, array_to_string(exclude, ',') AS exclude FROM s WHERE len(fit) > 0 ORDER BY doc LIMIT 50""",
}
