"""Registered retrieval queries: benchmark items ask, documents and embeddings answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.functions import vectors as V
from gritstone.operators import retrieval as R
from gritstone.sources import keyword_index as X
from gritstone.sources import spread, table
from gritstone.sources.scratch import kept

K, SHORTLIST = 5, 30
TEXT_DIMENSION = 64
WEIGHTS = {"dense": 0.5, "sparse": 0.5}


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def tokens_top(spark, sf):
    terms = documents(spark, sf).select(F.explode(T.tokenize(F.coalesce("text", F.lit("")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


def doc_ids(spark, sf):
    docs = table(spark, sf, "documents")
    key = T.document_key(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", key.alias("key"), T.chunk_key(key, F.lit(0)).alias("chunk_id"), T.count_tokens(F.coalesce("text", F.lit(""))).alias("token_count"))


def keyword_index(spark, sf, group=None):
    return X.build(X.corpus(documents(spark, sf), "id", "text", group))


def index_stats(spark, sf):
    index = keyword_index(spark, sf)
    sizes = index.postings.where("term = ''").agg(F.count("*").alias("documents"), F.round(F.avg("dl"), 6).alias("avg_length"))
    return sizes.crossJoin(index.terms.agg(F.count("*").alias("vocabulary"))).withColumns({"k1": F.lit(R.K1), "b": F.lit(R.B)})


def sparse_hits(spark, sf, group=None):
    return R.bm25(keyword_index(spark, sf, group), questions(spark, sf))


def sparse_top(spark, sf, k, group=None, only=None):
    """The first ``k`` of each question (and group): qid, id, grp, score, rank."""
    return R.bm25_top(keyword_index(spark, sf, group), questions(spark, sf), k, only=only)


def index_delta(spark, sf):
    """Nine tenths of the documents are indexed first, with old texts of some of the rest; the rest follows."""
    docs = X.corpus(documents(spark, sf), "id", "text")
    old = docs.where("id % 10 <> 0").unionByName(docs.where("id % 50 = 0").withColumn("text", F.reverse("text")))
    index = X.extend(X.build(old), docs.where("id % 10 = 0"))
    return R.bm25_top(index, questions(spark, sf), K).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf):
    return R.min_max(sparse_top(spark, sf, K)).select("qid", "id", "rank", F.round("score", 6).alias("score"), F.round("normalized", 4).alias("normalized"))


def bm25_filtered(spark, sf):
    hits = sparse_top(spark, sf, K, only=documents(spark, sf).where("lang = 'en'").select("id"))
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"))


def bm25_within_group(spark, sf):
    return sparse_top(spark, sf, K, group="source").select("qid", F.col("grp").alias("source"), "id", "rank", F.round("score", 6).alias("score"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def vector_queries(spark, sf):
    return vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def knn(kind, where=None):
    def query(spark, sf):
        base = vectors(spark, sf)
        found = R.nearest(base.where(where) if where else base, vector_queries(spark, sf), 10, kind)
        return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))

    return query


def embedded_texts(spark, sf):
    """Every component of the documents' hashed vectors."""
    made = V.embed(documents(spark, sf).select(F.col("id").alias("doc_id"), "text"), dimension=TEXT_DIMENSION, normal=False)
    return made.select("doc_id", F.posexplode("v").alias("place", "x")).select("doc_id", F.col("place").cast("long").alias("place"), (F.round("x", 6) + F.lit(0.0)).alias("value")).where("value <> 0")


def dense_text(spark, sf):
    """Questions and documents as hashed vectors: neighbours share words."""
    docs = V.embed(spread(documents(spark, sf).select("id", "text")), dimension=TEXT_DIMENSION, normal=False)
    asked = V.embed(questions(spark, sf), "question", TEXT_DIMENSION, False).select("qid", F.col("v").alias("q"))
    return R.nearest(docs, asked, K).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def dense_lists(spark, sf, k=SHORTLIST):
    """Vector neighbours under surrogate keys: a query's vector is that of the same number, an id is a document's."""
    asked = questions(spark, sf).select("qid").join(vectors(spark, sf).select(F.col("id").alias("qid"), F.col("v").alias("q")), "qid")
    return R.nearest(vectors(spark, sf), asked, k, "cosine")


def both_lists(spark, sf):
    sparse = R.min_max(sparse_top(spark, sf, SHORTLIST)).select("qid", "id", F.lit("sparse").alias("source"), "rank", "score", "normalized")
    dense = dense_lists(spark, sf).select("qid", "id", F.lit("dense").alias("source"), "rank", "score", F.col("score").alias("normalized"))
    return kept(sparse.unionByName(dense), "lists")  # what fuses them reads them several times


def fusion(method):
    def query(spark, sf):
        lists = both_lists(spark, sf)
        fused = R.reciprocal_rank(lists) if method == "rrf" else R.weighted_sum(lists, WEIGHTS) if method == "weighted" else R.fuse(lists.where("source = 'sparse' or qid % 2 = 0"), "rrf")
        return R.ranked(fused, K).select("qid", "id", "rank", F.round("score", 6).alias("score"))

    return query


def rerank_f1(least=None):
    def query(spark, sf):
        short = sparse_top(spark, sf, SHORTLIST)
        return R.rerank(short, documents(spark, sf), questions(spark, sf), K, least).select("qid", "id", "rank", F.round("score", 6).alias("score"))

    return query


def hybrid(spark, sf):
    """Both lists, fused, the shortlist reranked over the documents it names."""
    short = R.ranked(R.fuse(both_lists(spark, sf), "rrf"), SHORTLIST)
    return R.rerank(short, documents(spark, sf), questions(spark, sf), K).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def request_order(spark, sf):
    """Documents in the order asked for, unknown ids dropped: each conversation asks for three ids."""
    asked = table(spark, sf, "conversations").select(F.col("conv_id").alias("rid")).distinct()
    wanted = asked.select("rid", F.posexplode(F.array(F.col("rid") * 7 + 3, F.col("rid"), F.col("rid") * 1000)).alias("pos", "id"))
    return wanted.join(documents(spark, sf).select("id", F.length("text").cast("long").alias("chars")), "id").select("rid", F.col("pos").cast("long").alias("pos"), "id", "chars")


# ---- SQL ----------------------------------------------------------------------------------------

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOPWORDS)) + "]"
TOKENS_SQL = (
    "flatten(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-._][a-z0-9]+)*'), lambda x: NOT list_contains(" + STOP_SQL + ", x)), "
    "lambda x: list_concat([x], CASE WHEN regexp_matches(x, '[-._]') THEN list_filter(regexp_extract_all(x, '[a-z0-9]+'), lambda p: NOT list_contains(" + STOP_SQL + ", p) AND length(p) > 1) ELSE [] END)))"
)


def bm25_sql(group: str = "''") -> str:
    """CTEs up to ``hits`` (qid, grp, id, score)."""
    return f"""
toks AS MATERIALIZED (SELECT doc_id AS id, {group} AS grp, {TOKENS_SQL.format("coalesce(text, '')")} AS t FROM documents),
asked AS (SELECT qid, term, count(*)::DOUBLE AS times FROM (SELECT item_id AS qid, unnest({TOKENS_SQL.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
post AS MATERIALIZED (SELECT grp, id, term, count(*)::DOUBLE AS f FROM (SELECT grp, id, unnest(t) AS term FROM toks) GROUP BY ALL),
stats AS (SELECT grp, count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks GROUP BY grp),
dfs AS (SELECT grp, term, count(*)::DOUBLE AS df FROM post GROUP BY ALL),
raws AS (SELECT grp, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN stats USING (grp)),
idfs AS (SELECT grp, term, avgdl, CASE WHEN raw < 0 THEN {X.EPSILON} * avg(raw) OVER (PARTITION BY grp) ELSE raw END AS idf FROM raws),
hits AS MATERIALIZED (
  SELECT qid, p.grp, p.id, sum(times * idf * f * {R.K1 + 1} / (f + {R.K1} * (1 - {R.B} + {R.B} * len(t) / avgdl))) AS score
  FROM post p JOIN asked USING (term) JOIN idfs i ON i.grp = p.grp AND i.term = p.term JOIN toks ON toks.id = p.id AND toks.grp = p.grp GROUP BY ALL HAVING score > 0
)"""


def top_sql(source: str, k: int, by: str = "qid", tie: str = "id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, {tie}) AS rank FROM {source} QUALIFY rank <= {k}"


def knn_sql(kind: str, where: str = "true") -> str:
    score = "greatest(0.0, least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])))" if kind == "cosine" else "1 / (1 + list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
    return f"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, {score} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where}) SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('s', 10)})"


def lists_sql() -> str:
    return f"""{bm25_sql()},
sparse AS MATERIALIZED (SELECT qid, id, rank, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS normalized FROM ({top_sql('hits', SHORTLIST)}) WINDOW w AS (PARTITION BY qid)),
near AS (SELECT item_id AS qid, v.vec_id AS id, greatest(0.0, least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v),
dense AS MATERIALIZED (SELECT qid, id, rank, score, score AS normalized FROM ({top_sql('near', SHORTLIST)})),
lists AS (SELECT *, 'sparse' AS source FROM sparse UNION ALL BY NAME SELECT *, 'dense' AS source FROM dense)"""


RRF = "sum(1 / (60.0::DOUBLE + rank))"
SET_SQL = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
F1_SQL = f"""
f1 AS (SELECT qid, s.id, s.rank AS before, {SET_SQL.format("coalesce(b.text, '')")} AS a, {SET_SQL.format("coalesce(d.text, '')")} AS c FROM short s JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = s.id),
f1s AS (SELECT qid, id, before, CASE WHEN len(list_intersect(a, c)) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) ELSE 0 END AS score FROM f1)"""



def embed_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs up to ``name`` (key, v): hashed vectors of length one."""
    moved = "(CASE WHEN (seed >> 32) % 2 = 0 THEN 1 ELSE -1 END) * (CAST('0x' || substr(h, 17 + 6 * i, 6) AS BIGINT) / 8388608.0::DOUBLE - 1.0::DOUBLE)"
    return f"""
{name}_t AS (SELECT {key}, unnest(CASE WHEN len(t) > 0 THEN t ELSE [''] END) AS token FROM (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') AS t FROM {source})),
{name}_n AS (SELECT {key}, token, count(*) AS n FROM {name}_t GROUP BY ALL),
{name}_h AS MATERIALIZED (SELECT token, h, CAST('0x' || left(h, 16) AS UBIGINT) AS seed FROM (SELECT token, sha256(token) AS h FROM (SELECT DISTINCT token FROM {name}_n))),
{name}_m AS MATERIALIZED (SELECT token, CAST((seed % {TEXT_DIMENSION}::UBIGINT + i::UBIGINT) % {TEXT_DIMENSION}::UBIGINT AS BIGINT) AS place, {moved} AS amount FROM {name}_h, (SELECT unnest(range({V.BUMPS})) AS i)),
{name}_s AS (SELECT {key}, place, sum(n * amount) AS x FROM {name}_n JOIN {name}_m USING (token) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, place, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_s)"""


QUERIES = {
    "q_tokens_top": tokens_top, "q_doc_ids": doc_ids, "q_index_stats": index_stats, "q_bm25_topk": bm25_topk, "q_bm25_filtered": bm25_filtered, "q_bm25_within_group": bm25_within_group,
    "q_knn_cosine": knn("cosine"), "q_knn_l2": knn("l2"), "q_knn_where_label": knn("cosine", "label = 3"), "q_rrf": fusion("rrf"), "q_weighted_sum": fusion("weighted"), "q_fuse_single": fusion("fuse"),
    "q_rerank_f1": rerank_f1(), "q_rerank_threshold": rerank_f1(0.2), "q_hybrid": hybrid, "q_request_order_get": request_order, "q_index_delta": index_delta, "q_embed_texts": embedded_texts, "q_dense_text": dense_text,
}

SQL = {
    "q_tokens_top": f"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS_SQL.format(chr(39).join(['coalesce(text, ', '', ')']))}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "q_doc_ids": "SELECT doc_id, substr(sha1(source || '/' || doc_id), 1, 16) AS key, substr(sha1(source || '/' || doc_id), 1, 16) || '::00000' AS chunk_id, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS token_count FROM documents",
    "q_index_stats": f"WITH {bm25_sql()} SELECT count(*) AS documents, round(avg(len(t)), 6) AS avg_length, (SELECT count(DISTINCT term) FROM post) AS vocabulary, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM toks",
    "q_bm25_topk": f"WITH {bm25_sql()}, t AS ({top_sql('hits', K)}) SELECT qid, id, rank, round(score, 6) AS score, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 4) AS normalized FROM t WINDOW w AS (PARTITION BY qid)",
    "q_bm25_filtered": f"WITH {bm25_sql()}, h AS (SELECT hits.* FROM hits JOIN documents ON doc_id = id WHERE lang = 'en') SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('h', K)})",
    "q_bm25_within_group": f"WITH {bm25_sql('source')} SELECT qid, grp AS source, id, rank, round(score, 6) AS score FROM ({top_sql('hits', K, 'qid, grp')})",
    "q_knn_cosine": knn_sql("cosine"), "q_knn_l2": knn_sql("l2"), "q_knn_where_label": knn_sql("cosine", "v.label = 3"),
    "q_rrf": f"WITH {lists_sql()}, f AS (SELECT qid, id, {RRF} AS score FROM lists GROUP BY ALL) SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('f', K)})",
    "q_weighted_sum": f"WITH {lists_sql()}, f AS (SELECT qid, id, sum(0.5::DOUBLE * normalized) AS score FROM lists GROUP BY ALL) SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('f', K)})",
    "q_fuse_single": f"WITH {lists_sql()}, l AS (SELECT * FROM lists WHERE source = 'sparse' OR qid % 2 = 0), n AS (SELECT qid, count(DISTINCT source) AS n FROM l GROUP BY qid), f AS (SELECT qid, id, CASE WHEN max(n) = 1 THEN max(score) ELSE {RRF} END AS score FROM l JOIN n USING (qid) GROUP BY qid, id) SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('f', K)})",
    "q_rerank_f1": f"WITH {bm25_sql()}, short AS ({top_sql('hits', SHORTLIST)}), {F1_SQL} SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('f1s', K, 'qid', 'before')})",
    "q_rerank_threshold": f"WITH {bm25_sql()}, short AS ({top_sql('hits', SHORTLIST)}), {F1_SQL} SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('f1s', K, 'qid', 'before')}) WHERE score >= 0.2 OR rank = 1",
    "q_hybrid": f"WITH {lists_sql()}, f AS (SELECT qid, id, {RRF} AS rrf, max(score) AS own, count(DISTINCT source) AS k FROM lists GROUP BY ALL), n AS (SELECT qid, count(DISTINCT source) AS n FROM lists GROUP BY qid), fs AS (SELECT qid, id, CASE WHEN n = 1 THEN own ELSE rrf END AS score FROM f JOIN n USING (qid)), short AS ({top_sql('fs', SHORTLIST)}), {F1_SQL} SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('f1s', K, 'qid', 'before')})",
    "q_index_delta": f"WITH {bm25_sql()} SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('hits', K)})",
    "q_embed_texts": f"WITH {embed_sql('e', 'documents', 'doc_id', 'text')} SELECT doc_id, place, round(x, 6) + 0.0::DOUBLE AS value FROM e WHERE round(x, 6) <> 0",
    "q_dense_text": f"WITH {embed_sql('d', 'documents', 'doc_id', 'text')}, {embed_sql('a', 'benchmark', 'item_id', 'text')}, s AS (SELECT item_id AS qid, doc_id AS id, greatest(0.0, least(1.0, sum(d.x * a.x))) AS score FROM a JOIN d USING (place) GROUP BY ALL), every AS (SELECT item_id AS qid, doc_id AS id, coalesce(score, 0.0::DOUBLE) AS score FROM benchmark CROSS JOIN documents LEFT JOIN s ON qid = item_id AND id = doc_id) SELECT qid, id, rank, round(score, 6) AS score FROM ({top_sql('every', K)})",
    "q_request_order_get": "SELECT rid, pos, doc_id AS id, length(text)::BIGINT AS chars FROM (SELECT rid, unnest([0, 1, 2])::BIGINT AS pos, unnest([rid * 7 + 3, rid, rid * 1000]) AS id FROM (SELECT DISTINCT conv_id AS rid FROM conversations)) JOIN documents ON doc_id = id",
}
