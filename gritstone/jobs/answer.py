"""Registered chunking, answering, checking and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.jobs import retrieve as R
from gritstone.operators import answers as A
from gritstone.operators import chunking as C
from gritstone.operators import layout as L
from gritstone.operators import retrieval as O
from gritstone.sources import markup, table
from gritstone.sources.scratch import kept

PAGE_LINES, WIDTH = 6, 600.0


def units(spark, sf):
    return R.documents(spark, sf).select(F.col("id").alias("doc_id"), F.posexplode(C.units(F.coalesce("text", F.lit("")))).alias("pos", "unit")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("unit").cast("binary")).alias("unit_md5"), T.count_tokens("unit").alias("tokens"))


def chunks(spark, sf):
    return C.chunk(R.documents(spark, sf)).select(F.col("id").alias("doc_id"), "chunk_index", "token_count", "first_unit", "end_unit", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def chunk_report(spark, sf):
    return C.report(C.chunk(R.documents(spark, sf)))


def chunk_overlap(spark, sf):
    return C.overlap_report(C.chunk(R.documents(spark, sf)))


def concatenated(spark, sf):
    """Chunks put together again."""
    return C.concatenate(C.chunk(R.documents(spark, sf))).select(F.col("id").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("chars"))


def top_texts(spark, sf):
    hits = kept(R.sparse_top(spark, sf, R.K).select("qid", "id", "rank"), "hits")
    return hits.join(O.texts_of(hits, R.documents(spark, sf).select("id", "text")), "id")


def context_pack(spark, sf):
    return A.pack_context(top_texts(spark, sf))


def answered(spark, sf):
    texts = top_texts(spark, sf)
    context = A.pack_context(texts).join(texts.select("qid", "id", "text"), ["qid", "id"])
    return context, A.extract_answers(context.select("qid", "marker", "text"), R.questions(spark, sf))


def extractive_answer(spark, sf):
    return answered(spark, sf)[1]


def checked_claims(spark, sf):
    """Claims of the answers held against the passages they cite, with each answer's status."""
    context, answers = answered(spark, sf)
    cited = A.claims(answers).join(context.select("qid", "marker", F.col("text").alias("evidence")), ["qid", "marker"], "left")
    verdicts = A.check_claims(cited).groupBy("qid").agg(F.count("*").alias("claims"), F.sum(F.col("supported").cast("long")).alias("supported"))
    ratio = F.coalesce(F.col("supported") / F.col("claims"), F.lit(0.0))
    status = F.when(F.col("answer").isNull(), "refused_by_model").when(ratio < 0.5, "refused_low_support").otherwise("answered")
    return answers.join(verdicts, "qid", "left").select("qid", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("supported", F.lit(0)).alias("supported"), status.alias("status"))


def supported_ratio(spark, sf):
    """Each assistant turn held against all that its conversation's user said."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("evidence"))
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("claim")).join(asked, "conv_id", "left")
    return A.check_claims(said).select("conv_id", "turn", "coverage", "numbers_ok", "supported")


def typography(spark, sf):
    plain = T.normalize_markers(F.coalesce("text", F.lit("")))
    return R.documents(spark, sf).select(F.col("id").alias("doc_id"), F.md5(plain.cast("binary")).alias("plain_md5"), F.size(T.markers(plain)).cast("long").alias("markers"))


def blocks(spark, sf):
    """Lines of documents as page blocks: PAGE_LINES to a page, long lines across it, short ones in two columns."""
    lines = R.documents(spark, sf).select(F.col("id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).where("trim(text) <> ''")
    pos, n = F.col("pos"), F.length("text")
    x0 = F.when((n <= 200) & (pos % 2 == 1), 320.0).otherwise(20.0)
    x1 = F.when(n > 200, 580.0).when(pos % 2 == 1, 580.0).otherwise(280.0)
    return lines.select("doc", F.floor(pos / PAGE_LINES).alias("page"), (pos % PAGE_LINES).cast("long").alias("y"), x0.alias("x0"), x1.alias("x1"), (8 + n % 3).cast("long").alias("size"), "text")


def furniture(spark, sf):
    return L.furniture(blocks(spark, sf))


def reading_order(spark, sf):
    return L.reading_order(blocks(spark, sf), WIDTH).select("doc", "page", "y", "place")


def body_size(spark, sf):
    return L.body_size(blocks(spark, sf))


def block_offsets(spark, sf):
    return L.offsets(blocks(spark, sf)).select("doc", "page", "y", "char_start")


def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.html_title(F.col("html"), F.col("url")).alias("title"))


def html_blocks(spark, sf):
    return markup.html_blocks(table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")).withColumnRenamed("id", "page_id")


def markdown_blocks(spark, sf):
    return markup.markdown_blocks(R.documents(spark, sf).select("id", "text")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "q_units": units, "q_chunks": chunks, "q_chunk_report": chunk_report, "q_chunk_overlap": chunk_overlap, "q_concatenated": concatenated, "q_context_pack": context_pack, "q_extractive_answer": extractive_answer, "q_checked_claims": checked_claims, "q_supported_ratio": supported_ratio,
    "q_typography": typography, "q_furniture": furniture, "q_reading_order": reading_order, "q_body_size": body_size, "q_block_offsets": block_offsets, "q_html_title": html_title, "q_html_blocks": html_blocks, "q_markdown_blocks": markdown_blocks,
}

_SENT = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])["'')\]]?\s+([A-Z(\["''])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda s: trim(s)), lambda s: s <> '')"""
_TOK = "greatest(1, length({0}) // 4)"
_UNITS = f"""
sent AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, {_SENT.format("coalesce(text, '')")} AS s FROM documents)),
cut AS (SELECT doc_id, k, CASE WHEN {_TOK.format('s')} > {C.SIZE} THEN list_filter(list_transform(range(0, length(s), {4 * C.SIZE}), lambda i: substr(s, i + 1, {4 * C.SIZE})), lambda p: trim(p) <> '') ELSE [s] END AS p FROM sent),
each AS (SELECT doc_id, k, unnest(p) AS unit, generate_subscripts(p, 1) AS j FROM cut),
units AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS pos, unit, {_TOK.format('unit')} AS tokens FROM each)"""
_CHUNKS = f"""{_UNITS},
sums AS MATERIALIZED (SELECT doc_id, list_concat([0::BIGINT], list(total ORDER BY pos)) AS s, count(*) AS n FROM (SELECT doc_id, pos, sum(tokens) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS total FROM units) GROUP BY doc_id),
w AS (
  SELECT doc_id, 0 AS k, 0::BIGINT AS a, greatest(1, len(list_filter(s, lambda x: x <= {C.SIZE})) - 1) AS b, n, s FROM sums
  UNION ALL
  SELECT doc_id, k + 1, na, greatest(na + 1, len(list_filter(s, lambda x: x <= s[na + 1] + {C.SIZE})) - 1), n, s
  FROM (SELECT *, greatest(a + 1, least(len(list_filter(s, lambda x: x <= s[b + 1] - {C.OVERLAP})) - 1, b)) AS na FROM w WHERE b < n)
), texts AS (SELECT w.doc_id, k, a, b, string_agg(unit, ' ' ORDER BY pos) AS text FROM w JOIN units u ON u.doc_id = w.doc_id AND pos >= a AND pos < b GROUP BY ALL),
kept AS (SELECT *, {_TOK.format('text')} AS tokens FROM texts WHERE k = 0 OR {_TOK.format('text')} >= {C.LEAST}),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, tokens AS token_count, a AS first_unit, b AS end_unit, md5(text) AS text_md5 FROM kept)"""
_CONTEXT = f"""{R.bm25_sql()}, top AS ({R.top_sql('hits', R.K)}), tt AS (SELECT qid, id, rank, text, greatest(1, length('[S00] (' || id || ')' || chr(10) || text) // 4) + 1 AS cost FROM top JOIN documents ON doc_id = id),
pack AS (
  SELECT qid, 0::BIGINT AS rank, NULL::BIGINT AS id, 0::BIGINT AS cost, 0::BIGINT AS total, 0::BIGINT AS marker, false AS used FROM (SELECT DISTINCT qid FROM tt)
  UNION ALL
  SELECT p.qid, t.rank, t.id, CASE WHEN p.total + t.cost <= {A.BUDGET} THEN t.cost ELSE {A.BUDGET} END, CASE WHEN p.total + t.cost <= {A.BUDGET} THEN p.total + t.cost WHEN p.marker = 0 THEN p.total + {A.BUDGET} ELSE p.total END,
    p.marker + (p.total + t.cost <= {A.BUDGET} OR p.marker = 0)::BIGINT, p.total + t.cost <= {A.BUDGET} OR p.marker = 0
  FROM pack p JOIN tt t ON t.qid = p.qid AND t.rank = p.rank + 1
), context AS (SELECT pack.qid, pack.id, pack.rank, marker, pack.cost, text FROM pack JOIN tt ON tt.qid = pack.qid AND tt.id = pack.id WHERE used)"""
_ANSWERS = f"""{_CONTEXT},
said AS (SELECT qid, marker, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT qid, marker, {_SENT.format('text')} AS s FROM context)),
sets AS (SELECT said.*, {R.SET_SQL.format('sentence')} AS have, {R.SET_SQL.format("coalesce(b.text, '')")} AS want FROM said JOIN benchmark b ON item_id = qid),
scored AS (SELECT *, round(len(list_intersect(want, have))::DOUBLE / len(want) + 0.15 * len(list_intersect(want, have))::DOUBLE / sqrt(len(have)::DOUBLE), 6) AS score FROM sets WHERE len(have) > 0),
short AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, marker, pos) AS n, max(score) OVER (PARTITION BY qid) AS best FROM scored QUALIFY n <= {A.SCAN} AND score >= greatest({A.LEAST}, best / 2)),
fresh AS (SELECT * FROM short QUALIFY row_number() OVER (PARTITION BY qid, substr(sentence, 1, 80) ORDER BY n) = 1),
lines AS (SELECT qid, marker, row_number() OVER (PARTITION BY qid ORDER BY n) AS k, CASE WHEN regexp_matches(sentence, '[.!?]$') THEN sentence ELSE sentence || '.' END || ' [S' || marker || ']' AS line FROM fresh QUALIFY k <= {A.KEEP}),
answers AS (SELECT item_id AS qid, string_agg(line, ' ' ORDER BY k) AS answer FROM benchmark LEFT JOIN lines ON qid = item_id GROUP BY item_id)"""
_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z''-]*'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.CLAIM_STOPWORDS) + "], w) AND length(w) > 2))"
_NUMS = r"list_distinct(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?'))"
_CHECK = f"""SELECT *, round(CASE WHEN len(cw) > 0 THEN len(list_intersect(cw, ew))::DOUBLE / len(cw) ELSE 0 END, 6) AS coverage, len(list_filter(cn, lambda x: NOT list_contains(en, x))) = 0 AS numbers_ok
FROM (SELECT *, {_CONTENT.format('claim')} AS cw, {_CONTENT.format("coalesce(evidence, '')")} AS ew, {_NUMS.format('claim')} AS cn, {_NUMS.format("coalesce(evidence, '')")} AS en FROM cited)"""
_BLOCKS = f"""blocks AS MATERIALIZED (SELECT doc, pos // {PAGE_LINES} AS page, pos % {PAGE_LINES} AS y, CASE WHEN length(text) <= 200 AND pos % 2 = 1 THEN 320.0 ELSE 20.0 END AS x0, CASE WHEN length(text) > 200 OR pos % 2 = 1 THEN 580.0 ELSE 280.0 END AS x1, 8 + length(text) % 3 AS size, text
FROM (SELECT doc_id AS doc, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE trim(text) <> '')"""
_TYPO = "translate(regexp_replace(coalesce(text, ''), '[" + T.ZERO_WIDTH + "]', '', 'g'), '" + T.BLANKS + T.HYPHENS + T.QUOTES.replace("'", "''") + "', '" + " " * len(T.BLANKS) + "-" * len(T.HYPHENS) + T.PLAIN_QUOTES.replace("'", "''") + "')"
_MARKS = r"regexp_replace(regexp_replace(" + _TYPO + r", '[【［〔﹝⁅]\s*[Ss]\s*(\d{1,3})[^】］〕﹞⁆]*[】］〕﹞⁆]', '[S\1]', 'g'), '\[[ \t]*[Ss][ \t]*(\d{1,3})[ \t]*\]', '[S\1]', 'g')"

SQL = {
    "q_units": f"WITH {_UNITS} SELECT doc_id, pos, md5(unit) AS unit_md5, tokens FROM units",
    "q_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks",
    "q_chunk_report": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, min(token_count) AS least_tokens, max(token_count) AS most_tokens, round(avg(token_count), 6) AS mean_tokens FROM chunks",
    "q_chunk_overlap": f"""WITH RECURSIVE {_CHUNKS}, t AS (SELECT doc_id, k, regexp_extract_all(text, '\\S+') AS b, lag(regexp_extract_all(text, '\\S+')) OVER (PARTITION BY doc_id ORDER BY k) AS a FROM kept),
o AS (SELECT coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda n: a[len(a) - n + 1:] = b[1:n])), 0) AS words FROM t WHERE a IS NOT NULL)
SELECT count(*) AS pairs, round(avg((words > 0)::INT::DOUBLE), 6) AS share, round(avg(words) FILTER (words > 0), 6) AS mean_words FROM o""",
    "q_concatenated": f"WITH RECURSIVE {_CHUNKS}, u AS (SELECT doc_id, string_agg(unit, ' ' ORDER BY pos) AS text FROM units JOIN (SELECT doc_id, max(b) AS b FROM kept GROUP BY doc_id) USING (doc_id) WHERE pos < b GROUP BY doc_id) SELECT doc_id, md5(text) AS text_md5, length(text)::BIGINT AS chars FROM u",
    "q_context_pack": f"WITH RECURSIVE {_CONTEXT} SELECT qid, id, rank, marker, cost FROM context",
    "q_extractive_answer": f"WITH RECURSIVE {_ANSWERS} SELECT * FROM answers",
    "q_supported_ratio": f"WITH asked AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS evidence FROM conversations WHERE role = 'user' GROUP BY conv_id), cited AS (SELECT conv_id, turn, coalesce(text, '') AS claim, evidence FROM conversations LEFT JOIN asked USING (conv_id) WHERE role = 'assistant') SELECT conv_id, turn, coverage, numbers_ok, numbers_ok AND coverage >= {A.COVERAGE} AS supported FROM ({_CHECK})",
    "q_typography": f"SELECT doc_id, md5({_MARKS}) AS plain_md5, len(list_distinct(regexp_extract_all({_MARKS}, '\\[S(\\d{{1,3}})\\]', 1)))::BIGINT AS markers FROM documents",
    "q_furniture": f"""WITH {_BLOCKS}, z AS (SELECT doc, page, y, CASE WHEN a = 1 THEN 'header' ELSE 'footer' END AS zone, regexp_replace(lower(trim(text)), '[0-9]', '#', 'g') AS key, regexp_matches(trim(text), '^(?:page )?[0-9]{{1,4}}$') AS number
FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y) AS a, row_number() OVER (PARTITION BY doc, page ORDER BY y DESC) AS z FROM blocks) WHERE length(text) <= {L.SHORT} AND (a = 1 OR z = 1)),
p AS (SELECT doc, count(DISTINCT page) AS n, count(DISTINCT page) FILTER (page % 2 = 0) AS even FROM blocks GROUP BY doc),
k AS (SELECT doc, zone, key FROM (SELECT doc, zone, key, count(DISTINCT page) AS c, count(DISTINCT page) FILTER (page % 2 = 0) AS e FROM z GROUP BY ALL) JOIN p USING (doc) WHERE c >= {L.REPEAT} * n OR (c >= 3 AND ((e = 0 AND c >= {L.REPEAT} * (n - even)) OR (e = c AND c >= {L.REPEAT} * even))))
SELECT doc, page, y, zone FROM z WHERE number OR (doc, zone, key) IN (SELECT doc, zone, key FROM k)""",
    "q_reading_order": f"""WITH {_BLOCKS}, s AS (SELECT *, CASE WHEN x1 - x0 >= 360 THEN 0 WHEN (x0 + x1) / 2 < 276 THEN 1 WHEN (x0 + x1) / 2 > 324 THEN 2 ELSE 0 END AS s0 FROM blocks),
t AS (SELECT *, CASE WHEN count(*) FILTER (s0 = 1) OVER p >= 2 AND count(*) FILTER (s0 = 2) OVER p >= 2 THEN s0 ELSE 0 END AS side FROM s WINDOW p AS (PARTITION BY doc, page)),
b AS (SELECT *, sum((side = 0)::INT) OVER (PARTITION BY doc, page ORDER BY y, x0 ROWS UNBOUNDED PRECEDING) AS band FROM t)
SELECT doc, page, y, row_number() OVER (PARTITION BY doc, page ORDER BY band, side, y, x0) AS place FROM b""",
    "q_body_size": f"WITH {_BLOCKS} SELECT doc, size FROM (SELECT doc, size, sum(length(text)) AS n FROM blocks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, size) = 1",
    "q_block_offsets": f"WITH {_BLOCKS} SELECT doc, page, y, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc ORDER BY page, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM blocks",
    "q_html_title": r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '\s*[|-]\s*[^|-]+$', '')), ''), regexp_extract(url, '([^/]+)/?$', 1)) AS title FROM pages",
}
