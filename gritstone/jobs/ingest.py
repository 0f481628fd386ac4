"""Registered ingestion, synthesis and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.jobs import answer as A
from gritstone.jobs import retrieve as R
from gritstone.operators import chunking as C
from gritstone.operators import ingest as I
from gritstone.sources import files as X
from gritstone.sources import markup, table

WINDOW, CARRY, SLIVER = 120, 30, 20


def source_routes(spark, sf):
    """Pages by parser; some of them as files of other kinds."""
    kinds = F.element_at(F.array(*(F.lit(x) for x in (".PDF", ".md", ".txt", ".htm", ".zip", ""))), F.greatest(F.lit(1), F.col("page_id") % 7).cast("int"))
    uri = F.when(F.col("page_id") % 7 > 0, F.concat(F.lit("docs/v1.2/page"), F.col("page_id").cast("string"), kinds)).otherwise(F.col("url"))
    return table(spark, sf, "pages").groupBy(I.route(uri).alias("parser")).agg(F.count("*").alias("n"))


def sources(spark, sf):
    """Pages as files of several kinds; of eleven, one is no UTF-8, and of thirteen, one has no content."""
    kinds = F.element_at(F.array(*(F.lit(x) for x in (".PDF", ".md", ".txt", ".HTM", ".zip", ".html", ".xhtml"))), (F.pmod("page_id", F.lit(7)) + 1).cast("int"))
    path = F.concat(F.lit("docs/v1.2/page"), F.col("page_id").cast("string"), kinds)
    html = F.col("html").cast("binary")
    content = F.when(F.col("page_id") % 13 == 5, None).when(F.col("page_id") % 11 == 3, F.concat(html, F.unhex(F.lit("FF")))).otherwise(html)
    return table(spark, sf, "pages").select(path.alias("path"), content.alias("content"))


def parse_failures(spark, sf):
    """Every source with what became of it."""
    documents, _, failures = X.parse_sources(sources(spark, sf))
    return documents.select("path", "parser", F.lit("parsed").alias("state")).unionByName(failures.select("path", "parser", F.regexp_replace(F.regexp_replace("error", "^[A-Za-z]*: ", ""), "^.utf-8.*", "no UTF-8").alias("state")))


def inline_prose(spark, sf):
    """Lines given inline markup of every kind, and freed of it."""
    n = F.size(F.split("text", " "))
    word = lambda k: F.element_at(F.split(F.regexp_replace("text", r"[\[\]*_`()!]", ""), " "), k)
    marked = F.concat(F.lit("**"), word(1), F.lit("** _"), word(2), F.lit("_ ***"), word(3), F.lit("*** ["), word(1), F.lit("](http://x/"), word(2), F.lit(") `"), word(3), F.lit("` ![alt](pic.png) __"), word(2), F.lit("__"))
    return lines(spark, sf).where(n >= 3).select("doc", "ord", F.md5(markup.inline_stripped(marked).cast("binary")).alias("plain_md5"))


def manifest_restore(spark, sf):
    """English documents are the manifest, those of even id the files, every tenth of them altered."""
    docs = R.documents(spark, sf).where("text is not null")
    manifest = docs.where("lang = 'en'").select(F.col("id").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    files = docs.where("id % 2 = 0").select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return I.restore(manifest, files)


def lines(spark, sf):
    return R.documents(spark, sf).select(F.col("id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text")).where("trim(text) <> ''").withColumn("ord", F.col("ord").cast("long"))


def section_paths(spark, sf):
    """Lines as blocks: one of up to three words is a heading whose level is its number of words."""
    n = F.size(F.split(F.trim("text"), " +"))
    found = I.section_paths(lines(spark, sf).withColumn("level", F.when(n <= 3, n)))
    return found.select("doc", "ord", F.coalesce("level", F.lit(0)).alias("level"), F.array_join("path", " > ").alias("path"))


def section_blocks(spark, sf):
    """Lines as blocks with sections, pages of six lines and offsets; of seven lines one is code."""
    n = F.size(F.split(F.trim("text"), " +"))
    found = I.section_paths(lines(spark, sf).withColumn("level", F.when(n <= 3, n)))
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("ord") % 7 == 3, "code").otherwise("paragraph")
    offset = F.sum(F.length("text") + 1).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return found.select("doc", "ord", "text", kind.alias("kind"), F.when(F.col("doc") % 9 > 0, F.floor(F.col("ord") / 6) + 1).alias("page"), F.col("path").alias("section_path"), F.coalesce(offset, F.lit(0)).alias("char_start"))


def chunks_by_section(spark, sf):
    """Small windows, packed by either strategy."""
    out = None
    for strategy in (C.TOKEN_WINDOW, C.HEADING_AWARE):
        found = C.chunk_blocks(section_blocks(spark, sf), WINDOW, CARRY, SLIVER, strategy).select(F.lit(strategy).alias("strategy"), "*")
        out = found if out is None else out.unionByName(found)
    return out.select("strategy", "doc", "chunk_index", "token_count", "units", "page_start", "page_end", F.array_join("section_path", " > ").alias("section"), "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def fragments(spark, sf):
    return lines(spark, sf).groupBy("doc").agg(F.count("*").alias("n"), F.sum(I.is_fragment(F.col("text")).cast("long")).alias("fragments"), F.count(I.heading_level(F.col("text"))).alias("headings"))


def merged_blocks(spark, sf):
    """Blocks of one size and page side follow on into one, unless the one before ends a sentence."""
    w = Window.partitionBy("doc").orderBy("ord")
    b = A.blocks(spark, sf).withColumn("ord", F.col("page") * A.PAGE_LINES + F.col("y"))
    same = (F.lag("size").over(w) == F.col("size")) & (F.lag("x0").over(w) == F.col("x0")) & ~F.lag("text").over(w).rlike("[.!?]$")
    return I.merge_runs(b.withColumn("same", F.coalesce(same, F.lit(False))), F.col("same"), "doc", "ord").groupBy("doc").agg(F.count("*").alias("blocks"), F.max("run").alias("merged"))


def query_synthesis(spark, sf):
    text = F.coalesce("text", F.lit(""))
    terms = I.salient_terms(text)
    found = R.documents(spark, sf).select(F.col("id").alias("doc_id"), F.md5(I.verbatim_query(text, F.col("id"), "bench-1").cast("binary")).alias("verbatim_md5"), F.when(F.size(terms) >= 5, F.array_join(F.slice(terms, 1, 7), " ")).alias("terms"))
    return found


def named_documents(spark, sf):
    """Conversations as questions, each document named by the first three words of its text."""
    asked = table(spark, sf, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    names = R.documents(spark, sf).select(F.col("id").alias("doc"), F.substring_index(F.coalesce("text", F.lit("")), " ", 3).alias("name"))
    return I.named_documents(asked, names)


def verdicts(spark, sf):
    """Event properties as judge replies: text around a JSON object."""
    reply = F.concat(F.lit("verdict: "), "props", F.lit(" end"))
    return table(spark, sf, "events").select("event_id", I.parse_verdict(reply, "k bigint")["k"].alias("k"))


def feasibility(spark, sf):
    n = table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    return I.feasibility(n, 9.0, 14251.0, 30.0, 60000.0, 1000.0, 500000.0)


def normalized_lines(spark, sf):
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\u00a0]+", " "), "(?m) +$", ""), "\n{3,}", "\n\n")
    return R.documents(spark, sf).select(F.col("id").alias("doc_id"), F.md5(F.trim(plain).cast("binary")).alias("plain_md5"), T.count_tokens(plain).alias("tokens"))


QUERIES = {
    "q_source_routes": source_routes, "q_manifest_restore": manifest_restore, "q_section_paths": section_paths, "q_fragments": fragments, "q_merged_blocks": merged_blocks, "q_query_synthesis": query_synthesis,
    "q_named_documents": named_documents, "q_verdict_json": verdicts, "q_feasibility": feasibility, "q_normalized_lines": normalized_lines, "q_chunks_by_section": chunks_by_section, "q_parse_failures": parse_failures, "q_inline_prose": inline_prose,
}

_LINES = "lines AS MATERIALIZED (SELECT doc, pos AS ord, text FROM (SELECT doc_id AS doc, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE trim(text) <> '')"
_ROUTE = "CASE WHEN regexp_matches(url, '^https?://') THEN 'html' WHEN lower(regexp_extract(url, '(\\.[^./]+)$', 1)) = '.pdf' THEN 'pdf' WHEN lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.md', '.markdown', '.txt') THEN 'markdown' WHEN lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.html', '.htm') THEN 'html' ELSE 'unsupported' END"
_NUMBER = r"regexp_extract(text, '^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+[A-Z]', 1)"
_HEAD = rf"length(text) <= 120 AND NOT regexp_matches(text, '[.,;]$') AND (({_NUMBER} <> '' AND TRY_CAST(string_split({_NUMBER}, '.')[1] AS INT) <= 30) OR regexp_matches(text, '^[IVX]{{1,4}}\.\s+[A-Z][^,]{{0,70}}$') OR regexp_matches(text, '^[A-Z]\.\s+[A-Z][^,]{{0,70}}$') OR regexp_matches(text, '^[A-Z][A-Z ]{{3,60}}$'))"
_LEVELS = ", ".join(f"max(CASE WHEN level <= {k} THEN ord END) OVER w AS a{k}, last_value(CASE WHEN level = {k} THEN ord END IGNORE NULLS) OVER w AS o{k}, last_value(CASE WHEN level = {k} THEN text END IGNORE NULLS) OVER w AS h{k}" for k in range(1, 5))
_PATH = ", ".join(f"CASE WHEN o{k} = a{k} AND {k} < coalesce(level, 5) THEN h{k} END" for k in range(1, 5))
_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_SECTIONS = f"""{_LINES}, l AS (SELECT *, CASE WHEN len(regexp_split_to_array(trim(text), ' +')) <= 3 THEN len(regexp_split_to_array(trim(text), ' +'))::INT END AS level FROM lines), s AS (SELECT *, {_LEVELS} FROM l WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
blocks AS MATERIALIZED (SELECT doc, ord, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, level, ord % 7 = 3 AS code, CASE WHEN doc % 9 > 0 THEN ord // 6 + 1 END AS page, list_filter([{_PATH}], lambda x: x IS NOT NULL) AS path,
  coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s),
pieces AS (SELECT doc, ord, page, path, off, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT *, CASE WHEN code THEN [text] ELSE {A._SENT.format("text")} END AS p FROM blocks WHERE level IS NULL AND text <> '')),
spots AS (SELECT *, off + coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc, ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pieces),
cut AS (SELECT *, CASE WHEN length(piece) // 4 > {WINDOW} THEN list_filter(list_transform(range(0, length(piece), {4 * WINDOW}), lambda i: substr(piece, i + 1, {4 * WINDOW})), lambda p: regexp_matches(p, '\\S')) ELSE [piece] END AS p FROM spots),
slices AS (SELECT doc, ord, k, page, path, start, unnest(p) AS unit, generate_subscripts(p, 1) AS j FROM cut),
units AS MATERIALIZED (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord, k, j) - 1 AS pos, unit, greatest(1, length(unit) // 4) AS tokens, page, path, start, start + length(unit) AS fin FROM slices),
sums AS MATERIALIZED (SELECT doc, list_concat([0::BIGINT], list(total ORDER BY pos)) AS s, list(coalesce(path[1], '') ORDER BY pos) AS top, count(*) AS n FROM (SELECT *, sum(tokens) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS total FROM units) GROUP BY doc),
w AS (
  SELECT doc, strategy, 0 AS k, 0::BIGINT AS a, (SELECT list_min(list_filter(range(1, n + 1), lambda e: e = n OR s[e + 2] > {WINDOW} OR (top[e + 1] <> top[1] AND (strategy = 'heading_aware' OR s[e + 1] >= {WINDOW / 2}))))) AS b, n, s, top FROM sums, (VALUES ('token_window'), ('heading_aware')) v(strategy)
  UNION ALL
  SELECT doc, strategy, k + 1, na, list_min(list_filter(range(na + 1, n + 1), lambda e: e = n OR s[e + 2] - s[na + 1] > {WINDOW} OR (top[e + 1] <> top[na + 1] AND (strategy = 'heading_aware' OR s[e + 1] - s[na + 1] >= {WINDOW / 2})))), n, s, top
  FROM (SELECT *, greatest(a + 1, least(len(list_filter(s, lambda x: x <= s[b + 1] - {CARRY})) - 1, b)) AS na FROM w WHERE b < n)
),
texts AS (SELECT w.doc, strategy, w.k, count(*) AS units, trim(string_agg(unit, ' ' ORDER BY pos)) AS text, min(page) AS page_start, max(page) AS page_end, coalesce(first(path ORDER BY pos) FILTER (len(path) > 0), []) AS path, min(start) AS char_start, max(fin) AS char_end FROM w JOIN units u ON u.doc = w.doc AND pos >= a AND pos < b GROUP BY ALL)"""

_BARE = "string_split(regexp_replace(text, '[][*_`()!]', '', 'g'), ' ')"

SQL = {
    "q_parse_failures": """SELECT 'docs/v1.2/page' || page_id || ['.PDF', '.md', '.txt', '.HTM', '.zip', '.html', '.xhtml'][page_id % 7 + 1] AS path, ['pdf', 'markdown', 'markdown', 'html', 'unsupported', 'html', 'html'][page_id % 7 + 1] AS parser,
  CASE WHEN page_id % 7 IN (0, 4) THEN 'no parser for ' || ['pdf', '', '', '', 'unsupported'][page_id % 7 + 1] || ' sources' WHEN page_id % 13 = 5 OR html IS NULL THEN 'no content' WHEN page_id % 11 = 3 THEN 'no UTF-8' ELSE 'parsed' END AS state FROM pages""",
    "q_inline_prose": f"WITH {_LINES}, w AS (SELECT doc, ord, {_BARE} AS w FROM lines WHERE len(string_split(text, ' ')) >= 3) SELECT doc, ord, md5(w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[1] || ' ' || w[3] || '  ' || w[2]) AS plain_md5 FROM w",
    "q_chunks_by_section": f"WITH RECURSIVE {_SECTIONS} SELECT strategy, doc, row_number() OVER (PARTITION BY strategy, doc ORDER BY k) - 1 AS chunk_index, greatest(1, length(text) // 4) AS token_count, units, page_start, page_end, array_to_string(path, ' > ') AS section, char_start, char_end, md5(text) AS text_md5 FROM texts WHERE k = 0 OR length(text) // 4 >= {SLIVER}",
    "q_source_routes": f"SELECT {_ROUTE} AS parser, count(*) AS n FROM (SELECT CASE WHEN page_id % 7 > 0 THEN 'docs/v1.2/page' || page_id || ['.PDF', '.md', '.txt', '.htm', '.zip', ''][page_id % 7] ELSE url END AS url FROM pages) GROUP BY 1",
    "q_manifest_restore": "SELECT m.doc_id AS key, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN f.doc_id % 10 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM documents m LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) f USING (doc_id) WHERE lang = 'en' AND m.text IS NOT NULL",
    "q_section_paths": f"WITH {_LINES}, l AS (SELECT *, CASE WHEN len(regexp_split_to_array(trim(text), ' +')) <= 3 THEN len(regexp_split_to_array(trim(text), ' +'))::INT END AS level FROM lines), s AS (SELECT *, {_LEVELS} FROM l WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc, ord, coalesce(level, 0) AS level, coalesce(array_to_string(list_filter([{_PATH}], lambda x: x IS NOT NULL), ' > '), '') AS path FROM s",
    "q_fragments": f"WITH {_LINES} SELECT doc, count(*) AS n, count(*) FILTER (length(trim(text)) < 20 AND NOT regexp_matches(text, '[A-Za-z]{{3,}}')) AS fragments, count(*) FILTER ({_HEAD}) AS headings FROM lines GROUP BY doc",
    "q_merged_blocks": f"WITH {A._BLOCKS}, o AS (SELECT *, page * {A.PAGE_LINES} + y AS ord FROM blocks), s AS (SELECT *, coalesce(lag(size) OVER w = size AND lag(x0) OVER w = x0 AND NOT regexp_matches(lag(text) OVER w, '[.!?]$'), false) AS same FROM o WINDOW w AS (PARTITION BY doc ORDER BY ord)) SELECT doc, count(*) AS blocks, sum((NOT same)::INT)::BIGINT AS merged FROM s GROUP BY doc",
    "q_query_synthesis": f"""WITH s AS (SELECT doc_id, list_filter({A._SENT.format("coalesce(text, '')")}, lambda x: length(x) BETWEEN 40 AND 300) AS fit, list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}'), lambda w: NOT list_contains({R.STOP_SQL}, w))), lambda w: struct_pack(n := -length(w), w := w))) AS t FROM documents)
SELECT doc_id, md5(fit[1 + CAST('0x' || left(md5('bench-1|' || doc_id), 7) AS BIGINT) % nullif(len(fit), 0)]) AS verbatim_md5, CASE WHEN len(t) >= 5 THEN array_to_string(list_transform(t[1:7], lambda x: x.w), ' ') END AS terms FROM s""",
    "q_named_documents": f"WITH q AS (SELECT conv_id || '-' || turn AS qid, ' ' || {_PLAIN.format(chr(39).join(['coalesce(text, ', '', ')']))} || ' ' AS q FROM conversations), n AS (SELECT doc_id AS doc, {_PLAIN.format(chr(39).join(['array_to_string(string_split(coalesce(text, ', '', '), ', ' ', ')[1:3], ', ' ', ')']))} AS name FROM documents) SELECT DISTINCT qid, doc FROM q JOIN n ON name <> '' AND contains(q, ' ' || name || ' ')",
    "q_verdict_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "q_feasibility": "WITH n AS (SELECT role, count(*) AS n FROM conversations GROUP BY role), m AS (SELECT role, n, [n * 9 / 30.0, round_even(n * 14251.0, 0) / 60000, n * 9 / 1000.0 * 1440, round_even(n * 14251.0, 0) / 500000 * 1440]::DOUBLE[] AS m FROM n) SELECT role, n, round(list_max(m), 6) AS minutes, ['requests_per_minute', 'tokens_per_minute', 'requests_per_day', 'tokens_per_day'][list_position(m, list_max(m))] AS \"limit\" FROM m",
    "q_normalized_lines": "WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\u00a0]+', ' ', 'g'), '(?m) +$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS p FROM documents) SELECT doc_id, md5(trim(p)) AS plain_md5, greatest(1, length(p) // 4)::BIGINT AS tokens FROM p",
}
