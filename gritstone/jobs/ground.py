"""Registered grounding queries: rendered contexts, citations, answer statuses, attribution to named documents."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.jobs import answer as N
from gritstone.jobs import retrieve as R
from gritstone.operators import answers as A
from gritstone.operators import attribution as D
from gritstone.operators import grounding as G
from gritstone.operators import retrieval as O
from gritstone.sources import markup, table
from gritstone.sources.scratch import kept

GATE, SUPPORT, CONTAINED = 0.03, 0.5, 0.6
REFUSAL = "The corpus does not hold an answer to this question."


def questions(spark, sf):
    """Benchmark items as they are; of five, one is spelt backwards (nothing is found) and one names a document."""
    asked, kind = R.questions(spark, sf), F.col("qid") % 5
    text = F.when(kind == 1, F.reverse("question")).when(kind == 4, F.concat("question", F.lit(" (Rëcord-"), F.col("qid").cast("string"), F.lit(")"))).otherwise(F.col("question"))
    return asked.withColumn("question", text)


def titles(spark, sf):
    return R.documents(spark, sf).select(F.col("id").alias("doc"), F.concat(F.lit("Record "), F.col("id").cast("string"), F.lit(": "), F.coalesce("source", F.lit(""))).alias("title"))


def hits(spark, sf, asked):
    """The first five passages of each question with locators and a rerank score."""
    docs = R.documents(spark, sf)
    where = T.locator(F.concat(F.lit("Record "), F.col("id").cast("string")), F.array_compact(F.array("source", "lang")), (F.col("id") % 9 + 1).cast("int"), (F.col("id") % 9 + 1 + F.col("id") % 3).cast("int"))
    top = kept(O.bm25_top(R.keyword_index(spark, sf), asked, R.K).select("qid", "id", "rank"), "top")
    found = top.join(O.texts_of(top, docs.select("id", "text", where.alias("locator"))), "id").join(asked, "qid")
    score = F.round(T.overlap_f1(T.token_set(F.coalesce("question", F.lit(""))), T.token_set(F.coalesce("text", F.lit("")))), 6)
    return found.select("qid", "id", "rank", "locator", "text", score.alias("rerank_score"))


def rendered_context(spark, sf):
    found = hits(spark, sf, questions(spark, sf))
    made = G.render_context(found)
    return made.select("qid", F.md5(F.col("context").cast("binary")).alias("context_md5"), "tokens", F.array_join(F.transform("used", lambda x: x.cast("string")), ",").alias("used"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))


def parsed_context(spark, sf):
    """A context within a prompt, parsed: its markers, headers and passages come back."""
    made = G.render_context(hits(spark, sf, questions(spark, sf)))
    prompt = F.concat(F.lit("Use the passages.\n\n"), "context", F.lit("\n\nQuestion: what [S1] says\nAnswer:"))
    blocks = made.select("qid", F.explode(G.parse_context(prompt)).alias("b"))
    return blocks.select("qid", "b.marker", "b.header", F.md5(F.col("b.body").cast("binary")).alias("body_md5"))


def replies(spark, sf, asked, used):
    """What a model gave to each question still open: a word of refusal, a claim out of the air, or an extract."""
    kind = F.col("qid") % 5
    extract = A.extract_answers(used.select("qid", "marker", F.coalesce("text", F.lit("")).alias("text")), asked.where(~kind.isin(2, 3)))
    made = asked.select("qid").join(extract, "qid", "left")
    text = F.when(kind == 2, F.lit(G.SENTINEL)).when(kind == 3, F.lit("Nothing of this kind was seen before 1871 【S1】. It ends abruptly [S9].")).otherwise(F.coalesce("answer", F.lit(G.SENTINEL)))
    return made.select("qid", text.alias("answer"))


def chain(spark, sf):
    """Facts are found stage by stage, each for the questions that the stages before leave open."""
    asked = questions(spark, sf)
    found = kept(hits(spark, sf, asked), "hits")
    gate = G.retrieval_rules(GATE)
    facts = asked.join(found.groupBy("qid").agg(F.count("*").alias("passages"), F.max("rerank_score").alias("best")), "qid", "left")
    open_ = G.undecided(facts, gate).select("qid", "question")
    used = G.passages(G.render_context(found), found).join(open_.select("qid"), "qid", "left_semi")
    said = kept(replies(spark, sf, open_, used), "replies")
    facts = facts.join(said, "qid", "left")
    by_model = G.reply_rules()
    replied = G.undecided(said, by_model)
    cited = kept(G.resolve_citations(replied, used.select("qid", "marker", "id")), "citations")
    wrong = D.misattributed(open_, cited.where("known").select("qid", "place", F.col("id").alias("doc")), titles(spark, sf)).select("qid", F.col("reason").alias("misattribution"))
    claims = A.claims(replied.join(wrong, "qid", "left_anti").withColumn("answer", T.normalize_markers(F.col("answer"))))
    held = claims.join(used.select("qid", F.col("marker").cast("long").alias("marker"), F.col("text").alias("evidence")), ["qid", "marker"], "left")
    want, have = T.token_set("claim"), T.token_set(F.coalesce("evidence", F.lit("")))
    share = F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(0.0)
    checked = held.groupBy("qid").agg(F.count("*").alias("claims"), F.sum((F.round(share, 6) >= CONTAINED).cast("long")).alias("supported"), F.sum(F.col("marker").isNull().cast("long")).alias("uncited"))
    unknown = cited.groupBy("qid").agg(F.sum((~F.col("known")).cast("long")).alias("unresolved"))
    facts = facts.join(wrong, "qid", "left").join(checked, "qid", "left").join(unknown, "qid", "left")
    return G.finalize(G.decide(facts, gate + by_model + G.attribution_rules() + G.support_rules(SUPPORT)), REFUSAL), cited


def answer_status(spark, sf):
    decided, _ = chain(spark, sf)
    return decided.select("qid", "status", "reason", F.md5(F.col("text").cast("binary")).alias("text_md5"), *(F.col("usage")[k].alias(k) for k in ("unresolved_citations", "uncited_sentences", "claims_checked", "claims_supported")))


def citations(spark, sf):
    _, cited = chain(spark, sf)
    return cited.select("qid", F.col("place").cast("long").alias("place"), F.col("marker").cast("long").alias("marker"), "id", "known")


def page_titles(spark, sf):
    """Titles of pages; of three, one is given a short name before a colon."""
    title = markup.html_title(F.col("html"), F.col("url"))
    named = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(title, r"^([^ ]+ [^ :]+) ", "$1: ")).otherwise(title)
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc"), named.alias("title"))


def named_pages(spark, sf):
    """Questions that name one page, two pages, a page by its short name in capitals, or none; every second pair of answers cites the page."""
    names = kept(page_titles(spark, sf), "titles")
    then = names.select((F.col("doc") - 1).alias("qid"), F.col("title").alias("next"))
    q = names.select(F.col("doc").alias("qid"), "title").join(then, "qid", "left")
    kind = F.col("qid") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("What does "), "title", F.lit(" report?")))
        .when(kind == 1, F.concat(F.lit("How do "), "title", F.lit(" and "), F.coalesce("next", F.lit("others")), F.lit(" differ?")))
        .when(kind == 2, F.concat(F.lit("WHAT DOES “"), F.translate(F.substring_index("title", ":", 1), string.ascii_lowercase, string.ascii_uppercase), F.lit("” SAY?")))
        .otherwise(F.lit("Which pages are there?"))
    )
    asked = q.select("qid", text.alias("question"))
    cited = asked.select("qid", F.posexplode(F.array(F.when(F.col("qid") % 8 < 4, F.col("qid")).otherwise(F.col("qid") + 1), F.col("qid"))).alias("place", "doc"))
    return asked, cited, names


def attributed(spark, sf):
    """Named pages and wrongly cited ones of each question."""
    asked, cited, names = named_pages(spark, sf)
    named = kept(D.named_counts(asked, D.name_index(names)), "named")
    wrong = D.misattributed(asked, cited, names, named)
    return asked.select("qid").join(named.select("qid", F.col("n").alias("named")), "qid", "left").join(wrong, "qid", "left").select("qid", F.coalesce("named", F.lit(0)).alias("named"), F.coalesce(F.size("wrong"), F.lit(0)).cast("long").alias("wrong"), "reason")


def attribution_replay(spark, sf):
    return D.replay(*named_pages(spark, sf))


def title_frequency(spark, sf):
    return D.title_tokens(page_titles(spark, sf))


QUERIES = {"q_rendered_context": rendered_context, "q_parsed_context": parsed_context, "q_answer_status": answer_status, "q_citations": citations, "q_attribution": attributed, "q_title_tokens": title_frequency, "q_attribution_replay": attribution_replay}

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TOKENS = "greatest(1, length({0}) // 4)"
_ASKED = "items AS (SELECT item_id, CASE item_id % 5 WHEN 1 THEN reverse(text) WHEN 4 THEN text || ' (Rëcord-' || item_id || ')' ELSE text END AS text FROM benchmark)"
_PAGES = "CASE WHEN id % 3 = 0 THEN 'p. ' || (id % 9 + 1) ELSE 'pp. ' || (id % 9 + 1) || '-' || (id % 9 + 1 + id % 3) END"
_TOP = f"""{_ASKED}, {R.bm25_sql().replace("FROM benchmark", "FROM items")}, top AS ({R.top_sql("hits", R.K)}),
tt AS MATERIALIZED (SELECT qid, id, rank, {_STRIP.format("coalesce(d.text, '')")} AS body, coalesce(d.text, '') AS text, concat_ws(' | ', 'Record ' || id, nullif(concat_ws(' > ', source, lang), ''), {_PAGES}) AS locator,
  {R.SET_SQL.format("coalesce(b.text, '')")} AS a, {R.SET_SQL.format("coalesce(d.text, '')")} AS c FROM top JOIN documents d ON doc_id = id JOIN items b ON item_id = qid)"""
_RENDER = f"""{_TOP},
pack AS (
  SELECT qid, 0::BIGINT AS rank, 0::BIGINT AS total, 0::BIGINT AS n, []::VARCHAR[] AS blocks, []::BIGINT[] AS used, []::BIGINT[] AS dropped FROM (SELECT DISTINCT qid FROM tt)
  UNION ALL
  SELECT qid, rank, CASE WHEN fits THEN total + cost WHEN n = 0 THEN {_TOKENS.format("cut")} ELSE total END, n + (fits OR n = 0)::BIGINT,
    CASE WHEN fits THEN list_append(blocks, block) WHEN n = 0 THEN [cut] ELSE blocks END, CASE WHEN fits OR n = 0 THEN list_append(used, id) ELSE used END, CASE WHEN fits OR n = 0 THEN dropped ELSE list_append(dropped, id) END
  FROM (SELECT *, total + cost <= {G.BUDGET} AS fits FROM (SELECT *, {_TOKENS.format("block")} + 1 AS cost FROM (
    SELECT p.qid, t.rank, t.id, p.total, p.n, p.blocks, p.used, p.dropped, '[S' || (p.n + 1) || '] (' || locator || ')' || chr(10) || body AS block,
      '[S' || (p.n + 1) || '] (' || locator || ')' || chr(10) || substr(body, 1, 4 * greatest({G.FLOOR}, {G.BUDGET} - {_TOKENS.format("'[S' || (p.n + 1) || '] (' || locator || ')'")} - {G.ASIDE})) AS cut
    FROM pack p JOIN tt t ON t.qid = p.qid AND t.rank = p.rank + 1)))
), context AS MATERIALIZED (SELECT * FROM pack QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank DESC) = 1),
marked AS MATERIALIZED (SELECT c.qid, m AS marker, t.id, t.text, t.body, t.locator, blocks[m] AS block FROM (SELECT qid, used, blocks, unnest(range(1, len(used) + 1)) AS m FROM context) c JOIN tt t ON t.qid = c.qid AND t.id = used[m])"""
_CHAIN = f"""{_RENDER},
gate AS (SELECT item_id AS qid, count(id) AS passages, max(round(CASE WHEN len(list_intersect(a, c)) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) ELSE 0 END, 6)) FILTER (id IS NOT NULL) AS best FROM items LEFT JOIN tt ON qid = item_id GROUP BY item_id),
open AS (SELECT qid FROM gate WHERE passages > 0 AND best >= {GATE}),
said AS (SELECT qid, marker, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT qid, marker, {N._SENT.format("text")} AS s FROM marked WHERE qid IN (FROM open) AND qid % 5 NOT IN (2, 3))),
sets AS (SELECT said.*, {R.SET_SQL.format("sentence")} AS have, {R.SET_SQL.format("coalesce(b.text, '')")} AS want FROM said JOIN items b ON item_id = qid),
scored AS (SELECT *, round(len(list_intersect(want, have))::DOUBLE / len(want) + 0.15 * len(list_intersect(want, have))::DOUBLE / sqrt(len(have)::DOUBLE), 6) AS score FROM sets WHERE len(have) > 0),
short AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, marker, pos) AS n, max(score) OVER (PARTITION BY qid) AS best FROM scored QUALIFY n <= {A.SCAN} AND score >= greatest({A.LEAST}, best / 2)),
fresh AS (SELECT * FROM short QUALIFY row_number() OVER (PARTITION BY qid, substr(sentence, 1, 80) ORDER BY n) = 1),
picked AS (SELECT qid, marker, row_number() OVER (PARTITION BY qid ORDER BY n) AS k, CASE WHEN regexp_matches(sentence, '[.!?]$') THEN sentence ELSE sentence || '.' END AS claim FROM fresh QUALIFY k <= {A.KEEP}),
reply AS MATERIALIZED (SELECT qid, CASE qid % 5 WHEN 2 THEN '{G.SENTINEL}' WHEN 3 THEN 'Nothing of this kind was seen before 1871 [S1]. It ends abruptly [S9].' ELSE coalesce((SELECT string_agg(claim || ' [S' || marker || ']', ' ' ORDER BY k) FROM picked p WHERE p.qid = o.qid), '{G.SENTINEL}') END AS answer FROM open o),
cites AS MATERIALIZED (SELECT r.qid, row_number() OVER (PARTITION BY r.qid ORDER BY spot) AS place, m.marker, mk.id, mk.id IS NOT NULL AS known, mk.text FROM (
  SELECT qid, marker, min(spot) AS spot FROM (SELECT qid, unnest(regexp_extract_all(answer, '\\[S(\\d{{1,3}})\\]', 1))::BIGINT AS marker, generate_subscripts(regexp_extract_all(answer, '\\[S(\\d{{1,3}})\\]', 1), 1) AS spot FROM reply WHERE NOT contains(answer, '{G.SENTINEL}')) GROUP BY ALL
) m JOIN reply r USING (qid) LEFT JOIN marked mk ON mk.qid = m.qid AND mk.marker = m.marker),
wrong AS (SELECT qid, 'the question asks about "Record ' || qid || ': ' || (SELECT coalesce(source, '') FROM documents WHERE doc_id = qid) || '" but the answer cites a different document: ' || string_agg('"Record ' || id || ': ' || coalesce(source, '') || '"', '; ' ORDER BY place) AS misattribution
  FROM cites JOIN documents ON doc_id = id WHERE known AND qid % 5 = 4 AND id <> qid AND qid IN (SELECT doc_id FROM documents) GROUP BY qid),
said_claims AS (
  SELECT qid, marker, claim FROM picked WHERE qid NOT IN (SELECT qid FROM wrong)
  UNION ALL SELECT qid, 1, 'Nothing of this kind was seen before 1871.' FROM reply WHERE qid % 5 = 3 UNION ALL SELECT qid, 9, 'It ends abruptly.' FROM reply WHERE qid % 5 = 3),
checked AS (SELECT qid, count(*) AS claims, sum((round(len(list_intersect(w, h))::DOUBLE / len(w), 6) >= {CONTAINED})::BIGINT)::BIGINT AS supported FROM (SELECT s.qid, {R.SET_SQL.format("claim")} AS w, {R.SET_SQL.format("coalesce(mk.text, '')")} AS h FROM said_claims s LEFT JOIN marked mk ON mk.qid = s.qid AND mk.marker = s.marker) GROUP BY qid),
status AS (SELECT *, CASE WHEN passages = 0 OR best < {GATE} THEN 'refused_no_context' WHEN contains(answer, '{G.SENTINEL}') THEN 'refused_by_model' WHEN misattribution IS NOT NULL THEN 'refused_misattributed' WHEN supported / claims < {SUPPORT} THEN 'refused_low_support' ELSE 'answered' END AS status
  FROM gate LEFT JOIN reply USING (qid) LEFT JOIN wrong USING (qid) LEFT JOIN checked USING (qid) LEFT JOIN (SELECT qid, count(*) FILTER (NOT known) AS unresolved FROM cites GROUP BY qid) USING (qid))"""
_TITLES = r"""tag AS (SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '\s*[|-]\s*[^|-]+$', '')), ''), regexp_extract(url, '([^/]+)/?$', 1)) AS t FROM pages),
titles AS MATERIALIZED (SELECT page_id AS doc, CASE WHEN page_id % 3 = 0 THEN regexp_replace(t, '^([^ ]+ [^ :]+) ', '\1: ') ELSE t END AS title FROM tag)"""
_FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^0-9a-z]+', ' ', 'g'))"
_NAMES = f"""{_TITLES},
tokens AS MATERIALIZED (SELECT token, count(*) AS df FROM (SELECT DISTINCT f, unnest(string_split(f, ' ')) AS token FROM (SELECT {_FOLD.format("title")} AS f FROM titles) WHERE f <> '') GROUP BY token),
names AS MATERIALIZED (
  SELECT doc, {_FOLD.format("title")} AS phrase FROM titles
  UNION SELECT doc, head FROM (SELECT doc, {_FOLD.format("split_part(title, ':', 1)")} AS head FROM titles WHERE contains(title, ':')) LEFT JOIN tokens ON token = head WHERE contains(head, ' ') OR (length(head) >= {D.LONE} AND df = 1))"""
_ATTRIBUTION = f"""WITH {_NAMES}, asked AS MATERIALIZED (
  SELECT a.doc AS qid, {_FOLD.format("CASE a.doc % 4 WHEN 0 THEN 'What does ' || a.title || ' report?' WHEN 1 THEN 'How do ' || a.title || ' and ' || coalesce(b.title, 'others') || ' differ?' WHEN 2 THEN 'what does ' || split_part(a.title, ':', 1) || ' say?' ELSE 'Which pages are there?' END")} AS q
  FROM titles a LEFT JOIN titles b ON b.doc = a.doc + 1),
named AS (SELECT DISTINCT qid, doc FROM asked JOIN names ON phrase <> '' AND contains(' ' || q || ' ', ' ' || phrase || ' ')),
one AS (SELECT qid, count(*) AS named, min(doc) AS target FROM named GROUP BY qid),
cited AS (SELECT qid, 0 AS place, CASE WHEN qid % 8 < 4 THEN qid ELSE qid + 1 END AS doc FROM asked UNION ALL SELECT qid, 1, qid FROM asked),
other AS (SELECT qid, target, title, min(place) AS place FROM cited JOIN one USING (qid) JOIN titles USING (doc) WHERE named = 1 AND cited.doc <> target GROUP BY ALL),
reasons AS (SELECT qid, count(*) AS wrong, 'the question asks about "' || any_value(t.title) || '" but the answer cites a different document: ' || string_agg('"' || other.title || '"', '; ' ORDER BY place, other.title) AS reason FROM other JOIN titles t ON t.doc = target GROUP BY qid)"""

SQL = {
    "q_rendered_context": f"WITH RECURSIVE {_RENDER} SELECT qid, md5(array_to_string(blocks, chr(10) || chr(10))) AS context_md5, total AS tokens, array_to_string(used, ',') AS used, array_to_string(dropped, ',') AS dropped FROM context",
    "q_parsed_context": f"WITH RECURSIVE {_RENDER} SELECT qid, marker::INTEGER AS marker, '(' || locator || ')' AS header, md5({_STRIP.format('substr(block, strpos(block, chr(10)) + 1)')}) AS body_md5 FROM marked WHERE {_STRIP.format('substr(block, strpos(block, chr(10)) + 1)')} <> ''",
    "q_answer_status": f"""WITH RECURSIVE {_CHAIN} SELECT qid, status,
  CASE status WHEN 'refused_no_context' THEN CASE WHEN passages = 0 THEN 'retrieval returned no passages above threshold' ELSE printf('best passage scored %.2f for relevance to this question, below the {GATE:.2f} threshold: the corpus does not appear to cover it', best) END
    WHEN 'refused_by_model' THEN 'model reported the passages do not support an answer' WHEN 'refused_misattributed' THEN misattribution
    WHEN 'refused_low_support' THEN 'only ' || round_even(100 * supported / claims, 0)::INT || '% of claims are supported by the retrieved passages (threshold {SUPPORT:.0%})' END AS reason,
  md5(CASE WHEN status = 'answered' THEN answer ELSE '{REFUSAL}' END) AS text_md5, CASE WHEN status = 'answered' AND unresolved > 0 THEN unresolved END AS unresolved_citations, NULL::BIGINT AS uncited_sentences,
  CASE WHEN status = 'answered' THEN claims END AS claims_checked, CASE WHEN status = 'answered' THEN supported END AS claims_supported FROM status""",
    "q_citations": f"WITH RECURSIVE {_CHAIN} SELECT qid, place, marker, id, known FROM cites",
    "q_attribution": f"{_ATTRIBUTION} SELECT qid, coalesce(named, 0) AS named, coalesce(wrong, 0) AS wrong, reason FROM asked LEFT JOIN one USING (qid) LEFT JOIN reasons USING (qid)",
    "q_attribution_replay": f"{_ATTRIBUTION} SELECT count(*) AS answered, count(*) FILTER (named = 1) AS one_named, count(*) FILTER (named > 1) AS several_named, count(wrong) AS would_refuse FROM asked LEFT JOIN one USING (qid) LEFT JOIN reasons USING (qid)",
    "q_title_tokens": f"WITH {_NAMES} SELECT * FROM tokens",
}
