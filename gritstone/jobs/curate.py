"""Registered queries of claim checks, curation and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.jobs import retrieve as R
from gritstone.operators import claims as V
from gritstone.operators import curation as C
from gritstone.operators import gates as A
from gritstone.operators import governance as G
from gritstone.operators import retrieval as O
from gritstone.sources import keyword_index as X
from gritstone.sources import table
from gritstone.sources.scratch import own_folder

GATE, SAMPLE = 0.2, 40
PRICED = [("assistant", 1), ("user-2025", 2), ("sys", 3), ("mock", 4)]
SECTIONS = ["intro", "References", "Appendix A", "Methods", ""]


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def evidence(spark, sf):
    """Each assistant turn beside all that its conversation's user said."""
    said = turns(spark, sf)
    held = said.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("evidence"))
    return said.where("role = 'assistant'").join(held, "conv_id", "left")


def claims(spark, sf):
    """Sentence claims of assistant turns."""
    found = turns(spark, sf).where("role = 'assistant'").select("conv_id", "turn", F.posexplode(V.split_claims(F.col("text"))).alias("at", "c"))
    return found.select("conv_id", "turn", F.col("at").cast("long").alias("claim_no"), "c.claim", F.array_join(F.transform("c.markers", lambda m: m.cast("string")), ",").alias("markers"))


def lexical_verdicts(spark, sf):
    """Each claim of an assistant turn held against what the user said."""
    each = evidence(spark, sf).select("conv_id", "turn", "evidence", F.posexplode(V.split_claims(F.col("text"))).alias("at", "c")).withColumn("claim", F.col("c.claim"))
    return V.judge(each).select("conv_id", "turn", F.col("at").cast("long").alias("claim_no"), "coverage", "numbers_ok", "negation_ok", "ambiguous", "supported", "escalate", "reason")


def number_sets(spark, sf):
    docs = R.documents(spark, sf)
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("id").alias("doc_id"), F.size(V.claimed_numbers(text)).cast("long").alias("claimed"), F.size(V.evidence_numbers(text)).cast("long").alias("held"))


def contained_claims(spark, sf):
    """Assistant turns of whose tokens six tenths or more occur in what the user said."""
    want, have = T.token_set("text"), T.token_set(F.coalesce("evidence", F.lit("")))
    share = F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(0.0)
    return evidence(spark, sf).select("conv_id", "turn", F.round(share, 6).alias("share"), (F.round(share, 6) >= 0.6).alias("contained"))


def normal_texts(spark, sf):
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("id") % 3 == 0, "code").otherwise("prose")
    return R.documents(spark, sf).select(F.col("id").alias("doc_id"), *(F.md5(c.cast("binary")).alias(n) for n, c in (("spaces_md5", C.normalize_whitespace(text)), ("code_md5", C.normalize_code(text)), ("block_md5", C.normalize_block(text, kind)))))


def question_checks(spark, sf):
    text = F.concat(F.when(F.col("conv_id") % 2 == 0, "what does the paper say of ").otherwise(""), F.col("text"), F.when(F.col("conv_id") % 5 == 0, " (S2)").otherwise(""))
    asked = turns(spark, sf).withColumn("text", text)
    return asked.select(
        "conv_id", "turn", C.names_something(F.col("text")).alias("names_something"), C.names_nothing(F.col("text")).alias("names_nothing"), F.col("text").rlike(C.SUSPECT_MARKER).alias("suspect"),
        ((T.strip("text") != "") & (F.length("text") <= 2000) & F.col("turn").between(1, 50)).alias("valid"),
    )


def prices(spark, sf):
    role = F.concat(F.when(F.col("conv_id") % 4 == 0, "mock:").otherwise(""), F.col("role"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("-2025-"), (F.col("turn") % 9).cast("string"))).otherwise(""))
    models = turns(spark, sf).select(F.when(F.col("conv_id") % 50 == 0, "mock:other").otherwise(role).alias("model"))
    return C.resolve_prices(models, spark.createDataFrame(PRICED, "model string, place int"))


def logits(spark, sf):
    return R.documents(spark, sf).select(F.col("id").alias("doc_id"), F.round(C.logit(F.col("id") % 101 / 100), 6).alias("logit"))


def versions(spark, sf):
    """Manifest entries: id and version, the date of a time stamp, and whether a file would pass."""
    rows = R.documents(spark, sf).select(F.concat((F.lit(2400) + F.col("id") % 97).cast("string"), F.lit("."), F.col("id").cast("string"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))).otherwise("")).alias("key"), F.length("text").alias("n"))
    return rows.select("key", F.regexp_extract("key", "^(.*?)(v[0-9]+)?$", 1).alias("paper"), F.regexp_extract("key", "v([0-9]+)$", 1).alias("version"), (F.coalesce("n", F.lit(0)) >= 2000).alias("valid"))


def newest_versions(spark, sf):
    """Of each paper's manifest entries the newest."""
    n = F.col("id") % 4
    key = F.concat(F.lit("2401."), F.floor(F.col("id") / 3).cast("string"), F.when(n > 0, F.concat(F.lit("v"), (n * 4).cast("string"))).otherwise(""))
    return A.newest_versions(R.documents(spark, sf).select(key.alias("key"), "id")).select("paper", "version", "id")


def scores(spark, sf, half):
    """Mean labels of the documents of each language as a run's metrics."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.where(F.col("doc_id") % 2 == half).groupBy(F.coalesce("lang", F.lit("none")).alias("metric")).agg(F.round(F.avg("quality"), 9).alias("score"))


def score_gate(spark, sf):
    """One half's scores against thresholds and the other half's."""
    thresholds = scores(spark, sf, 1).where("metric <> 'de'").select("metric", F.lit(0.5).alias("threshold"))
    return A.gate(scores(spark, sf, 1), thresholds, scores(spark, sf, 0).where("metric <> 'fr'"))


def gate_verdict(spark, sf):
    return A.verdict(score_gate(spark, sf))


def rejudged(spark, sf):
    """Lexical verdicts of whole turns, of which a second judge has looked at the escalated ones of even conversations."""
    first = V.judge(evidence(spark, sf).withColumn("claim", F.col("text"))).select("conv_id", "turn", "supported", "coverage", "reason", "escalate")
    second = first.where("conv_id % 2 = 0").select("conv_id", "turn", (F.col("conv_id") % 4 == 0).alias("supported"), F.lit(0.91234).alias("score"), F.when(F.col("turn") % 2 == 1, "seen").alias("reason"))
    found = A.judged_again(first, second, "conv_id", "turn")
    return found.groupBy("escalate", "reason").agg(F.count("*").alias("n"), F.sum(F.col("supported").cast("long")).alias("supported"))


def event_days(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = F.to_date(F.substring(stamp, 1, 10))
    score = F.expr("try_cast(coalesce(get_json_object(props, '$.scores.k'), get_json_object(props, '$.k')) as double)")
    return table(spark, sf, "events").groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count(score).alias("scored"), F.round(F.avg(score), 6).alias("mean"))


def sections(spark, sf):
    docs = R.documents(spark, sf)
    return docs.select(F.col("id"), F.col("source").alias("doc"), F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("id") % 5 + 1).cast("int")).alias("section"), T.count_tokens(F.coalesce("text", F.lit(""))).alias("token_count"))


def eligible(spark, sf):
    return C.eligible(sections(spark, sf)).select("id", "section", "token_count")


def spread_sample(spark, sf):
    return C.spread_sample(C.eligible(sections(spark, sf)), SAMPLE).select("doc", "section", "id")


def ledger(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "suspect").otherwise("rejected").alias("status"))


def review_queue(spark, sf):
    """Documents still to be reviewed, suspects first."""
    status = F.coalesce("status", F.lit("draft"))
    open_ = R.documents(spark, sf).select(F.col("id").alias("doc_id"), "source").join(ledger(spark, sf), "doc_id", "left").withColumn("status", status).where("status in ('draft', 'suspect')")
    w = Window.partitionBy("source").orderBy(F.when(F.col("status") == "suspect", 0).otherwise(1), "doc_id")
    return open_.select("doc_id", "source", "status", F.row_number().over(w).cast("long").alias("place"))


def undecided(spark, sf):
    """Labelled rows as decided, and candidates that are not among them."""
    known = table(spark, sf, "labels").select("doc_id").distinct()
    fresh = R.documents(spark, sf).select(F.col("id").alias("doc_id")).join(known, "doc_id", "left_anti")
    return known.withColumn("part", F.lit("decided")).unionByName(fresh.withColumn("part", F.lit("fresh"))).groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def duplicate_members(spark, sf):
    """Documents of one text: the first of them, and each member."""
    keyed = R.documents(spark, sf).where("text is not null").select("id", F.md5(F.col("text").cast("binary")).alias("key"))
    lead = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(lead, "key").select("lead", F.col("id").alias("member"), "n")


def first_seen(spark, sf):
    """One document for each text: that of the smallest id."""
    return R.documents(spark, sf).groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key")).agg(F.min_by(F.struct("id", "lang", "source"), "id").alias("x")).select("x.*")


def enriched(spark, sf):
    return R.documents(spark, sf).select(F.col("id").alias("doc_id"), "lang").join(ledger(spark, sf), "doc_id", "left").select("doc_id", "lang", F.coalesce("status", F.lit("unknown")).alias("status"))


def category_means(spark, sf):
    """Means by language over answerable rows, NaN left out; a language without any has zeros."""
    rows = R.documents(spark, sf).select(F.col("id").alias("doc_id"), "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    good = F.col("toxic") == 0
    judged = F.when(good & (F.col("doc_id") % 7 == 0), float("nan")).when(good, F.col("quality").cast("double"))
    mean = F.avg(F.when(~F.isnan(judged), judged))
    return rows.groupBy("lang").agg(F.sum(F.coalesce(good, F.lit(False)).cast("long")).alias("answerable"), F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("mean"))


def lowest(spark, sf):
    rows = table(spark, sf, "labels").where("quality = 1").join(R.documents(spark, sf).select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("score")), "doc_id")
    return rows.select("doc_id", "score").orderBy("score", "doc_id").limit(10)


def gated(spark, sf):
    short = R.sparse_top(spark, sf, R.SHORTLIST)
    reranked = O.rerank(short, R.documents(spark, sf), R.questions(spark, sf), R.K)
    return C.relevance_gate(reranked, GATE).select("qid", F.round("best", 6).alias("best"), "status")


def provenance(spark, sf):
    lists = R.both_lists(spark, sf)
    found = C.provenance(lists, O.ranked(O.reciprocal_rank(lists), R.K))
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"), "dense_rank", "sparse_rank", F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"), "retriever")


def acceptable(spark, sf):
    docs = R.documents(spark, sf)
    hits = R.sparse_top(spark, sf, 10).select("qid", "id", "rank")
    return C.first_acceptable(hits, docs.where("id % 3 = 0"), docs.where("lang = 'en'"))


def vectors_upsert(spark, sf):
    old = R.vectors(spark, sf).select("id", "v")
    new = old.where("id % 10 = 0").select("id", F.transform("v", lambda x: -x).alias("v"))
    return C.upsert_vectors(old, new, 64).select("id", F.size("v").cast("long").alias("dim"), F.round(F.element_at("v", 1).cast("double"), 6).alias("first"))


def metadata(spark, sf):
    """Flattened metadata of each document, and what comes back of it."""
    flat = C.flatten_metadata(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("id") % 2 == 0, F.col("source"))))
    back = C.unflatten_metadata(flat)
    return R.documents(spark, sf).select(F.col("id").alias("doc_id"), F.array_join(F.array_sort(F.map_keys(flat)), ",").alias("keys"), back["lang"].alias("lang"), F.try_element_at(back, F.lit("source")).alias("source"))


def corpus_digest(spark, sf):
    """A digest of each source's texts that any order gives, as sums of hashed rows."""
    h = F.conv(F.left(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("text", F.lit(""))).cast("binary")), F.lit(8)), 16, 10).cast("long")
    return R.documents(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


def index_manifest(spark, sf):
    index = R.keyword_index(spark, sf)
    return index.manifest.select("documents", "terms", "postings")


def json_lines(spark, sf):
    """Documents written as JSON lines and read back."""
    path = f"{own_folder(spark)}/lines-{uuid.uuid4().hex}"
    R.documents(spark, sf).write.json(path)
    back = spark.read.schema("id long, text string, lang string, source string").json(path)
    return back.select("id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang")


def store_ids(spark, sf):
    return R.documents(spark, sf).where("source <> ''").select("source").distinct().orderBy("source")


def upserted(spark, sf):
    """Prescreen results: newer ones take the place of older ones of the same pair."""
    old = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("verdict"))
    new = old.where("doc_id % 4 = 0").withColumn("verdict", F.lit(9).cast("long"))
    return G.upsert(old, new.unionByName(spark.range(1).select((F.col("id") - 1).alias("doc_id"), F.lit(9).cast("long").alias("verdict"))), "doc_id")


def prompts(spark, sf):
    """A template filled with each question and its conversation's number."""
    said = turns(spark, sf).where("role = 'user'")
    filled = F.replace(F.replace(F.lit("Q{n}: {question}\nA:"), F.lit("{n}"), F.col("conv_id").cast("string")), F.lit("{question}"), F.col("text"))
    return said.select("conv_id", "turn", F.md5(filled.cast("binary")).alias("prompt_md5"))


QUERIES = {
    "q_claims": claims, "q_lexical_verdicts": lexical_verdicts, "q_number_sets": number_sets, "q_contained_claims": contained_claims, "q_normal_texts": normal_texts, "q_question_checks": question_checks, "q_prices": prices,
    "q_logits": logits, "q_versions": versions, "q_event_days": event_days, "q_eligible": eligible, "q_spread_sample": spread_sample, "q_review_queue": review_queue, "q_undecided": undecided,
    "q_duplicate_members": duplicate_members, "q_first_seen": first_seen, "q_enriched": enriched, "q_category_means": category_means, "q_lowest_answerable": lowest, "q_relevance_gate": gated, "q_provenance": provenance,
    "q_first_acceptable": acceptable, "q_vectors_upsert": vectors_upsert, "q_metadata": metadata, "q_corpus_digest": corpus_digest, "q_index_manifest": index_manifest, "q_json_lines": json_lines, "q_store_ids": store_ids,
    "q_prescreen_upsert": upserted, "q_newest_versions": newest_versions, "q_score_gate": score_gate, "q_gate_verdict": gate_verdict, "q_judged_again": rejudged, "q_prompts": prompts,
}

_TEXT = "coalesce(text, '')"
_SPACES = rf"regexp_replace(regexp_replace(replace(regexp_replace(translate(regexp_replace(regexp_replace({_TEXT}, '([A-Za-z0-9_])-\s*\n\s*([A-Za-z0-9_])', '\1\2', 'g'), '\n{{2,}}', chr(1), 'g'), chr(10), ' '), '[ \t' || chr(160) || ']+', ' ', 'g'), chr(1), chr(10) || chr(10)), '^\s+', ''), '\s+$', '')"
_CODE = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace({_TEXT}, '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '')"
_ASKED = "(CASE WHEN conv_id % 2 = 0 THEN 'what does the paper say of ' ELSE '' END || coalesce(text, '') || CASE WHEN conv_id % 5 = 0 THEN ' (S2)' ELSE '' END)"
_QUOTED = "\"[^\"]{3,}\"|“[^”]{3,}”"
_WORDS = "list_filter(list_transform(regexp_split_to_array(trim(q), '\\s+')[2:], lambda w: regexp_replace(regexp_replace(w, '^[{0}]+', ''), '[{0}]+$', '')), lambda w: length(w) >= 2 AND NOT list_contains(" + R.STOP_SQL + ", lower(w)))"
_STATUS = "CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 1 THEN 'suspect' ELSE 'rejected' END"
_SECTION = "['intro', 'References', 'Appendix A', 'Methods', ''][doc_id % 5 + 1]"
_ELIGIBLE = f"(SELECT doc_id AS id, source AS doc, {_SECTION} AS section, greatest(1, length({_TEXT}) // 4)::BIGINT AS token_count FROM documents WHERE greatest(1, length({_TEXT}) // 4) >= 150 AND NOT regexp_matches({_SECTION}, '(?i)reference|bibliograph|acknowledg|author|affiliation|appendix'))"
_EVIDENCE = "SELECT a.conv_id, a.turn, coalesce(a.text, '') AS text, coalesce(e.evidence, '') AS evidence FROM conversations a LEFT JOIN (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, text) AS evidence FROM conversations WHERE role = 'user' GROUP BY conv_id) e USING (conv_id) WHERE a.role = 'assistant'"

_GATE = "s AS (SELECT coalesce(lang, 'none') AS metric, doc_id % 2 AS half, round(avg(quality), 9) AS score FROM labels JOIN documents USING (doc_id) GROUP BY ALL), g AS (SELECT metric, a.score, CASE WHEN metric <> 'de' THEN 0.5::DOUBLE END AS threshold, b.score AS base FROM (SELECT * FROM s WHERE half = 1) a LEFT JOIN (SELECT * FROM s WHERE half = 0 AND metric <> 'fr') b USING (metric)), t AS (SELECT metric, score, threshold, round(score - threshold, 9) AS delta, round(score - threshold, 9) >= 0 AS passes, base, round(score - base, 9) AS change, round(score - base, 9) < -0.02 AS regressed FROM g)"

SQL = {
    "q_newest_versions": "WITH k AS (SELECT '2401.' || (doc_id // 3) AS paper, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 * 4 ELSE 1 END::INT AS version, doc_id AS id FROM documents) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY paper ORDER BY version DESC, id DESC) = 1",
    "q_score_gate": f"WITH {_GATE} SELECT * FROM t",
    "q_gate_verdict": f"WITH {_GATE}, n AS (SELECT count(threshold) AS checked, count(base) AS compared, count(*) FILTER (NOT passes) AS below, count(*) FILTER (regressed) AS regressions FROM t) SELECT *, CASE WHEN checked = 0 THEN 'no metric has a threshold' WHEN regressions > 0 THEN 'FAIL (regression)' WHEN below > 0 THEN 'FAIL (below threshold)' ELSE 'PASS' END AS verdict, CASE WHEN checked = 0 THEN 3 WHEN regressions > 0 THEN 2 WHEN below > 0 THEN 1 ELSE 0 END AS code FROM n",
    "q_contained_claims": f"WITH e AS ({_EVIDENCE}), s AS (SELECT conv_id, turn, {R.SET_SQL.format('text')} AS w, {R.SET_SQL.format('evidence')} AS h FROM e), r AS (SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, h))::DOUBLE / len(w) ELSE 0 END, 6) AS share FROM s) SELECT conv_id, turn, share, share >= 0.6 AS contained FROM r",
    "q_normal_texts": f"SELECT doc_id, md5({_SPACES}) AS spaces_md5, md5({_CODE}) AS code_md5, md5(CASE WHEN doc_id % 3 = 0 THEN {_CODE} ELSE {_SPACES} END) AS block_md5 FROM documents",
    "q_question_checks": f"""WITH a AS (SELECT conv_id, turn, {_ASKED} AS q FROM conversations), w AS (SELECT *, {_WORDS.format("(),.?:;''\"")} AS t, {_WORDS.format("(),.?:;")} AS u FROM a)
SELECT conv_id, turn, regexp_matches(q, '{_QUOTED}|''[^'']{{8,}}''') OR len(list_filter(t, lambda x: NOT list_contains([{", ".join(f"'{g}'" for g in C.GENERIC)}], lower(x)) AND regexp_matches(x, '^[A-Z]|[A-Z].*[A-Z]|[0-9].*[A-Za-z]|[A-Za-z].*[0-9]'))) > 0 AS names_something,
  regexp_matches(q, '{C.BACK_REFERENCES}') AND NOT regexp_matches(q, '{_QUOTED}') AND len(list_filter(u, lambda x: regexp_matches(x, '^[A-Z]'))) = 0 AS names_nothing, regexp_matches(q, '{C.SUSPECT_MARKER}') AS suspect,
  regexp_matches(q, '\\S') AND length(q) <= 2000 AND turn BETWEEN 1 AND 50 AS valid FROM w""",
    "q_prices": """WITH m AS (SELECT DISTINCT CASE WHEN conv_id % 50 = 0 THEN 'mock:other' ELSE CASE WHEN conv_id % 4 = 0 THEN 'mock:' ELSE '' END || coalesce(role, '') || CASE WHEN conv_id % 3 = 0 THEN '-2025-' || (turn % 9) ELSE '' END END AS model FROM conversations),
n AS (SELECT model, regexp_replace(model, '^[^:]*:', '') AS bare, CASE WHEN contains(model, ':') THEN split_part(model, ':', 1) END AS provider FROM m), p AS (SELECT * FROM (VALUES ('assistant', 1), ('user-2025', 2), ('sys', 3), ('mock', 4)) AS v(key, place)),
l AS (SELECT model, key, place, CASE WHEN key = model THEN 1 WHEN key = bare THEN 2 WHEN starts_with(bare, key) OR starts_with(key, bare) THEN 3 WHEN key = provider THEN 4 END AS level FROM n, p)
SELECT n.model, x.key AS price_key FROM n LEFT JOIN (SELECT model, key FROM l WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY level, place) = 1) x USING (model)""",
    "q_logits": "SELECT doc_id, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT doc_id, least(greatest((doc_id % 101)::DOUBLE / 100, 1e-7), 1 - 1e-7) AS p FROM documents)",
    "q_versions": "SELECT key, regexp_extract(key, '^(.*?)(v[0-9]+)?$', 1) AS paper, regexp_extract(key, 'v([0-9]+)$', 1) AS version, coalesce(n, 0) >= 2000 AS valid FROM (SELECT (2400 + doc_id % 97) || '.' || doc_id || CASE WHEN doc_id % 4 > 0 THEN 'v' || (doc_id % 4) ELSE '' END AS key, length(text) AS n FROM documents)",
    "q_event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(k) AS scored, round(avg(k), 6) AS mean FROM (SELECT ts, TRY_CAST(coalesce(json_extract_string(props, '$.scores.k'), json_extract_string(props, '$.k')) AS DOUBLE) AS k FROM events) GROUP BY 1",
    "q_eligible": f"SELECT id, section, token_count FROM {_ELIGIBLE}",
    "q_spread_sample": f"WITH o AS (SELECT doc, section, id FROM {_ELIGIBLE} QUALIFY row_number() OVER (PARTITION BY doc, section ORDER BY md5('spread-1|' || id), id) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY section) AS turn FROM o) SELECT doc, section, id FROM t ORDER BY turn, md5('spread-1|' || doc), doc LIMIT {SAMPLE}",
    "q_review_queue": f"SELECT doc_id, source, status, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN status = 'suspect' THEN 0 ELSE 1 END, doc_id) AS place FROM (SELECT d.doc_id, source, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN {_STATUS} END, 'draft') AS status FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE status IN ('draft', 'suspect')",
    "q_undecided": "SELECT part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT DISTINCT doc_id, 'decided' AS part FROM labels UNION ALL SELECT doc_id, 'fresh' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY part",
    "q_duplicate_members": "SELECT min(doc_id) OVER w AS lead, doc_id AS member, count(*) OVER w AS n FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY md5(text)) QUALIFY n > 1",
    "q_first_seen": f"SELECT doc_id AS id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5({_TEXT}) ORDER BY doc_id) = 1",
    "q_enriched": f"SELECT d.doc_id, lang, CASE WHEN l.doc_id IS NULL THEN 'unknown' ELSE {_STATUS} END AS status FROM documents d LEFT JOIN labels l USING (doc_id)",
    "q_category_means": "SELECT lang, count(*) FILTER (WHERE toxic = 0) AS answerable, coalesce(round(avg(quality::DOUBLE) FILTER (WHERE toxic = 0 AND d.doc_id % 7 <> 0), 6), 0) AS mean FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang",
    "q_lowest_answerable": "SELECT doc_id, length(text)::BIGINT AS score FROM labels JOIN documents USING (doc_id) WHERE quality = 1 ORDER BY score, doc_id LIMIT 10",
    "q_relevance_gate": f"WITH {R.bm25_sql()}, short AS ({R.top_sql('hits', R.SHORTLIST)}), {R.F1_SQL} SELECT qid, round(max(score), 6) AS best, CASE WHEN max(score) < {GATE} THEN 'refused_no_context' ELSE 'pass' END AS status FROM f1s GROUP BY qid",
    "q_provenance": f"WITH {R.lists_sql()}, f AS (SELECT qid, id, {R.RRF} AS score FROM lists GROUP BY ALL), e AS (SELECT qid, id, max(rank) FILTER (WHERE source = 'dense') AS dense_rank, max(score) FILTER (WHERE source = 'dense') AS dense_score, max(rank) FILTER (WHERE source = 'sparse') AS sparse_rank, max(score) FILTER (WHERE source = 'sparse') AS sparse_score FROM lists GROUP BY ALL) SELECT t.qid, t.id, t.rank, round(t.score, 6) AS score, dense_rank, sparse_rank, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, CASE WHEN dense_rank IS NULL THEN 'sparse' WHEN sparse_rank IS NULL THEN 'dense' ELSE 'hybrid' END AS retriever FROM ({R.top_sql('f', R.K)}) t JOIN e USING (qid, id)",
    "q_first_acceptable": f"WITH {R.bm25_sql()}, r AS ({R.top_sql('hits', 10)}), k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM r WHERE id % 3 <> 0) SELECT qid, min(CASE WHEN lang = 'en' THEN rank END) AS first FROM k JOIN documents ON doc_id = id GROUP BY qid",
    "q_vectors_upsert": "SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(CASE WHEN vec_id % 10 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings",
    "q_metadata": "SELECT doc_id, concat_ws(',', CASE WHEN lang IS NOT NULL THEN 'x_lang' END, CASE WHEN doc_id % 2 = 0 AND source IS NOT NULL THEN 'x_source' END) AS keys, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents",
    "q_corpus_digest": f"SELECT source, count(*) AS n, CAST(sum(CAST('0x' || left(md5(doc_id || '|' || {_TEXT}), 8) AS BIGINT)) AS BIGINT) AS digest FROM documents GROUP BY source",
    "q_index_manifest": f"WITH {R.bm25_sql()} SELECT (SELECT count(*) FROM toks) AS documents, (SELECT count(DISTINCT term) FROM post) AS terms, (SELECT count(*) FROM post) AS postings",
    "q_json_lines": f"SELECT doc_id AS id, md5({_TEXT}) AS text_md5, lang FROM documents",
    "q_store_ids": "SELECT DISTINCT source FROM documents WHERE source <> '' ORDER BY source",
    "q_prescreen_upsert": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE quality END::BIGINT AS verdict FROM labels UNION ALL SELECT -1, 9",
    "q_prompts": f"SELECT conv_id, turn, md5('Q' || conv_id || ': ' || {_TEXT} || chr(10) || 'A:') AS prompt_md5 FROM conversations WHERE role = 'user'",
}
