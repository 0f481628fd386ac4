"""Registered queries on headings, wrapped blocks and titles: lines of documents as blocks with sizes and fonts."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from gritstone.jobs import answer as A
from gritstone.jobs import retrieve as R
from gritstone.operators import titles as H

HEIGHT, STEP, BODY_FONT = 792.0, 40.0, "NimbusRegu"
_MAKES = ("{}", "3.1 {}", "2 {}", "II. {}", "B. Data {}", "{}:", "31 {}", "Results")


def blocks(spark, sf):
    """The page blocks of documents, cut to 40 characters, some made headings of each form."""
    b = A.blocks(spark, sf)
    n, short = F.length("text"), F.trim(F.substring("text", 1, 40))
    made = F.lit("Results")
    for k, form in enumerate(_MAKES[:-1]):
        head, tail = form.split("{}")
        body = F.translate(short, string.ascii_lowercase, string.ascii_uppercase) if k in (1, 3) else short
        made = F.when(n % 8 == k, F.concat(F.lit(head), body, F.lit(tail))).otherwise(made)
    size = F.when(n % 5 == 0, 14.0).when(n % 5 == 1, 12.6).otherwise(10.0)
    return b.select("doc", "page", F.col("y").alias("ord"), made.alias("text"), size.alias("size"), (n % 3 != 0).alias("bold"), F.when(n % 4 == 0, "NimbusMedi").otherwise(BODY_FONT).alias("font"), "x0", (F.col("y") * STEP).alias("y0"), (F.col("y") * STEP + 10).alias("y1"))


def leveled(spark, sf):
    level = H.heading_level(F.col("text"), F.col("size"), F.lit(10.0), F.col("bold"), F.col("font"), F.lit(BODY_FONT))
    return blocks(spark, sf).withColumn("level", level)


def heading_levels(spark, sf):
    return leveled(spark, sf).select("doc", "page", "ord", F.coalesce("level", F.lit(0)).alias("level"))


def wrapped_blocks(spark, sf):
    """Blocks put together over gaps, sizes and columns."""
    return H.merge_blocks(leveled(spark, sf), A.WIDTH, HEIGHT).select("doc", "page", "ord", F.coalesce("level", F.lit(0)).alias("level"), "size", "lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def titles(spark, sf):
    """Titles from a manifest, metadata, the largest block or the key, and the title's lines that are no headings."""
    docs = R.documents(spark, sf).select(F.col("id").alias("doc"), F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("stem"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.select("doc", "stem", F.when(F.col("doc") % 4 == 1, F.concat(F.lit(" "), F.substring("text", 1, 90))).alias("manifest_title"), F.when(F.col("doc") % 4 == 2, F.when(F.col("doc") % 8 == 2, "paper.PDF").otherwise("A Title Given")).alias("meta_title"))
    found = H.resolve_titles(named, blocks(spark, sf))
    level = leveled(spark, sf)
    kept = H.drop_title_lines(level, found).groupBy("doc").agg(F.count("level").alias("headings"))
    return found.join(kept, "doc", "left").select("doc", "origin", F.md5(F.col("title").cast("binary")).alias("title_md5"), F.coalesce("headings", F.lit(0)).alias("headings"))


QUERIES = {"q_heading_levels": heading_levels, "q_wrapped_blocks": wrapped_blocks, "q_titles": titles}

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SHORT = "trim(substr(text, 1, 40))"
_MADE = "CASE length(text) % 8 " + " ".join(
    f"WHEN {k} THEN '{form.split('{}')[0]}' || {f"translate({_SHORT}, '{string.ascii_lowercase}', '{string.ascii_uppercase}')" if k in (1, 3) else _SHORT} || '{form.split('{}')[1]}'" for k, form in enumerate(_MAKES[:-1])
) + " ELSE 'Results' END"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_SECTION = "list_contains(" + _LIST(H.SECTIONS) + ", {0})"
_RATIO = r"CASE WHEN length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace({0}, '[^\p{{Lu}}]', '', 'g'))::DOUBLE / length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) ELSE 0 END"
_LONG = r"list_filter(regexp_extract_all(rest, '\S+'), lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 4 AND NOT list_contains(" + _LIST(H.SMALL_WORDS) + ", lower(w)))"
_BLOCKS = rf"""{A._BLOCKS},
made AS MATERIALIZED (SELECT doc, page, y AS ord, {_MADE} AS text, CASE length(text) % 5 WHEN 0 THEN 14.0 WHEN 1 THEN 12.6 ELSE 10.0 END::DOUBLE AS size, length(text) % 3 <> 0 AS bold, length(text) % 4 = 0 AS medi, x0, y * {STEP} AS y0, y * {STEP} + 10 AS y1 FROM blocks),
p AS (SELECT *, regexp_extract(text, '{H.NUMBERED}', 1) AS number, {_STRIP.format(f"regexp_extract(text, '{H.NUMBERED}', 2)")} AS rest, regexp_extract(text, '{H.LETTERED}', 1) AS letter, {_STRIP.format(f"regexp_extract(text, '{H.LETTERED}', 2)")} AS after, {_STRIP.format("text")} AS line FROM made),
leveled AS MATERIALIZED (SELECT *, CASE WHEN line <> '' AND length(line) <= 120 AND NOT regexp_matches(line, '[.,;]$') AND regexp_matches(text, '[A-Za-z]{{3,}}') THEN CASE
  WHEN number <> '' THEN CASE WHEN TRY_CAST(string_split(number, '.')[1] AS INT) <= 30 AND regexp_matches(rest, '^\p{{Lu}}') AND NOT regexp_matches(rest, '{H.SIGNS}') AND NOT regexp_matches(rest, '{H.BARE_SIGN}')
      AND length(regexp_replace(rest, '[^\p{{L}}]', '', 'g')) >= 0.5 * length(replace(rest, ' ', '')) AND ((regexp_matches(rest, '\p{{Lu}}') AND NOT regexp_matches(rest, '\p{{Ll}}')) OR len({_LONG}) = 0 OR len(list_filter({_LONG}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= 0.6 * len({_LONG})) THEN len(string_split(number, '.')) END
  ELSE coalesce(
    CASE WHEN letter <> '' AND length(after) <= 70 AND NOT contains(after, ',') AND len(regexp_extract_all(after, '\S+')) <= 10 AND regexp_matches(after, '^\p{{Lu}}') THEN CASE WHEN regexp_matches(letter, '^[IVXLCDM]+$') AND {_RATIO.format("after")} >= 0.8 THEN 1 WHEN length(letter) = 1 AND {_RATIO.format("after")} < 0.8 THEN 2 END END,
    CASE WHEN {_SECTION.format("lower(regexp_replace(line, ':+$', ''))")} THEN 1 END, CASE WHEN bold AND size >= 11.5 THEN CASE WHEN size >= 14 THEN 1 WHEN size >= 12.5 THEN 2 ELSE 3 END END, CASE WHEN medi AND length(text) <= 60 AND NOT contains(text, ',') THEN 2 END) END END AS level FROM p)"""
_NEAR = f"b.y0 - r.y1 >= 0 AND b.y0 - r.y1 < {H.GAP} * {HEIGHT} AND abs(b.x0 - r.x0) < {H.COLUMN} * {A.WIDTH} AND abs(r.size - b.size) < {H.SIZE}"
_HEADS = f"r.level IS NOT NULL AND b.level IS NOT NULL AND NOT regexp_matches(b.text, '{H.NUMBERED}') AND NOT regexp_matches(b.text, '{H.LETTERED}')"
_PROSE = r"r.level IS NULL AND b.level IS NULL AND NOT regexp_matches(regexp_replace(r.text, '\s+$', ''), '[.!?:]$')"
_PLAIN = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^[:.,]+|[:.,]+$', '', 'g'))"

SQL = {
    "q_heading_levels": f"WITH {_BLOCKS} SELECT doc, page, ord, coalesce(level, 0) AS level FROM leveled",
    "q_wrapped_blocks": f"""WITH RECURSIVE {_BLOCKS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY ord) AS k FROM leveled),
w AS (
  SELECT doc, page, k, ord, text, level, size, x0, y1, 1 AS lines, ord AS run FROM o WHERE k = 1
  UNION ALL
  SELECT b.doc, b.page, b.k, b.ord, CASE WHEN j THEN r.text || CASE WHEN r.level IS NOT NULL THEN ' ' ELSE chr(10) END || b.text ELSE b.text END, CASE WHEN j THEN r.level ELSE b.level END, CASE WHEN j THEN greatest(r.size, b.size) ELSE b.size END,
    CASE WHEN j THEN r.x0 ELSE b.x0 END, CASE WHEN j THEN r.y1 ELSE b.y1 END, CASE WHEN j THEN r.lines + 1 ELSE 1 END, CASE WHEN j THEN r.run ELSE b.ord END
  FROM w r JOIN o b ON b.doc = r.doc AND b.page = r.page AND b.k = r.k + 1, LATERAL (SELECT {_NEAR} AND (({_HEADS}) OR ({_PROSE})) AS j)
) SELECT doc, page, run AS ord, coalesce(level, 0) AS level, size, lines, md5(text) AS text_md5 FROM w QUALIFY row_number() OVER (PARTITION BY doc, page, run ORDER BY k DESC) = 1""",
    "q_titles": f"""WITH {_BLOCKS}, top AS (SELECT doc, arg_max({_STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")}, struct_pack(a := size, b := -ord)) AS largest FROM (SELECT * FROM made QUALIFY page = min(page) OVER (PARTITION BY doc)) GROUP BY doc),
n AS (SELECT doc_id AS doc, nullif({_STRIP.format("CASE WHEN doc_id % 4 = 1 THEN substr(coalesce(text, ''), 1, 90) END")}, '') AS given, CASE WHEN doc_id % 4 = 2 AND doc_id % 8 <> 2 THEN 'A Title Given' END AS meta, nullif(largest, '') AS largest, 'doc-' || doc_id AS stem FROM documents LEFT JOIN top ON doc = doc_id),
t AS (SELECT doc, coalesce(given, meta, largest, stem) AS title, CASE WHEN given IS NOT NULL THEN 'manifest' WHEN meta IS NOT NULL THEN 'metadata' WHEN largest IS NOT NULL THEN 'largest' ELSE 'stem' END AS origin FROM n),
h AS (SELECT l.doc, l.page, l.ord, level IS NOT NULL AS heading, page = min(page) OVER (PARTITION BY l.doc) AS first, length({_PLAIN.format("text")}) >= 4 AND NOT {_SECTION.format(_PLAIN.format("text"))} AND contains({_PLAIN.format("title")}, {_PLAIN.format("text")}) AS part FROM leveled l JOIN t ON t.doc = l.doc),
k AS (SELECT *, max((heading AND first AND NOT part)::INT) OVER (PARTITION BY doc ORDER BY page, ord ROWS UNBOUNDED PRECEDING) AS other FROM h)
SELECT t.doc, origin, md5(title) AS title_md5, coalesce(c, 0) AS headings FROM t LEFT JOIN (SELECT doc, count(*) FILTER (heading AND (NOT first OR other = 1)) AS c FROM k GROUP BY doc) k ON k.doc = t.doc""",
}
