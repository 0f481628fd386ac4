"""Headings by number, size and font, blocks that belong together, titles.

A page's blocks are put together in one fold over its few blocks, in the JVM: what follows on from a run (a
heading's next line, or a paragraph that did not end) joins it while the gap to where the run began, the
size and the column are near. Lines that repeat a part of the title at the beginning of a document are no headings.

Edge cases: null texts are blank and no headings; an unknown body size (null or nought) leaves numbers, letters and standard
names to decide; a document without blocks, manifest and metadata is called by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T

# Names of sections; words that titles leave in lower case; signs of formulas; fonts of headings; tolerances.
SECTIONS = (
    "abstract", "introduction", "related work", "background", "method", "methods", "methodology", "experiments", "experiment", "results", "discussion", "conclusion", "conclusions",
    "limitations", "references", "bibliography", "acknowledgements", "acknowledgments", "appendix",
)
SMALL_WORDS = "a an the of in on for to and or with from by as is are into via vs at using".split()
SIGNS, BARE_SIGN = "[≤≥±×÷≈≠∈∑∏∫√∞→←↔∀∃∇∂⊂⊆∪∩]", r"(?:^|\s)[=<>](?:\s|$)"
NUMBERED, LETTERED, HEADING_FONT = r"^(\d+(?:\.\d+){0,3})[.\s]+(\S.*)$", r"^([A-Z]{1,6})\.\s+(\S.*)$", "(?i)(medi|bold|bd|black|semibold)"
GAP, COLUMN, SIZE = 0.12, 0.05, 0.6


def upper_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def numbered_rest(rest: Column) -> Column:
    """Whether what follows a section number reads as a title: a capital first, no formula, mostly letters, and all capitals
    or six tenths of the long words capitalised."""
    text = T.strip(rest)
    compact = F.replace(text, F.lit(" "), F.lit(""))
    long = F.filter(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda w: (F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 4) & ~F.lower(w).isin(SMALL_WORDS))
    titled = F.size(F.filter(long, lambda w: w.rlike(r"^\p{Lu}"))) >= 0.6 * F.size(long)
    shouted = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    sound = text.rlike(r"^\p{Lu}") & ~text.rlike(SIGNS) & ~text.rlike(BARE_SIGN) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 0.5 * F.length(compact))
    return sound & (shouted | (F.size(long) == 0) | titled)


def lettered_rest(rest: Column) -> Column:
    """Whether what follows "I. " or "A. " reads as a title: one to ten words, no comma, a capital first."""
    text = T.strip(rest)
    return (F.length(text) <= 70) & ~F.contains(text, F.lit(",")) & (F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) <= 10) & text.rlike(r"^\p{Lu}")


def heading_level(text: Column, size: Column, body: Column, bold: Column, font: Column, body_font: Column) -> Column:
    """1 to 4 of what is a heading by its form, null otherwise: section numbers, then letters, standard names, size, font."""
    text = F.coalesce(text, F.lit(""))
    number, rest = F.regexp_extract(text, NUMBERED, 1), F.regexp_extract(text, NUMBERED, 2)
    letter, after = F.regexp_extract(text, LETTERED, 1), F.regexp_extract(text, LETTERED, 2)
    depth = F.size(F.split(number, r"\."))
    by_number = F.when((F.try_element_at(F.split(number, r"\."), F.lit(1)).try_cast("int") <= 30) & numbered_rest(rest), depth)
    by_letter = F.when(lettered_rest(after), F.when(letter.rlike("^[IVXLCDM]+$") & (upper_ratio(after) >= 0.8), 1).when((F.length(letter) == 1) & (upper_ratio(after) < 0.8), 2))
    named = F.lower(F.regexp_replace(T.strip(text), ":+$", "")).isin(*SECTIONS)
    ratio = size / F.when(body > 0, body)
    by_size = F.when((ratio >= 1.15) & bold, F.when(ratio >= 1.4, 1).when(ratio >= 1.25, 2).otherwise(3))
    fonts = (font != "") & (body_font != "") & (font != body_font) & font.rlike(HEADING_FONT)
    by_font = F.when(fonts & (F.length(text) <= 60) & ~F.contains(text, F.lit(",")) & (ratio >= 0.85), 2)
    form = F.coalesce(F.when(letter != "", by_letter), F.when(named, 1), by_size, by_font)
    line = T.strip(text)
    shaped = (line != "") & (F.length(line) <= 120) & (F.size(F.split(line, "\n")) <= 2) & ~line.rlike("[.,;]$")
    return F.when(shaped & text.rlike("[A-Za-z]{3,}"), F.when(number != "", by_number).otherwise(form)).cast("int")


def starts_heading(text: Column) -> Column:
    return text.rlike(NUMBERED) | text.rlike(LETTERED)


def merge_blocks(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """(doc, page, ord, text, level, size, x0, y0, y1) in reading order -> doc, page, ord, text, level, size, lines of the runs.

    ``level`` is the block's own heading level. A run keeps the place where it began, and its greatest size.
    """
    fields = [F.col("ord").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text"), F.col("level").cast("int").alias("level"), *(F.col(c).cast("double").alias(c) for c in ("size", "x0", "y0", "y1")), F.lit(1).alias("lines")]
    listed = blocks.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("b"))
    kind = "struct<ord:bigint,text:string,level:int,size:double,x0:double,y0:double,y1:double,lines:int>"
    none = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("run"))

    def add(s: Column, b: Column) -> Column:
        run = s["run"]
        gap = b["y0"] - run["y1"]
        near = (gap >= 0) & (gap < GAP * height) & (F.abs(b["x0"] - run["x0"]) < COLUMN * width) & (F.abs(run["size"] - b["size"]) < SIZE)
        heading = run["level"].isNotNull() & b["level"].isNotNull() & ~starts_heading(b["text"])
        prose = run["level"].isNull() & b["level"].isNull() & ~F.regexp_replace(run["text"], r"(?U)\s+$", "").rlike("[.!?:]$")
        joins = F.coalesce(near & (heading | prose), F.lit(False)) & run.isNotNull()
        longer = F.struct(
            run["ord"].alias("ord"), F.concat(run["text"], F.when(heading, " ").otherwise("\n"), b["text"]).alias("text"), run["level"].alias("level"), F.greatest(run["size"], b["size"]).alias("size"),
            run["x0"].alias("x0"), run["y0"].alias("y0"), run["y1"].alias("y1"), (run["lines"] + 1).alias("lines"),
        )
        done = F.when(joins | run.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(run)))
        return F.struct(done.alias("done"), F.when(joins, longer).otherwise(b).cast(kind).alias("run"))

    merged = F.aggregate("b", none, add, lambda s: F.concat(s["done"], F.array(s["run"])))
    return listed.select("doc", "page", F.explode(merged).alias("r")).select("doc", "page", "r.ord", "r.text", "r.level", "r.size", "r.lines")


def continues_title(text: Column, title: Column) -> Column:
    """Whether a line is a part of the title: four characters or more, and no standard section."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(T.strip(c), r"(?U)\s+", " "), "^[:.,]+|[:.,]+$", ""))
    part = plain(text)
    return (F.length(part) >= 4) & ~part.isin(*SECTIONS) & F.contains(plain(title), part)


def drop_title_lines(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Blocks (doc, page, ord, text, level) with ``level`` null for those headings of a document's first page that continue
    its title (doc, title), up to the first that does not."""
    w = Window.partitionBy("doc").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, 0)
    joined = blocks.join(titles.select("doc", F.coalesce("title", F.lit("")).alias("__title")), "doc", "left")
    heading = F.col("level").isNotNull() & (F.col("page") == F.min("page").over(Window.partitionBy("doc")))
    other = F.max(F.when(heading & ~F.coalesce(continues_title(F.col("text"), F.col("__title")), F.lit(False)), 1)).over(w)
    return joined.withColumn("level", F.when(heading & other.isNull(), None).otherwise(F.col("level"))).drop("__title")


def resolve_titles(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, stem, manifest_title, meta_title), (doc, page, ord, text, size) -> doc, title, origin: the manifest's, else the
    metadata's unless that is a file name, a number or shorter than three, else the largest block of the first page, else the stem."""
    first = F.col("page") == F.min("page").over(Window.partitionBy("doc"))
    plain = T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    largest = blocks.withColumn("first", first).where("first").groupBy("doc").agg(F.max_by(plain, F.struct("size", -F.col("ord"))).alias("largest"))
    meta = T.strip(F.col("meta_title"))
    sound = F.when((F.length(meta) >= 3) & ~F.lower(meta).rlike(r"\.(pdf|docx?)$") & ~meta.rlike("^[0-9]+$"), meta)
    given = F.when(T.strip(F.col("manifest_title")) != "", T.strip(F.col("manifest_title")))
    found = docs.join(largest, "doc", "left").withColumn("largest", F.when(F.col("largest") != "", F.col("largest")))
    origin = F.when(given.isNotNull(), "manifest").when(sound.isNotNull(), "metadata").when(F.col("largest").isNotNull(), "largest").otherwise("stem")
    return found.select("doc", F.coalesce(given, sound, "largest", "stem").alias("title"), origin.alias("origin"))
