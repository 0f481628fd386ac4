"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The function words that keyword search leaves out.
STOPWORDS = (
    "a an the of in on at to for with by from as that this these those it its and or but if then than so such what which who whom how why when "
    "where does do did can could should would will shall may might must have has had having be been being was were are is am i we you he she "
    "they them his her their our your my me us not no nor also into over under between out up down off again further once here there all any "
    "both each few more most other some only own same too very s t can will just don now"
).split()
# The function words that claim checking leaves out.
CLAIM_STOPWORDS = (
    "the a an and or but if then than that this these those of in on at to for with by from as is are was were be been being it its "
    "their our we they he she which who whom when where how why what can could should would will may might must have has had do does did also "
    "both each more most other such some any there here over under between about into through during"
).split()
# Invisible characters, and characters that stand for a blank, a hyphen or a quote.
ZERO_WIDTH = "​‌‍⁠﻿"
BLANKS = "            "
HYPHENS = "‐‑‒–−"
QUOTES, PLAIN_QUOTES = "‘’“”", "''\"\""

TOKEN, PART = r"[a-z0-9]+(?:[-._][a-z0-9]+)*", "[a-z0-9]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_blanks(text: Column) -> Column:
    """Without Unicode's blanks at both ends, as SQL engines trim; line ends stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def words(items: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in dict.fromkeys(items)))


def tokenize(text: Column) -> Column:
    """Lower-case tokens without stopwords; a compound is followed by its parts of two characters or more.

    Stopwords are looked up in a hash set, which Spark makes of a long list of literals.
    """
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda x: ~x.isin(STOPWORDS))

    def with_parts(x: Column) -> Column:
        parts = F.filter(F.split(x, "[-._]"), lambda p: ~p.isin(STOPWORDS) & (F.length(p) > 1))
        return F.when(F.translate(x, "-._", "") != x, F.concat(F.array(x), parts)).otherwise(F.array(x))

    return F.flatten(F.transform(kept, with_parts))


def explode_tokens(rows: DataFrame, text: str) -> DataFrame:
    """A row with ``term`` for each token that ``tokenize`` gives: exploded first, filtered in generated code after."""
    found = rows.withColumn("term", F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))).drop(text).where(~F.col("term").isin(STOPWORDS))
    parts = F.filter(F.split("term", "[-._]"), lambda p: ~p.isin(STOPWORDS) & (F.length(p) > 1))
    compound = F.translate("term", "-._", "") != F.col("term")
    return found.withColumn("term", F.explode(F.when(compound, F.concat(F.array("term"), parts)).otherwise(F.array("term"))))


def token_set(text: Column) -> Column:
    """Distinct runs of letters a-z and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(PART), F.lit(0)))


def content_words(text: Column) -> Column:
    """Distinct ASCII words of three letters or more that aren't function words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]*"), F.lit(0)), lambda w: ~w.isin(CLAIM_STOPWORDS) & (F.length(w) > 2)))


def count_tokens(text: Column) -> Column:
    """The offline token estimate: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    return F.substring(text, F.lit(1), (tokens * 4).cast("int"))


def document_key(source: Column) -> Column:
    return F.substring(F.sha1(source.cast("binary")), 1, 16)


def chunk_key(doc: Column, index: Column) -> Column:
    return F.format_string("%s::%05d", doc, index)


def sentences(text: Column) -> Column:
    """Parts that begin after ``. ! ?``, a closing quote if any, and white space, before a capital or an opening mark."""
    marked = F.regexp_replace(text, r"""([.!?])["')\]]?\s+([A-Z(\["'])""", "$1\u001e$2")
    # a lambda of one argument: ``F.trim`` itself would be given the place too, as characters to take off
    return F.filter(F.transform(F.split(marked, "\u001e"), lambda s: trim_blanks(s)), lambda s: s != "")


def normalize_typography(text: Column) -> Column:
    plain = F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")
    return F.translate(plain, BLANKS + HYPHENS + QUOTES, " " * len(BLANKS) + "-" * len(HYPHENS) + PLAIN_QUOTES)


def normalize_markers(text: Column) -> Column:
    """Citation markers in full-width or CJK brackets, or with blanks inside, as ``[S1]``."""
    wide = F.regexp_replace(normalize_typography(text), r"[【［〔﹝⁅]\s*[Ss]\s*(\d{1,3})[^】］〕﹞⁆]*[】］〕﹞⁆]", "[S$1]")
    return F.regexp_replace(wide, r"\[[ \t]*[Ss][ \t]*(\d{1,3})[ \t]*\]", "[S$1]")


def markers(text: Column) -> Column:
    """Distinct marker numbers in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[S(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))


def strip_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\[S\d{1,3}\]", ""))


def locator(title: Column, section: Column, first: Column, last: Column) -> Column:
    pages = F.when(first.isNull(), None).when(last.isNull() | (first == last), F.format_string("p. %d", first)).otherwise(F.format_string("pp. %d-%d", first, last))
    return F.concat_ws(" | ", title, F.when(F.size(section) > 0, F.array_join(section, " > ")), pages)


def question_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens occur in a row; an empty phrase does not."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 0 if they share nothing."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(both > 0, 2 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))
