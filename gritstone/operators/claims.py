"""Claims held against passages: sentence claims, number sets, negations and lexical verdicts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import text as T

COVERAGE = 0.45

# Patterns of enumerators, references, numbers, contrasts and claims; negating words.
_BLANK = "    "
ENUM_PREFIX = r"^\s*[\(\[]?\s*(?:\d{1,2}|[ivxIVX]{1,4}|[a-zA-Z])\s*(?:[\)\]]\s*|\.\s+)"
INLINE_ENUM = r"(?<![^\s:])\(\s*(?:0?[1-9]|1\d|20|[ivxIVX]{1,4}|[a-zA-Z])\s*\)(?=\s+[A-Za-z])"
REFERENCE = r"(?i)\b(?:figure|fig|table|tab|section|sec|equation|eq|appendix|app|supplementary|algorithm|alg|step|item|re)\s*\.?\s*\(?[\dSivx]+(?:\.\d+)*\)?"
THOUSANDS = rf"(?<![\d.,])(?<!\d[{_BLANK}])(\d{{1,3}})((?:[{_BLANK}]\d{{3}})+)(?!\d)(?![{_BLANK}]\d)(?!-\w)(?![.,]\d)"
COMMA_THOUSANDS = r"(?<![\d.,])(\d{1,3})((?:,\d{3})+)(?!\d)(?!,\d)"
NUMBER = r"(?<![\w.])[-+]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?%?(?!\w)"
ANY_NUMBER = r"-?(?:\d+(?:\.\d+)?|(?<![\w.])\.\d+)"
CONTRAST = r"(?i)\b(?:otherwise|rather\s+than|instead\s+of|in\s+contrast|by\s+contrast|as\s+opposed\s+to|unlike|conversely)\b"
WORD = r"[A-Za-z][A-Za-z0-9\-_]*"
NEGATIONS = (
    "not no never none neither nor without cannot cant doesnt dont isnt arent wasnt werent fails fail failed unable absent lacks lack "
    "nothing unsupported insufficient worse degrades decreases"
).split()
_ABBREVIATIONS = (
    r"(?<!\be\.g)(?<!\bi\.e)(?<!\bet\sal)(?<!\bcf)(?<!\bvs)(?<!\bapprox)(?<!\bFig)(?<!\bFigs)(?<!\bEq)(?<!\bEqs)(?<!\bSec)(?<!\bSecs)"
    r"(?<!\bTab)(?<!\bRef)(?<!\bRefs)(?!(?<=\bNo)\.\s*\d)(?<!\b[A-Za-z]\.[A-Za-z])"
)
CLAIM = rf"(?s)(.+?{_ABBREVIATIONS}(?<!\.\s)[.!?](?!\s*[.!?])[\"')\]]?)((?:\s*\[S\d{{1,3}}\])*)(?=\s|$)"


def _merged(text: Column, pattern: str, dropped: str) -> Column:
    """Grouped digits without what stands between the groups: matches are marked, then mended one by one."""
    marked = F.split(F.regexp_replace(text, pattern, "\u0002$1$2\u0002"), "\u0002")
    return F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, f"[{dropped}]", "")).otherwise(x)), "")


def _canonical(number: Column) -> Column:
    """Six significant digits, whatever the way of writing."""
    return F.format_string("%.5e", number.cast("double") + F.lit(0.0))


def claimed_numbers(text: Column) -> Column:
    """Quantities that a claim asserts: enumerators and cross-references are none, grouped thousands are one."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ENUM_PREFIX, ""), REFERENCE, " "), INLINE_ENUM, " ")
    found = F.regexp_extract_all(_merged(plain, THOUSANDS, _BLANK), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: _canonical(F.translate(x, "%+", ""))))


def evidence_numbers(text: Column) -> Column:
    """Every number that a passage can be read to hold, those within identifiers and of either sign included."""
    commas = _merged(text, COMMA_THOUSANDS, ",")
    loose = F.concat(*(F.regexp_extract_all(t, F.lit(ANY_NUMBER), F.lit(0)) for t in (_merged(commas, THOUSANDS, _BLANK), text)))
    both = F.concat(F.transform(loose, _canonical), F.transform(loose, lambda x: _canonical(F.abs(x.cast("double")))))
    return F.array_distinct(F.concat(claimed_numbers(text), claimed_numbers(commas), both))


def content_words(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(T.CLAIM_STOPWORDS) & (F.length(w) > 2)))


def negates(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    return F.exists(found, lambda w: w.isin(NEGATIONS))


def split_claims(text: Column) -> Column:
    """array<struct<claim, markers>>: sentences with the markers they cite; what holds no word goes to the one before."""
    body = F.trim(T.normalize_markers(F.coalesce(text, F.lit(""))))
    pieces = F.split(F.regexp_replace(body, CLAIM, "$0\u001e"), "\u001e")
    made = F.transform(pieces, lambda p: F.struct(T.strip_markers(p).alias("claim"), F.transform(F.regexp_extract_all(p, F.lit(r"\[S(\d{1,3})\]"), F.lit(1)), lambda m: m.cast("int")).alias("markers")))
    none = F.array().cast("array<struct<claim:string,markers:array<int>>>")

    def add(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        joined = F.struct(F.trim(F.concat_ws(" ", last["claim"], x["claim"])).alias("claim"), F.concat(last["markers"], x["markers"]).alias("markers"))
        return (
            F.when(x["claim"].rlike("[A-Za-z]{2,}"), F.concat(kept, F.array(x)))
            .when(F.size(kept) > 0, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(joined)))
            .otherwise(kept)
        )

    return F.transform(F.aggregate(made, none, add), lambda c: F.struct(c["claim"].alias("claim"), F.sort_array(F.array_distinct(c["markers"])).alias("markers")))


def judge(pairs: DataFrame, claim: str = "claim", evidence: str = "evidence", least: float = COVERAGE) -> DataFrame:
    """Adds coverage, numbers_ok, negation_ok, ambiguous, supported, escalate and reason to rows of claim and evidence.

    In order: an empty passage supports nothing; numbers that the passage lacks and negations that it
    does not make fail; a contrast in the passage leaves a negation open; coverage of the claim's words
    decides the rest. Claims near the threshold, or with an open negation, are worth a closer judge
    (``escalate``). Nulls are empty texts.
    """
    said, held = (T.normalize_typography(F.coalesce(F.col(c), F.lit(""))) for c in (claim, evidence))
    want = content_words(said)
    out = pairs.withColumn("coverage", F.round(F.when(F.size(want) > 0, F.size(F.array_intersect(want, content_words(held))) / F.size(want)).otherwise(0.0), 6))
    out = out.withColumn("numbers_ok", F.size(F.array_except(claimed_numbers(said), evidence_numbers(held))) == 0)
    mismatch = negates(said) & ~negates(held)
    out = out.withColumn("ambiguous", mismatch & held.rlike(CONTRAST)).withColumn("negation_ok", ~mismatch | F.col("ambiguous"))
    cited = F.coalesce(F.col(evidence), F.lit("")) != ""
    sound = cited & F.col("numbers_ok") & F.col("negation_ok")
    score = F.round("coverage", 3)
    near = score.between(least / 2, min(1.0, least * 1.6)) & (score < min(1.0, least * 1.6))
    reason = F.when(~cited, "no citation").when(~F.col("numbers_ok"), "figures absent").when(~F.col("negation_ok"), "negates the passage").when(F.col("coverage") < least, "low coverage").otherwise("covered")
    return out.withColumns({"supported": sound & (F.col("coverage") >= least), "escalate": sound & (near | (F.col("ambiguous") & (score >= least / 2))), "reason": reason})
