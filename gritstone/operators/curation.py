"""Preparing, selecting and reviewing rows: normal forms, prices, samples, queues, gates and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.operators.governance import upsert

# Words that point back to a text, words that point into one, and sections without substance.
BACK_REFERENCES = r"(?i)\b(the passage|the text|the study|the paper|this section|according to the (passage|text|excerpt|document))\b"
GENERIC = "figure fig table section sec equation eq appendix algorithm theorem lemma step stage phase".split()
THIN_SECTION = r"(?i)reference|bibliograph|acknowledg|author|affiliation|appendix"
SUSPECT_MARKER = r"[【［〔]\s*\d{1,3}\s*[】］〕]|\(\s*[Ss]\d{1,3}\s*\)"
MIN_TOKENS, CLAMP = 150, 1e-7


def normalize_whitespace(text: Column) -> Column:
    """Words broken by a hyphen joined, single line ends and runs of blanks one blank, blank lines one."""
    joined = F.regexp_replace(text, r"([A-Za-z0-9_])-\s*\n\s*([A-Za-z0-9_])", "$1$2")
    lines = F.translate(F.regexp_replace(joined, r"\n{2,}", "\u0001"), "\n", " ")
    return F.regexp_replace(F.replace(F.regexp_replace(lines, "[ \t ]+", " "), F.lit("\u0001"), F.lit("\n\n")), r"^\s+|\s+$", "")


def normalize_code(text: Column) -> Column:
    """Indents stay; blanks at line ends go, and so do line ends at both ends and blank lines beyond one."""
    plain = F.translate(F.regexp_replace(text, "\r\n?", "\n"), " ", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+(\n|$)", "$1"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def normalize_block(text: Column, kind: Column) -> Column:
    return F.when(kind == "code", normalize_code(text)).otherwise(normalize_whitespace(text))


def _named(question: Column, strip: str) -> Column:
    bare = F.transform(F.slice(F.split(F.trim(question), r"\s+"), F.lit(2), F.lit(2_000_000_000)), lambda w: F.regexp_replace(w, f"^[{strip}]+|[{strip}]+$", ""))
    return F.filter(bare, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(T.STOPWORDS))


def names_something(question: Column) -> Column:
    """A quoted title, or past the first word an acronym, a capitalised or a digit-bearing term."""
    term = F.exists(_named(question, r"""(),.?:;'\""""), lambda w: ~F.lower(w).isin(GENERIC) & w.rlike("^[A-Z]|[A-Z].*[A-Z]|[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"))
    return question.rlike("""\"[^"]{3,}\"|“[^”]{3,}”|'[^']{8,}'""") | term


def names_nothing(question: Column) -> Column:
    """A back-reference, and neither a quoted title nor a capitalised term past the first word."""
    return question.rlike(BACK_REFERENCES) & ~question.rlike("""\"[^"]{3,}\"|“[^”]{3,}”""") & ~F.exists(_named(question, r"(),.?:;"), lambda w: w.rlike("^[A-Z]"))


def logit(p: Column) -> Column:
    clamped = F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1 - CLAMP))
    return F.log(clamped / (1 - clamped))


def resolve_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model), (model, place, price) -> model, price_key: the entry of the same name, of the name without its
    provider, the first of which one name begins with the other, or the provider's; null if there is none."""
    bare, provider = F.regexp_replace("model", "^[^:]*:", ""), F.when(F.instr("model", ":") > 0, F.substring_index("model", ":", 1))
    p = prices.select(F.col("model").alias("price_key"), "place")
    asked = models.select("model", bare.alias("bare"), provider.alias("provider")).distinct()
    level = (
        F.when(F.col("price_key") == F.col("model"), 1).when(F.col("price_key") == F.col("bare"), 2)
        .when(F.col("bare").startswith(F.col("price_key")) | F.col("price_key").startswith(F.col("bare")), 3).when(F.col("price_key") == F.col("provider"), 4)
    )
    found = asked.join(F.broadcast(p), level.isNotNull(), "left")  # a price list is a page, not a corpus
    return found.withColumn("level", level).groupBy("model").agg(F.min_by("price_key", F.struct("level", "place")).alias("price_key"))


def eligible(chunks: DataFrame, tokens: str = "token_count", section: str = "section") -> DataFrame:
    return chunks.where((F.col(tokens) >= MIN_TOKENS) & ~F.coalesce(F.col(section), F.lit("")).rlike(THIN_SECTION))


def spread_sample(chunks: DataFrame, n: int, seed: str = "spread-1") -> DataFrame:
    """(doc, section, id) -> ``n`` chunks in turns over the documents, one of each section of a document."""
    at = lambda c: F.md5(F.concat(F.lit(seed + "|"), c.cast("string")).cast("binary"))
    one = chunks.groupBy("doc", "section").agg(F.min_by("id", F.struct(at(F.col("id")), "id")).alias("id"))
    turns = one.withColumn("turn", F.row_number().over(Window.partitionBy("doc").orderBy("section")))
    return turns.orderBy("turn", at(F.col("doc")), "doc").limit(n)


def first_acceptable(hits: DataFrame, excluded: DataFrame, accepted: DataFrame) -> DataFrame:
    """(qid, id, rank) -> qid, first: the rank of the first accepted hit, excluded ones not counting."""
    left = hits.join(excluded.select("id"), "id", "left_anti")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    good = ranked.join(accepted.select("id").withColumn("good", F.lit(True)), "id", "left")
    return good.groupBy("qid").agg(F.min(F.when(F.col("good"), F.col("rank"))).cast("long").alias("first"))


def provenance(lists: DataFrame, fused: DataFrame) -> DataFrame:
    """Fused hits (qid, id, rank, score) with each list's rank and score, and who found them."""
    of = lambda column, source: F.max(F.when(F.col("source") == source, F.col(column))).alias(f"{source}_{column}")
    each = lists.groupBy("qid", "id").agg(*(of(c, s) for s in ("dense", "sparse") for c in ("rank", "score")))
    by = F.when(F.col("dense_rank").isNull(), "sparse").when(F.col("sparse_rank").isNull(), "dense").otherwise("hybrid")
    return fused.join(each, ["qid", "id"]).withColumn("retriever", by)


def relevance_gate(reranked: DataFrame, least: float) -> DataFrame:
    """qid, best, status: a query whose best rerank score is below ``least`` has no context; one without scores passes."""
    best = reranked.groupBy("qid").agg(F.max("score").alias("best"))
    return best.withColumn("status", F.when(F.col("best") < least, "refused_no_context").otherwise("pass"))


def upsert_vectors(old: DataFrame, new: DataFrame, dim: int, order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` (id, v) in place of those of the same id; another dimension is an error.

    Of new rows of one id the last by ``order`` counts, else the one of the greatest vector.
    """
    checked = new.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit(f"a vector is not of dimension {dim}"))))
    return upsert(old, checked, "id", order)


def flatten_metadata(metadata: Column) -> Column:
    """A map's entries that have a value, each key with ``x_`` before it."""
    return F.transform_keys(F.map_filter(metadata, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit("x_"), k))


def unflatten_metadata(flat: Column) -> Column:
    return F.transform_keys(F.map_filter(flat, lambda k, v: k.startswith("x_")), lambda k, v: F.substr(k, F.lit(3)))
