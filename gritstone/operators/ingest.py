"""Routing, restoring and sectioning of sources; query synthesis, attribution and run feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.functions import text as T
from gritstone.operators.attribution import phrases_held


def route(uri: Column) -> Column:
    """The parser of a source: web addresses are html, else the suffix decides (a .txt is markdown)."""
    suffix = F.lower(F.regexp_extract(uri, r"(\.[^./]+)$", 1))
    return F.when(uri.rlike("^https?://"), "html").when(suffix == ".pdf", "pdf").when(suffix.isin(".md", ".markdown", ".mdx", ".txt"), "markdown").when(suffix.isin(".html", ".htm", ".xhtml"), "html").otherwise("unsupported")


def restore(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(key, sha256) against (key, content) -> key, state: ok, mismatch or missing."""
    have = files.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("mismatch")
    return manifest.join(have, "key", "left").select("key", state.alias("state"))


def heading_level(text: Column) -> Column:
    """1 to 4 by the depth of a leading section number, 1 for ALL CAPS or a roman number, 2 for a letter; null otherwise.

    At most 120 characters, no closing ``. , ;``; the rest of a numbered heading begins with a capital.
    """
    number = F.regexp_extract(text, r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+[A-Z]", 1)
    depth = F.size(F.split(number, r"\."))
    short = (F.length(text) <= 120) & ~text.rlike("[.,;]$")
    kind = F.when((number != "") & (F.split(number, r"\.")[0].cast("int") <= 30), depth).when(text.rlike(r"^[IVX]{1,4}\.\s+[A-Z][^,]{0,70}$"), 1).when(text.rlike(r"^[A-Z]\.\s+[A-Z][^,]{0,70}$"), 2).when(text.rlike("^[A-Z][A-Z ]{3,60}$"), 1)
    return F.when(short, kind).cast("int")


def section_paths(blocks: DataFrame, deepest: int = 4) -> DataFrame:
    """(doc, ord, text, level) -> ``path``: the open headings above each block; a heading closes its level
    and deeper ones, and isn't in its own path. One window per level, no fold."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks
    for k in range(1, deepest + 1):
        out = out.withColumn(f"_at{k}", F.max(F.when(F.col("level") <= k, F.col("ord"))).over(w)).withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.struct("ord", "text")), True).over(w))
    own = F.coalesce(F.col("level"), F.lit(deepest + 1))
    parts = [F.when((F.col(f"_h{k}")["ord"] == F.col(f"_at{k}")) & (F.lit(k) < own), F.col(f"_h{k}")["text"]) for k in range(1, deepest + 1)]
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop(*(f"_{n}{k}" for k in range(1, deepest + 1) for n in ("at", "h")))


def is_fragment(text: Column) -> Column:
    return (F.length(T.strip(text)) < 20) & ~text.rlike("[A-Za-z]{3,}")


def merge_runs(blocks: DataFrame, same: Column, by: str, order: str) -> DataFrame:
    """``run`` numbers stretches of rows for which ``same`` (against the row before, by lag) holds."""
    w = Window.partitionBy(by).orderBy(order)
    return blocks.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def salient_terms(text: Column, limit: int = 12) -> Column:
    """Distinct words of four letters or more that aren't stopwords, long ones first, then by alphabet."""
    stop = T.words(T.STOPWORDS)
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w)))
    ranked = F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda x: x["w"]), 1, limit)


def verbatim_query(text: Column, key: Column, seed: str) -> Column:
    """A sentence of 40 to 300 characters, chosen by a seeded hash of the key; null without one."""
    fit = F.filter(T.sentences(text), lambda s: F.length(s).between(40, 300))
    pick = F.conv(F.left(F.md5(F.concat(F.lit(seed + "|"), key.cast("string")).cast("binary")), F.lit(7)), 16, 10).cast("long")
    return F.when(F.size(fit) > 0, F.element_at(fit, (F.pmod(pick, F.size(fit)) + 1).cast("int")))


def named_documents(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, question) × (doc, name) -> qid, doc where the question holds the name's tokens in a row."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return phrases_held(questions.select("qid", plain(F.col("question")).alias("q")), names.select("doc", plain(F.col("name")).alias("phrase")))


def parse_verdict(reply: Column, schema: str) -> Column:
    """The first ``{`` to the last ``}`` of a reply, parsed; null if that isn't the object asked for."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema)


def feasibility(samples: DataFrame, requests: float, tokens: float, rpm: float, tpm: float, rpd: float, tpd: float) -> DataFrame:
    """(…, n) -> minutes that n samples take under per-minute and per-day limits, and the limit that binds."""
    r, t = F.bround(F.col("n") * F.lit(requests)), F.bround(F.col("n") * F.lit(tokens))
    found = {"requests_per_minute": r / rpm, "tokens_per_minute": t / tpm, "requests_per_day": r / rpd * 1440, "tokens_per_day": t / tpd * 1440}
    most = F.greatest(*found.values())
    which = F.coalesce(*(F.when(v == most, k) for k, v in found.items()))
    return samples.withColumn("minutes", F.round(most, 6)).withColumn("limit", which)
