"""From ranked passages to an answer's status: rendered context and its inverse, citations, the refusal chain.

A context is one text of blocks ``[S1] (locator)``, passage, blank line; its markers are what an answer
cites. ``parse_context`` recovers marker, header and passage from any prompt that holds such blocks.

``decide`` is the chain: rules in order, of which the first that fails gives status and reason. A rule is a
condition on facts of the question; facts that cost something are only found for the questions that are
``undecided`` by the rules before them.

Edge cases: a null passage is an empty one and its block a header alone, which parsing leaves out; a
question without passages has no row in a context; null answers are empty; repeated markers count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import text as T

# Tokens of a context; tokens a first passage keeps at least, and those set aside for its header;
# words that head the instructions after a context; statuses and the word by which a model declines.
BUDGET, FLOOR, ASIDE = 1200, 50, 8
TAIL = "Question|QUESTION|Answer|ANSWER|CLAIM|Claim|Claims|CLAIMS|Task|TASK|Instructions|INSTRUCTIONS"
ANSWERED, NO_CONTEXT, BY_MODEL, MISATTRIBUTED, LOW_SUPPORT = "answered", "refused_no_context", "refused_by_model", "refused_misattributed", "refused_low_support"
SENTINEL = "INSUFFICIENT_CONTEXT"
# Separators that passages are freed of.
_BLOCK, _FIELD = "\u001e", "\u001f"


def render_context(hits: DataFrame, budget: int = BUDGET, locators: bool = True) -> DataFrame:
    """(qid, id, rank, locator, text) -> qid, context, used (id of each marker), dropped (ids), tokens.

    Passages go in by rank; one that doesn't fit is dropped and later ones may still fit, but a first one is cut
    to the budget. A question's hits are its top few, so they are folded in one row.
    """
    listed = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "locator", T.strip(F.coalesce("text", F.lit(""))).alias("body")))).alias("h"))
    ids = "array<bigint>"
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("blocks"), F.array().cast(ids).alias("used"), F.array().cast(ids).alias("dropped"))

    def add(s: Column, x: Column) -> Column:
        tag = F.concat(F.lit("[S"), (F.size(s["used"]) + 1).cast("string"), F.lit("]"))
        head = F.concat(tag, F.lit(" ("), F.coalesce(x["locator"], F.lit("")), F.lit(")")) if locators else tag
        block = F.concat(head, F.lit("\n"), x["body"])
        total, fits, first = s["total"] + T.count_tokens(block) + 1, s["total"] + T.count_tokens(block) + 1 <= budget, F.size(s["used"]) == 0
        room = F.greatest(F.lit(FLOOR).cast("long"), budget - T.count_tokens(head) - ASIDE)
        short = F.concat(head, F.lit("\n"), T.truncate_to_tokens(x["body"], room))
        return F.struct(
            F.when(fits, total).when(first, T.count_tokens(short)).otherwise(s["total"]).alias("total"),
            F.when(fits, F.concat(s["blocks"], F.array(block))).when(first, F.array(short)).otherwise(s["blocks"]).alias("blocks"),
            F.when(fits | first, F.concat(s["used"], F.array(x["id"]))).otherwise(s["used"]).alias("used"),
            F.when(fits | first, s["dropped"]).otherwise(F.concat(s["dropped"], F.array(x["id"]))).alias("dropped"),
        )

    made = listed.select("qid", F.aggregate("h", start, add).alias("s"))
    return made.select("qid", F.array_join("s.blocks", "\n\n").alias("context"), "s.used", "s.dropped", F.col("s.total").alias("tokens"))


def parse_context(prompt: Column) -> Column:
    """array<struct<marker, header, body>> of the blocks in ``prompt``, instructions after the last one left out.

    Of blocks with the same marker the last counts, in the first one's place; blocks without a passage don't.
    """
    plain = F.translate(prompt, _BLOCK + _FIELD, "  ")
    marked = F.regexp_replace(plain, r"(?md)^[ \t]*\[S(\d{1,9})\][ \t]*([^\n]*)", f"{_BLOCK}$1{_FIELD}$2{_FIELD}")
    pieces = F.transform(F.slice(F.split(marked, _BLOCK), 2, 1_000_000), lambda p: F.split(p, _FIELD))

    def block(p: Column) -> Column:
        body = T.strip(F.regexp_replace(T.strip(p[2]), rf"(?s)\n\s*(?:{TAIL})\b[^\n]*:.*", ""))
        return F.struct(p[0].cast("int").alias("marker"), p[1].alias("header"), body.alias("body"))

    found = F.filter(F.transform(pieces, block), lambda b: b["body"] != "")
    order = F.array_distinct(F.transform(found, lambda b: b["marker"]))
    return F.transform(order, lambda m: F.element_at(F.filter(found, lambda b: b["marker"] == m), -1))


def passages(context: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of ``hits`` that a context used, with their ``marker``."""
    return context.select("qid", F.posexplode("used").alias("at", "id")).select("qid", "id", (F.col("at") + 1).alias("marker")).join(hits, ["qid", "id"])


def resolve_citations(answers: DataFrame, used: DataFrame) -> DataFrame:
    """(qid, answer), (qid, marker, …) -> qid, place, marker and the passage's columns, null where there is none (an unknown citation)."""
    text = T.normalize_markers(F.coalesce("answer", F.lit("")))
    cited = answers.select("qid", F.posexplode(T.markers(text)).alias("at", "marker")).select("qid", (F.col("at") + 1).alias("place"), "marker")
    return cited.join(used.withColumn("known", F.lit(True)), ["qid", "marker"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


Rule = tuple[str, Column, Column]


def decide(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``status`` and ``reason``: those of the first rule (status, fails, reason) that fails, else answered.

    Later rules stay unevaluated, and a condition that is null does not fail.
    """
    state = F.struct(F.lit(ANSWERED).alias("status"), F.lit(None).cast("string").alias("reason"))
    for status, fails, reason in reversed(rules):
        state = F.when(F.coalesce(fails, F.lit(False)), F.struct(F.lit(status).alias("status"), reason.alias("reason"))).otherwise(state)
    return facts.withColumn("__state", state).select("*", "__state.status", "__state.reason").drop("__state")


def undecided(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that no rule refuses."""
    passed = F.lit(True)
    for _, fails, _ in rules:
        passed = passed & ~F.coalesce(fails, F.lit(False))
    return facts.where(passed)


def retrieval_rules(gate: float | None) -> list[Rule]:
    """On ``passages`` (how many) and ``best`` (the greatest rerank score, null if unscored)."""
    rules = [(NO_CONTEXT, F.coalesce("passages", F.lit(0)) == 0, F.lit("retrieval returned no passages above threshold"))]
    if gate is not None:
        said = F.format_string(f"best passage scored %.2f for relevance to this question, below the {gate:.2f} threshold: the corpus does not appear to cover it", F.col("best"))
        rules.append((NO_CONTEXT, F.col("best") < gate, said))
    return rules


def reply_rules(sentinel: str = SENTINEL) -> list[Rule]:
    """On ``answer``, as the model gave it."""
    return [(BY_MODEL, F.contains(F.coalesce("answer", F.lit("")), F.lit(sentinel)), F.lit("model reported the passages do not support an answer"))]


def attribution_rules() -> list[Rule]:
    """On ``misattribution``, a reason of ``attribution.misattributed`` or null."""
    return [(MISATTRIBUTED, F.col("misattribution").isNotNull(), F.col("misattribution"))]


def support_rules(least: float) -> list[Rule]:
    """On ``claims`` and ``supported``; an answer without claims has nothing unsupported only if ``claims`` is null."""
    ratio = F.when(F.col("claims") > 0, F.col("supported") / F.col("claims")).otherwise(F.lit(0.0))
    said = F.concat(F.lit("only "), F.bround(ratio * 100).cast("int").cast("string"), F.lit(f"% of claims are supported by the retrieved passages (threshold {least:.0%})"))
    return [(LOW_SUPPORT, F.col("claims").isNotNull() & (ratio < least), said)]


def finalize(decided: DataFrame, refusal: str) -> DataFrame:
    """``text`` (the answer, or ``refusal``) and ``usage``: counts of what did not resolve, was uncited, checked and supported.

    On status, answer, unresolved, uncited, claims and supported; a refusal has no counts.
    """
    counts = {"unresolved_citations": F.col("unresolved"), "uncited_sentences": F.col("uncited"), "claims_checked": F.col("claims"), "claims_supported": F.when(F.col("claims") > 0, F.col("supported"))}
    entries = F.array(*(F.when((F.col("status") == ANSWERED) & ((n > 0) | ((F.lit(k) == "claims_supported") & (n >= 0))), F.struct(F.lit(k), n.cast("long"))) for k, n in counts.items()))
    usage = F.map_from_entries(F.array_compact(entries))
    return decided.withColumn("text", F.when(F.col("status") == ANSWERED, T.strip(T.normalize_markers(F.coalesce("answer", F.lit(""))))).otherwise(F.lit(refusal))).withColumn("usage", usage)
