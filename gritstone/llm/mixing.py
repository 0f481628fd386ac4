"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed into cells (source, language, topic). Every cell has a probability, first
``reach``; the axes in turn multiply the probabilities of each value by what the value's kept tokens
lack of its target, 1 at most, so that the cells that cannot give more leave the rest to the others.
A document is kept with its cell's probability, decided by a hash of its id: the tokens expected of
the sample have the wanted shares on each axis. ``reach`` is ``keep`` of the largest sample that the
scarcest value of any axis allows.

Default targets temper the corpus's own shares: share ** ``temper``, normalised, of which no value gets
more than ``boost`` times its own share, nor more than the values with the most want for their share do
that together hold over ``rare`` of the tokens (what is cut off goes to the others in proportion). So
the sample holds ``keep`` / ``boost`` of the corpus when each axis is looked at alone, and a stray document of a
source of its own changes next to nothing. Explicit targets are given per axis as {value: share} and
taken as they are, however small a sample they leave; a value without a share gets none, shares are
normalised over the values that the corpus has. ``residual`` says how far a fit is from its targets.

The topic is the form that a text's markers show, the first of ``topics`` of which one occurs, else
``prose``. (Topics named by the corpus's own words were tried: words belong to one language, so that
their shares and the languages' cannot be had together.)

Edge cases: a null source or language is the value ``(none)``; null and empty texts weigh no
tokens and share their cell's probability; cells without tokens or without a target get 0; a null id hashes as an
empty string; repeated documents are decided alike; texts of any length count by their characters, and
equal hashes are decided alike; an empty table gives an empty result; other columns stay and, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm.common import materialize

AXES = ("source", "lang", "topic")
TOPICS = (("licence", ("Licensed under", "Copyright", "All rights reserved")), ("table", (" | ",)), ("contact", ("@", "http")))
ROUNDS, TEMPER, BOOST, RARE, KEEP, SEED = 12, 0.7, 2.0, 0.01, 0.9, "mix-1"
#: Cells are raked in one partition up to this many, by shuffled sums beyond it.
ONE_PARTITION = 200_000
#: Rounds between two written tables, so that plans stay short.
_ROUNDS_A_PLAN = 4


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F.lit("prose")
    for name, markers in reversed(topics):
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(text, F.lit(m))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """The token estimate used throughout the library: a quarter of the characters, one at least."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(0).cast("long")


def _measures(docs: DataFrame, topics=TOPICS) -> dict[str, Column]:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    named = {a: F.coalesce(docs[a].cast("string"), F.lit("(none)")) for a in ("source", "lang")}
    return named | {"topic": topic_of(text, topics), "n_tokens": tokens_of(text)}


def _bounded(shares: DataFrame, temper: float, boost: float) -> DataFrame:
    """``raw``: the least of most * share and level * share ** temper, with the level at which they sum to one.

    Were the values with the most want for their share cut off, k of them, the level would be what is left over the
    others' wants; the true level is the greatest of these, for every k.
    """
    want = F.when(F.col("share") > 0, F.pow("share", F.lit(temper))).otherwise(0.0)
    order, whole = Window.orderBy(F.desc("ratio")), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each value of the axis
    ranked = shares.withColumn("want", want).where("want > 0").withColumn("ratio", F.col("want") / F.col("share"))
    held = F.sum("share").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    common = F.max(F.when(F.col("held") > RARE, F.col("ratio"))).over(whole) / F.sum("want").over(whole)
    most = ranked.withColumn("held", held).withColumn("most", F.least(F.lit(float(boost)), F.greatest(F.lit(1.0), common)))
    before = F.coalesce(F.sum("share").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0)) - F.sum("share").over(Window.partitionBy("ratio"))
    left = F.sum("want").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = most.withColumn("at", (1 - F.col("most") * before) / left).withColumn("level", F.max("at").over(whole))
    return leveled.withColumn("raw", F.least(F.col("most") * F.col("share"), F.col("level") * F.col("want")))


def _wanted(cells: DataFrame, total: int, targets, temper: float, boost: float) -> tuple[DataFrame, float]:
    """Cells with the share wanted for their value on each axis, and the largest share of all tokens that a
    sample with these shares can hold when each axis is looked at alone."""
    largest = 1.0
    for axis in AXES:
        shares = cells.groupBy(axis).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("share"))
        if targets and axis in targets:
            given = cells.sparkSession.createDataFrame(sorted(targets[axis].items()), f"{axis} string, raw double")
            found = shares.where("share > 0").join(F.broadcast(given), axis)
        else:
            found = _bounded(shares, temper, boost)
        found = materialize(found.select(axis, "share", "raw"), "mixing-shares")
        raw, scarcest = found.agg(F.sum("raw"), F.min(F.when(F.col("raw") > 0, F.col("share") / F.col("raw")))).first()
        largest = min(largest, scarcest * raw if raw else 1.0)
        wants = found.select(axis, (F.col("raw") / F.lit(raw or 1.0)).alias(f"want_{axis}"))
        cells = cells.join(wants, axis, "left").withColumn(f"want_{axis}", F.coalesce(f"want_{axis}", F.lit(0.0)))
    return cells, largest


def residual(cells: DataFrame, targets=None, temper: float = TEMPER, boost: float = BOOST) -> float:
    """The largest gap between the share of the expected tokens and the wanted one, over all values of ``rake``'s cells."""
    total, kept = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.sum(F.col("tokens") * F.col("probability"))).first()
    wanted, _ = _wanted(cells, total, targets, temper, boost)
    share = F.sum(F.col("tokens") * F.col("probability")) / F.lit(kept or 1.0)
    gaps = [wanted.groupBy(a).agg(F.abs(share - F.first(f"want_{a}")).alias("gap")).agg(F.max("gap")).first()[0] for a in AXES]
    return max((g for g in gaps if g is not None), default=0.0)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, keep: float = KEEP, boost: float = BOOST) -> DataFrame:
    """source, lang, topic, tokens -> the same with the ``probability`` of the cell's documents."""
    cells = materialize(cells, "mixing-cells")
    all_tokens, n = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    small = n <= ONE_PARTITION
    now, largest = _wanted(cells, all_tokens, targets, temper, boost)
    reach = keep * largest
    whole = now.where(" and ".join(f"want_{a} > 0" for a in AXES) + " and tokens > 0")
    now = materialize(whole.withColumn("p", F.lit(reach)), "mixing-rake")
    for k in range(rounds):
        for axis in AXES:
            kept = F.sum(F.col("tokens") * F.col("p"))
            if small:  # windows over one partition: nothing is shuffled
                has = kept.over(Window.partitionBy(axis))
                now = now.coalesce(1)
            else:
                has = F.col("has")
                now = now.join(now.groupBy(axis).agg(kept.alias("has")), axis)
            p = F.least(F.lit(1.0), F.col("p") * (F.col(f"want_{axis}") * F.lit(reach * all_tokens) / has))
            now = now.select(*AXES, "tokens", *(f"want_{a}" for a in AXES), p.alias("p"))
            if not small or (axis == AXES[-1] and (k + 1) % _ROUNDS_A_PLAN == 0):
                now = materialize(now, "mixing-rake")
    return cells.join(now.select(*AXES, "p"), list(AXES), "left").select(*AXES, "tokens", F.coalesce("p", F.lit(0.0)).alias("probability"))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 from the first 32 bits of MD5(seed, id)."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def calibrate(docs: DataFrame, targets=None, keep: float = KEEP, rounds: int = ROUNDS, temper: float = TEMPER, seed: str = SEED, topics=TOPICS, boost: float = BOOST) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and selected of every document."""
    slim = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(c.alias(n) for n, c in _measures(docs, topics).items())), "mixing-docs")
    cells = rake(slim.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")), targets, rounds, temper, keep, boost)
    weighed = slim.join(materialize(cells, "mixing-weights").drop("tokens"), list(AXES))
    return weighed.select("doc_id", *AXES, "n_tokens", "probability", (chance(F.col("doc_id"), seed) < F.col("probability")).alias("selected"))


def sample(docs: DataFrame, targets=None, keep: float = KEEP, rounds: int = ROUNDS, temper: float = TEMPER, seed: str = SEED, topics=TOPICS, boost: float = BOOST) -> DataFrame:
    """The rows of ``docs`` that are selected, with their own columns; texts are not shuffled."""
    names = {n: f"__mix_{n}" for n in (*AXES, "n_tokens")}
    marked = docs.select("*", *(c.alias(names[n]) for n, c in _measures(docs, topics).items()))
    cells = marked.groupBy(*(F.col(names[a]).alias(a) for a in AXES)).agg(F.sum(names["n_tokens"]).alias("tokens"))
    weights = materialize(rake(cells, targets, rounds, temper, keep, boost), "mixing-weights")
    weights = weights.select(*(F.col(a).alias(names[a]) for a in AXES), F.col("probability").alias("__mix_p"))
    return marked.join(weights, [names[a] for a in AXES]).where(chance(F.col("doc_id"), seed) < F.col("__mix_p")).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    found = calibrate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *AXES, "n_tokens", F.round("probability", 6).alias("probability"), "selected")


def _op3_sql() -> str:
    text = "coalesce(text, '')"
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{m}')" for m in ms) + f" THEN '{n}'" for n, ms in TOPICS) + " ELSE 'prose' END"
    steps, now = [], "p0"
    for k in range(ROUNDS * 3):
        axis = AXES[k % 3]
        steps.append(f"p{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(1.0, p * want_{axis} * reach * total / sum(tokens * p) OVER (PARTITION BY {axis})) AS p) FROM {now})")
        now = f"p{k + 1}"
    wants = ", ".join(
        f"""s_{a} AS MATERIALIZED (SELECT {a}, share, pow(share, {TEMPER}) AS want, pow(share, {TEMPER}) / share AS ratio
  FROM (SELECT {a}, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM d) AS share FROM d GROUP BY {a}) WHERE share > 0),
m_{a} AS MATERIALIZED (SELECT least({BOOST}, greatest(1.0, (SELECT max(ratio) FROM s_{a} s WHERE (SELECT sum(share) FROM s_{a} t WHERE t.ratio >= s.ratio) > {RARE}) / (SELECT sum(want) FROM s_{a}))) AS most),
l_{a} AS MATERIALIZED (SELECT max((1 - most * (SELECT coalesce(sum(share), 0) FROM s_{a} t WHERE t.ratio > s.ratio)) / (SELECT sum(want) FROM s_{a} t WHERE t.ratio <= s.ratio)) AS level FROM s_{a} s, m_{a}),
w_{a} AS MATERIALIZED (SELECT {a}, share, least(most * share, level * want) / sum(least(most * share, level * want)) OVER () AS want_{a} FROM s_{a}, l_{a}, m_{a})"""
        for a in AXES
    )
    least = ", ".join(f"(SELECT min(share / want_{a}) FROM w_{a})" for a in AXES)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {topic} AS topic,
         CASE WHEN length({text}) > 0 THEN greatest(1, length({text}) // 4) ELSE 0 END::BIGINT AS n_tokens FROM documents
), {wants}, p0 AS MATERIALIZED (
  SELECT source, lang, topic, tokens, want_source, want_lang, want_topic, (SELECT sum(n_tokens) FROM d)::DOUBLE AS total, {KEEP} * least(1.0, {least}) AS reach, {KEEP} * least(1.0, {least}) AS p
  FROM (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0) JOIN w_source USING (source) JOIN w_lang USING (lang) JOIN w_topic USING (topic)
), {", ".join(steps)}
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(p, 0.0), 6) AS probability,
       CAST('0x' || left(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) / 4294967296.0 < coalesce(p, 0.0) AS selected
FROM d LEFT JOIN {now} USING (source, lang, topic)
"""


OP3_SQL = _op3_sql()
