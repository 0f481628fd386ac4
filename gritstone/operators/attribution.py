"""Whether an answer cites the document that its question names.

A title, and the part before its first colon where that is a name rather than a topic (two tokens or more, or
one of six characters that no other title has), are phrases of an index. A question's runs of tokens, as long
as phrases are, meet the phrases themselves, so that neither a token of many titles nor a long question grows a join. A question that names
exactly one document must be answered from it; one that names none or several is left alone.

Edge cases: null and blank titles and questions name nothing; equal titles of several documents are several
documents; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StringType, StructField, StructType

from gritstone.functions import text as T
from gritstone.sources.scratch import kept

# Fixed value: characters of a single-token name at least.
LONE = 6
#: Tokens of a run that a phrase is met by at most; what a longer phrase goes on with is verified.
RUN = 24
#: Bits that phrases set (8 MB). Where phrases are so many that most bits are set, more runs are shuffled; none is lost.
BITS = 1 << 26
#: Parts of the questions and lists of the documents that share a phrase.
SALTS, LISTS = 32, 1024
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@F.pandas_udf(StringType())
def _unaccented(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for texts in parts:
        yield texts.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def fold(text: Column) -> Column:
    """Compatibility-decomposed, without accents, lower-case; all but digits and a-z are single blanks."""
    return F.trim(F.regexp_replace(F.lower(_unaccented(F.coalesce(text, F.lit("")))), "[^0-9a-z]+", " "))


def title_tokens(titles: DataFrame) -> DataFrame:
    """(doc, title) -> token, df: in how many distinct folded titles each token occurs."""
    distinct = titles.select(fold(F.col("title")).alias("full")).where("full <> ''").distinct()
    return distinct.select(F.explode(F.array_distinct(F.split("full", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def name_index(titles: DataFrame) -> DataFrame:
    """(doc, title) -> doc, phrase, key: a row for each phrase that names the document; key is its rarest token."""
    head = F.when(F.instr("title", ":") > 0, F.substring_index("title", ":", 1)).otherwise("")
    plain = titles.select("doc", fold(F.col("title")).alias("full"), fold(head).alias("head"))
    df = title_tokens(titles)
    whole = plain.select("doc", F.col("full").alias("phrase"), F.lit(False).alias("lone"))
    heads = plain.select("doc", F.col("head").alias("phrase"), ~F.contains("head", F.lit(" ")).alias("lone"))
    each = whole.union(heads).where("phrase <> '' and (not lone or length(phrase) >= %d)" % LONE).distinct()
    keyed = each.select("*", F.explode(F.array_distinct(F.split("phrase", " "))).alias("token")).join(df, "token")
    named = keyed.groupBy("doc", "phrase", "lone").agg(F.min(F.struct("df", "token")).alias("least"))
    return named.where("not lone or least.df = 1").groupBy("doc", "phrase").agg(F.first("least.token").alias("key"))


def named_documents(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, question) -> qid, doc of each document that the question names."""
    return phrases_held(questions.select("qid", fold(F.col("question")).alias("q")), index.select("doc", "phrase"))


def named_counts(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, question) -> qid, n, target: how many documents a question names, if any, and the least of them.

    ``named_documents`` counted without its pairs, which grow with the square of documents alike: a phrase stands for
    the number of its documents, and those that a question names by both of their two phrases are taken off once.
    Only documents of more phrases are listed.
    """
    names = kept(_by_document(index), "names")
    met = phrases_met(questions.select("qid", fold(F.col("question")).alias("q")), names.select("phrase").distinct())
    each = met.join(names.where("of <= 2").groupBy("phrase").agg(F.count("*").alias("n"), F.min("doc").alias("target")), "phrase").select("qid", "n", "target")
    pair = F.sort_array(F.array(*(F.struct(F.length(c), F.col(c).alias("phrase")) for c in ("first", "last"))), asc=False)
    two = names.where("of = 2 and phrase = first").groupBy(pair[0]["phrase"].alias("phrase"), pair[1]["phrase"].alias("other")).agg(F.count("*").alias("n"))
    both = met.join(two, "phrase").join(met.select("qid", F.col("phrase").alias("other")), ["qid", "other"], "left_semi")
    listed = met.join(names.where("of > 2").select("doc", "phrase"), "phrase").select("qid", "doc").distinct()
    found = each.union(both.select("qid", -F.col("n"), F.lit(None))).union(listed.select("qid", F.lit(1), "doc"))
    return found.groupBy("qid").agg(F.sum("n").alias("n"), F.min("target").alias("target"))


def phrases_held(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, q) × (doc, phrase), tokens parted by single blanks -> qid, doc where q holds the phrase's tokens in a row.

    Pairs of documents with one phrase are made last and go through no shuffle: a phrase's documents lie in lists, which
    are sent once to each of ``SALTS`` parts of the questions in use. Pairs of other documents may be met repeatedly.
    """
    each = kept(_by_document(names), "names")
    met = phrases_met(questions, each.select("phrase").distinct())
    asked = met.withColumn("salt", F.pmod(F.xxhash64("qid"), F.lit(SALTS)))
    lists = each.where("of = 1").groupBy("phrase", F.pmod(F.xxhash64("doc"), F.lit(LISTS)).alias("list")).agg(F.collect_list(F.struct("doc")).alias("docs"))
    sent = asked.select("phrase", "salt").distinct().hint("merge").join(lists, "phrase").select("phrase", "salt", "docs")
    once = asked.hint("merge").join(sent, ["phrase", "salt"]).select("qid", F.explode("docs").alias("of")).select("qid", F.col("of.doc").alias("doc"))
    return once.union(met.join(each.where("of > 1").select("doc", "phrase"), "phrase").select("qid", "doc").distinct())


def phrases_met(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, q) × distinct (phrase) -> distinct qid, phrase where q holds the phrase's tokens in a row.

    An equi-join of runs: a row holds a run and never the question. Runs are looked up in bits that the phrases set
    before they become rows, so that hardly more are shuffled than meet a phrase; a false one meets none. Phrases of
    over ``RUN`` tokens are met by their first ones and verified.
    """
    tokens = F.split("phrase", " ")
    sized = phrases.where("phrase <> ''").select("phrase", F.size(tokens).alias("n"), F.array_join(F.slice(tokens, 1, RUN), " ").alias("run"))
    bits, lengths = phrase_bits(sized.select("run", F.least("n", F.lit(RUN + 1)).alias("n")))
    asked = kept(runs_known(questions.select("qid", "q").where("q <> ''"), [min(n, RUN) for n in lengths], bits).distinct(), "runs")
    met = asked.hint("merge").join(sized, "run").select("qid", "phrase", "n")
    found = met.where(F.col("n") <= RUN).select("qid", "phrase")
    if lengths[-1:] != [RUN + 1]:
        return found
    longer = met.where(F.col("n") > RUN).join(questions, "qid").where(T.contains_phrase(F.col("q"), F.col("phrase"))).select("qid", "phrase")
    return found.union(longer.distinct())


def _by_document(names: DataFrame) -> DataFrame:
    """Distinct (doc, phrase) with the number of the document's phrases, the first and the last of them."""
    w = Window.partitionBy("doc")
    return names.select("doc", "phrase").where("phrase <> ''").distinct().select("*", F.count("*").over(w).alias("of"), F.min("phrase").over(w).alias("first"), F.max("phrase").over(w).alias("last"))


def phrase_bits(runs: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(run, n) -> ``BITS`` bits of which each run sets two, packed, and the n that occur: of one size, whatever the table."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes(batch.column(0))
            two, n = _places(raw, offsets[:-1], offsets[1:]), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(two) + 1), pa.array(np.concatenate((n, n)))], ["bit", "n"])

    marks = runs.select("run", "n").mapInArrow(places, "bit long, n int").select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("bit"), F.expr("shiftleft(1L, n)").alias("n"))
    found = marks.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.bit_or("n").alias("n")).collect()
    bits, n = np.zeros(BITS // 8, np.uint8), 0
    for r in found:  # buckets count from 1
        part = np.frombuffer(r.bits, np.uint8)
        bits[(r.bucket - 1) * len(part) :][: len(part)] = part
        n |= r.n
    return bits, [k for k in range(RUN + 2) if n >> k & 1]


def runs_known(questions: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """(qid, q) -> qid, run: each question's runs of these numbers of tokens whose two bits are set."""
    shared, sizes = questions.sparkSession.sparkContext.broadcast(bits), sorted(set(lengths))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = shared.value
        is_set = lambda place: set_[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
        for batch in batches:
            raw, offsets = _bytes(batch.column(1))
            for a, b in _parts(offsets):
                own, ends = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                begin, end, row = _tokens(own, ends)
                rows, runs = [], []
                for n in sizes:
                    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
                    one, two = _places(own, begin[at], end[at + n - 1])
                    at = at[is_set(one)]
                    at = at[is_set(two[is_set(one)])]
                    rows.append(row[at])
                    runs += [own[x:y].tobytes().decode() for x, y in zip(begin[at].tolist(), end[at + n - 1].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows) + a)), pa.array(runs, pa.string())], ["qid", "run"]) if sizes else batch.slice(0, 0).rename_columns(["qid", "run"])

    schema = StructType([StructField("qid", questions.schema["qid"].dataType), StructField("run", StringType())])
    return questions.select("qid", "q").mapInArrow(known, schema)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts side by side and where each begins; the last of these is where they end."""
    plain = pa.concat_arrays([texts.cast(pa.large_binary())])
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    return (np.frombuffer(plain.buffers()[2], np.uint8) if plain.buffers()[2] else np.zeros(0, np.uint8)), offsets


def _parts(offsets: np.ndarray, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``size`` bytes, one text at least."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of each token."""
    word = raw != 32
    fresh, last = word.copy(), word.copy()
    fresh[1:] &= ~word[:-1] | np.isin(np.arange(1, len(raw)), offsets)
    last[:-1] &= ~word[1:] | np.isin(np.arange(1, len(raw)), offsets)
    begin = np.flatnonzero(fresh)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(offsets, begin, side="right") - 1


def _places(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each stretch of bytes: its polynomial modulo 2 ** 64 from sums up to its ends, mixed."""
    up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), base, np.uint64)))) for base in (_BASE, _INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    h = (sums[end] - sums[begin]) * down[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(BITS)).astype(np.int64), (h >> np.uint64(38)).astype(np.int64)


def misattributed(questions: DataFrame, cited: DataFrame, titles: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(qid, question), (qid, place, doc), (doc, title) -> qid, doc, wrong, reason of the questions that name
    exactly one document and whose answers cite others: their distinct titles in the order cited. ``named`` are the
    questions' ``named_counts``, where these are known."""
    found = (named if named is not None else named_counts(questions, name_index(titles))).where("n = 1")
    other = cited.join(found, "qid").where("doc <> target")
    of = titles.groupBy("doc").agg(F.min("title").alias("title"))
    first = other.join(of, "doc").groupBy("qid", "target", "title").agg(F.min("place").alias("place"))
    listed = first.groupBy("qid", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("wrong"))
    named = listed.join(of.withColumnRenamed("doc", "target").withColumnRenamed("title", "asked"), "target")
    quoted = F.array_join(F.transform("wrong", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "; ")
    reason = F.concat(F.lit('the question asks about "'), "asked", F.lit('" but the answer cites a different document: '), quoted)
    return named.select("qid", F.col("target").alias("doc"), "wrong", reason.alias("reason"))


def replay(answers: DataFrame, cited: DataFrame, titles: DataFrame) -> DataFrame:
    """What the check would do to answers given (qid, question) with their citations: one row of answered, one_named,
    several_named, would_refuse."""
    named = kept(named_counts(answers, name_index(titles)), "named")
    refused = misattributed(answers, cited, titles, named).select("qid", F.lit(1).alias("refused"))
    joined = answers.select("qid").join(named.select("qid", "n"), "qid", "left").join(refused, "qid", "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return joined.agg(F.count("*").alias("answered"), count(F.col("n") == 1).alias("one_named"), count(F.col("n") > 1).alias("several_named"), count(F.col("refused") == 1).alias("would_refuse"))
