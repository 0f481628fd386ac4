"""Keyword indexes as tables: built once for a corpus, found again by its hash, extended by new documents.

An index is made of segments, tables of ``bags`` (grp, id, rows, dl, terms, f: a document's distinct terms and how often each
occurs, in one row) and of ``postings`` (grp, term, id, f, dl; a row with an empty term for each document, sorted by term within
files), and of tables of its vocabulary's size: ``counts`` (grp, term, df), ``sizes`` (grp, n, total),
``terms`` (grp, term, df, idf, avgdl) and ``manifest``. A segment is written once; an extension writes
one for the new documents and merges counts, and segments are put together when there are ``SEGMENTS``.

Terms are counted where a document is read, so that neither tokens nor postings are shuffled; only the vocabulary's counts are.
Rows that share id and grp are one document, and rows without one of them are left out.

An index is known by its corpus's hash and the version of the tokenizer. Whoever builds it writes to a folder of
their own and publishes that last; of several published, all take the first.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.sources import spread
from gritstone.sources.scratch import shared_folder

EPSILON, SEGMENTS = 0.25, 8
#: Terms that a batch of bags goes out with, unless one document has more.
BATCH_TERMS = 1 << 17


@dataclass
class KeywordIndex:
    postings: DataFrame
    terms: DataFrame
    manifest: DataFrame
    counts: DataFrame
    sizes: DataFrame
    bags: DataFrame
    segments: int = 1


def tokenizer_version() -> str:
    """Another one for other patterns or stopwords."""
    return hashlib.sha1("|".join((T.TOKEN, T.PART, *T.STOPWORDS)).encode()).hexdigest()[:12]


def corpus_hash(docs: DataFrame) -> str:
    """A hash of the set of rows (id, grp, text): the same in any order, another after any change."""
    mixed = F.xxhash64("id", "grp", "text")
    n, x, s = docs.agg(F.count("*"), F.coalesce(F.bit_xor(mixed), F.lit(0)), F.coalesce(F.sum(F.pmod(mixed, F.lit(1 << 31))), F.lit(0))).first()
    return f"{n:x}-{x & (1 << 64) - 1:016x}-{s:x}"


def corpus(docs: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """id, grp and text of each document; grp is empty without a ``group``."""
    return docs.select(F.col(key).alias("id"), (F.col(group) if group else F.lit("")).alias("grp"), F.coalesce(text, F.lit("")).alias("text"))


def count_terms(docs: DataFrame) -> DataFrame:
    """(id, grp, text) -> grp, id, rows, dl, terms, f of each row: one pass over the texts."""
    token, stopwords = re.compile(T.TOKEN), frozenset(T.STOPWORDS)

    def counted(text: str) -> dict[str, int]:
        """What ``T.tokenize`` gives for a lower-case text, counted."""
        out: dict[str, int] = {}
        for term, n in Counter(token.findall(text)).items():
            if term not in stopwords:
                out[term] = out.get(term, 0) + n
                if not term.isalnum():
                    for part in re.split("[-._]", term):
                        if len(part) > 1 and part not in stopwords:
                            out[part] = out.get(part, 0) + n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, terms, f, ends, lengths = 0, [], [], [0], []
            for at in range(batch.num_rows):
                found = counted(batch.column(2)[at].as_py())
                terms += found
                f += found.values()
                ends.append(len(terms))
                lengths.append(sum(found.values()))
                if len(terms) >= BATCH_TERMS or at + 1 == batch.num_rows:
                    keys = batch.slice(first, at + 1 - first)
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(terms, pa.string()), pa.array(f, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), pa.array([1] * len(lengths), pa.int64()), pa.array(lengths, pa.float64()), *lists], ["grp", "id", "rows", "dl", "terms", "f"])
                    first, terms, f, ends, lengths = at + 1, [], [], [0], []

    read = spread(docs).where("id is not null and grp is not null").select("grp", "id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    types = dict(read.dtypes)
    return read.mapInArrow(run, f"grp {types['grp']}, id {types['id']}, rows long, dl double, terms array<string>, f array<double>")


def _merged(bags: DataFrame) -> DataFrame:
    """Rows of equal id and grp as one: counts and lengths add up."""
    each = bags.select("grp", "id", F.explode(F.arrays_zip("terms", "f")).alias("x")).groupBy("grp", "id", F.col("x.terms").alias("term")).agg(F.sum("x.f").alias("f"))
    listed = each.groupBy("grp", "id").agg(F.collect_list(F.struct("term", "f")).alias("x"))
    whole = bags.groupBy("grp", "id").agg(F.sum("rows").alias("rows"), F.sum("dl").alias("dl")).join(listed, ["grp", "id"], "left")
    return whole.select("grp", "id", "rows", "dl", F.coalesce("x.term", F.array().cast("array<string>")).alias("terms"), F.coalesce("x.f", F.array().cast("array<double>")).alias("f"))


def _postings(bags: DataFrame) -> DataFrame:
    """(grp, term, id, f, dl) of every term of every bag, and a row with an empty term for each row."""
    none = F.array_repeat(F.struct(F.lit("").alias("terms"), F.lit(0.0).alias("f")), F.col("rows").cast("int"))
    rows = bags.select("grp", "id", F.explode(F.concat(F.arrays_zip("terms", "f"), none)).alias("x"), "dl")
    return rows.select("grp", F.col("x.terms").alias("term"), "id", F.col("x.f").alias("f"), "dl").sortWithinPartitions("term", "id")


def weigh_terms(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """grp, term, df, idf, avgdl: negative idf values become EPSILON times the mean idf of the vocabulary."""
    stats = sizes.select("grp", F.col("n").cast("double").alias("n"), (F.col("total") / F.col("n")).alias("avgdl"))
    raw = counts.withColumn("df", F.col("df").cast("double")).join(F.broadcast(stats), "grp").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("grp").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), "grp").select("grp", "term", "df", "avgdl", idf.alias("idf"))


def _counts(postings: DataFrame) -> DataFrame:
    return postings.where("term <> ''").groupBy("grp", "term").agg(F.count("*").alias("df"))


def _sizes(postings: DataFrame) -> DataFrame:
    return postings.where("term = ''").groupBy("grp").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _segment(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame, str]:
    """Postings and bags of (id, grp, text), written, and the name of the bags' folder."""
    bags = _written(count_terms(docs), f"{path}/read")
    name, again = "read", bags.groupBy("grp", "id").count().where("count > 1").select("grp", "id")
    if again.limit(1).count():
        keys = _written(again, f"{path}/again")
        bags = _written(bags.join(keys, ["grp", "id"], "left_anti").unionByName(_merged(bags.join(keys, ["grp", "id"], "left_semi"))), f"{path}/merged")
        name = "merged"
    return _written(_postings(bags), f"{path}/postings"), bags, name


def _weighed(postings: DataFrame, bags: DataFrame, counts: DataFrame, sizes: DataFrame, path: str, known_as: str, segments: int) -> KeywordIndex:
    counts, sizes = _written(counts, f"{path}/counts"), _written(sizes, f"{path}/sizes")
    terms = _written(weigh_terms(counts, sizes), f"{path}/terms")
    made = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("documents"), F.count("*").alias("groups")).crossJoin(counts.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("postings")))
    named = {"corpus_hash": known_as, "tokenizer": tokenizer_version(), "segments": segments}
    manifest = _written(made.withColumns({k: F.lit(v) for k, v in named.items()}), f"{path}/manifest")
    return KeywordIndex(postings, terms, manifest, counts, sizes, bags, segments)


def _published(spark: SparkSession, base: str) -> KeywordIndex:
    path, part_of_bags = min((r.path, r.bags) for r in spark.read.parquet(f"{base}/published").collect())  # a row for each that built it
    postings, terms, manifest, counts, sizes, bags = (spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "manifest", "counts", "sizes", part_of_bags))
    return KeywordIndex(postings, terms, manifest, counts, sizes, bags)


def build(docs: DataFrame, folder: str | None = None) -> KeywordIndex:
    """The index of (id, grp, text) in ``folder``, built unless one of the same corpus and tokenizer is there."""
    spark, known_as = docs.sparkSession, corpus_hash(docs)
    base = f"{folder or shared_folder(spark)}/keywords-2-{known_as}-{tokenizer_version()}"
    try:
        return _published(spark, base)
    except AnalysisException:  # nobody has published it yet
        path = f"{base}/{uuid.uuid4().hex}"
        postings, bags, name = _segment(docs, path)
        _weighed(postings, bags, _counts(postings), _sizes(postings), path, known_as, 1)
        spark.range(1).select(F.lit(path).alias("path"), F.lit(name).alias("bags")).write.mode("append").parquet(f"{base}/published")
        return _published(spark, base)


def extend(index: KeywordIndex, docs: DataFrame, folder: str | None = None) -> KeywordIndex:
    """An index with ``docs`` (id, grp, text) added; a document of a known id and group replaces the old one.

    Only the new texts are read and only their postings written, old segments stay as they are; postings of
    replaced documents are read for their counts, if there are any, and are passed over from then on.
    """
    path = f"{folder or shared_folder(docs.sparkSession)}/keywords-delta-{uuid.uuid4().hex}"
    new, new_bags, _ = _segment(docs, path)
    keys = new.where("term = ''").select("id", "grp")
    gone = index.postings.where("term = ''").join(keys, ["id", "grp"], "left_semi")
    old, old_bags, counts, sizes = index.postings, index.bags, index.counts.unionByName(_counts(new)), index.sizes.unionByName(_sizes(new))
    if gone.limit(1).count():
        lost = _written(index.postings.join(keys, ["id", "grp"], "left_semi"), f"{path}/replaced")
        old, old_bags = index.postings.join(keys, ["id", "grp"], "left_anti"), index.bags.join(keys, ["id", "grp"], "left_anti").select(*index.bags.columns)
        counts = counts.unionByName(_counts(lost).withColumn("df", -F.col("df")))
        sizes = sizes.unionByName(_sizes(lost).withColumn("n", -F.col("n")).withColumn("total", -F.col("total")))
    counts = counts.groupBy("grp", "term").agg(F.sum("df").alias("df")).where("df > 0")
    sizes = sizes.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    merged, bags, segments = old.unionByName(new), old_bags.unionByName(new_bags), index.segments + 1
    if segments > SEGMENTS:
        merged, segments = _written(merged.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), f"{path}/compacted"), 1
        bags = _written(bags, f"{path}/bags-compacted")
    return _weighed(merged, bags, counts, sizes, path, path.rsplit("-", 1)[1], segments)
