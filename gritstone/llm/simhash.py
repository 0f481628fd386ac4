"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that
differ in at most two bits agree in one whole segment (pigeonhole), and its successor then has
at most two errors. A segment, padded to 23 bits, is decoded by the perfect binary Golay code:
the codeword indices of the segment and of all its one-bit neighbours are its keys (one or six
of them), and two segments within two bits always share one. So (segment number, exact segment,
one codeword index of the next segment) is a join key that no link escapes; pairs are verified.

Work is on distinct fingerprints. A key held by more than ``max_bucket`` fingerprints is not
paired off: those fingerprints are linked through the 65 words within one bit of each, where all
that meet in a word are within two bits of each other, which finds the same links in linear work.

Edge cases: null, empty and blank texts have no words and get fingerprint zero, which links like
any other; texts of any length count with all their shingles; an empty table gives no rows; documents with equal texts or repeated ids each keep their row; a null doc_id keeps
its row and is never a component's id unless nothing else is in it (then null).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm import shingles
from gritstone.llm.common import doc_texts, map_rows, materialize, spread_join
from gritstone.llm.components import connected_components
from gritstone.llm.golay import Golay

MAX_BUCKET = 256
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The majority bits of the XXH64 of all ``width``-word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(plain[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fuzzy_keys(fingerprints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of each key of each unsigned fingerprint."""
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = golay.near(parts[j], SEGMENTS[j][1])
        fresh = np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        row, col = np.nonzero(fresh)
        rows.append(row)
        keys.append((i << 36) | (parts[i][row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def run(rows: dict) -> dict:
        fps = np.array([fingerprint(x) for x in rows["text"]], np.uint64)
        return {"doc_id": rows["doc_id"], "fp": fps.view(np.int64)}

    return map_rows(doc_texts(docs), run, "doc_id long, fp long")


def links(distinct: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Pairs (u, v) that connect distinct fingerprints (column fp) exactly as all links do."""
    made: list[Golay] = []

    def keys(rows: dict) -> dict:
        if not made:
            made.append(Golay())
        fps = np.array(rows["fp"], np.int64)
        row, key = fuzzy_keys(fps.view(np.uint64), made[0])
        return {"fp": fps[row], "key": key}

    keyed = materialize(map_rows(distinct.select("fp"), keys, "fp long, key long"), "simhash-keys")
    hot = keyed.groupBy("key").count().where(F.col("count") > max_bucket).select("key")
    rest = keyed.join(hot, "key", "left_anti")
    a, b = rest.select("key", F.col("fp").alias("u")), rest.select("key", F.col("fp").alias("v"))
    paired = a.join(b, (a.key == b.key) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    crowded = keyed.join(hot, "key", "left_semi").select("fp").distinct()
    around = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = crowded.select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    starred = met.withColumn("m", F.min("fp").over(Window.partitionBy("word"))).where("m <> fp").select(F.col("m").alias("u"), F.col("fp").alias("v"))
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp, component_id of every document; columns other than doc_id and text are ignored."""
    marked = materialize(fingerprints(docs), "simhash-fp")
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    linked = connected_components(links(first, max_bucket))
    rooted = first.join(linked.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    named = first.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return spread_join(marked, named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = shingles.WIDTH, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each group, that of the smallest doc_id; rows without an id stay.

    Groups are the components of pairs whose ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Candidates share two Golay codewords of one of several fingerprints, since a
    single one at two bits is too narrow a net for a corpus; each link is verified on the texts. Rows that
    share an id but not a group are all kept; of equal rows of one id and text one stays.
    """
    leads = shingles.near_duplicates(docs, width, similarity).where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("lead"))
    named = docs.where("doc_id is not null").withColumn("__text_hash", F.xxhash64(F.col("text").cast("string"))).withColumn("__id", F.col("doc_id").cast("long"))
    kept = named.join(leads.select(F.col("lead.doc_id").alias("__id"), F.col("lead.text_hash").alias("__text_hash")).distinct(), ["__id", "__text_hash"], "left_semi")
    return kept.dropDuplicates(["__id", "__text_hash"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
