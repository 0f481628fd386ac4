"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one blank, and the 1- to 3-grams of code
points are hashed. Document frequencies are counted over every document that may be learned
from. The weights are fitted by follow-the-regularised-leader with elastic-net penalties, on at
most ``MAX_DOCS`` documents of each language and some ``MAX_SAMPLE`` in all, one of each language
at least (those whose id hashes lowest), and a temperature is fitted on a part of that sample kept
apart. Only the n-gram counts of the sample reach the driver, 2 ** ``BITS`` a document at most. The weights that the l1 penalty leaves are few, and
scoring is a sum over a text's n-grams, whatever its length.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; null languages or ids
aren't learned from; with nothing to learn from every text is ``und``; ties go to the
alphabetically first language; repeated documents each keep their row; texts of any length are read
whole; an empty table gives no rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm.common import map_rows, spread

BITS = 16
MAX_DOCS, MAX_SAMPLE, EPOCHS, BATCH = 600, 20_000, 3, 16
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.002, 0.002
NONE = "und"
#: Characters of a text scored at once.
PART = 1 << 18
#: Numbers other than digits pass for word characters, though they are no letters.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
#: Kept apart: a class of characters up to U+FFFF is a bitmap; one with others, or with categories in it, is tried member by member.
_NO_LETTERS, _FAR = re.compile(r"[\W\d_]+"), re.compile("[\U00010000-\U0010ffff]")
_NEAR_NUMBER = re.compile(f"[{re.escape(''.join(c for c in _NUMBERS if ord(c) < 1 << 16))}]")
_NUMBERS_OR_BLANKS = re.compile(f"[ {re.escape(_NUMBERS)}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalize(text: str | None) -> str:
    """Lower-case words of letters between single blanks; empty if there is no letter."""
    plain = _NO_LETTERS.sub(" ", text.lower()) if text else ""
    if not plain.isascii() and (_NEAR_NUMBER.search(plain) or _FAR.search(plain)):
        plain = _NUMBERS_OR_BLANKS.sub(" ", plain)
    plain = plain.strip(" ")
    return f" {plain} " if plain else ""


def codes(plain: str) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams of a normalised text."""
    c = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    return (np.concatenate((c, two, three)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language: idf * weight
    idf: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, plain: str) -> np.ndarray:
        total, mass = np.zeros(len(self.langs)), 0.0
        for part in parts_of(plain):
            total += self.table[part].sum(axis=0, dtype=np.float64)
            mass += self.idf[part].sum(dtype=np.float64)
        return total / max(mass, 1e-9) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        plain = normalize(text)
        if not plain or not self.langs:
            return NONE, 0.0
        z = self.logits(plain) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.langs[k], float(p[k] / p.sum())


def _later(plain: str) -> np.ndarray:
    """Codes of the n-grams that end after the two code points repeated from the part before."""
    c = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    return (np.concatenate((c[2:], two[1:], three)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def parts_of(plain: str) -> Iterator[np.ndarray]:
    """``codes`` in parts of bounded size; n-grams over a part's border are found by the overlap of two."""
    for at in range(0, len(plain), PART):
        yield codes(plain[:PART]) if not at else _later(plain[at - 2 : at + PART])


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    counts = np.zeros(1 << BITS, np.int64)
    for part in parts_of(normalize(text)):
        counts += np.bincount(part, minlength=1 << BITS)
    hit = np.flatnonzero(counts)
    return hit, counts[hit]


def _weighed(buckets: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of a text; the values sum to one."""
    v = n * idf[buckets]
    return buckets, v / max(v.sum(), 1e-9)


def train(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], df: np.ndarray, n_docs: int, seed: int = 3) -> Model:
    """FTRL-proximal over mini-batches; one document in four is kept for the temperature."""
    names = sorted(set(langs))
    idf = np.log((1 + n_docs) / (1.0 + df)) + 1.0
    shape = (1 << BITS, len(names))
    z, n, w = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    zb, nb, bias = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    x, y = [_weighed(b, n_, idf) for b, n_ in counts], np.array([names.index(v) for v in langs], np.int64)
    order = np.arange(len(x))
    rng = np.random.default_rng(seed)
    rng.shuffle(order)
    apart = order[: len(order) // 4] if len(order) >= 80 else order
    rest = order[len(order) // 4 :] if len(order) >= 80 else order
    scale = 200.0  # values sum to one per document; gradients are scaled so that ALPHA is a usual rate
    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for at in range(0, len(rest), BATCH):
            own = rest[at : at + BATCH]
            own = own[[len(x[i][0]) > 0 for i in own]]
            if not len(own):
                continue
            logit = np.stack([scale * (x[i][1] @ w[x[i][0]]) for i in own]) + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            d = p / p.sum(axis=1, keepdims=True)
            d[np.arange(len(own)), y[own]] -= 1
            d /= len(own)
            rows = np.concatenate([x[i][0] for i in own])
            vals = np.concatenate([x[i][1] for i in own]) * scale
            which = np.repeat(np.arange(len(own)), [len(x[i][0]) for i in own])
            used, place = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(place, vals * d[which, k], len(used)) for k in range(len(names))], axis=1)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - sigma * w[used]
            n[used] += g * g
            w[used] = np.where(np.abs(z[used]) <= L1, 0.0, -(z[used] - np.sign(z[used]) * L1) / ((BETA + np.sqrt(n[used])) / ALPHA + L2))
            gb = d.sum(axis=0)
            sigma = (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA
            zb += gb - sigma * bias
            nb += gb * gb
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
    logit = np.stack([scale * (x[i][1] @ w[x[i][0]]) + bias for i in apart]) if len(apart) else np.zeros((0, len(names)))
    best = temperature_of(logit, y[apart]) if len(logit) else 1.0
    return Model(names, (scale * w * idf[:, None]).astype(np.float32), idf.astype(np.float32), bias, best)


def log_loss(logit: np.ndarray, y: np.ndarray, temperature: float, target: float = 1.0) -> float:
    """Mean cross-entropy; the true language has ``target``, the others share the rest."""
    v = logit / temperature
    v = v - v.max(axis=1, keepdims=True)
    logp = v - np.log(np.exp(v).sum(axis=1, keepdims=True))
    own, rest = logp[np.arange(len(y)), y], (1 - target) / max(1, logp.shape[1] - 1)
    return -float(np.mean((target - rest) * own + rest * logp.sum(axis=1)))


def temperature_of(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss on documents kept apart.

    Of n documents the true language is given (n + 1) / (n + 2), as one more right and one wrong would have
    it: were all of them right, no temperature would be low enough for certainty.
    """
    scale = float(np.std(logit - logit.mean(axis=1, keepdims=True)))
    if not scale:
        return 1.0
    target, heats = (len(y) + 1) / (len(y) + 2), scale * np.exp(np.linspace(-8, 8, 321))
    losses = [log_loss(logit, y, t, target) for t in heats]
    at = int(np.argmin(losses))
    return float(heats[at]) if 0 < at < len(heats) - 1 else 1.0  # at an end only where the logits say nothing


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of documents with crc32(id) mod 5 <> 0, a text and a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where("doc_id is not null and text is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, and how many texts there are: sums of counts per task."""
    size = 1 << BITS

    def count(batches):
        import pyarrow as pa

        df, seen, n = np.zeros(size, np.int64), np.zeros(size, bool), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in parts_of(normalize(text)):
                    seen[part] = True
                hit = np.flatnonzero(seen)
                df[hit] += 1
                seen[hit] = False
                n += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], names=["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BITS bound the rows
    df = np.zeros(size, np.int64)
    bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_sample: int = MAX_SAMPLE) -> Model:
    rows = learnable(docs)
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("at"))
    n_langs = ids.select("lang").distinct().count()
    if not n_langs:
        return Model([], np.zeros((1, 0)), np.zeros(1), np.zeros(0))
    each = max(1, min(max_docs, max_sample // n_langs))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))  # tasks keep their first ``each`` before the shuffle
    chosen = ids.withColumn("place", place).where(F.col("place") <= each).select("doc_id").distinct()  # max_sample ids, one more for each language at most
    texts = rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("doc_id", "one.lang", "one.text")

    def count(rows: dict) -> dict:
        made = [counts_of(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "lang": rows["lang"], "buckets": [b for b, _ in made], "n": [n for _, n in made]}

    got = map_rows(texts, count, "doc_id long, lang string, buckets array<int>, n array<int>").toArrow().sort_by("doc_id")
    counts = [tuple(got[c][i].values.to_numpy().astype(np.int64) for c in ("buckets", "n")) for i in range(got.num_rows)]
    df, n_docs = document_frequencies(rows)
    return train(counts, got["lang"].to_pylist(), df, n_docs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and lang_score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict) -> dict:
        found = [shared.value.predict(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "lang_pred": [x[0] for x in found], "lang_score": [x[1] for x in found]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, lang_score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    found = identify(docs, fit(docs))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
