"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as its hashed word vector beside the mean of its hashed character n-gram
vectors; a GRU reads every window of words from both ends, attention pools the states, and a
linear layer gives the window's logit. Windows begin at every ``STRIDE``-th word, half a window, so that
each passage of half a window's words lies whole in one. A document's logit is the largest of all its overlapping
windows, a logistic map fitted on sampled documents kept apart turns it into the score.

Training uses at most ``MAX_DOCS`` labelled documents of each class, those whose id hashes lowest.
Labels are of whole documents, so windows are learned by multiple instances: the windows of a
toxic document that score highest count as toxic (at first by n-gram log odds, then by the
network), all kinds of windows of a clean document count as clean, the hardest ones included, and
so do clean windows in which one word is repeated over and over.

Edge cases: null and empty texts are one empty window; a document of several labels takes the
largest; null ids or labels aren't learned from; without labels of both classes every score is
the share of toxic labels (0 if there are none). Repeated documents each keep their row; texts of any
length are scored whole, window by window; an empty table gives no rows; columns other than doc_id and text
take no part, and one named like the score stays as it is.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import map_rows

WINDOW, STRIDE = 32, 16
DIM, HIDDEN = 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
GRAMS = (3, 4, 5)
#: Epochs are added until there are ``STEPS`` gradient steps, which matters for few labels only.
MAX_DOCS, EPOCHS, STEPS, BATCH, RATE = 1200, 4, 60, 128, 0.02
THRESHOLD = 0.7
_CHUNK = 2048
_PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_PLAIN).split() if text else []


def gram_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (with word borders) of all words: buckets, and each one's word number."""
    raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(raw))
    code, codes, owners = raw.copy(), [], []
    for n in range(2, max(GRAMS) + 1):
        code[: len(raw) - n + 1] = code[: len(raw) - n + 1] * np.uint64(0x100000001B3) + raw[n - 1 :]
        if n in GRAMS:
            ok = left >= n
            mixed = (code[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            codes.append((mixed >> np.uint64(48)).astype(np.int64) % GRAM_BUCKETS)
            owners.append(word[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(codes)[order], owner[order]


class Words:
    """Distinct words of some texts: local numbers, word buckets and n-gram buckets."""

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        self.docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
        self.words = list(number)
        self.buckets = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in self.words), np.int64, len(self.words))
        self.codes, self.owner = gram_codes(self.words) if self.words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first = np.searchsorted(self.owner, np.arange(len(self.words)))
        self.n_grams = np.bincount(self.owner, minlength=len(self.words)).astype(np.float32) if self.words else np.zeros(0, np.float32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """All overlapping windows of local word numbers (the pad is the number of words), and each one's document."""
        pad, rows, owner = len(self.words), [], []
        for k, ids in enumerate(self.docs):
            n = 1 + max(0, -(-(len(ids) - WINDOW) // STRIDE))
            filled = np.full((n - 1) * STRIDE + WINDOW, pad, np.int32)
            filled[: len(ids)] = ids
            rows.append(np.lib.stride_tricks.sliding_window_view(filled, WINDOW)[::STRIDE])
            owner.append(np.full(n, k))
        return np.concatenate(rows), np.concatenate(owner)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def inputs(self, w: Words) -> np.ndarray:
        """A row of 2 * DIM for each distinct word and one, of zeros, for the pad."""
        x = np.zeros((len(w.words) + 1, 2 * DIM), np.float32)
        if w.words:
            x[:-1, :DIM] = self.p["word"][w.buckets]
            sums = np.empty((len(w.words), DIM), np.float32)
            step = 1 << 16
            for a in range(0, len(w.words), step):
                b = min(a + step, len(w.words))
                lo, hi = w.first[a], w.first[b] if b < len(w.words) else len(w.codes)
                sums[a:b] = np.add.reduceat(self.p["gram"][w.codes[lo:hi]], w.first[a:b] - lo, axis=0)
            x[:-1, DIM:] = sums / w.n_grams[:, None]
        return x

    def logits(self, w: Words, windows: np.ndarray) -> np.ndarray:
        x = self.inputs(w)
        pad = len(w.words)
        tables = []
        for d in "fb":
            t = x @ self.p["in" + d] + self.p["bias" + d]
            t[pad, :HIDDEN] = 30.0  # the update gate of a pad keeps the state
            tables.append(t)
        out = np.empty(len(windows), np.float32)
        for at in range(0, len(windows), _CHUNK):
            part = windows[at : at + _CHUNK].T
            states = np.empty((WINDOW, part.shape[1], 2 * HIDDEN), np.float32)
            for d, table, steps, col in (("f", tables[0], range(WINDOW), 0), ("b", tables[1], range(WINDOW - 1, -1, -1), HIDDEN)):
                gates, cand = self.p["gate" + d], self.p["cand" + d]
                h = np.zeros((part.shape[1], HIDDEN), np.float32)
                for t in steps:
                    g = table[part[t]]
                    zr = np.tanh(0.5 * (g[:, : 2 * HIDDEN] + h @ gates)) * 0.5 + 0.5
                    z = zr[:, :HIDDEN]
                    n = np.tanh(g[:, 2 * HIDDEN :] + (zr[:, HIDDEN:] * h) @ cand)
                    h = n + z * (h - n)
                    states[t, :, col : col + HIDDEN] = h
            e = np.tanh(states @ self.p["att"]) @ self.p["query"]
            e[part == pad] = -1e4
            e = np.exp(e - e.max(axis=0))
            pooled = np.einsum("tb,tbh->bh", e / e.sum(axis=0), states)
            out[at : at + _CHUNK] = pooled @ self.p["out"] + self.p["out0"]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        top = self.document_logits(Words(texts), len(texts))
        return 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -30, 30)))

    def document_logits(self, w: Words, n: int) -> np.ndarray:
        windows, owner = w.windows()
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, self.logits(w, windows).astype(np.float64))
        return top


def _gradients(net: Network, w: Words, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time of the mean log loss; embeddings get (rows, gradient) by local word."""
    p, part, pad = net.p, windows.T, len(w.words)
    used, local = np.unique(part, return_inverse=True)
    local = local.reshape(part.shape)
    x = net.x[used]
    size, keep = part.shape[1], (part != pad)[:, :, None].astype(np.float32)
    states, saved = np.zeros((WINDOW, size, 2 * HIDDEN), np.float32), {}
    for d, steps, col in (("f", range(WINDOW), 0), ("b", range(WINDOW - 1, -1, -1), HIDDEN)):
        table = x @ p["in" + d] + p["bias" + d]
        h = np.zeros((size, HIDDEN), np.float32)
        for t in steps:
            g = table[local[t]]
            zr = np.tanh(0.5 * (g[:, : 2 * HIDDEN] + h @ p["gate" + d])) * 0.5 + 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            z = 1 - keep[t] * (1 - z)
            n = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ p["cand" + d])
            saved[d, t] = (h, z, r, n)
            h = n + z * (h - n)
            states[t, :, col : col + HIDDEN] = h
    u = np.tanh(states @ p["att"])
    e = u @ p["query"]
    e[part == pad] = -1e4
    e = np.exp(e - e.max(axis=0))
    a = e / e.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, states)
    logit = pooled @ p["out"] + p["out0"]
    dl = (1 / (1 + np.exp(-logit)) - y) / size
    grads = {"out": pooled.T @ dl, "out0": np.array(dl.sum(), np.float32)}
    dpool = dl[:, None] * p["out"]
    da = np.einsum("bh,tbh->tb", dpool, states)
    de = a * (da - (a * da).sum(axis=0))
    grads["query"] = np.einsum("tb,tbk->k", de, u)
    du = de[:, :, None] * p["query"] * (1 - u * u)
    grads["att"] = np.einsum("tbh,tbk->hk", states, du)
    dstates = a[:, :, None] * dpool + du @ p["att"].T
    dx = np.zeros_like(x)
    for d, steps, col in (("f", range(WINDOW - 1, -1, -1), 0), ("b", range(WINDOW), HIDDEN)):
        dtable = np.zeros((WINDOW, size, 3 * HIDDEN), np.float32)
        dgate, dcand, dh = np.zeros_like(p["gate" + d]), np.zeros_like(p["cand" + d]), np.zeros((size, HIDDEN), np.float32)
        for t in steps:
            h, z, r, n = saved[d, t]
            dh = dh + dstates[t, :, col : col + HIDDEN]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z) * keep[t]
            drh = dn @ p["cand" + d].T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate((dz, dr), axis=1)
            dcand += (r * h).T @ dn
            dgate += h.T @ dzr
            dtable[t] = np.concatenate((dzr, dn), axis=1)
            dh = dh * z + drh * r + dzr @ p["gate" + d].T
        grads["gate" + d], grads["cand" + d] = dgate, dcand
        flat = dtable.reshape(-1, 3 * HIDDEN)
        summed = np.stack([np.bincount(local.ravel(), flat[:, k], len(used)) for k in range(3 * HIDDEN)], axis=1).astype(np.float32)
        grads["in" + d], grads["bias" + d] = x.T @ summed, summed.sum(axis=0)
        dx += summed @ p["in" + d].T
    real = used < pad
    grads["x"] = (used[real], dx[real])
    return grads


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        """``rows``: for a table, the rows that ``grads`` holds."""
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = rows.get(k, ...)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] = self.p[k][at] - fix * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)


def _log_odds(w: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of toxic against clean documents for each word bucket and each n-gram bucket."""
    out = []
    for n_buckets, of in ((WORD_BUCKETS, w.buckets), (GRAM_BUCKETS, None)):
        counts = np.zeros((2, n_buckets))
        for ids, label in zip(w.docs, y):
            own = np.unique(ids)
            if of is not None:
                hit = of[own]
            else:
                hit = np.concatenate([w.codes[w.first[i] : w.first[i] + int(w.n_grams[i])] for i in own] or [np.zeros(0, np.int64)])
            counts[label, np.unique(hit)] += 1
        share = (counts + 0.5) / (np.array([[np.sum(y == 0)], [np.sum(y == 1)]]) + 1.0)
        out.append(np.log(share[1] / share[0]).astype(np.float32))
    return out[0], out[1]


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Network:
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Network({}, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    w = Words(texts)
    windows, owner = w.windows()
    word_odds, gram_odds = _log_odds(w, y)
    draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
    p = {"word": draw(WORD_BUCKETS, DIM, by=0.1), "gram": draw(GRAM_BUCKETS, DIM, by=0.1)}
    p["word"][:, 0], p["gram"][:, 0] = np.clip(word_odds, -2, 4) / 2, np.clip(gram_odds, -2, 4)
    for d in "fb":
        p |= {"in" + d: draw(2 * DIM, 3 * HIDDEN, by=0.35), "bias" + d: np.zeros(3 * HIDDEN, np.float32), "gate" + d: draw(HIDDEN, 2 * HIDDEN, by=0.3), "cand" + d: draw(HIDDEN, HIDDEN, by=0.3)}
    p |= {"att": draw(2 * HIDDEN, HIDDEN, by=0.4), "query": draw(HIDDEN, by=0.4), "out": draw(2 * HIDDEN, by=0.4), "out0": np.array(0.0, np.float32)}
    net = Network(p)
    opt = Adam(p, RATE)
    odds = np.concatenate((net.inputs(w)[:-1, DIM], [np.float32(-9)]))
    score = np.partition(odds[windows], WINDOW - 2, axis=1)[:, WINDOW - 2 :].mean(axis=1)
    # a fifth of the documents is kept apart for the logistic map, if there are enough of each class
    apart = np.zeros(len(texts), bool)
    if min(np.bincount(y)) >= 100:
        for c in (0, 1):
            apart[np.flatnonzero(y == c)[::5]] = True
    own_windows, toxic = ~apart[owner], y[owner] == 1
    epoch = 0
    while epoch < EPOCHS or opt.t < STEPS:
        epoch += 1
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, score)
        best = np.flatnonzero(own_windows & toxic & (score >= top[owner] - 1e-6))
        best = best[np.unique(owner[best], return_index=True)[1]]
        clean = np.flatnonzero(own_windows & ~toxic)
        hard = clean[np.argsort(-score[clean], kind="stable")[: 2 * len(best)]]
        easy = rng.choice(clean, min(len(clean), 3 * len(best)), replace=False)
        pick = np.concatenate((best, best, hard, easy))
        shown, label = windows[pick], toxic[pick].astype(np.float32)
        # clean windows in which one word says itself over and over, as junk does
        junk = windows[rng.choice(clean, len(best))].copy() if len(clean) else windows[:0].copy()
        word = junk[np.arange(len(junk)), rng.integers(0, WINDOW, len(junk))]
        junk = np.where(np.arange(WINDOW) >= rng.integers(0, WINDOW - 4, len(junk))[:, None], word[:, None], junk)
        shown, label = np.concatenate((shown, junk)), np.concatenate((label, np.zeros(len(junk), np.float32)))
        order = rng.permutation(len(shown))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            net.x = net.inputs(w) if at % (8 * BATCH) == 0 else net.x
            grads = _gradients(net, w, shown[own], label[own])
            used, dx = grads.pop("x")
            rows = {"word": np.unique(w.buckets[used])}
            place = np.searchsorted(rows["word"], w.buckets[used])
            grads["word"] = np.zeros((len(rows["word"]), DIM), np.float32)
            np.add.at(grads["word"], place, dx[:, :DIM])
            n = w.n_grams[used].astype(np.int64)
            spread = np.repeat(w.first[used] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            codes = w.codes[spread]
            rows["gram"], inverse = np.unique(codes, return_inverse=True)
            each = np.repeat(dx[:, DIM:] / n[:, None], n, axis=0)
            grads["gram"] = np.stack([np.bincount(inverse, each[:, k], len(rows["gram"])) for k in range(DIM)], axis=1).astype(np.float32)
            opt.step(grads, rows)
        score = net.logits(w, windows)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, score.astype(np.float64))
    held = apart if apart.any() else ~apart
    net.scale, net.shift = _platt(top[held], y[held])
    net.x = None
    return net


def _platt(x: np.ndarray, y: np.ndarray, prior: float = 1e-3) -> tuple[float, float]:
    """A logistic fit with smoothed targets, the toxic class weighing a quarter: Newton steps, halved until
    the loss falls, on centred values; ``prior`` holds the slope down where classes are apart."""
    mid, wide = float(np.median(x)), float(np.std(x)) or 1.0
    x = (x - mid) / wide
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.25 / n1, 0.75 / n0)

    def loss(v: np.ndarray) -> float:
        z = v[0] * x + v[1]
        return float(np.sum(weight * (np.logaddexp(0, z) - target * z)) + prior * v[0] ** 2 / 2)

    v = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -30, 30)))
        g, h = weight * (q - target), weight * q * (1 - q)
        m = np.array([[np.sum(h * x * x) + prior, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-6]])
        step, size = np.linalg.solve(m, [np.sum(g * x) + prior * v[0], np.sum(g)]), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
    return (float(v[0] / wide), float(v[1] - v[0] * mid / wide)) if v[0] > 0 else (1.0, 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """text and label (``toxic``) of the bounded sample: ids with crc32(id) mod 3 <> 1, lowest hashes first."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = known.withColumn("at", F.xxhash64("doc_id"))
    chosen = [ranked.where(F.col("toxic") == c).orderBy("at", "doc_id").limit(max_docs) for c in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 * max_docs rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Network:
    rows = sorted((r.doc_id, r.text, r.toxic) for r in training_rows(docs, labels, max_docs).where("text is not null").collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, network: Network, name: str = "toxicity_score") -> DataFrame:
    """All columns of ``docs`` and the score in column ``name``, which ``docs`` must not have."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double"

    def run(rows: dict) -> dict:
        return rows | {name: shared.value.scores(rows["text"])}

    return map_rows(docs, run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with their own columns, whatever their names."""
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    found = score(docs, network).withColumnRenamed("toxicity_score", "score")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
