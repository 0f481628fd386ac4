"""Near-duplicates by the Jaccard similarity of word shingles, found by fuzzy hashing of SimHash
fingerprints with the Golay code, each link verified on the texts.

A set of shingles has ``FINGERPRINTS`` fingerprints of three Golay words each: the votes of its shingles'
hashes for every bit, whose signs are the SimHash bits. At similarity 0.8 some 15 % of the bits differ, far more
than the words of one fingerprint bear, so words are decoded by their votes: each goes to the codeword
that the votes agree with most. Two sets are candidates if two of the three codewords of any fingerprint are
the same. At 0.8 a codeword is shared with a chance of 0.26 and two of three with 0.17, so that a pair escapes all 88
fingerprints with a chance of 1 in 10 million, and less above it. Unlike sets share two
codewords by accident, one in 2 ** 24 for each key, which grows with the square of the sets: where keys meet, sizes and 64 other bits of the sketch
(one of four such parts, taken in turn by the slices of keys) tell all but one in 120 of them apart before any row is made, and what hangs together
within a code is a key of its own. A pair at 0.8 is turned away by one part with a chance of 3 in 100,000 and has the keys of the three
others then. Further candidates whose 256 bits differ in more places than any pair of that similarity would are not verified.

Documents with the same set are one node. First each node is compared with the least one that it meets under two keys or more, then
nodes of one key that are not yet in one component are compared with each other, so
that no pair is left out that could still join two components: pair by pair if the key has few nodes or
few such pairs; keys with many form groups, which are cut into chunks of bounded size,
and the sets of every two chunks are compared in one task, where a comparison is a look-up in an array
and no more links come out than join components. Nodes of one component or one group are never paired off again.

Edge cases: a text of fewer words than a shingle is one shingle; null, empty and blank texts have
the empty set and are alike; documents with repeated ids each take part; a null doc_id is never a
component's id unless nothing else is in it (then null); texts of any length count with all their shingles; an empty
table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm.common import doc_texts, map_rows, materialize, spread_join
from gritstone.llm.components import connected_components
from gritstone.llm.golay import BITS, Golay

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of a set, the Golay words of each, and the keys of a set that are sent as one row.
FINGERPRINTS, WORDS, PACKED = 88, 3, 4
SLICES = FINGERPRINTS * WORDS // PACKED
#: Bits by which candidates are told from accidents, and the standard deviations by which 64 of them may exceed the mean where keys meet.
SKETCH, DEVIATIONS = 256, 4.5
#: Pairs of one text that are compared in one task; its text is sent once for each so many.
PAIRS_A_TASK = 256
#: Sets of a key that are paired off one by one (or, of more, a quarter as many pairs for each), and shingles of a chunk of larger keys.
PAIRED, CHUNK_SHINGLES = 16, 1 << 17
_VOTES = FINGERPRINTS * WORDS * BITS
_SEEDS = np.random.default_rng(5).integers(0, 1 << 64, -(-_VOTES // 64), np.uint64, endpoint=False)
#: Less than one vote for each bit, so that even votes are alike in every set.
_TIES = np.random.default_rng(6).uniform(-0.9, 0.9, _VOTES).astype(np.float32)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of all ``width``-word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(plain[a:b], 43) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprints, how many more shingles have it than not."""
    ones = np.zeros(64 * len(_SEEDS), np.int64)
    for at in range(0, len(hashes), 255):
        z = hashes[at : at + 255, None] + _SEEDS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * ones[:_VOTES] - len(hashes)).astype(np.float32) + _TIES


def codewords(found: np.ndarray, golay: Golay) -> np.ndarray:
    """Index of the codeword of each word of the fingerprints."""
    return golay.nearest(found.reshape(-1, BITS)).astype(np.uint16)


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """For each row of codewords, every two of the three of a fingerprint: ``PACKED`` keys of each slice in turn, their
    numbers within the slice included."""
    of = words.reshape(len(words), FINGERPRINTS, WORDS).astype(np.int32)
    both = (of << 12 | np.roll(of, -1, axis=2)).reshape(len(words), SLICES, PACKED)
    return (both | np.arange(PACKED, dtype=np.int32) << 24).reshape(len(words), -1)


def most_bits(similarity: float, bits: int = SKETCH, deviations: float = 10) -> int:
    """Of so many bits those in which sets of this similarity may differ: so many standard deviations above the mean."""
    apart = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(bits * apart + deviations * (bits * apart * (1 - apart)) ** 0.5)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of which the texts (node, text) are similar; a text of many pairs is dealt to many tasks."""
    tasks = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("tasks"))
    dealt = pairs.join(tasks, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("tasks")).cast("int")).drop("tasks")
    left = texts.withColumnRenamed("node", "u").join(tasks, "u").select("u", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    both = dealt.join(right, "v").join(left, ["u", "part"]).select("u", "v", "a", "b")

    def run(rows: dict) -> dict:
        out, last, own = {"u": [], "v": []}, None, None
        for u, v, a, b in zip(rows["u"], rows["v"], rows["a"], rows["b"]):
            if u != last:
                last, own = u, shingle_set(a, width)
            if similar(own, shingle_set(b, width), similarity):
                out["u"].append(u)
                out["v"].append(v)
        return out

    return materialize(map_rows(both, run, "u long, v long"), "shingles-links")


def _plausible(pairs: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sizes and sketches allow of the similarity."""
    of = lambda x: first.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"))
    apart = sum(F.bit_count(F.col("u_sketch")[i].bitwiseXOR(F.col("v_sketch")[i])) for i in range(SKETCH // 64))
    fits = F.least("u_size", "v_size") >= F.lit(similarity) * F.greatest("u_size", "v_size") - 1e-9
    return pairs.join(of("u"), "u").join(of("v"), "v").where(fits & (apart <= most_bits(similarity))).select("u", "v")


def _unsettled(placed: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes of one key that are neither in one component (root) nor in one group (grp, null for none)."""
    classes = placed.select("key", "root", "grp").distinct()
    apart = classes.withColumnsRenamed({"root": "r", "grp": "g"}).join(classes.withColumnsRenamed({"root": "s", "grp": "h"}), "key").where("r < s and (g is null or h is null or g <> h)")
    a = placed.select("key", F.col("root").alias("r"), F.col("grp").alias("a_grp"), F.col("node").alias("a"))
    b = placed.select("key", F.col("root").alias("s"), F.col("grp").alias("b_grp"), F.col("node").alias("b"))
    met = apart.join(a, ["key", "r"]).where("g <=> a_grp").join(b, ["key", "s"]).where("h <=> b_grp")
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _between_chunks(width: int, similarity: float):
    """Links (u, v) among the sets of one chunk, or between those of two."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("chunk", "ascending"), ("node", "ascending")]).select(["node", "root", "chunk", "text"]).to_pydict()
        sets = [shingle_set(t, width) for t in rows["text"]]
        sizes, chunk = np.array([len(x) for x in sets], np.int64), np.array(rows["chunk"])
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        other = int(np.searchsorted(chunk, chunk[0], side="right"))  # where the second chunk begins
        has, parent = np.zeros(len(values), bool), {r: r for r in rows["root"]}

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        u, v = [], []
        for a in range(other if other < len(sets) else len(sets) - 1):
            first = other if other < len(sets) else a + 1
            own = ids[begin[a] : begin[a] + sizes[a]]
            has[own] = True
            both = np.add.reduceat(has[ids[begin[first] :]].astype(np.int64), begin[first:] - begin[first])
            has[own] = False
            for b in (np.flatnonzero(both >= similarity * (sizes[a] + sizes[first:] - both) - 1e-9) + first).tolist():
                x, y = find(rows["root"][a]), find(rows["root"][b])
                if x != y:
                    parent[x] = y
                    u.append(rows["node"][a])
                    v.append(rows["node"][b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _chunked(placed: DataFrame, texts: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Groups (node, root) of sets that meet in the keys of ``placed``, directly or over others, and links (u, v) among those of a group."""
    groups = connected_components(placed.select(F.col("least").alias("u"), F.col("node").alias("v")))
    own = placed.select("node", "size", "root").distinct().join(groups.withColumnRenamed("root", "grp"), "node")
    sized = own.groupBy("grp").agg(F.ceil(F.sum("size") / CHUNK_SHINGLES).cast("int").alias("chunks"))
    dealt = own.join(sized, "grp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("grp", "node", "root", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    met = paired.join(texts, "node")
    return groups, materialize(met.groupBy("grp", "i", "j").applyInArrow(_between_chunks(width, similarity), "u long, v long").distinct(), "shingles-links")


def clusters(code: np.ndarray, node: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the nodes that may be similar to another of their code, the row number of the least node of each one's
    cluster, and the cluster's nodes: what hangs together by sizes and ``bits`` that allow of the similarity."""
    most = most_bits(similarity, 64, DEVIATIONS)

    def fits(i, j) -> np.ndarray:
        alike = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        return alike & (np.bitwise_count(bits[i] ^ bits[j]) <= most)

    order = np.lexsort((node, code))
    begin = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
    held = np.diff(np.append(begin, len(order)))
    least = order[np.repeat(begin, held)]
    together = np.logical_and.reduceat(fits(order, least), begin)
    whole = np.repeat(together & (held > 1), held)
    rows, heads, counts = [order[whole]], [least[whole]], [np.repeat(held, held)[whole]]
    some = ~together & (held > 2)
    for start, n in zip(begin[some].tolist(), held[some].tolist()):
        left = order[start : start + n]
        while len(left) > 1:
            head, left = left[0], left[1:]
            found = [int(head)]
            for i in found:
                close = fits(left, i)
                found.extend(left[close].tolist())
                left = left[~close]
                if not len(left):
                    break
            if len(found) > 1:
                rows.append(np.array(found))
                heads.append(np.full(len(found), head))
                counts.append(np.full(len(found), len(found)))
    return np.concatenate(rows), np.concatenate(heads), np.concatenate(counts)


def _clustered(similarity: float):
    """code, node, size, least, n of the clusters among rows sorted by code; a code may go on in the next batch."""

    def named(rows: pa.Table) -> pa.RecordBatch:
        code, node, size, bits = (rows[c].to_numpy() for c in ("code", "node", "size", "bits"))
        at, least, n = clusters(code, node, size, bits, similarity)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (code[at], node[at], size[at], node[least], n)], ["code", "node", "size", "least", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            kept = now if kept is None else pa.concat_tables([kept, now])
            code = kept["code"].to_numpy()
            if len(code) and (last := int(np.searchsorted(code, code[-1]))):
                yield named(kept.slice(0, last))
                kept = kept.slice(last)
        if kept is not None and kept.num_rows:
            yield named(kept)

    return run


def _met(first: DataFrame, similarity: float) -> DataFrame:
    """key, node, size, the least node of the key and their number, of every key that is shared by nodes that may be similar.

    A set's keys are sent as one row for each slice, with 64 bits of the sketch; there they become rows of their own, which are sorted
    where they are. Nodes that share a code by accident are told apart there and then; those that hang together are one key.
    """

    def pack(rows: dict) -> dict:
        keys = fuzzy_keys(np.frombuffer(b"".join(rows["words"]), np.uint16).reshape(len(rows["node"]), -1))
        return {"node": rows["node"], "size": rows["size"], "sketch": rows["sketch"], "keys": list(keys)}

    packed = map_rows(first.select("node", "size", "sketch", "words"), pack, "node long, size int, sketch array<long>, keys array<int>")
    sliced = packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).select(
        "node", "size", "slice", F.get("sketch", (F.col("slice") + 2) % (SKETCH // 64)).alias("bits"), F.slice("keys", F.col("slice") * PACKED + 1, F.lit(PACKED)).alias("keys")
    )
    keyed = sliced.repartition("slice").select("node", "size", "bits", "slice", F.explode("keys").alias("code")).withColumn("code", F.expr("shiftleft(bigint(slice), 32) | code"))
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("slice", "code"))).where("n > 1").sortWithinPartitions("slice", "code").select("code", "node", "size", "bits")
    found = shared.mapInArrow(_clustered(similarity), "code long, node long, size int, least long, n long")
    return materialize(found.select(F.xxhash64("code", "least").alias("key"), "node", "size", "least", "n"), "shingles-met")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), node (its shingle set), root (the group's least node) and component_id
    (the group's smallest doc_id) of every document."""
    made: list[Golay] = []

    def mark(rows: dict) -> dict:
        if not made:
            made.append(Golay())
        out = {"doc_id": rows["doc_id"], "text": rows["text"], "node": [], "size": [], "sketch": [], "words": []}
        for text in rows["text"]:
            hashes = shingle_set(text, width)
            found = votes(hashes)
            out["node"].append(xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63))
            out["size"].append(len(hashes))
            out["sketch"].append(np.packbits(found[:SKETCH] > 0).view(np.int64))
            out["words"].append(codewords(found, made[0]).tobytes())
        return out

    marked = materialize(map_rows(doc_texts(docs), mark, "doc_id long, text string, node long, size int, sketch array<long>, words binary"), "shingles-marked")
    first = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("size", "sketch", "words"))), "shingles-first")
    met = _met(first.where("size > 0"), similarity)
    to_least = met.where("least <> node").groupBy(F.col("least").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("keys"))
    tried = materialize(to_least.groupBy("v").agg(F.min(F.struct(F.col("keys") == 1, "u"))["u"].alias("u")).select("u", "v"), "shingles-pairs")
    texts = materialize(marked.select("node", "text").join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "shingles-texts")
    found = _verified(tried, texts, width, similarity)

    rooted = connected_components(found)
    placed = met.join(rooted, "node", "left").select("key", "node", "size", "least", "n", F.coalesce("root", "node").alias("root"))
    same = placed.withColumn("m", F.count("*").over(Window.partitionBy("key", "root"))).withColumn("same", F.sum("m").over(Window.partitionBy("key")))
    open_ = same.withColumn("pairs", F.expr("(n * n - same) div 2")).where("pairs > 0").withColumn("large", (F.col("n") > PAIRED) & (F.col("pairs") > PAIRED // 4 * F.col("n")))
    open_ = materialize(open_.select("key", "node", "size", "least", "root", "large"), "shingles-open")
    groups, grouped = _chunked(open_.where("large"), texts, width, similarity)
    placed = open_.where("not large").join(groups.withColumnRenamed("root", "grp"), "node", "left").select("key", "node", "root", "grp")
    rest = _unsettled(materialize(placed, "shingles-placed")).join(tried, ["u", "v"], "left_anti")
    rest = materialize(_plausible(rest, first, similarity), "shingles-pairs")
    linked = connected_components(found.union(_verified(rest, texts, width, similarity)).union(grouped))

    joined = first.join(linked, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("node", "root", "component_id")
    rows = marked.select("doc_id", F.xxhash64("text").alias("text_hash"), "node")
    return spread_join(rows, named, "node").select("doc_id", "text_hash", "node", "root", "component_id")
