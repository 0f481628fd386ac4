"""Merkle manifest of a dataset with incremental witnesses.

Leaves are H of a document's fields; per language they ascend by id and every ``ARITY`` consecutive
nodes become their H until one is left, the subroot; the subroots, ordered by language, give the root
in the same way. H is the lowercase hex SHA-256 of its inputs joined, digests as hex text.

``append`` is the streaming part: digests arrive in order, each as a subtree with the witnesses below
it. When the last of an open run's siblings is complete, the witnesses below each of them are extended
by the others (their place and the siblings' digests), and the run goes on as one node of the next
level. Leaves are dealt into aligned blocks of ``ARITY ** DEPTH``, one task streams a block, and what a
block comes to, its root, is appended in turn: block roots of a language among themselves, block by
block, and the subroots at last. The witness of a block root completes those of all leaves of the block,
so that nothing but one row for each block moves between the phases.

``extend`` appends further documents to a manifest: full blocks keep their roots, and only the open
block of a language is streamed again.

Edge cases: a null field is ``-`` and an empty text ``0:``; texts of any length are hashed whole; a null
language is a language of its own, the first; rows of one id (or without one, which come first) follow
the order of their leaves, and equal rows are leaves of their own; an only leaf is its own subroot, with
no siblings of its language; an empty table gives no rows; a table without one of the fields has it
null; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.llm.common import materialize, shuffle_parts

ARITY, DEPTH = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = 64


def H(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Witness:
    """What leads from one node upwards: its place among its siblings and their digests, level by level."""

    __slots__ = ("places", "siblings")

    def __init__(self):
        self.places: list[int] = []
        self.siblings: list[str] = []

    def fold(self, digest: str) -> str:
        for place, others in zip(self.places, self.siblings):
            digest = H([others[: place * _HEX], digest, others[place * _HEX :]])
        return digest


class Appender:
    """Digests appended in order; ``levels`` runs stand open, one above the other."""

    def __init__(self, levels: int, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[str, list[Witness]]]] = [[] for _ in range(levels)]
        self.root = ""

    def append(self, digest: str, below: list[Witness], level: int = 0) -> None:
        if level == len(self.open):
            self.root = digest
            return
        self.open[level].append((digest, below))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests, below = [d for d, _ in run], []
        for place, (_, witnesses) in enumerate(run):
            others = "".join(digests[:place] + digests[place + 1 :])
            for w in witnesses:
                w.places.append(place)
                w.siblings.append(others)
            below += witnesses
        self.append(H(digests), below, level + 1)

    def finish(self) -> str:
        """Completes the runs that are open, shorter ones too."""
        for level in range(len(self.open)):
            if self.open[level]:
                self._complete(level)
        return self.root


def levels_of(nodes: int, arity: int = ARITY, most: int = DEPTH) -> int:
    """Levels to a single node from ``nodes``, ``most`` of them at once."""
    n = 0
    while nodes > 1 and n < most:
        nodes, n = -(-nodes // arity), n + 1
    return n


def leaf_of(row: dict[str, Column]) -> Column:
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(field(row[n]) for n in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf and altered (the leaf of a tampered text, null where nothing is tampered with)."""
    row = {n: docs[n] if n in docs.columns else F.lit(None).cast("string") for n in FIELDS}
    chosen = F.coalesce(F.crc32(row["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    altered = leaf_of(row | {"text": F.translate(row["text"].cast("string"), _UPPER, _LOWER)})
    return docs.select(row["lang"].cast("string").alias("lang"), row["doc_id"].cast("long").alias("doc_id"), leaf_of(row).alias("leaf"), F.when(chosen, altered).alias("altered"))


def placed(rows: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """Adds ``at``, the place from 0 of each row in its ``group``, and ``n``, the group's rows.

    Rows are sorted by ranges, so a large group lies in many tasks; a range's counts alone say where its rows begin.
    """
    dealt = rows.withColumn("__deal", F.monotonically_increasing_id())  # equal rows lie in many ranges too
    keys = [group, *order, "__deal"]
    sorted_ = dealt.repartitionByRange(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    kept = materialize(sorted_.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()).drop("__deal"), tag)
    spans = kept.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.min("__row").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("__group")
    before = F.sum("rows").over(own.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("__group", "__of", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    joined = kept.join(spans, kept[group].eqNullSafe(spans["__group"]) & (kept["__part"] == spans["__of"]))
    return joined.withColumn("at", F.col("__row") + F.col("shift")).drop("__row", "__part", "__group", "__of", "shift")


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / size).cast("long"))


def block_roots(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """(lang, at, n, digest) -> lang, at, n, digest of the blocks' roots: the next phase's nodes."""
    size = arity**depth

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table["n"][0].as_py()
        stream = Appender(levels_of(n, arity, depth), arity)
        for digest in table["digest"].to_pylist():
            stream.append(digest, [])
        block = table["block"][0].as_py()
        return pa.table({"lang": [table["lang"][0].as_py()], "at": [block], "n": [-(-n // size)], "digest": [stream.finish()]}, schema=pa.schema([("lang", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))

    return _blocks(nodes.select("lang", "at", "n", "digest"), size).groupBy("lang", "block").applyInArrow(run, "lang string, at long, n long, digest string")


class Tree(NamedTuple):
    """Phases of one forest: nodes as appended, from the leaves to the phase whose blocks are the subroots."""

    phases: list[DataFrame]
    subroots: DataFrame


def grow(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH, known: DataFrame | None = None) -> Tree:
    """Appends nodes (lang, at, n, digest) until each language has one; ``known`` holds roots of full first blocks."""
    phases, now = [nodes], nodes
    while True:
        if known is None:
            up = materialize(block_roots(now, arity, depth), "merkle-roots")
        else:  # the blocks that nothing was appended to
            size = F.lit(arity**depth)
            totals = now.groupBy("lang").agg(F.max("n").alias("all"))
            full = known.join(totals, known["lang"].eqNullSafe(totals["lang"])).select(known["lang"], known["at"], F.ceil(F.col("all") / size).cast("long").alias("n"), known["digest"])
            blocked = _blocks(now, arity**depth).alias("b")
            left = blocked.join(full.alias("k"), F.col("b.lang").eqNullSafe(F.col("k.lang")) & (F.col("b.block") == F.col("k.at")), "left_anti")
            up, known = materialize(block_roots(left, arity, depth).unionByName(full), "merkle-roots"), None
        if not up.where("n > 1").limit(1).count():
            return Tree(phases, up)
        phases.append(up)
        now = up


_STEPS = "places array<int>, siblings array<string>"


def witnesses(nodes: DataFrame, above: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """lang, at, places and siblings, up to the root, of nodes (lang, at, n, digest); ``above`` has those of their blocks."""
    return _extended(nodes.select("lang", "at", "n", "digest"), above, arity, depth, lambda table, found: {"places": [w.places for w in found], "siblings": [w.siblings for w in found]}, f"lang string, at long, {_STEPS}")


def _extended(nodes: DataFrame, above: DataFrame, arity: int, depth: int, made, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(table: pa.Table, up: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        table = table.sort_by("at")
        stream, found = Appender(levels_of(table["n"][0].as_py(), arity, depth), arity), []
        for digest in table["digest"].to_pylist():
            found.append(Witness())
            stream.append(digest, [found[-1]])
        stream.finish()
        places, siblings = up["places"][0].as_py(), up["siblings"][0].as_py()
        for w in found:  # the block root's later siblings complete what lies below it
            w.places += places
            w.siblings += siblings
        out = made(table, found)
        return pa.table({f.name: pa.array(out[f.name], f.type) if f.name in out else table[f.name].combine_chunks().cast(f.type) for f in arrow}, schema=arrow)

    left = _blocks(nodes, arity**depth).groupBy("lang", "block")
    right = above.select("lang", F.col("at").alias("block"), "places", "siblings").groupBy("lang", "block")
    return left.cogroup(right).applyInArrow(run, schema)


def _to_root(tree: Tree, top: DataFrame, arity: int, depth: int) -> DataFrame:
    """Witnesses of the first phase's blocks: from the subroots' witnesses down, phase by phase."""
    above = top
    for nodes in reversed(tree.phases[1:]):
        above = materialize(witnesses(nodes, above, arity, depth), "merkle-witnesses")
    return above


class Manifest(NamedTuple):
    """``leaves``: lang, at, n, digest, doc_id, altered; ``blocks``: roots of their blocks; ``subroots``: lang, subroot;
    ``root``: one row; ``witnesses``: lang, at (of the block), places and siblings up to the root."""

    leaves: DataFrame
    blocks: DataFrame
    subroots: DataFrame
    root: DataFrame
    witnesses: DataFrame


def _completed(nodes: DataFrame, arity: int, depth: int, known: DataFrame | None = None) -> Manifest:
    tree = grow(nodes, arity, depth, known)
    blocks = tree.phases[1] if len(tree.phases) > 1 else tree.subroots
    ordered = placed(tree.subroots.select(F.lit(None).cast("string").alias("all"), "lang", "digest"), "all", ["lang"], "merkle-subroots")
    over = grow(materialize(ordered.select(F.lit(None).cast("string").alias("lang"), "at", "n", "digest", F.col("lang").alias("named")), "merkle-top"), arity, depth)
    start = over.subroots.select("lang", "at", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings"))
    first = witnesses(over.phases[0], _to_root(over, start, arity, depth), arity, depth)
    names = over.phases[0].select("at", F.col("named"))
    top = materialize(first.drop("lang").join(names, "at").select(F.col("named").alias("lang"), F.lit(0).cast("long").alias("at"), "places", "siblings"), "merkle-witnesses")
    return Manifest(nodes, blocks, tree.subroots.select("lang", F.col("digest").alias("subroot")), over.subroots.select(F.col("digest").alias("root")), _to_root(tree, top, arity, depth))


def build(docs: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> Manifest:
    made = materialize(leaves(docs), "merkle-leaves").withColumnRenamed("leaf", "digest")
    return _completed(materialize(placed(made, "lang", ["doc_id", "digest"], "merkle-sorted"), "merkle-placed"), arity, depth)


def extend(old: Manifest, docs: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> Manifest:
    """``old`` with ``docs`` appended: per language after the last old leaf, ascending by id among themselves.

    It equals the manifest built anew where the new ids are greater than the old ones of their language.
    """
    made = materialize(leaves(docs), "merkle-leaves").withColumnRenamed("leaf", "digest")
    new = placed(made, "lang", ["doc_id", "digest"], "merkle-sorted")
    before = old.leaves.groupBy("lang").agg(F.max("n").alias("before"))
    after = new.join(before, new["lang"].eqNullSafe(before["lang"]), "left").select(new["lang"], "doc_id", "digest", "altered", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"))
    every = old.leaves.select("lang", "doc_id", "digest", "altered", "at").unionByName(after)
    totals = every.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("n"))
    nodes = materialize(every.join(totals, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang"), "merkle-placed")
    full = before.select(F.col("lang").alias("__lang"), F.floor(F.col("before") / arity**depth).alias("full"))
    known = old.blocks.join(full, F.col("lang").eqNullSafe(F.col("__lang"))).where("at < full").select("lang", "at", "digest")
    return _completed(nodes, arity, depth, known)


def proofs(manifest: Manifest, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """lang, doc_id, leaf, proof_sha256 (H of the witness) and folded_root (from the altered leaf where there is one)."""

    def made(table: pa.Table, found: list[Witness]) -> dict:
        leaf, altered = table["digest"].to_pylist(), table["altered"].to_pylist()
        return {"leaf": leaf, "proof_sha256": [H(w.siblings) for w in found], "folded_root": [w.fold(b or a) for w, a, b in zip(found, leaf, altered)]}

    return _extended(manifest.leaves.select("lang", "at", "n", "digest", "doc_id", "altered"), manifest.witnesses, arity, depth, made, "lang string, doc_id long, leaf string, proof_sha256 string, folded_root string")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    manifest = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found, subroots = proofs(manifest), manifest.subroots.withColumnRenamed("lang", "__lang")
    named = found.join(subroots, found["lang"].eqNullSafe(subroots["__lang"])).crossJoin(F.broadcast(manifest.root))  # one row
    return named.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _op13_sql(levels: int = 7, top: int = 2) -> str:
    """Unrolled: ``levels`` for leaves (8 ** 7 of a language), ``top`` for languages (64)."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c if c != "text" else text) for c in FIELDS) + ")"

    table = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b))"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295::BIGINT), 4294967295)"

    def climb(first: str, key: str, n: int, p: str) -> tuple[list[str], str]:
        out, now = [], first
        for k in range(n):
            by = f"PARTITION BY {key}, pos // 8" if key else "PARTITION BY pos // 8"
            whole = f"OVER (PARTITION BY {key})" if key else "OVER ()"
            out.append(f"{p}w{k} AS MATERIALIZED (SELECT *, count(*) {whole} AS cnt, list(d) OVER ({by} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ds FROM {now})")
            group = f"{key}, " if key else ""
            out.append(f"{p}n{k + 1} AS MATERIALIZED (SELECT {group}pos // 8 AS pos, CASE WHEN any_value(cnt) > 1 THEN sha256(array_to_string(any_value(ds), '')) ELSE any_value(d) END AS d FROM {p}w{k} GROUP BY {group}pos // 8)")
            now = f"{p}n{k + 1}"
        return out, now

    low, low_last = climb("n0", "lang", levels, "l")
    high, high_last = climb("s0", "", top, "t")
    steps, now = [], "f0"
    for k in range(levels + top):
        w, on = (f"lw{k}", f"f.lang IS NOT DISTINCT FROM w.lang AND f.pos // {8**k} = w.pos") if k < levels else (f"tw{k - levels}", f"f.top // {8 ** (k - levels)} = w.pos")
        before, after = "array_to_string(w.ds[1:w.pos % 8], '')", "array_to_string(w.ds[w.pos % 8 + 2:], '')"
        steps.append(
            f"f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (CASE WHEN w.cnt > 1 THEN proof || {before} || {after} ELSE proof END AS proof, CASE WHEN w.cnt > 1 THEN sha256({before} || cur || {after}) ELSE cur END AS cur) FROM {now} f JOIN {w} w ON {on})"
        )
        now = f"f{k + 1}"
    return f"""
WITH crc AS MATERIALIZED (SELECT {table} AS t),
d AS MATERIALIZED (
  SELECT doc_id, lang, {leaf("text")} AS d, {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS altered, coalesce({crc} % 3 = 0, false) AS chosen FROM documents, crc
), n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM d),
{", ".join(low)},
s0 AS MATERIALIZED (SELECT lang, d, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM {low_last}),
{", ".join(high)},
f0 AS MATERIALIZED (SELECT n0.doc_id, n0.lang, n0.d AS leaf, s0.d AS subroot, n0.pos, s0.pos AS top, '' AS proof, CASE WHEN chosen THEN altered ELSE n0.d END AS cur FROM n0 JOIN s0 ON n0.lang IS NOT DISTINCT FROM s0.lang),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.d AS verified FROM {now} CROSS JOIN {high_last} r
"""


OP13_SQL = _op13_sql()
