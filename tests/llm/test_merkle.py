import hashlib
import zlib

import pytest
from tests.llm.same import by_spark, by_sql

from gritstone.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, arity):
    """Levels from the nodes to the single one, written plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, at, arity):
    """(place, siblings) at each level above the node."""
    out = []
    for level in levels[:-1]:
        run = level[at // arity * arity :][:arity]
        out.append((at % arity, run[: at % arity] + run[at % arity + 1 :]))
        at //= arity
    return out


def brute(rows, arity=merkle.ARITY):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = own, climb([leaf(*r) for r in own], arity)
    top = climb([trees[v][1][-1][0] for v in order], arity)
    out = []
    for n, lang in enumerate(order):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            steps = path(levels, at, arity) + path(top, n, arity)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1]
            folded = leaf(r[0], lower, *r[2:])
            for place, others in steps:
                folded = sha(*others[:place], folded, *others[place:])
            out.append((r[0], folded, levels[0][at], sha(*(d for _, others in steps for d in others)), top[-1][0], levels[-1][0], folded == top[-1][0]))
    return sorted(out, key=repr)


def proven(manifest, **size):
    found = merkle.proofs(manifest, **size)
    roots = {r["lang"]: r["subroot"] for r in manifest.subroots.collect()}
    root = manifest.root.first()[0] if manifest.root.count() else None
    return sorted(((r["doc_id"], r["folded_root"], r["leaf"], r["proof_sha256"], root, roots[r["lang"]], r["folded_root"] == root) for r in found.collect()), key=repr)


def corpus(n, first=0):
    langs = ["en", None, "ß", "de", "Z", ""]
    return [(i, f"Text {i}" if i % 5 else None, langs[i % 7] if i % 7 < 6 else "en", None if i % 4 else "Src", i) for i in range(first, first + n)]


def test_query_by_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = by_spark(merkle.op13_merkle(spark, sf))
    assert got == by_sql(merkle.OP13_SQL, "documents", f"{sf}/documents.parquet") and any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("arity, depth", [(2, 1), (2, 2), (3, 2), (8, 4)])
def test_any_block_size_by_brute_force(spark, arity, depth):
    rows = corpus(90)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert proven(merkle.build(docs, arity, depth), arity=arity, depth=depth) == brute(rows, arity)


def test_one_group_of_many_blocks(spark):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(700)] + [(1000, "only", "fr", None, None)]
    assert proven(merkle.build(spark.createDataFrame(rows, SCHEMA), 4, 2), arity=4, depth=2) == brute(rows, 4)


def test_appended_documents_give_the_manifest_built_anew(spark):
    old, new = corpus(40), corpus(33, 40) + [(500, "n", "new", "s", 1)]
    for arity, depth in ((2, 2), (8, 4)):
        grown = merkle.extend(merkle.build(spark.createDataFrame(old, SCHEMA), arity, depth), spark.createDataFrame(new, SCHEMA), arity, depth)
        assert proven(grown, arity=arity, depth=depth) == brute(old + new, arity)


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    rows = [(None, "a", "en", None, None), (None, None, None, None, None), (3, "B", "en", "s", 1), (3, "A", "en", "s", 1), (3, "A", "en", "s", 1), (4, "", "en", "", 0), (-6, "É" * 200_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA + ", digest string, leaf string, at long, n long")
    assert proven(merkle.build(docs)) == brute(rows)


def test_empty_table(spark):
    assert proven(merkle.build(spark.createDataFrame([], SCHEMA))) == []


def test_stream_extends_every_witness_below():
    stream, held = merkle.Appender(3, 2), []
    nodes = [sha(str(i)) for i in range(7)]
    for d in nodes:
        held.append(merkle.Witness())
        stream.append(d, [held[-1]])
    assert [len(w.places) for w in held] == [2, 2, 2, 2, 1, 1, 0]  # open subtrees have partial witnesses
    root = stream.finish()
    assert all(w.fold(d) == root for w, d in zip(held, nodes)) and held[0].fold(nodes[1]) != root
