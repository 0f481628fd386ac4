"""Groups of similar sets: classes of equal ones, links between classes counted, components; no list of pairs.

Two sets of Jaccard similarity ``least`` or more share an item among the first size - ceil(least * size) + 1
of each, items from rare to frequent, so classes meet under those items. What meets under an item is
compared in chunks of bounded size, every two of them in a task; a pair counts under the first such item
that both have. A task returns counts for each class and as many links as join components.

Edge cases: null and empty sets are classes of their own row, without links; equal sets are one class; ties
of ids count once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gritstone.sources.scratch import kept

#: Classes of a chunk.
CHUNK = 2048


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> node, root: one root for each component of two nodes or more.

    Every round each node joins the least of its neighbours and itself by a hash of the round, edges between what has
    been joined are contracted, and a constant share of the nodes goes; the roots are then handed back down.
    """
    now = kept(edges.where("u <> v").select("u", "v").distinct(), "edges")
    steps: list[DataFrame] = []
    while now.limit(1).count():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), c.alias("n"))
        joined = kept(both.groupBy("u").agg(F.least(F.min(order(F.col("v"))), order(F.col("u")))["n"].alias("to")), "joined")
        steps.append(joined)
        left, right = joined.select("u", F.col("to").alias("a")), joined.select(F.col("u").alias("v"), F.col("to").alias("b"))
        now = kept(now.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not steps:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = steps[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        above = rooted.withColumnRenamed("node", "to")
        rooted = kept(step.join(above, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root")), "rooted")
    return rooted


def _compared(least: float):
    """Counts and links among the classes of one chunk, or between those of two, that meet under one item."""
    schema = pa.schema([("u", pa.string()), ("v", pa.string()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("chunk", "ascending"), ("rep", "ascending")]).select(["rep", "items", "prefix", "chunk", "item"]).to_pydict()
        reps, item, chunk = rows["rep"], rows["item"][0], np.array(rows["chunk"])
        sizes = np.array([len(x) for x in rows["items"]], np.int64)
        values, ids = np.unique(np.concatenate([np.array(x, object) for x in rows["items"]]), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        heads = [dict.fromkeys(x[:n]) for x, n in zip(rows["items"], rows["prefix"])]
        second = int(np.searchsorted(chunk, chunk[0], side="right"))
        has, parent, counts, links = np.zeros(len(values), bool), list(range(len(reps))), [0] * len(reps), []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for a in range(second if second < len(reps) else len(reps) - 1):
            first = second if second < len(reps) else a + 1
            own = ids[begin[a] : begin[a] + sizes[a]]
            has[own] = True
            both = np.add.reduceat(has[ids[begin[first] :]].astype(np.int64), begin[first:] - begin[first])
            has[own] = False
            for b in (np.flatnonzero(both >= least * (sizes[a] + sizes[first:] - both) - 1e-9) + first).tolist():
                if next(x for x in heads[a] if x in heads[b]) == item:
                    counts[a] += 1
                    counts[b] += 1
                    x, y = find(a), find(b)
                    if x != y:
                        parent[x] = y
                        links.append((reps[a], reps[b], None))
        out = [(r, None, n) for r, n in zip(reps, counts) if n] + links
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def similar_groups(sets: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """(id: string, items: array<string>) -> id, class_id, group_id, links: the least id of the equal sets and of the
    component, and how many other classes are similar to this one."""
    rows = sets.select("id", F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))).alias("items"))
    named = kept(rows.withColumn("class_id", F.when(F.size("items") > 0, F.min("id").over(Window.partitionBy("items"))).otherwise(F.col("id"))), "classes")
    distinct = named.where("size(items) > 0").groupBy(F.col("class_id").alias("rep")).agg(F.first("items").alias("items"))
    each = distinct.select("rep", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("df"))
    ordered = each.join(often, "item").groupBy("rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "item"))), lambda x: x["item"]).alias("items"))
    n = F.size("items")
    prefixed = kept(ordered.withColumn("prefix", (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int")), "prefixed")
    met = prefixed.select("rep", "items", "prefix", F.explode(F.slice("items", F.lit(1), F.col("prefix"))).alias("item"))
    crowds = met.groupBy("item").agg(F.count("*").alias("crowd")).where("crowd > 1").withColumn("chunks", F.ceil(F.col("crowd") / chunk).cast("int"))
    dealt = met.join(crowds, "item").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    paired = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("rep", "items", "prefix", "item", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    found = kept(paired.groupBy("item", "i", "j").applyInArrow(_compared(least), "u string, v string, links long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("class_id")).agg(F.sum("links").alias("links"))
    rooted = connected_components(found.where("v is not null").select("u", "v"))
    groups = rooted.withColumn("group_id", F.min("node").over(Window.partitionBy("root"))).select(F.col("node").alias("class_id"), "group_id")
    return named.select("id", "class_id").join(groups, "class_id", "left").join(counts, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
