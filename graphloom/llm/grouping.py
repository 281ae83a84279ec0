"""Connected components by union-find: each partition merges its own links, then rounds of
minimum joins merge what is left. Links and components never reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, frugal, heavy_from, materialize, salted_join

#: Nodes that a task's union-find holds before it sends its links on.
HELD = 500_000


def _stars(parent: dict[int, int]) -> pa.RecordBatch:
    out = []
    for x in parent:
        root = x
        while parent[root] != root:
            root = parent[root]
        if root != x:
            out.append((x, root))
    u, v = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


@frugal
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around the smallest node of each set."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield _stars(parent)
            parent.clear()
    if parent:
        yield _stars(parent)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in `links`, whose two columns
    are bigint ids. Self-links and repeated links are harmless, links with a null are ignored.

    Rounds of large-star and small-star: every node's neighbours are linked to its smallest one. The
    links of a node with very many are dealt over tasks by salted_join. Each round is a written table.
    """
    a, b = links.columns
    edges = links.select(F.col(f"`{a}`").cast("bigint").alias("u"), F.col(f"`{b}`").cast("bigint").alias("v")).where("u is not null and v is not null")
    alone = edges.where("u = v").select("u").distinct()
    edges = materialize(edges.where("u <> v").mapInArrow(_merge, "u bigint, v bigint"), "links")
    count, mark = edges.count(), None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("_n")), "least")
        hot = least.where(F.col("_n") > heavy_from(2 * count)).select("u", "_n")
        large = salted_join(both.where("v > u"), least.select("u", "m"), ["u"], "v", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # A node has few smaller ones here: what a task's union-find sends on is stars around their smallest.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(smallest.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "stars")
        discard(edges)
        discard(least)
        edges = after
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        count, mark = found[0], found
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    single = alone.select(F.col("u").alias("node"), F.col("u").alias("component")).join(stars.union(roots).select("node"), "node", "left_anti")
    return stars.union(roots).union(single)
