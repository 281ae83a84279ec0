"""Bounded paths, cycles, ripples, shortest paths and importance on edges(src, dst)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.storage import cut


def _link(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def _walks(edges: DataFrame, starts: DataFrame, depth: int) -> Iterator[DataFrame]:
    """(path, used) of the walks of 0, 1, ... `depth` edges from starts(id) that use no edge twice: one
    join a hop, a hash or sort-merge join on the walk's last node."""
    link = _link(edges)
    step = F.struct("src", "dst")
    kinds = ", ".join(f"{c}:{link.schema[c].dataType.simpleString()}" for c in ("src", "dst"))
    walk = starts.select(F.array("id").alias("path"), F.array().cast(f"array<struct<{kinds}>>").alias("used"))
    yield walk
    for _ in range(depth):
        walk = walk.join(link, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("used", step))
        walk = walk.select(F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array(step)).alias("used"))
        yield walk


def bounded_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(path, hops): every walk of 0 to `depth` edges from starts(id), as arrays of ids, that uses no
    edge twice."""
    every = reduce(DataFrame.unionAll, (w.select("path") for w in _walks(edges, starts, depth)))
    return every.select("path", (F.size("path") - 1).alias("hops"))


def call_graph(edges: DataFrame, starts: DataFrame, depth: int = 3, limit: int = 50) -> DataFrame:
    """The edges, repeats kept, on the first `limit` paths of up to `depth` hops (shortest first, then
    by id): (src, dst, n) with n the paths that hold the edge. Hops beyond the one at which the limit
    is met are not walked, so `limit` paths at most are held."""
    walks, left = [], limit
    for hops, walk in enumerate(_walks(edges, starts, depth)):
        walk = cut(walk.orderBy("path").limit(left))
        walks.append(walk.select("path", F.lit(hops).alias("hops")))
        left -= walk.count()
        if left <= 0:
            break
    pairs = F.transform(F.sequence(F.lit(1), F.col("hops")), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    steps = reduce(DataFrame.unionAll, walks).where("hops > 0").select(F.explode(pairs).alias("e"))
    return steps.groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.count("*").alias("n"))


def members(defines: DataFrame, files: DataFrame, hops: int = 2) -> DataFrame:
    """(id): what is tied to files(id) by 1 to `hops` edges of defines(src, dst), in either direction."""
    ties = defines.select("src", "dst").unionAll(defines.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    files = files.select("id").distinct()
    around = files
    every = None
    for _ in range(hops):
        around = around.join(ties, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        every = around if every is None else every.unionAll(around)
    return every.distinct().join(files, "id", "left_anti")


def cycles(edges: DataFrame, least: int = 2, most: int = 5, limit: int | None = 10, within: DataFrame | None = None) -> DataFrame:
    """(path, length): cycles of `least` to `most` edges, none used twice. Of the cycles over the same
    set of nodes one stays: the shortest, then the smallest path, so rotations count once.

    Walks start at their smallest node only, which keeps a rotation of each and prunes the joins; the
    closing edge is a join on both ends. Shorter cycles come first, so walks end at the length at
    which `limit` cycles are found. With `within` (id), only cycles that hold one of its nodes count: they
    are sorted out by a semi-join before the limit is."""
    link = cut(_link(edges).where("src <> dst"))
    used = F.exists(F.sequence(F.lit(1), F.size("path") - 1), lambda i: (F.element_at("path", i) == F.col("src")) & (F.element_at("path", i + 1) == F.col("dst")))
    longer = F.concat("path", F.array("dst")).alias("path")
    last, first = F.element_at("path", -1), F.col("path")[0]
    walk, once = link.where("src < dst").select(F.array("src", "dst").alias("path")), None
    for hops in range(2, most + 1):
        if hops >= least:
            closed = walk.join(link, (last == F.col("src")) & (first == F.col("dst"))).where(~used).select(longer, F.lit(hops).alias("length"))
            if within is not None:
                held = closed.select("path", F.explode("path").alias("id")).join(within.select("id"), "id", "left_semi").select("path")
                closed = closed.join(held.distinct(), "path", "left_semi")
            closed = closed.withColumn("set", F.array_sort(F.array_distinct("path"))) if once is None else once.unionByName(closed.withColumn("set", F.array_sort(F.array_distinct("path"))))
            once = closed.groupBy("set").agg(F.min(F.struct("length", "path")).alias("c")).select("c.path", "c.length", "set")
            if limit is not None:
                once = cut(once)
                if len(once.select("length").head(limit)) == limit:
                    break
        if hops < most:
            walk = walk.join(link, (last == F.col("src")) & (F.col("dst") >= first)).where(~used).select(longer)
    once = once.drop("set")
    return once if limit is None else once.orderBy("length", "path").limit(limit)


#: How many nodes hang on a node, and how bad that is.
def severity(n: Column) -> Column:
    return F.when(n > 10, "critical").when(n > 5, "high").when(n > 1, "medium").otherwise("low")


def ripple(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(id, distance): what calls starts(id) directly or through others. Nodes at `depth` are still
    expanded, so distance reaches depth + 1. The start itself is no part of it. Edges and start are computed
    once and stored, not anew for each hop."""
    link = cut(_link(edges))
    seen = cut(start.select(F.col("id"), F.lit(0).alias("distance")))
    frontier = seen
    for hop in range(1, depth + 2):
        step = frontier.select(F.col("id").alias("dst")).join(link, "dst").select(F.col("src").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)))
        seen = seen.unionAll(frontier)
    return seen.where("distance > 0")


def ripple_summary(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    found = ripple(edges, start, depth).agg(F.count("*").alias("affected"), F.count_if(F.col("distance") == 1).alias("direct"))
    return found.withColumn("severity", severity(F.col("affected"))).withColumn("transitive_impact", F.lit(depth))


def shortest_path(edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, distance): the shortest path between the ids, however long; among equally short ones the
    smallest in order; itself with distance 0; no row if there is none."""
    return typed_path(edges.select("src", "dst", F.lit("").alias("type"), F.col("dst").alias("place")), source, target, ("",))


#: The relations that a dependency follows, in this order.
DEPENDENCIES = ("CALLS", "IMPORTS", "DEPENDS_ON")


def typed_path(edges: DataFrame, source: DataFrame, target: DataFrame, types: tuple[str, ...] = DEPENDENCIES) -> DataFrame:
    """(path, distance): a shortest path from source(id) to target(id) over edges(src, dst, type, place) of the
    types. Of equally short ones that is taken which a breadth-first search meets first: nodes go on in the
    order in which they were reached, their edges by type, then place. Itself with distance 0; no row if there
    is no path.

    Each hop is a table of its own: (id, parent, reached), with `reached` ascending in the order of the search,
    as a sort by ranges gives it. The path is walked back over these tables at the end.
    """
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    link = cut(edges.where(F.col("type").isin(*types)).select("src", "dst", rank.alias("rank"), "place"))
    target = cut(target.select("id").distinct())
    levels = [cut(source.select("id", F.lit(None).cast(source.schema["id"].dataType).alias("parent"), F.lit(0).cast("bigint").alias("reached")))]
    while (last := levels[-1].join(target, "id", "left_semi")).isEmpty():
        step = levels[-1].select(F.col("id").alias("src"), "reached").join(link, "src").groupBy("dst").agg(F.min(F.struct("reached", "rank", "place", "src")).alias("by"))
        seen = reduce(DataFrame.unionAll, (level.select("id") for level in levels))
        fresh = step.join(seen, F.col("dst") == F.col("id"), "left_anti").orderBy("by.reached", "by.rank", "by.place", "dst")
        level = cut(fresh.select(F.col("dst").alias("id"), F.col("by.src").alias("parent"), F.monotonically_increasing_id().alias("reached")))
        if level.isEmpty():
            return level.select(F.array("id").alias("path"), F.lit(0).alias("distance"))
        levels.append(level)
    walk = last.orderBy("reached").limit(1).select(F.array("id").alias("path"), F.col("parent").alias("_at"))
    for level in levels[-2::-1]:
        walk = walk.join(level, F.col("_at") == F.col("id")).select(F.concat(F.array("id"), "path").alias("path"), F.col("parent").alias("_at"))
    return walk.select("path", F.lit(len(levels) - 1).alias("distance"))


def _pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, n): edges with their number, stored: every round reads them."""
    return cut(edges.groupBy("src", "dst").agg(F.count("*").alias("n")))


def importance(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, score): every node starts with 1; in each round its score is 1 plus half the scores of all
    that call it, repeats counted; at last all are divided by the largest."""
    return _scores(nodes, _pairs(edges), rounds)


def _scores(nodes: DataFrame, calls: DataFrame, rounds: int = 5) -> DataFrame:
    score = nodes.select("id", F.lit(1.0).alias("score"))
    for _ in range(rounds):
        into = score.join(calls, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("n") / 2).alias("more"))
        score = cut(nodes.select("id").join(into, F.col("id") == F.col("dst"), "left").select("id", (1 + F.coalesce("more", F.lit(0.0))).alias("score")))
    return score.crossJoin(F.broadcast(score.agg(F.max("score").alias("top")))).select("id", (F.col("score") / F.col("top")).alias("score"))


def suggestion(score: Column, calls: Column) -> Column:
    """A ladder over score and calls."""
    return F.when((score > 0.7) & (calls > 5), "critical").when((score > 0.5) & (calls > 3), "important").when(score > 0.3, "watch").otherwise("fine")


def criticality(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The `top` nodes by importance, then id: id, score, calls, is_critical, suggestion."""
    pairs = _pairs(edges)
    calls = pairs.groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("calls"))
    scored = _scores(nodes, pairs).join(calls, "id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    return scored.orderBy(F.desc("score"), "id").limit(top).withColumn("is_critical", F.col("score") > 0.5).withColumn("suggestion", suggestion(F.col("score"), F.col("calls")))


def transitive_paths(edges: DataFrame, target: DataFrame, depth: int = 2) -> DataFrame:
    """(paths, nodes): walks of 1 to `depth` edges that end in the target, and the nodes they start from."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    walks = bounded_paths(back, target, depth).where("hops > 0")
    return walks.agg(F.count("*").alias("paths"), F.countDistinct(F.element_at("path", -1)).alias("nodes"))


def first_match(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
