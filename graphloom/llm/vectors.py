"""Near-duplicate vectors by NN-descent: lists of nearest neighbours, begun in blocks of vectors
that random hyperplanes put next to each other, are refined by comparing neighbours of
neighbours; the links at the threshold are kept, and the lists' recall is measured."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from graphloom.llm.common import discard, materialize, prepare
from graphloom.llm.grouping import components

#: Vectors of a block: a group is cut into 16 blocks at most until they hold MOST_BLOCK vectors each.
BLOCK, MOST_BLOCK = 128, 2048


def n_blocks(size: Column) -> Column:
    """Blocks of a group of `size` vectors: few copies of each vector, and a bound for a task's matrix."""
    return F.greatest(F.least(F.lit(16), F.ceil(size / BLOCK)), F.ceil(size / MOST_BLOCK)).cast("int")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys of sorted rows, at most `most` rows at a time (a longer run comes in
    parts), across batch borders."""
    held: list[pa.RecordBatch] = []
    now = None

    def done():
        return now, pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        at = 0
        count = sum(b.num_rows for b in held)
        for i in range(len(rows)):
            if rows[i] != now or count >= most:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield done()
                held, at, count, now = [], i, 0, rows[i]
            count += 1
        if at < len(rows):
            held.append(batch.slice(at))
    if held:
        yield done()


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles of length 1 from a column of lists of floats or doubles."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])]).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pairs(ids: np.ndarray, s: np.ndarray, worst: np.ndarray, k: int, apart: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k closest others that beat its worst neighbour so far; those
    that have the same value of a column of `apart` don't count."""
    np.fill_diagonal(s, -2.0)
    for value in apart:
        s[value[:, None] == value[None, :]] = -2.0
    if s.shape[1] > k:
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    else:
        best = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    value = np.take_along_axis(s, best, axis=1)
    rows, columns = np.nonzero((value > worst[:, None]) & (ids[best] != ids[:, None]))
    return ids[rows], ids[best[rows, columns]], value[rows, columns]


_FOUND = "u bigint, v bigint, s double"


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "s"])


def _joined(keys: list[str], most: int, k: int, apart: list[str] = ()):
    """Compares the vectors of each group of sorted rows (*keys, id, worst, x, *apart)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for _, group in _groups(batches, keys, most):
            if group.num_rows < 2:
                continue
            x = unit(group.column("x"))
            found = _pairs(group.column("id").to_numpy(), x @ x.T, group.column("worst").to_numpy(), k, [group.column(c).to_numpy() for c in apart])
            if len(found[0]):
                parts.append(found)
                n += len(found[0])
            if n > 200_000:
                yield _batch(parts)
                parts, n = [], 0
        yield _batch(parts)

    return compare


def _code(planes: np.ndarray):
    """The signs of a vector's projections as a number."""
    bits = np.int64(1) << np.arange(planes.shape[1] - 1, -1, -1, dtype=np.int64)

    @F.arrow_udf("bigint")
    def code(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(((unit(column) @ planes) > 0) @ bits, pa.int64()) if len(column) else pa.array([], pa.int64())

    return code


def start(vectors: DataFrame, seeds: range, leaf: int, k: int, dims: int, apart: list[str] = ()) -> DataFrame:
    """Lists from an order of the vectors for each seed, by the signs of random projections: neighbours
    in an order are compared in blocks of `leaf`, so blocks are equally full whatever the data. A few
    vectors are one range, as its borders part neighbours in every order alike."""
    out, ranges = None, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + vectors.count() // leaf)
    for seed in seeds:
        code = _code(np.random.default_rng(seed).standard_normal((dims, 48)))
        ordered = vectors.select(code("x").alias("code"), "id", F.lit(-2.0).alias("worst"), "x", *apart)
        ordered = ordered.repartitionByRange(ranges, "code", "id").sortWithinPartitions("code", "id")
        one = ordered.withColumn("all", F.lit(0)).mapInArrow(_joined(["all"], leaf, k, apart), _FOUND)
        out = one if out is None else out.union(one)
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """The k closest of each u, each with the first round that found it: one shuffle, by u."""
    once = found.repartition(F.col("u")).groupBy("u", "v").agg(F.max("s").alias("s"), F.min("since").alias("since"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _both(links: DataFrame, *more: str) -> DataFrame:
    """Each link in both directions."""
    return links.select(F.col("u").alias("centre"), F.col("v").alias("id"), *more).union(links.select(F.col("v").alias("centre"), F.col("u").alias("id"), *more))


def refine(vectors: DataFrame, lists: DataFrame, k: int, since: int = 0, rivals: DataFrame | None = None, apart: list[str] = ()) -> DataFrame:
    """Neighbours of neighbours: around each vector, those in its list and those that list it are all
    compared with each other, where one of them came in round `since` or later (others have met); around
    vectors that very many list, in pairs of blocks. What is found has to beat `rivals` (the
    lists themselves, if not given); vectors with the same value of a column of `apart` are not compared."""
    worst = (lists if rivals is None else rivals).groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(-2.0).alias("worst"))
    known = vectors.join(worst, vectors["id"] == worst["u"], "left").select("id", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "x", *apart)
    around = _both(lists, "since").groupBy("centre", "id").agg(F.max("since").alias("since"))
    moved = around.groupBy("centre").agg((F.count("*") + 1).alias("n"), F.max("since").alias("since")).where(F.col("since") >= since).select("centre", n_blocks(F.col("n")).alias("blocks"))
    around = around.select("centre", "id").join(moved, "centre").union(moved.select("centre", F.col("centre").alias("id"), "blocks"))
    sized = around.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"))))
    dealt = sized.select("centre", "id", "block", pair.alias("pair")).select("centre", "id", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), F.when(F.col("pair.i") == F.col("pair.j"), F.col("id")).otherwise(F.col("block")).alias("side"))
    grouped = dealt.join(known, "id").repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")
    return grouped.select("centre", "i", "j", "id", "worst", "x", "side", *apart).mapInArrow(_joined(["centre", "i", "j"], 1 << 40, k, ["side", *apart]), _FOUND)


def saturated(lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(id): vectors whose whole list reaches the threshold, which may have more links than it holds."""
    return lists.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("s")).where((F.col("n") >= k) & (F.col("s") >= threshold)).select(F.col("u").alias("id"))


def count_full(members: DataFrame, threshold: float) -> DataFrame:
    """(id, other, n) of members' (id, component, copies, full, x): for each `full` vector the copies of
    those in its component with a cosine of `threshold` or more (other is null; several rows to be
    summed), and for the others each link to a full one, with its copies.

    Blocks of full vectors are compared with each other and with the blocks of the rest; of pairs of
    full ones only counts are kept, so no list of links is held however large the group."""
    sizes = members.groupBy("component").agg(F.count_if("full").alias("n_full"), F.count_if(~F.col("full")).alias("n_rest")).where("n_full > 0")
    sizes = sizes.select("component", n_blocks(F.col("n_full")).alias("full_blocks"), n_blocks(F.col("n_rest")).alias("rest_blocks"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("full"), F.col("full_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    own = members.join(sizes, "component").withColumn("block", block)
    # Block j of the rest is written -1 - j, so that a pair of blocks is (least, greatest) too.
    number = F.when(F.col("full"), F.col("block")).otherwise(-1 - F.col("block"))
    others = F.sequence(F.when(F.col("full"), -F.col("rest_blocks")).otherwise(0), F.col("full_blocks") - 1)
    pair = F.explode(F.transform(others, lambda j: F.struct(F.least(j, number).alias("i"), F.greatest(j, number).alias("j"))))
    dealt = own.select("component", pair.alias("pair"), number.alias("block"), "id", "copies", "x").select("component", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "id", "copies", "x")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids, others, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64()) if others is None else pa.array(others, pa.int64()), pa.array(n, pa.int64())], names=["id", "other", "n"])

        for (_, i, j), group in _groups(batches, ["component", "i", "j"], 1 << 40):
            x, ids, copies = unit(group.column("x")), group.column("id").to_numpy(), group.column("copies").to_numpy()
            first = group.column("block").to_numpy() == i
            if i == j:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                yield rows(ids, None, near @ copies)
                continue
            near = x[first] @ x[~first].T >= threshold
            yield rows(ids[~first], None, near.T @ copies[first])
            if i >= 0:
                yield rows(ids[first], None, near @ copies[~first])
            else:
                u, v = np.nonzero(near)
                yield rows(ids[first][u], ids[~first][v], copies[~first][v])

    return dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(counted, "id bigint, other bigint, n bigint")


def count_links(members: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(id, n): the copies of others that each of members' (id, component, copies, full, x) is linked with:
    from `links` (u, v), which hold all those of vectors that aren't full, and by comparison for those that are."""
    counted = materialize(count_full(members, threshold), "counted")
    listed = _both(links).select(F.col("centre").alias("id"), F.col("id").alias("other"))
    rest = members.where("not full").select("id")
    listed = listed.join(rest, "id", "left_semi").join(members.select(F.col("id").alias("other"), F.col("copies").alias("n")), "other").select("id", "other", "n")
    once = listed.union(counted.where("other is not null")).groupBy("id", "other").agg(F.first("n").alias("n")).select("id", "n")
    return once.union(counted.where("other is null").select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))


def across(vectors: DataFrame, lists: DataFrame, full: DataFrame, groups: DataFrame, threshold: float, k: int, trees: int, leaf: int, rounds: int, dims: int) -> DataFrame | None:
    """(u, v): links between the components `groups` of saturated vectors `full`: their lists go on
    with the closest vectors of other components. None if there are not two such components."""
    sub = materialize(vectors.join(full.join(groups.withColumnsRenamed({"node": "id", "component": "label"}), "id"), "id"), "saturated")
    if len(sub.select("label").distinct().head(2)) < 2:
        return None
    ids = sub.select("id")
    inner = lists.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "s", F.lit(0).alias("since"))
    outer = materialize(best(start(sub, range(trees), leaf, k, dims, ["label"]).withColumn("since", F.lit(0)), k), "outer")
    for done in range(rounds):
        found = refine(sub, inner.union(outer), k, done, outer, ["label"]).withColumn("since", F.lit(done + 1))
        after = materialize(best(outer.union(found), k), "outer")
        discard(outer)
        outer = after
    return outer.where(F.col("s") >= threshold).select("u", "v")


def audit(vectors: DataFrame, lists: DataFrame, threshold: float, queries: int) -> DataFrame:
    """(u, v): all links of drawn vectors, found by comparing them with every vector. Drawn by a hash of
    their ids: `queries` of those with a link in `lists`, of those whose closest is within 0.1 of the
    threshold, and of all."""
    closest = lists.groupBy("u").agg(F.max("s").alias("s"))
    ranked = vectors.select("id").join(closest, F.col("id") == F.col("u"), "left").select("id", F.when(F.col("s") >= threshold, 0).when(F.col("s") >= threshold - 0.1, 1).otherwise(2).alias("kind"), F.xxhash64(F.lit("audit"), "id").alias("draw"))
    drawn = ranked.orderBy("draw", "id").limit(queries).select("id")
    for kind in (0, 1):
        drawn = drawn.union(ranked.where(F.col("kind") == kind).orderBy("draw", "id").limit(queries).select("id"))
    own = vectors.join(F.broadcast(drawn.distinct()), "id", "left_semi").select("id", "x").orderBy("id").toArrow()  # 3 * queries at most
    if not own.num_rows:
        return vectors.sparkSession.createDataFrame([], "u bigint, v bigint")
    ids, x = own.column("id").to_numpy(), unit(own.column("x"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = x @ unit(batch.column("x")).T
                others = batch.column("id").to_numpy()
                q, v = np.nonzero((s >= threshold) & (ids[:, None] != others[None, :]))
                yield _batch([(ids[q], others[v], s[q, v])])

    return vectors.select("id", "x").mapInArrow(compared, _FOUND).select("u", "v")


def held(truth: DataFrame, links: DataFrame, full: DataFrame, groups: DataFrame) -> float:
    """The share of a vector's links `truth` (u, v) that the result holds, on average over the vectors u:
    those in `links`, in either direction, and those inside a component of which an end is compared
    with the whole component. A vector of a large group counts as much as one of a pair."""
    listed = _both(links).distinct().select(F.col("centre").alias("u"), F.col("id").alias("v"), F.lit(True).alias("listed"))
    of_u, of_v = (groups.withColumnsRenamed({"node": x, "component": f"c{x}"}) for x in "uv")
    full_u, full_v = (full.select(F.col("id").alias(x), F.lit(True).alias(f"full_{x}")) for x in "uv")
    found = truth.join(listed, ["u", "v"], "left").join(of_u, "u", "left").join(of_v, "v", "left").join(full_u, "u", "left").join(full_v, "v", "left")
    hit = F.coalesce(F.expr("listed or (cu = cv and (full_u or full_v))"), F.lit(False))
    return found.groupBy("u").agg(F.avg(hit.cast("int")).alias("share")).agg(F.avg("share")).first()[0]


def near_vectors(df: DataFrame, threshold: float = 0.95, id: str = "vec_id", vector: str = "embedding", k: int = 10, trees: int = 8, leaf: int = 256, rounds: int = 2, most_rounds: int = 8, queries: int = 256, recall: float = 0.99, least_recall: float = 0.9) -> DataFrame:
    """One row per row of df: id, n_links, component_id, kept.

    Vectors with a cosine (in doubles) of `threshold` or more are linked; n_links counts the other
    vectors linked directly, component_id is the smallest id reachable, kept marks it. Null, empty
    and zero vectors, ones with a null, infinite or NaN component, ones with a null id, and ones
    whose number of components isn't the commonest are linked with nothing. Equal vectors are
    compared once; rows that repeat an id and vector count as copies. Of several vectors under one
    id the least, component by component, is that id's, and all its rows count as copies of it. Other
    columns are left out; an empty df gives an empty result.

    After `rounds` rounds, the links of up to 3 * `queries` vectors are found by brute force; while the
    result would hold less than `recall` of them, further rounds follow with further orders, up to
    `most_rounds`. The measured recall is logged; below `least_recall` RuntimeError is raised rather
    than a result given. The audit adds nothing to the result. A vector whose whole list reaches the
    threshold is saturated: its list is enlarged by the closest vectors outside its component, until
    no component is linked with another, and by its whole component, with which count_full compares it
    in blocks, so that no number of neighbours caps it.
    """
    prepare(df)
    kind = "float" if isinstance(getattr(df.schema[vector].dataType, "elementType", None), FloatType) else "double"
    rows = df.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("x"))
    size = F.aggregate("x", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x).cast("double")))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0), F.lit(False))
    dims = rows.where(usable).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return df.select(F.col(f"`{id}`").alias(id), F.lit(0).cast("bigint").alias("n_links"), F.col(f"`{id}`").cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    d = dims.d
    usable = usable & (F.size("x") == d)
    # Doubles whose squares would leave the range of doubles are scaled; the cosine stays.
    x = F.when((size > 1e-100) & (size < 1e100), F.col("x")).otherwise(F.transform("x", lambda x: (x / size).cast(kind)))
    own = materialize(rows.where(usable).select("id", x.alias("x")).groupBy("id").agg(F.min("x").alias("x"), F.count("*").alias("copies")), "vectors")
    classes = materialize(own.groupBy("x").agg(F.min("id").alias("id"), F.sum("copies").alias("copies")), "distinct")
    vectors = classes.select("id", "x")
    lists = materialize(best(start(vectors, range(trees), leaf, k, d).withColumn("since", F.lit(0)), k), "lists")
    truth, sought, done = None, 0, 0
    while True:
        found = refine(vectors, lists, k, done)
        if done >= rounds:
            found = found.union(start(vectors, range(done * trees, (done + 1) * trees), leaf, k, d))
        done += 1
        after = materialize(best(lists.union(found.withColumn("since", F.lit(done))), k), "lists")
        discard(lists)
        lists = after
        if done < rounds:
            continue
        links, full = lists.where(F.col("s") >= threshold).select("u", "v"), materialize(saturated(lists, threshold, k), "full")
        groups = components(links)
        while (more := across(vectors, lists, full, groups, threshold, k, trees, leaf, rounds, d)) is not None and more.head(1):
            links = links.union(more)
            groups = components(links)
        if truth is None:
            truth = materialize(audit(vectors, lists, threshold, queries), "audit")
            sought = truth.count()
        if not sought:
            logging.getLogger(__name__).info("no vector of the audit has a link")
            break
        reached = held(truth, links, full, groups)
        logging.getLogger(__name__).info("recall %.4f of %d links after %d rounds", reached, sought, done)
        if reached >= recall or done >= most_rounds:
            if reached < least_recall:
                raise RuntimeError(f"recall {reached:.4f} of {sought} links is below {least_recall} after {done} rounds: give more trees, a larger leaf or a larger k")
            break
    placed = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").join(full.withColumn("full", F.lit(True)), "id", "left")
    placed = materialize(placed.withColumn("full", F.coalesce("full", F.lit(False))), "placed")
    counts = count_links(placed.where("component is not null"), links, threshold)
    solved = placed.join(counts, "id", "left").select("x", F.col("copies").alias("all"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component"))
    solved = own.join(solved, "x").select("id", "copies", (F.col("n") + F.col("all") - 1).alias("n_links"), "component")
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    solved = solved.select("id", "n_links", "component", again.alias("copy")).drop("copy")
    rest = rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return solved.union(rest).select(F.col("id").alias(id), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
