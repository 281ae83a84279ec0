"""Best-fit packing by a grouping genetic algorithm.

Pieces of one length are interchangeable, so the whole packing problem is a table of lengths with
counts, at most one row for each length, however many documents there are. A packing is a table of
kinds of bins (the lengths in one sequence) with their numbers. Islands, one Spark task each,
evolve populations of packings: crossover injects whole well-filled bins of one parent into the other,
removes the bins that now hold a piece twice, and best-fits the displaced pieces; the elite migrates
between epochs. The pieces themselves never meet: each finds its place in the best packing from its
length and its number among the pieces of that length."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import MOST_BROADCAST, discard, frugal, materialize, pieces, prepare
from graphloom.llm.tokens import BATCH_BYTES, encoder

#: Kinds of bins of a packing: a child with more is not taken up, so that a packing's size has a bound.
MOST_KINDS = 50_000

#: A packing: the lengths in a bin, descending, and how many such bins there are.
Packing = dict[tuple[int, ...], int]


def best_fit(packing: Packing, items: Iterable[tuple[int, int]], size: int) -> Packing:
    """The packing with the items (length, count) put in, in the order given: each piece goes to the fullest bin
    that has room for it, a new one if none has. All bins of a kind, and all pieces of a length, are
    taken at once, with the result of taking them one after the other."""
    rooms: dict[int, Packing] = {}
    mask = 0
    for kind, many in packing.items():
        room = size - sum(kind)
        rooms.setdefault(room, {})[kind] = many
        mask |= 1 << room
    for length, count in items:
        while count:
            fitting = mask >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                kind, many = rooms[room].popitem()
                if not rooms[room]:
                    mask ^= 1 << room
            else:
                room, kind, many = size, (), count
            each = room // length
            full = min(many, count // each)
            count -= full * each
            partly = count if full < many and count else 0
            count -= partly
            if kind and many - full - (partly > 0):
                rooms[room][kind] = many - full - (partly > 0)
                mask |= 1 << room
            for more, bins in ((each, full), (partly, 1)):
                if more and bins:
                    grown, left = tuple(sorted(kind + (length,) * more, reverse=True)), room - length * more
                    there = rooms.setdefault(left, {})
                    there[grown] = there.get(grown, 0) + bins
                    mask |= 1 << left
    return {kind: many for of in rooms.values() for kind, many in of.items()}


def cost(packing: Packing, size: int) -> tuple[int, int]:
    """Fewer bins are better; among as many, the more unequally filled ones (the sum of squared fills)."""
    return sum(packing.values()), -sum(many * sum(kind) ** 2 for kind, many in packing.items())


def least_bins(lengths: dict[int, int], size: int) -> int:
    """No packing has fewer bins (the L2 bound: what can't share a bin, and what then has no room beside it)."""
    if not lengths:
        return 0
    length, count = (np.array(x, np.int64) for x in zip(*lengths.items(), strict=True))
    found = -(-int((length * count).sum()) // size)
    for alpha in range(1, size // 2 + 1):
        alone, big, small = length > size - alpha, (length > size / 2) & (length <= size - alpha), (length >= alpha) & (length <= size / 2)
        room = int(count[big].sum()) * size - int((length * count)[big].sum())
        found = max(found, int(count[alone].sum() + count[big].sum()) + max(0, -((room - int((length * count)[small].sum())) // size)))
    return found


def shuffled(lengths: dict[int, int], draw: random.Random, spread: float) -> list[tuple[int, int]]:
    """The items about by descending length, each length in up to two lots."""
    lots = []
    for length, count in lengths.items():
        part = draw.randint(0, count) if spread else 0
        lots += [(length, n) for n in (part, count - part) if n]
    return sorted(lots, key=lambda x: -x[0] * (1 + spread * draw.random()))


def crossover(a: Packing, b: Packing, lengths: dict[int, int], size: int, draw: random.Random) -> Packing:
    """Some well-filled bins of b, the bins of a that hold no piece of theirs, and the rest by best fit."""
    quota = draw.uniform(0.1, 0.6) * sum(b.values())
    child: Packing = {}
    left = dict(lengths)

    def take(kind: tuple[int, ...], most: int) -> None:
        held = Counter(kind)
        many = min(most, *(left[x] // n for x, n in held.items()))
        if many > 0:
            child[kind] = child.get(kind, 0) + many
            for x, n in held.items():
                left[x] -= n * many

    for kind, many in sorted(b.items(), key=lambda x: (-sum(x[0]), draw.random())):
        if quota <= 0:
            break
        if draw.random() < 0.6:
            many = many if draw.random() < 0.7 else draw.randint(1, many)
            take(kind, many)
            quota -= many
    for kind, many in sorted(a.items(), key=lambda x: -sum(x[0])):
        take(kind, many)
    displaced = {x: n for x, n in left.items() if n}
    return best_fit(child, shuffled(displaced, draw, draw.choice((0.0, 0.0, 0.1, 0.3))), size)


def mutate(packing: Packing, size: int, draw: random.Random) -> Packing:
    """The packing with its emptiest bins, and a few others, dissolved and best-fitted again."""
    kinds = sorted(packing, key=lambda x: (sum(x), x))
    worst = set(kinds[: draw.randint(1, 3)]) | {k for k in kinds if draw.random() < 0.05}
    displaced: Counter[int] = Counter()
    kept = dict(packing)
    for kind in worst:
        many = draw.randint(1, packing[kind])
        kept[kind] -= many
        for x in kind:
            displaced[x] += many
    return best_fit({k: n for k, n in kept.items() if n}, shuffled(displaced, draw, draw.choice((0.0, 0.2))), size)


def evolve(population: list[Packing], lengths: dict[int, int], size: int, many: int, generations: int, draw: random.Random) -> list[Packing]:
    """The population after some generations, the best first; ends early where no packing can be better."""
    least = least_bins(lengths, size)
    if not population:
        population = [best_fit({}, shuffled(lengths, draw, 0.0), size)]
    for _ in range(generations):
        population = sorted(population, key=lambda p: cost(p, size))[:many]
        if cost(population[0], size)[0] == least:
            break
        if len(population) < many:
            population += [best_fit({}, shuffled(lengths, draw, draw.uniform(0.02, 0.3)), size) for _ in range(many - len(population))]
        children = []
        for _ in range(max(1, many // 2)):
            a, b = (min(draw.sample(population, 2), key=lambda p: cost(p, size)) if many > 1 else population[0] for _ in range(2))
            child = crossover(a, b, lengths, size, draw)
            children.append(mutate(child, size, draw) if draw.random() < 0.5 else child)
        population += [c for c in children if len(c) <= MOST_KINDS and c not in population]
    return sorted(population, key=lambda p: cost(p, size))[:many]


def pack_lengths(spark: SparkSession, lengths: dict[int, int], size: int, islands: int = 4, population: int = 8, generations: int = 8, epochs: int = 3, seed: int = 11) -> Packing:
    """The best packing that the islands find. Each epoch is a written table of populations; between two
    epochs the best packing of each island is copied to the next one. A lost task's island is evolved again
    from the table, with the same numbers drawn."""
    schema = "island bigint, place bigint, bins bigint, squares decimal(38,0), kinds array<array<int>>, counts array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]
    if not lengths:
        return {}

    def grown(island: int, before: list[Packing], epoch: int) -> pa.Table:
        after = evolve(before, lengths, size, population, generations, random.Random(f"{seed}:{epoch}:{island}"))
        rows = [(island, place, *cost(p, size), [list(k) for k in p], list(p.values())) for place, p in enumerate(after)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for island in batch.column(0).to_pylist():
                yield from grown(island, [], 0).to_batches()

    found = materialize(spark.range(0, islands, 1, islands).mapInArrow(start, schema), "islands")
    least = least_bins(lengths, size)
    for epoch in range(1, epochs):
        if islands == 1 or found.where(F.col("bins") == least).limit(1).count():
            break

        def go_on(key: tuple, table: pa.Table) -> pa.Table:
            rows = sorted(table.select(["place", "moved", "kinds", "counts"]).to_pylist(), key=lambda r: (r["moved"], r["place"]))
            packings: list[Packing] = []
            for r in rows:
                one = {tuple(k): n for k, n in zip(r["kinds"], r["counts"], strict=True)}
                if one not in packings:
                    packings.append(one)
            return grown(key[0].as_py(), packings, epoch)  # noqa: B023 - runs within this epoch

        elite = found.where("place = 0").withColumns({"island": (F.col("island") + 1) % islands, "moved": F.lit(1)})
        after = materialize(found.withColumn("moved", F.lit(0)).unionByName(elite).groupBy("island").applyInArrow(go_on, schema), "islands")
        discard(found)
        found = after
    best = found.orderBy("bins", "squares", "island", "place").select("kinds", "counts").first()
    discard(found)
    return {tuple(k): n for k, n in zip(best.kinds, best.counts, strict=True)}


def places(packing: Packing) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go: (length, first, sequence, offset), sorted; the pieces of a length with
    numbers from `first` on, up to the next row's, are in consecutive sequences from `sequence`."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for kind, many in sorted(packing.items(), reverse=True):
        offset = 0
        for length in kind:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += many
            offset += length
        sequence += many
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2, ids: bool = True, **search: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the ids.

    size: longest sequence. end: the id that closes each document. A document of more than `size` tokens is
    cut into pieces of `size`, the first of which is shorter unless the length divides evenly; all
    others are whole. search: parameters of pack_lengths. Null text is empty (its only token is `end`);
    repeated rows are packed each for itself, and rows with a null id like others; an empty df gives
    an empty result; other columns of df are left out. Ids are never shuffled: counts of pieces by
    length and task are. Numbers are fixed by a written table, so a lost task doesn't change them.
    """
    spark = prepare(df).sparkSession
    if size < 1:
        raise ValueError("size must be positive")
    schema = f"{id} {df.schema[id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint" + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int32())] * ids]

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in (x for whole in batches for x in pieces(whole, "_text", BATCH_BYTES)):
            rows, out = [], []
            for row, own in enumerate(own_ids.encode([x.as_py() or "" for x in batch.column(1)])):
                tokens = np.append(own, np.uint32(end)).astype("<u4")
                stops = range(len(tokens) % size or size, len(tokens) + 1, size)
                for piece, stop in enumerate(stops):
                    start = max(0, stop - size)
                    some = tokens[start:stop]
                    rows.append(row)
                    out.append((piece, start, len(some), zlib.crc32(some), part, seen[len(some)], *[some.astype(np.int32)] * ids))
                    seen[len(some)] += 1
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=names)

    source = df.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").cast("string").alias("_text"))
    cuts = materialize(source.mapInArrow(cut, schema), "cuts")
    # One row for each task and length; the second table has at most `size` rows.
    counts = materialize(cuts.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()}
    packing = pack_lengths(spark, lengths, size, **search)
    table = spark.sparkContext.broadcast(places(packing))  # a bounded number of kinds of bins, of at most `size` pieces each
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    firsts = F.broadcast(firsts) if counts.count() <= MOST_BROADCAST else firsts
    numbered = cuts.join(firsts, ["length", "part"])

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, number: pa.Array) -> pa.Array:
        of_length, first, sequence, offset = table.value
        length, number = length.to_numpy(), number.to_numpy()
        key = lambda x, y: (x << 48) | y  # noqa: E731 - fewer than 2^48 pieces have one length
        at = np.searchsorted(key(of_length, first), key(length, number), "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[at] + number - first[at]), pa.array(offset[at])], names=["sequence_id", "offset"])

    where = numbered.withColumn("_place", placed("length", F.col("first") + F.col("nth")))
    return where.select(id, "piece", "start", "length", "ids_crc32", F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"), *["ids"] * ids)
