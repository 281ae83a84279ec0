"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets of
shingles, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import MOST_BROADCAST, discard, fresh_name, frugal, heavy_from, materialize, mix, pieces, prepare, raw, salted_join, words
from graphloom.llm.grouping import components

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LATE = np.uint64(0xFFFFFFFFFFFFFFFF)
def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; with fewer words, of the whole
    sequence; none without words."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    n = min(k, len(h))
    rolling = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        rolling = rolling * _GOLD + mix(h[i : len(h) - n + 1 + i])
    return np.unique(mix(rolling ^ np.uint64(n)))


def signatures(elements: np.ndarray, owner: np.ndarray, count: int, m: int) -> np.ndarray:
    """SuperMinHash of `count` sets: element i belongs to set owner[i]. uint64, count x m.

    Each element draws a random permutation of the m places, one swap a layer; in layer j it offers
    j + r (r random in [0, 1), here as j << 48 | r) to the permutation's j-th place. The ranks of an
    element are so correlated that it fills every place once. A set whose places all hold less than
    j can't change any more: its elements leave, after one or two layers for long texts.
    """
    h = np.full((count, m), _LATE, np.uint64)
    flat = h.reshape(-1)
    e, d = elements, owner.astype(np.int64)
    places = None
    for j in range(m):
        with np.errstate(over="ignore"):
            r = mix(e + np.uint64(2 * j + 1) * _GOLD) >> np.uint64(16)
            k = (j + ((mix(e + np.uint64(2 * j + 2) * _GOLD) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64))
        if places is None:
            slot = k
        else:
            rows = np.arange(len(e))
            slot = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, j]
            places[:, j] = slot
        np.minimum.at(flat, d * m + slot, np.uint64(j << 48) | r)
        going = (h.max(axis=1) >= np.uint64((j + 1) << 48))[d]
        if not going.any():
            break
        if places is None:  # only now is the permutation needed as an array
            e, d, k = e[going], d[going], k[going]
            places = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), m)).copy()
            rows = np.arange(len(e))
            places[rows, k] = 0
            places[:, 0] = k
        elif not going.all():
            e, d, places = e[going], d[going], places[going]
    return h


def bands(h: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each `rows` neighbouring places, different for each band: int64, sets x bands."""
    n = h.shape[1] // rows
    keys = np.zeros((len(h), n), np.uint64)
    for i in range(rows):
        keys = mix(keys * _GOLD + h[:, i : n * rows : rows])
    return mix(keys + np.arange(n, dtype=np.uint64) * _GOLD).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def sign(df: DataFrame, k: int, m: int, rows: int) -> DataFrame:
    """(id, n_shingles, print, bands) of df's (id, text); print: 128 bits of the whole set."""

    @frugal
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 500_000):
                sets = [shingles(t, k) for t in raw(part.column("text"))]
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = bands(signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), m), rows)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(prints, pa.binary()), _lists(keys.reshape(-1), np.full(len(sets), keys.shape[1]))], names=["id", "n_shingles", "print", "bands"])

    return df.mapInArrow(signed, "id bigint, n_shingles bigint, print binary, bands array<bigint>")


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """df joined by id with `ids`: a broadcast if they are few enough by count, else a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "id", how)


def full_sets(df: DataFrame, k: int) -> DataFrame:
    """(id, set) of df's (id, text)."""

    @frugal
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingles(t, k) for t in raw(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(np.concatenate(sets), np.array([len(s) for s in sets], np.int64))], names=["id", "set"])

    return df.mapInArrow(made, "id bigint, set array<bigint>")


def links(reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links, each verified, that connect all of reps' (id, n, bands) that candidates with
    percent * union <= 100 * intersection connect. texts: (id, text) of all.

    Not every pair of a bucket is looked at. First each member is compared with the bucket's
    smallest id, its hub h, which links most of a group of copies. Let x be a member in another
    component than h, and y any other member of yet another component. They need a common part of
    c = percent / (100 + percent) * (|x| + |y|), and share min(|x in h|, |y in h|) inside h at most. So
    either that is enough, which leaves only y of a few sizes, looked up by size; or they share some
    shingles that h lacks, looked up by their rarest shingles. Heavily
    changed copies rarely share changes, so a bucket full of copies costs little more comparisons
    than it has members, and no link between components is lost. A member of several hubs meets
    those that have its nearest hub in common with it there only.
    """
    keyed = materialize(reps.select("id", "n", F.explode("bands").alias("key")), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("hub")).where("members > 1")
    around = materialize(keyed.join(shared.select("key", "hub"), "key").select("hub", "id").distinct(), "around")
    discard(keyed)
    candidates = materialize(full_sets(only(texts, materialize(around.select("id").distinct(), "candidates")), k).dropDuplicates(["id"]), "sets")
    a, b = candidates.withColumnsRenamed({"id": "a", "set": "set_a"}), candidates.withColumnsRenamed({"id": "b", "set": "set_b"})
    both = F.size(F.array_intersect("set_a", "set_b"))

    def shares(pairs: DataFrame) -> DataFrame:
        hot = pairs.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_from(pairs.count()))
        return salted_join(pairs.join(b, "b"), a, ["a"], "b", hot).select("a", "b", both.alias("both"), F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"))

    same = 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
    first = materialize(shares(around.select(F.col("hub").alias("a"), F.col("id").alias("b"))), "stars")
    found = first.where(same & (F.col("a") != F.col("b"))).select("a", "b")
    own = components(found)
    placed = first.join(own.withColumnsRenamed({"node": "b", "component": "c"}), "b", "left").join(own.withColumnsRenamed({"node": "a", "component": "c_hub"}), "a", "left")
    near = F.struct((F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("j"), (-F.col("a")).alias("k"))
    own_hub = first.where("a <> b").groupBy("b").agg(F.max_by("a", near).alias("p"))
    placed = placed.join(own_hub, "b").select(F.col("a").alias("hub"), F.col("b").alias("id"), F.col("n_b").alias("n"), F.col("both").alias("i"), F.coalesce("c", "b").alias("c"), F.coalesce("c_hub", "a").alias("c_hub"), "p").where("id <> hub")
    placed = materialize(placed, "placed")
    # Members nearest to the same other hub meet there.
    mixed = placed.groupBy("hub").agg(F.count_if(F.col("c") != F.col("c_hub")).alias("out"), F.min("p").alias("p1"), F.max("p").alias("p2")).where("out > 0 and (p1 <> p2 or p1 = hub)").select("hub")
    placed = placed.join(mixed, "hub", "left_semi")
    x, y = placed.where("c <> c_hub"), placed
    x = x.select("hub", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "i", "c", "p")))
    y = y.withColumnsRenamed({c: f"{c}_y" for c in ("id", "n", "i", "c", "c_hub", "p")})
    # Two members outside the hub's component meet twice; once is enough.
    apart = (F.col("c_x") != F.col("c_y")) & ((F.col("p_x") != F.col("p_y")) | (F.col("p_x") == F.col("hub"))) & ((F.col("c_y") == F.col("c_hub_y")) | (F.col("id_x") < F.col("id_y")))
    missing = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent) - 1e-9) - F.least("i_x", "i_y")
    pair = (F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
    low, high = F.ceil(F.col("n_x") * percent / 100 - 1e-9), F.floor(F.col("i_x") * (100 + percent) / percent - F.col("n_x") + 1e-9)
    by_size = x.where(low <= high).withColumn("n_y", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    inside = by_size.withColumnsRenamed({"hub": "hub_x", "n_y": "n_w"}).join(y, (F.col("hub_x") == F.col("hub")) & (F.col("n_w") == F.col("n_y")) & apart & (missing <= 0)).select(*pair)
    fresh = y.select(F.col("hub").alias("a"), F.col("id_y").alias("b"), "i_y", "n_y", "c_y", "c_hub_y", "p_y").join(a, "a").join(b, "b")
    fresh = fresh.select(F.col("a").alias("hub"), F.col("b").alias("id_y"), "n_y", "i_y", "c_y", "c_hub_y", "p_y", F.explode(F.array_except("set_b", "set_a")).alias("e"))
    fresh = materialize(fresh, "changes")
    several = fresh.groupBy("hub", "e").agg(F.min("c_y").alias("least"), F.max("c_y").alias("most"), F.min("p_y").alias("p1"), F.max("p_y").alias("p2"), F.count("*").alias("held"))
    several = several.where("least <> most and (p1 <> p2 or p1 = hub)").select("hub", "e", "held")
    # Of m common shingles one is among all but m - 1 of either member's, so the rarest suffice.
    own = Window.partitionBy("hub", "id_y")
    fresh = fresh.join(several, ["hub", "e"]).withColumn("d_y", F.count("*").over(own)).withColumn("r_y", F.row_number().over(own.orderBy("held", "e"))).drop("held")
    fresh = materialize(fresh, "shared")
    of_x = fresh.where("c_y <> c_hub_y").select(F.col("hub").alias("hub_x"), F.col("e").alias("e_x"), *(F.col(f"{c}_y").alias(f"{c}_x") for c in ("id", "n", "i", "c", "p", "d", "r")))
    rare = (missing >= 1) & (F.col("r_x") <= F.col("d_x") - missing + 1) & (F.col("r_y") <= F.col("d_y") - missing + 1)
    outside = of_x.join(fresh, (F.col("hub_x") == F.col("hub")) & (F.col("e_x") == F.col("e")) & apart & rare).select(*pair)
    rest = materialize(inside.union(outside).distinct(), "pairs")
    return found.union(materialize(shares(rest).where(same).select("a", "b"), "links"))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, m: int = 120, rows: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles;
    component_id is the smallest id reachable, kept marks the document with that id. A pair at 80 %
    shares one of the 24 bands of 5 places with probability 0.9999; equal sets always meet.
    Null and empty texts have no shingles and are linked with nothing. Rows with the same id are one
    document; a row with a null id is linked with nothing and has component_id null, kept true.
    Other columns of df are left out. An empty df gives an empty result.
    """
    prepare(df)
    source = df.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = materialize(sign(source, k, m, rows), "signatures")
    some = signed.where("n_shingles > 0 and id is not null")
    # One representative of each set of shingles; equal sets are linked without a comparison.
    reps = materialize(some.groupBy("print").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    same = some.select("print", "id").join(reps.where("copies > 1").select("print", F.col("id").alias("rep")), "print").select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a <> b")
    near = links(reps, source, k, percent)
    groups = components(same.union(near))
    out = signed.select("id", "n_shingles").join(groups.withColumnRenamed("node", "id"), "id", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id), "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def remove_near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each group of near_duplicates(): that with the smallest id.

    Rows that repeat an id are one document, of which one row stays, the one with the smallest hash
    of its text; rows with a null id, and null or empty texts, stay. Columns are unchanged. Texts
    are not shuffled: the ids that go are broadcast if few enough by count, else joined.
    """
    of, nth = fresh_name(df, "_gone"), fresh_name(df, "_rank")
    groups = materialize(near_duplicates(df, k, percent, id=id, text=text).select(F.col(id).alias(of), "kept"), "groups")
    gone = groups.where("not kept").select(of).distinct()
    again = groups.where(F.col(of).isNotNull() & F.col("kept")).groupBy(of).agg(F.count("*").alias("n")).where("n > 1").select(of)
    key = F.col(f"`{id}`").cast("bigint")

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids

    left = df.join(small(gone), key == F.col(of), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(small(again), key == F.col(of), "left_semi")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.col(f"`{text}`").cast("string")), F.col(f"`{text}`").cast("string")))
    once = once.withColumn(nth, rank).where(F.col(nth) == 1).drop(nth)
    return left.join(small(again), key == F.col(of), "left_anti").unionByName(once)
