"""Vector collections: points(id, vector, payload), cosine search with filters and thresholds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Scores that a task of a batch search holds at once: 8 MB, and a few times that while it sorts them.
SCORES = 1 << 20


def dot(a: Column, b: Column) -> Column:
    """Sum of products in doubles, in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def matches(payload: str, **equal: object) -> Column:
    keep = F.lit(True)
    for name, value in equal.items():
        keep = keep & (F.col(payload)[name] == F.lit(str(value)))
    return keep


def search(points: DataFrame, query: Sequence[float], limit: int = 5, threshold: float | None = 0.0, where: Column | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """The `limit` points closest to the query with at least the threshold: points' columns and score;
    by score, then id. The filter reaches the scan, and Spark keeps a heap of `limit` rows in each task."""
    q = F.lit(np.asarray(query, float).tolist()).cast("array<double>")
    kept = points if where is None else points.where(where)
    scored = kept.withColumn("score", cosine(F.col(vector), q))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id).limit(limit)


def batch_search(points: DataFrame, queries: DataFrame, limit: int = 5, id: str = "id", vector: str = "vector", query_block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): the `limit` closest points of every query(query_id, vector), itself
    left out. Queries go through in blocks of a bounded size, each multiplied as a matrix with slices of
    the points, SCORES numbers at a time; a task sends `limit` rows a query on, not its pairs."""
    spark = points.sparkSession
    queries = queries.select("query_id", F.col(vector).cast("array<double>").alias("q"))
    out = None
    blocks = -(-queries.count() // query_block)
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    for b in range(max(1, blocks)):
        table = numbered.where(F.col("_b") == b).select("query_id", "q").toArrow()
        ids = table.column("query_id").to_numpy()
        q = np.array(table.column("q").to_pylist(), float).reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(1e-300, np.linalg.norm(q, axis=1, keepdims=True))))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, unit = shared.value
            top_ids, top = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
            step = max(1, SCORES // max(1, len(own)))
            for batch in batches:
                if not batch.num_rows or not len(own):
                    continue
                for at in range(0, batch.num_rows, step):  # a whole batch of scores is hundreds of MB
                    x = np.array(batch.column(1).slice(at, step).to_pylist(), float)
                    s = unit @ (x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))).T
                    n = batch.column(0).slice(at, step).to_numpy()
                    s[own[:, None] == n[None, :]] = -2.0
                    top_ids, top = np.hstack([top_ids, np.broadcast_to(n, s.shape)]), np.hstack([top, s])
                    order = np.lexsort((top_ids, -top))[:, :limit] if top.shape[1] else np.zeros((len(own), 0), int)
                    top_ids, top = np.take_along_axis(top_ids, order, 1), np.take_along_axis(top, order, 1)
            keep = top > -2.0
            rows = np.nonzero(keep)[0]
            yield pa.RecordBatch.from_arrays([pa.array(own[rows], pa.int64()), pa.array(top_ids[keep], pa.int64()), pa.array(top[keep], pa.float64())], names=["query_id", "id", "score"])

        part = points.select(F.col(id).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(best, "query_id bigint, id bigint, score double")
        out = part if out is None else out.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def upsert(points: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """points after storing `new`: points without a vector are skipped, the last of an id wins."""
    last = new.where(F.size("vector") > 0).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("_n = 1").select(*points.columns)
    return points.join(last.select("id"), "id", "left_anti").select(*points.columns).unionByName(last)


def delete_where(points: DataFrame, **equal: object) -> DataFrame:
    """points without those whose payload holds all the values."""
    return points.where(~F.coalesce(matches("payload", **equal), F.lit(False)))


def recent(points: DataFrame, ts: str, limit: int = 10, where: Column | None = None) -> DataFrame:
    """The newest points, without their vectors."""
    kept = points if where is None else points.where(where)
    return kept.drop("vector").orderBy(F.desc(ts), "id").limit(limit)


def without(payload: Column, *keys: str) -> Column:
    return F.map_filter(payload, lambda k, v: ~k.isin(*keys))


def text_of(*columns: str) -> Column:
    """The first of the columns that isn't empty: content, then source, then code."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def point_id(name: Column) -> Column:
    """The version-5 UUID of a name in the DNS namespace, as text."""
    space = "6ba7b8109dad11d180b400c04fd430c8"
    h = F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary")))
    variant = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate("0123456789abcdef") for x in (c, "89ab"[i & 3]))), F.substring(h, 17, 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hashing_embedder(dimensions: int = 64):
    """A deterministic stand-in for an embedding model, as an Arrow function from texts to vectors:
    signed counts of hashed words, scaled to length 1. Texts without words give zeros. Any function
    of the same shape can take its place."""

    @F.arrow_udf("array<float>")
    def embed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = np.zeros((len(column), dimensions), np.float32)
            for row, text in enumerate(column.to_pylist()):
                for word in (text or "").lower().split():
                    h = zlib.crc32(word.encode())
                    out[row, h % dimensions] += 1 if h & 0x80000000 else -1
            out /= np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))
            yield pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), dimensions).cast(pa.list_(pa.float32()))

    return embed


def resilient_embedder(model: Callable[[list[str]], np.ndarray], dimensions: int, batch: int = 100, tries: int = 3):
    """An Arrow function from texts to struct(vector, failed) around a model that may fail: `model` takes a
    list of texts and gives a row of numbers for each.

    A batch that fails `tries` times is cut in halves, and these again, until the texts that the model can't
    take are alone: they get a zero vector and failed = true; all others get their own. A text that fails
    costs about twice log2(batch) calls, not a call for each of its neighbours. Null and empty texts are
    zeros without a call, and an answer of another shape is a failure.
    """
    kind = pa.struct([("vector", pa.list_(pa.float32())), ("failed", pa.bool_())])

    def attempt(texts: list[str]) -> np.ndarray | None:
        for _ in range(tries):
            try:
                found = np.asarray(model(texts), np.float32)
            except Exception:  # whatever a model raises: the batch is smaller next time
                continue
            if found.shape == (len(texts), dimensions) and np.isfinite(found).all():
                return found
        return None

    def fill(texts: list[str], rows: list[int], out: np.ndarray, failed: np.ndarray) -> None:
        todo = [rows[at : at + batch] for at in range(0, len(rows), batch)]
        while todo:
            some = todo.pop()
            found = attempt([texts[i] for i in some])
            if found is not None:
                out[some] = found
            elif len(some) == 1:
                failed[some[0]] = True
            else:
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]

    @F.arrow_udf("struct<vector:array<float>,failed:boolean>")
    def embed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = [x or "" for x in column.to_pylist()]
            out, failed = np.zeros((len(texts), dimensions), np.float32), np.zeros(len(texts), bool)
            fill(texts, [i for i, x in enumerate(texts) if x], out, failed)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), dimensions).cast(pa.list_(pa.float32()))
            yield pa.StructArray.from_arrays([vectors, pa.array(failed)], fields=list(kind))

    return embed


def points_from_chunks(chunks: DataFrame, session: str, embed) -> DataFrame:
    """chunks(chunk_id, text, source, metadata) as points: id from the chunk's, payload with content,
    source and session."""
    payload = F.map_concat("metadata", F.create_map(F.lit("content"), F.col("text"), F.lit("source"), F.col("source"), F.lit("session_id"), F.lit(session)))
    return chunks.select(point_id(F.col("chunk_id")).alias("id"), embed(F.col("text")).alias("vector"), payload.alias("payload"))


def scalar_payload(values: Mapping[str, Column]) -> Column:
    """A payload of texts from columns of any type."""
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
