"""Packing by power-of-two decomposition: a document of n tokens becomes pieces whose lengths
are the powers of two in n (with n // size full ones first). Each piece is a sequence of its
own; equal lengths are numbered next to each other. Nothing is padded and no sequence crosses
documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import MOST_BROADCAST, frugal, materialize, pieces, prepare
from graphloom.llm.tokens import BATCH_BYTES, encoder


def decompose(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n tokens: full sequences, then the powers of two of the rest."""
    return [size] * (n // size) + [1 << k for k in range(size.bit_length() - 1, -1, -1) if (n % size) >> k & 1]


def pack(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", size: int = 2048, end: int = 1, ids: bool = True, remember: int | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, the ids themselves.

    remember: pieces of text whose ids a worker remembers, if not the Encoder's own bound: time for memory, the ids are the same.
    size: longest sequence, a power of two. end: the id that closes each document. Null text is
    empty (its only token is `end`); repeated rows are packed each for itself, and rows with a null
    id like others. Other columns of df are left out. sequence_id numbers all sequences from 0, the
    longest first; the numbers are fixed once by a written table, so a lost task doesn't change
    them. Ids are never shuffled: only counts of pieces by task and length are.
    """
    prepare(df)
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    schema = f"{id} {df.schema[id].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, nth bigint" + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, part, seen = encoder(vocabulary, remember), TaskContext.get().partitionId(), {}
        for batch in (x for whole in batches for x in pieces(whole, "_text", BATCH_BYTES)):
            out: list[list] = [[] for _ in names]
            rows: list[int] = []

            def made() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in out[1:7]]
                if ids:
                    columns.append(pa.array(out[7], pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(columns, names=names)

            held = 0
            for row, own in enumerate(own_ids.encode([x.as_py() or "" for x in batch.column(1)])):
                tokens = np.append(own, np.uint32(end)).astype("<u4")
                at = 0
                for n in decompose(len(tokens), size):
                    piece = tokens[at : at + n]
                    rows.append(row)
                    nth = seen[n] = seen.get(n, -1) + 1
                    for column, value in zip(out[1:], (at, n, zlib.crc32(piece), len(tokens), part, nth, piece.astype(np.int32)), strict=False):
                        column.append(value)
                    at += n
                held += len(tokens)
                if held > 4_000_000:
                    yield made()
                    out, rows, held = [[] for _ in names], [], 0
            if rows:
                yield made()

    source = df.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").cast("string").alias("_text"))
    cuts = materialize(source.mapInArrow(cut, schema), "pieces")
    # One row for each task and length: counts that place a task's sequences after those before it.
    counts = materialize(cuts.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # Longer lengths come first: of lengths there are a dozen rows, of tasks within a length a window each.
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("begin"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.join(F.broadcast(begins), "length").select("length", "part", (F.col("begin") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    # So few rows that sending them to every task spares a shuffle of the ids; beyond the bound they shuffle.
    firsts = F.broadcast(firsts) if counts.count() <= MOST_BROADCAST else firsts
    return cuts.join(firsts, ["length", "part"]).select(id, "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *["ids"] * ids)
