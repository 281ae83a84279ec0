"""Ranked lexical search by Block-Max WAND. The index is partitioned by documents: each shard keeps,
for each of its terms, compressed blocks of a fixed number of postings with the place of their first and last
document and their greatest impact. A search moves all its terms' pointers over these headers alone,
bounds the score of every range of documents between block ends, and decompresses only blocks of
ranges whose bound reaches the score of the best documents so far."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import MOST_BROADCAST, frugal, materialize, prepare

#: Terms are maximal runs of what this pattern matches: digits, letters of ASCII and all beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same by bytes of UTF-8: A-Z are lower-cased, what ends a term becomes a space.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Postings of a block, terms (with repeats) and documents from which a shard is closed.
BLOCK, SHARD_TERMS, SHARD_DOCUMENTS = 64, 2_000_000, 100_000
#: Items that a task searches its shard for together.
ITEMS_A_BLOCK = 500
#: Length norm: m = 100 - B + B * n * N div L. Impact: SCALE * tf div (1000 * tf + 8 * m).
B, SCALE = 90, 1_000_000_000


@dataclass
class Index:
    """table: the shards' rows, of terms and (term null) of documents. documents: those with a term (N).
    terms: all terms with repeats (L)."""

    table: DataFrame
    documents: int
    terms: int


def split_terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, seven bits in each, the lowest first, and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= 1 << 7 * k
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > k)
        out[ends[rows] - size[rows] + k] = (values[rows] >> 7 * k & 127) | np.where(size[rows] > k + 1, 128, 0)
    return out, size


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that pack_numbers made these bytes of."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 8 * m)


def norms(sizes: list[int], documents: int, terms: int) -> np.ndarray:
    """m of documents with so many terms."""
    return np.array([100 - B + B * n * documents // terms for n in sizes], np.int64)


def build_index(df: DataFrame, id: str = "doc_id", text: str = "text") -> Index:
    """The index of all terms of the whole texts, in the shared folder.

    Every row is a document of its own, repeated rows and rows with a null id too; null texts and texts
    without a term are none. Other columns of df are left out. Each task indexes its own documents, in
    shards of bounded size (a longer text is a shard by itself), so no posting is shuffled and no term,
    however frequent, is gathered anywhere.
    """
    prepare(df)
    kind = df.schema[id].dataType

    @frugal
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(split_terms(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["n", "l"])

    whole = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    totals = whole.mapInArrow(measure, "n bigint, l bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    n_documents, n_terms = totals

    @frugal
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = itertools.count(TaskContext.get().partitionId() << 32)
        held = _Shard()
        for batch in batches:
            ids = batch.column(0)
            for row, of in enumerate(batch.column(1)):
                found = split_terms(of.as_py())
                if not found:
                    continue
                if held.size and held.size + len(found) > SHARD_TERMS or len(held.sizes) >= SHARD_DOCUMENTS:
                    yield from held.rows(next(shards), n_documents, n_terms)
                    held = _Shard()
                held.add(ids.slice(row, 1), found)
        if held.size:
            yield from held.rows(next(shards), n_documents, n_terms)

    schema = f"shard bigint, term string, n bigint, data binary, at array<int>, first array<int>, last array<int>, top array<bigint>, ids array<{kind.simpleString()}>, sizes array<bigint>"
    source = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return Index(materialize(source.mapInArrow(index, schema), "index"), n_documents, n_terms)


class _Shard:
    """Documents of a shard on their way to blocks."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.sizes: list[int] = []
        self.found: list[np.ndarray] = []
        self.number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.size = 0

    def add(self, id: pa.Array, terms: list[bytes]) -> None:
        self.ids.append(id)
        self.sizes.append(len(terms))
        self.found.append(np.fromiter(map(self.number.__getitem__, terms), np.int32, len(terms)))
        self.size += len(terms)

    def rows(self, shard: int, n_documents: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """The row of the documents, by ascending id with nulls last, and the terms' rows."""
        import pyarrow.compute as pc

        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.array(self.sizes, np.int64)
        # One number for each pair of a term and a document, counted; they ascend by term, then document.
        pairs, tf = np.unique(np.concatenate(self.found) * np.int64(len(sizes)) + np.repeat(place, sizes), return_counts=True)
        term, doc = np.divmod(pairs, len(sizes))
        sizes = sizes[order]
        top = impacts(tf, norms(sizes.tolist(), n_documents, n_terms)[doc])
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        count = np.diff(begins, append=len(term))
        blocks = -(-count // BLOCK)
        ends = np.cumsum(blocks)
        start = np.repeat(begins, blocks) + BLOCK * (np.arange(ends[-1]) - np.repeat(ends - blocks, blocks))
        last = np.append(start[1:], len(term)) - 1
        gap = np.diff(doc, prepend=0)
        gap[start] = 0  # a block's first document is in its header
        data, taken = pack_numbers(np.stack([gap, tf - 1], axis=1).ravel())
        offset = np.concatenate([[0], np.cumsum(taken)])[::2]
        first_byte = offset[begins]
        per_term = pa.array(np.concatenate([[0], ends]).astype(np.int32))

        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(per_term, pa.array(values, kind))

        words = pa.array(list(self.number), pa.binary()).cast(pa.string())
        many = len(words)
        names = ["shard", "term", "n", "data", "at", "first", "last", "top", "ids", "sizes"]
        bytes_of = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(np.append(first_byte, len(data)).astype(np.int32)), pa.py_buffer(data)])
        columns = [
            pa.array(np.full(many, shard)), words, pa.array(count), bytes_of,
            lists(offset[start] - np.repeat(first_byte, blocks), pa.int32()), lists(doc[start], pa.int32()), lists(doc[last], pa.int32()),
            lists(np.maximum.reduceat(top, start), pa.int64()), pa.nulls(many, pa.list_(ids.type)), pa.nulls(many, pa.list_(pa.int64())),
        ]
        terms = pa.RecordBatch.from_arrays(columns, names=names)
        whole = pa.array([0, len(ids)], pa.int32())
        none = [pa.nulls(1, x.type) for x in columns[1:8]]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), *none, pa.ListArray.from_arrays(whole, ids.take(pa.array(order))), pa.ListArray.from_arrays(whole, pa.array(sizes))], names=names)
        for at in range(0, many, 20_000):
            yield terms.slice(at, 20_000)


class Postings:
    """A term's blocks in a shard. Headers are arrays; blocks are decompressed when they are asked for, once."""

    def __init__(self, data: bytes, at: np.ndarray, first: np.ndarray, last: np.ndarray, top: np.ndarray, n: int, weight: int):
        self.data, self.at, self.first, self.last, self.weight = data, np.append(at, len(data)), first, last, weight
        self.top = top * weight
        self.docs = self.scores = None
        self.open, self.n = np.zeros(len(at), bool), n

    def decompress(self, blocks: np.ndarray, m: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        if self.docs is None:
            self.docs, self.scores = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        numbers = unpack_numbers(np.frombuffer(b"".join(self.data[self.at[j] : self.at[j + 1]] for j in blocks), np.uint8))
        sizes = np.minimum(BLOCK, self.n - BLOCK * blocks)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        places = self.places(blocks)
        run = np.cumsum(numbers[::2])
        docs = run - np.repeat(run[begins] - self.first[blocks], sizes)
        self.docs[places], self.scores[places] = docs, self.weight * impacts(numbers[1::2] + 1, m[docs])
        self.open[blocks] = True

    def places(self, blocks: np.ndarray) -> np.ndarray:
        """Places of these blocks' postings."""
        sizes = np.minimum(BLOCK, self.n - BLOCK * blocks)
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.arange(sizes.sum()) + np.repeat(BLOCK * blocks - before, sizes)


def best(terms: list[Postings], m: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best documents with a score above 0, the highest first, equal ones by place.

    Between two block ends, each term's pointer stays in one block: its greatest impact bounds what the
    term adds to any document there. Ranges are opened in the order of their bounds, some at a time,
    until the next bound is below the k-th best score; one that equals it may hold a smaller place.
    """
    ends = np.unique(np.concatenate([t.last for t in terms]))
    bound = np.zeros(len(ends), np.int64)
    pointers = []
    for t in terms:
        j = np.searchsorted(t.last, ends)
        there = (j < len(t.last)) & (t.first[np.minimum(j, len(t.last) - 1)] <= ends)
        j = np.where(there, j, -1)
        bound += np.where(there, t.top[j], 0)
        pointers.append(j)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    score = np.zeros(len(m), np.int64)
    top_score, top_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, 4
    while at < len(order) and (len(top_doc) < k or bound[order[at]] >= top_score[-1]):
        opened = np.zeros(len(ends), bool)
        some = order[at : at + step]
        if len(top_doc) == k:
            some = some[bound[some] >= top_score[-1]]
        opened[some] = True
        seen = []
        for t, j in zip(terms, pointers, strict=True):
            blocks = np.unique(j[some])
            blocks = blocks[blocks >= 0]
            if len(blocks):
                t.decompress(blocks, m)
                places = t.places(blocks)
                docs = t.docs[places]
                inside = opened[np.searchsorted(ends, docs)]
                docs = docs[inside]
                score[docs] += t.scores[places[inside]]
                seen.append(docs)
        docs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        docs = docs[score[docs] > 0]
        top_score, top_doc = np.concatenate([top_score, score[docs]]), np.concatenate([top_doc, docs])
        keep = np.lexsort((top_doc, -top_score))[:k]
        top_score, top_doc = top_score[keep], top_doc[keep]
        at, step = at + step, 2 * step
    return list(zip(top_score.tolist(), top_doc.tolist(), strict=True))


def search(index: Index, items: DataFrame, id: str = "item_id", text: str = "text", k: int = 10, of: str = "doc_id") -> DataFrame:
    """(item id, rank, doc_id, score): the k best documents of the index for each item, ranked from 1 by
    descending score, equal scores by ascending id (null last); only scores above 0.

    The score of a document is the sum, over the item's distinct terms, of floor(1000 * ln((2 N + 2) /
    (2 df + 1))) times the term's impact. Rows that repeat an item's id are one item with all their terms;
    a null id is an item too; items without a term have no row. Items are searched in blocks, each in
    every shard, so a task holds a shard's postings of one block's terms; only k documents an item and
    shard are shuffled on.
    """
    prepare(items)
    lowered = F.translate(F.col(f"`{text}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col(f"`{id}`").alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    blocks = max(1, -(-items.count() // ITEMS_A_BLOCK))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "asked")
    # An item of a block at most once each: a list has a bound by the block's items.
    wanted = asked.groupBy("block", "term").agg(F.collect_list(F.struct("item")).alias("items"))
    terms = asked.select("term").distinct()
    few = terms.count() <= MOST_BROADCAST
    rows = index.table.where("term is not null").join(F.broadcast(terms) if few else terms, "term")
    found = materialize(rows.drop("ids", "sizes"), "postings")
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents).cast("double") + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = wanted.join(df, "term").select("block", "term", "items", weight.alias("weight"))
    postings = found.join(weighed, "term").withColumns({"ids": F.lit(None).cast(index.table.schema["ids"].dataType), "sizes": F.lit(None).cast("array<bigint>")})
    shards = index.table.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    n_documents, n_terms = index.documents, index.terms
    item_kind, id_kind = items.schema[id].dataType.simpleString(), index.table.schema["ids"].dataType.elementType.simpleString()

    def look(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, m, asked, out = None, None, defaultdict(list), []
        for row in table.select(["ids", "sizes"]).filter(pa.array(table.column("ids").is_valid())).to_batches():
            ids, m = row.column(0)[0].values, norms(row.column(1)[0].as_py(), n_documents, n_terms)
        part = table.filter(pa.array(table.column("term").is_valid()))
        for i in range(part.num_rows):
            one = {c: part.column(c)[i] for c in ("data", "at", "first", "last", "top")}
            arrays = [one[c].values.to_numpy() for c in ("at", "first", "last", "top")]
            of_term = Postings(one["data"].as_py(), *arrays, part.column("n")[i].as_py(), part.column("weight")[i].as_py())
            if of_term.weight > 0:
                for item in part.column("items")[i].values.field(0).to_pylist():
                    asked[item].append(of_term)
        if m is not None:
            out = [(item, doc, score) for item, terms in asked.items() for score, doc in best(terms, m, k)]
        item, doc, score = zip(*out, strict=True) if out else ((), (), ())
        kind = part.schema.field("items").type.value_type.field(0).type
        docs = ids.take(pa.array(doc, pa.int64())) if out else pa.array([], table.schema.field("ids").type.value_type)
        return pa.Table.from_arrays([pa.array(item, kind), docs, pa.array(score, pa.int64())], names=["item", "doc", "score"])

    both = postings.unionByName(shards, allowMissingColumns=True)
    local = both.groupBy("shard", "block").applyInArrow(look, f"item {item_kind}, doc {id_kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(id), "rank", F.col("doc").alias(of), "score")
