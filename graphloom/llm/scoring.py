"""Language-model scoring by subword lattice likelihood. The pieces of an existing vocabulary,
with unigram scores, weight all segmentations of a word; the forward recursion in log space
returns the word's marginal probability. No piece crosses white space, so a text's probability
is the product over its words and the end, and each distinct word of the corpus is solved once."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, mix, pieces, prepare, raw, words

#: Distinct words a task gathers before it sends their counts on.
HELD = 300_000
_NONE = -math.inf


@functools.cache
def vocabulary(path: str) -> tuple[dict[str, int], list[int], int]:
    """Piece -> id, the ids of the 256 byte pieces, and the number of ids of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return normal, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n


@functools.cache
def first_scores(path: str) -> np.ndarray:
    """Log-probabilities from the vocabulary's own scores. A merge vocabulary scores a piece with
    minus its rank, so its probability is taken as 1 / (rank + 1), Zipf's law; byte pieces, which
    stand for what the vocabulary lacks, get the smallest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, by_byte, n = vocabulary(path)
    raw_scores = np.full(n, _NONE)
    for i in normal.values():
        raw_scores[i] = model.get_score(i)
    ranked = all(float(x).is_integer() for x in raw_scores[list(normal.values())][:500])
    scores = -np.log1p(np.maximum(0.0, -raw_scores)) if ranked else raw_scores
    scores[by_byte] = scores[list(normal.values())].min()
    return scores - np.logaddexp.reduce(scores)


#: Places in each table of pieces, a power of two.
ROOM = 1 << 20


def _hashes(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length from 1: hashes of every substring of that many characters, by its start."""
    n = codes.shape[1]
    out, rolling = [], np.zeros(codes.shape, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for length in range(1, min(n, longest) + 1):
        rolling = rolling[:, : n - length + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[:, length - 1 :]
        out.append(mix(rolling ^ np.uint64(length)))
    return out


@functools.cache
def _tables(path: str):
    """What finds pieces by hash: made once in a worker. Tables lead from some bits of a hash to a
    piece's number; pieces whose place is taken go to the next table, which looks at other bits."""
    normal, by_byte, size = vocabulary(path)
    by_length: dict[int, list[str]] = {}
    for piece in normal:
        by_length.setdefault(len(piece), []).append(piece)
    names = [x for own in by_length.values() for x in own]
    keys = np.concatenate([_hashes(np.array([list(map(ord, x)) for x in own], np.uint32), n)[-1][:, 0] for n, own in by_length.items()])
    tables, left = [], np.arange(len(keys))
    while len(left):
        shift = np.uint64(11 * len(tables) % 44)
        place = (keys[left] >> shift & np.uint64(ROOM - 1)).astype(np.int64)
        table = np.full(ROOM, len(keys), np.int32)
        table[place] = left
        tables.append((shift, table))
        left = left[table[place] != left]
    return np.array(by_byte), size, max(by_length), np.array([normal[x] for x in names] + [-1]), np.append(keys, np.uint64(0)), tables


def _many(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """The batches, put together to about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Lattice:
    """Segmentations of words into pieces with log-probabilities, many words at a time: words of
    one length are rows of an array, and the recursions run over its columns."""

    #: Longer words go through the recursion one by one, others in arrays.
    WIDE = 40

    def __init__(self, path: str, scores: np.ndarray):
        self.scores = scores
        self.by_byte, self.size, self.longest, self.ids, self.keys, self.tables = _tables(path)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; that of no piece is the last."""
        none = len(self.keys) - 1
        out = np.full(h.shape, none, np.int32)
        for shift, table in self.tables:
            at = table[h >> shift & np.uint64(ROOM - 1)]
            np.copyto(out, at, where=(self.keys[at] == h) & (at != none))
        return out

    def arcs(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: the log-probability of the piece that starts at each place (-inf: none),
        and its id. A character that is no piece is spelled in bytes, with id -1."""
        out = []
        for length, h in enumerate(_hashes(codes, self.longest), 1):
            ids = self.ids[self._find(h)]
            hit = ids >= 0
            logs = np.where(hit, self.scores[ids], _NONE)
            if length == 1 and not hit.all():
                strange, which = np.unique(codes[~hit], return_inverse=True)
                logs[~hit] = np.array([self.scores[self.by_byte[list(chr(c).encode("utf-8", "replace"))]].sum() for c in strange])[which]
            out.append((logs, ids))
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        x = np.stack(terms)
        top = x.max(axis=0)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return top + np.log(np.exp(x - top).sum(axis=0))

    def forward(self, arcs: list) -> list[np.ndarray]:
        n = arcs[0][0].shape[1]
        alpha = [np.zeros(arcs[0][0].shape[0])]
        for j in range(1, n + 1):
            alpha.append(self._sum([alpha[j - k] + arcs[k - 1][0][:, j - k] for k in range(1, min(j, len(arcs)) + 1)]))
        return alpha

    def backward(self, arcs: list) -> list[np.ndarray]:
        n = arcs[0][0].shape[1]
        beta = [np.zeros(arcs[0][0].shape[0])]
        for i in range(n - 1, -1, -1):
            beta.append(self._sum([beta[n - i - k] + arcs[k - 1][0][:, i] for k in range(1, min(n - i, len(arcs)) + 1)]))
        return beta[::-1]

    def _by_length(self, words_: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, codes) of words of equal length, at most 8192 at a time."""
        by: dict[int, list[int]] = {}
        for row, word in enumerate(words_):
            by.setdefault(len(word), []).append(row)
        for n, rows in by.items():
            step = max(1, 8192 if n <= self.WIDE else 8192 * self.WIDE // n)
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                codes = np.frombuffer("".join("▁" + words_[r] for r in own).encode("utf-32-le", "replace"), "<u4").reshape(len(own), n + 1)
                yield np.array(own), codes

    def marginals(self, words_: list[str]) -> np.ndarray:
        """Natural logarithms of the words' probabilities over all segmentations."""
        out = np.zeros(len(words_))
        for rows, codes in self._by_length(words_):
            out[rows] = self.forward(self.arcs(codes))[-1]
        return out

    def expect(self, words_: list[str], times: np.ndarray, counts: np.ndarray) -> None:
        """Adds the pieces' expected counts (forward-backward) when each word occurs `times` times."""
        for rows, codes in self._by_length(words_):
            arcs = self.arcs(codes)
            alpha, beta = self.forward(arcs), self.backward(arcs)
            whole, weight = alpha[-1], times[rows]
            for length, (logs, ids) in enumerate(arcs, 1):
                for i in range(logs.shape[1]):
                    used = np.flatnonzero(logs[:, i] > _NONE)
                    if not len(used):
                        continue
                    share = weight[used] * np.exp(np.minimum(0.0, alpha[i][used] + logs[used, i] + beta[i + length][used] - whole[used]))
                    piece = ids[used, i]
                    known = piece >= 0
                    counts += np.bincount(piece[known], weights=share[known], minlength=self.size)
                    for c, x in zip(codes[used[~known], i].tolist(), share[~known].tolist(), strict=True):
                        np.add.at(counts, self.by_byte[list(chr(c).encode("utf-8", "replace"))], x)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, trained, all): occurrences in training texts and in all, summed as far as memory allows."""
    trained: Counter = Counter()
    all_: Counter = Counter()

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(all_), pa.binary()), pa.array([trained.get(w, 0) for w in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], names=["word", "trained", "total"])
        trained.clear(), all_.clear()
        return out

    for batch in batches:
        for part in pieces(batch, "text"):
            learn = part.column("learn").to_pylist()
            for text, use in zip(raw(part.column("text")), learn, strict=True):
                own = words(text)
                all_.update(own)
                if use:
                    trained.update(own)
            if len(all_) > HELD:
                yield made()
    if all_:
        yield made()


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def score(df: DataFrame, learn: Column, vocabulary_path: str, id: str = "doc_id", text: str = "text", head: int = 60_000, rounds: int = 4) -> DataFrame:
    """One row per row of df: id, n_tokens, n_known, train_tokens, base_score, score.

    learn: which rows the model learns from. Tokens are the words (A-Z lower-cased) and one end.
    base_score: log10 of the add-one unigram probability of the words. score: log10 of the lattice
    probability under piece probabilities that start from the vocabulary's scores and are
    re-estimated (`rounds` of expectation-maximisation) on all training words. Null is an empty text,
    which has the end alone; rows that repeat are scored each for itself; other columns are left
    out; with no training rows c and N are 0. head: the commonest words, whose figures every task
    holds in a table of that bounded size; all other words are looked up by a join on the word.
    """
    prepare(df)
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    source = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    table = materialize(source.select("text", "learn").mapInArrow(_sums, "word binary, trained bigint, total bigint").groupBy("word").agg(F.sum("trained").alias("c"), F.sum("total").alias("total")), "words")
    ends = source.agg(F.count(F.when(F.col("learn"), 1))).first()[0]
    row = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, distinct = row[0] + ends, row[1] + (1 if ends else 0)

    current = sc.broadcast(first_scores(vocabulary_path))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary_path, current.value)
        found = np.zeros(lattice.size)
        for batch in _many(batches):
            lattice.expect([_text(w) for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float), found)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], names=["piece", "n"])

    start = first_scores(vocabulary_path)
    for _ in range(rounds):
        pieces_n = np.zeros(len(start))
        # At most one row for each piece of the vocabulary reaches the driver.
        for r in table.where("c > 0").select("word", "c").mapInArrow(expected, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect():
            pieces_n[r.piece] = r.n
        # As much as one occurrence for each piece is dealt by the vocabulary's own scores.
        smooth = np.where(np.isfinite(start), pieces_n + np.exp(start) * len(start), 0.0)
        whole = smooth.sum() + ends + 1
        with np.errstate(divide="ignore"):
            current = sc.broadcast(np.log(smooth / whole))
    end_log10 = math.log10((ends + 1) / whole)
    shared = current

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary_path, shared.value)
        for batch in _many(batches):
            logs = lattice.marginals([_text(w) for w in batch.column(0).to_pylist()]) / math.log(10)
            yield from batch.append_column("lm", pa.array(logs, pa.float64())).to_batches()

    solved_table = materialize(table.mapInArrow(solved, "word binary, c bigint, total bigint, lm double"), "lattice")
    discard(table)
    top = {bytes(r.word): (r.c, math.log10(r.c + 1), r.lm) for r in solved_table.orderBy(F.desc("total"), "word").limit(head).collect()}
    common = sc.broadcast(top)
    total_log = math.log10(n + distinct + 1)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, row = common.value, TaskContext.get().partitionId() << 33, 0
        zero = (0, 0.0, 0.0)
        for batch in batches:
            for own in pieces(batch, "text"):
                out: list[list] = [[] for _ in range(7)]
                for text in raw(own.column("text")):
                    found = Counter(words(text))
                    c_sum, base, lm, rare, times, tokens = 0, 0.0, 0.0, [], [], 1
                    for word, k in found.items():
                        tokens += k
                        if (x := known.get(word, zero)) is zero:
                            rare.append(word), times.append(k)
                        else:
                            c_sum += k * (x[0] > 0)
                            base += k * x[1]
                            lm += k * x[2]
                    for column, value in zip(out, (part + row, tokens, c_sum, base, lm, rare, times), strict=True):
                        column.append(value)
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["id", "row", "tokens", "known", "base", "lm", "rare", "times"])

    texts = materialize(source.select("id", "text").mapInArrow(partly, f"id {df.schema[id].dataType.simpleString()}, row bigint, tokens bigint, known bigint, base double, lm double, rare array<binary>, times array<bigint>"), "partly")
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    looked = rare.join(solved_table, "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("base2"), F.sum(F.col("k") * F.col("lm")).alias("lm2"))
    zero = F.lit(0)
    return texts.select("id", "row", "tokens", "known", "base", "lm").join(looked, "row", "left").select(
        F.col("id").alias(id),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", zero) + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + math.log10(ends + 1) - F.col("tokens") * total_log).alias("base_score"),
        (F.col("lm") + F.coalesce("lm2", zero) + end_log10).alias("score"),
    )
