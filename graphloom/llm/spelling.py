"""Spelling variants by full neighbourhood generation: every distinct deletion, replacement and
insertion over the letters that occur is emitted for each word of the vocabulary, and a hash join
with the vocabulary says which of them are words. A match is near by construction, so no distance
is computed."""

from __future__ import annotations

import collections
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, frugal, materialize, mix, prepare

#: Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, one byte each in Latin-1; A-Z are lower-cased, all else is a space.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
#: Words that a task counts before it sends its counts on.
MOST_COUNTED = 500_000
#: Bits of the filter of the vocabulary: so many a word, and never more than MOST_BITS (64 MB), whatever the input.
BITS_A_WORD, MOST_BITS, PROBES = 16, 1 << 29, 4
#: Words that a task generates neighbours of, and neighbours that it holds at a time.
TASK_WORDS, HELD = 10_000, 1_000_000
#: The base of the polynomial over a word's letters, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def count_words(df: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, slip: int | None = None) -> DataFrame:
    """(word, n): how often each word of at least `least_length` code points occurs in the whole texts,
    where that is at least `least_count` times.

    slip: with h the crc32 of `<id>:<word>`, a word whose h this number divides loses its code point
    h % length before it is counted. Null texts hold no word, words of rows with a null id are never
    changed, repeated rows count each for itself. Counts are combined in each task before they are
    shuffled, so a frequent word is a few rows.
    """
    prepare(df)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: collections.Counter[bytes] = collections.Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for own, of in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = collections.Counter(w for w in (of.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= least_length)
                if slip is not None and own is not None:
                    start = zlib.crc32(f"{own}:".encode())
                    for word in [w for w in found if zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start) % slip == 0]:
                        at = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start) % len(word)
                        total[word[:at] + word[at + 1 :]] += found.pop(word)
                total.update(found)
            if len(total) > MOST_COUNTED:
                yield made()
                total.clear()
        yield made()

    texts = df.select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    words = texts.mapInArrow(count, "word string, n bigint").where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


@functools.cache
def _powers(length: int) -> np.ndarray:
    """Powers of the base for every place of a word of up to `length` letters and one more."""
    out = np.ones(length + 2, np.uint64)
    np.multiply.accumulate(np.full(length + 1, _BASE, np.uint64), out=out[1:])
    return out


def _values(letters: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    return mix((letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def _by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for word in words:
        out.setdefault(len(word), []).append(word)
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), len(words[0]))


def _place(sums: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The filter's place of words with these polynomials, for one of the probes."""
    return mix(sums + np.uint64(probe)) & np.uint64(bits - 1)


def _filter(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The filter of all words: `bits` bits in 64-bit numbers. It says yes to each of them, and to few
    others. Its parts are combined by an aggregate; its size has a bound, so it may go to every task."""

    @frugal
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, masks = [], []
            for words in _by_length(batch.column(0).to_pylist()).values():
                codes = _codes(words)
                sums = (_values(codes) * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)
                for probe in range(PROBES):
                    place = _place(sums, probe, bits)
                    slots.append(place >> np.uint64(6))
                    masks.append(np.uint64(1) << (place & np.uint64(63)))
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (slots, masks)], names=["slot", "mask"])

    # At most bits / 64 rows, so at most MOST_BITS / 64.
    found = vocabulary.select("word").mapInArrow(places, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


class Neighbours:
    """All distinct words one edit away from given ones that the filter doesn't rule out."""

    def __init__(self, letters: str, table: np.ndarray):
        self.letters = letters
        self.codes = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
        self.values, self.table, self.bits = _values(self.codes), table, len(table) * 64

    def _passing(self, sums: np.ndarray) -> np.ndarray:
        """Places in the flattened sums of what passes every probe."""
        left = np.arange(sums.size)
        sums = sums.ravel()
        for probe in range(PROBES):
            place = _place(sums[left] if probe else sums, probe, self.bits)
            left = left[(self.table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return left

    def of(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(place of a word, neighbour) for words of one length. A deletion inside a run of equal letters
        is emitted at the run's first letter only, an insertion of a letter never before an equal one, and
        a replacement never by the same letter: these rules leave each neighbour exactly once."""
        size = len(words[0])
        codes = _codes(words)
        power = _powers(size)
        terms = _values(codes) * power[:size]
        before = np.zeros((len(words), size + 1), np.uint64)
        np.cumsum(terms, axis=1, out=before[:, 1:])
        whole = before[:, -1:]
        gone = before[:, :-1] + (whole - before[:, 1:]) * _INVERSE
        for at in self._passing(gone).tolist():
            row, i = divmod(at, size)
            word = words[row]
            if not i or word[i] != word[i - 1]:
                yield row, word[:i] + word[i + 1 :]
        many = len(self.values)
        if not many:
            return
        step = max(1, HELD // (len(words) * many))
        for start in range(0, size + 1, step):
            stop = min(start + step, size + 1)
            added = power[start:stop, None] * self.values
            shifted = before[:, start:stop] + (whole - before[:, start:stop]) * np.uint64(_BASE)
            for at in self._passing(shifted[:, :, None] + added).tolist():
                row, i, c = at // ((stop - start) * many), at // many % (stop - start) + start, at % many
                word, letter = words[row], self.letters[c]
                if i == size or word[i] != letter:
                    yield row, word[:i] + letter + word[i:]
            stop = min(stop, size)
            if start < stop:
                kept = whole - terms[:, start:stop]
                for at in self._passing(kept[:, :, None] + added[: stop - start]).tolist():
                    row, i, c = at // ((stop - start) * many), at // many % (stop - start) + start, at % many
                    word, letter = words[row], self.letters[c]
                    if word[i] != letter:
                        yield row, word[:i] + letter + word[i + 1 :]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words of the vocabulary (word, n) that differ by one inserted,
    deleted or replaced code point, in both directions.

    All edits of every word are generated over the letters that occur in the vocabulary. A filter of the
    vocabulary drops nearly all that are no words before anything is shuffled; the join drops the rest.
    The filter's size has a bound: with a larger vocabulary more of what it lets through is shuffled,
    the result is the same.
    """
    spark = prepare(vocabulary).sparkSession
    count = vocabulary.count()
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r.c for r in letters.collect()))  # one row a code point that occurs
    bits = max(64, min(MOST_BITS, 1 << (BITS_A_WORD * max(1, count) - 1).bit_length()))
    table = spark.sparkContext.broadcast(_filter(vocabulary, bits).tobytes())

    @frugal
    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Neighbours(alphabet, np.frombuffer(table.value, np.uint64))
        for batch in batches:
            for size, words in _by_length(batch.column(0).to_pylist()).items():
                many = max(1, HELD // (max(1, len(alphabet)) * (size + 1)))
                for at in range(0, len(words), many):
                    some = words[at : at + many]
                    found = list(source.of(some))
                    if found:
                        rows, near = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([some[r] for r in rows], pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    dealt = vocabulary.select("word").repartition(-(-max(1, count) // TASK_WORDS), "word")
    candidates = dealt.mapInArrow(generate, "word string, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of the chain that begins at each word. A form is more
    frequent than its word, so chains end; each round doubles the steps taken and is a written table."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(found)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        found = after.select("word", "root")
        found.stored_at = after.stored_at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n).

    n_near: words that differ from it by exactly one inserted, deleted or replaced code point. form: the
    most frequent of them (ties: the smallest in code-point order) if it is at least `ratio` (more than
    1) times as frequent, else null; form_n: its n. root: the last word that forms lead to, or the word itself.
    Words must not repeat; an empty table gives an empty result. A word has few near words (at most its
    edits), so no key of a join is hot.
    """
    if ratio <= 1:
        raise ValueError("ratio must be more than 1, or chains of forms need not end")
    vocabulary = materialize(words.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    near = neighbours(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    found = vocabulary.join(near, "word", "left")
    form_n = -F.col("best.less")
    is_form = form_n >= ratio * F.col("n")
    judged = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, form_n).alias("form_n")), "forms")
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
