"""Token counts: whole batches are encoded by the tokenizer's own library inside an Arrow
function that returns lengths only. Batches hold about equally many bytes, and texts are cut where
the tokenizer cuts anyway, so that what repeats in a batch is encoded once."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_name, lengths, prepare, release

#: The byte-level pattern always cuts before a space between two characters that are no white space
#: (Python counts a few more characters as such than the pattern does, which only means fewer cuts),
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: and between these marks and a letter or digit.
_MARKS = re.compile(r"(?<=[。，、！？；：])(?=[^\W_])")
#: White space other than spaces and line ends.
_ODD = re.compile(r"[^\S \n]")
#: Characters of a piece from which it is cut at marks too.
LONG = 20_000
#: Pieces, and characters of them, that a worker remembers at most.
MOST_PIECES, MOST_CHARACTERS = 1_000_000, 24_000_000
#: Bytes that the library encodes at a time, and words that are one text for it.
BATCH_BYTES, WORDS = 500_000, 100


@functools.cache
def tokenizer(path: str):
    """A function from texts to the ids of each, loaded once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    raise ValueError(f"no tokenizer library for {path}")


@functools.cache
def _model(path: str) -> tuple[bool, np.ndarray, tuple[str, ...]]:
    """What cuts_safely, spaced and special_strings tell of a .json file, which is read once and let go before the
    library reads it: workers share an executor's memory."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    before, added = model.get("pre_tokenizer") or {}, model.get("added_tokens", [])
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not model.get("normalizer")
    safe = usual and not any(" " in x["content"] or _MARKS.search(f"a{x['content']}a") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added)
    begins = np.zeros(0, bool)
    if safe:
        ids = model["model"]["vocab"] | {x["content"]: x["id"] for x in added}
        begins = np.zeros(max(ids.values()) + 1, bool)
        begins[[i for x, i in ids.items() if x.startswith("Ġ")]] = True  # the model's sign for a space
    return safe, begins, tuple(x["content"] for x in added)


def cuts_safely(path: str) -> bool:
    """Whether texts may be cut at _SAFE and _MARKS: the file is a byte-level model with the usual pattern,
    and no added token reaches across a cut."""
    return path.endswith(".json") and _model(path)[0]


def spaced(path: str) -> np.ndarray:
    """Whether each id of a byte-level model begins with a space."""
    return _model(path)[1]


#: Begins a piece that has no space before it. Texts that hold this character are encoded whole.
BEGIN = "\x01"


def special_strings(path: str) -> tuple[str, ...]:
    """Texts that are tokens of their own, whatever is around them."""
    return _model(path)[2]


def split_safely(text: str, special: tuple[str, ...] = ()) -> list[str] | None:
    """Pieces of the text whose ids, one after the other, are the text's; None where it can't be cut. A piece
    stands for itself and the space before it, unless it begins with BEGIN or is a line end alone. A text with
    one of the special strings is cut at spaces only."""
    if BEGIN in text:
        return None
    if any(x in text for x in special) or _ODD.search(text) or "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text[:1] == " " or text[-1:] == " " or text[-2:] == "\n\n":
        pieces = _SAFE.split(text)
        pieces[0] = BEGIN + pieces[0]
        return pieces
    # Between other characters one line end, or two, are tokens of their own.
    return (BEGIN + text.replace("\n", f" \n {BEGIN}")).split(" ")


class _Grown:
    """An array that grows at its end, by copies as seldom as a list's."""

    def __init__(self, kind: type):
        self.values, self.size = np.empty(1024, kind), 0

    def append(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.values):
            held = self.values[: self.size]
            self.values = np.empty(2 * (self.size + len(more)), held.dtype)
            self.values[: self.size] = held
        self.values[self.size : self.size + len(more)] = more
        self.size += len(more)


class Encoder:
    """The library's ids of whole texts. Texts are cut by split_safely where the model allows it, and a
    worker remembers the numbers of the ids of pieces, so that a piece that repeats is encoded once;
    what it remembers has a bound."""

    def __init__(self, path: str, most: int | None = None):
        self.cut, self.most = cuts_safely(path), most or MOST_PIECES
        release()
        self.library = tokenizer(path)
        self.spaced = spaced(path) if self.cut else None
        self.special = special_strings(path) if self.cut else ()
        self.line_end = self.library(["\n"])[0][0] if self.cut else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.ids = _Grown(np.int64), _Grown(np.uint32)  # where a piece's ids begin, and all of them
        self.start.append(np.zeros(1, np.int64))
        self.characters = 0

    def _learn(self, new: list[str]) -> None:
        """Takes up new pieces. Words are encoded many in one text, which is cut before the ids that begin with a
        space, or at line ends where the words have none before them."""
        plain, begun, other = [], [], []
        for x in new:
            simple = len(x) <= LONG and "\n" not in x and " " not in x
            (other if not simple else begun if x[0] == BEGIN and len(x) > 1 and not _ODD.search(x) else other if x[0] == BEGIN else plain).append(x)
        found, sizes = [], []
        for batch in _slices(plain):
            ids = self._joined([" " + " ".join(some) for some in _groups(batch)])
            found.append(ids)
            sizes.append(np.diff(np.flatnonzero(np.append(self.spaced[ids], True))))
        for batch in _slices(begun):
            ids = self._joined(["\n".join(x[1:] for x in some) + "\n" for some in _groups(batch)])
            ends = np.flatnonzero(ids == self.line_end)
            found.append(ids[ids != self.line_end])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        for batch in _batches([x[1:] if x[0] == BEGIN else x if x == "\n" else " " + x for x in other]):
            parts = [_MARKS.split(x) if len(x) > LONG else [x] for x in batch]
            ids = iter(self.library([y for x in parts for y in x]))
            for x in parts:
                found.append(np.array([i for _ in x for i in next(ids)], np.uint32))
                sizes.append([len(found[-1])])
        at = self.start.size - 1
        self.number.update(zip(itertools.chain(plain, begun, other), range(at, at + len(new)), strict=True))
        self.start.append(self.ids.size + np.cumsum(np.concatenate(sizes), dtype=np.int64))
        self.ids.append(np.concatenate(found))
        self.characters += sum(map(len, new))

    def _joined(self, texts: list[str]) -> np.ndarray:
        made = self.library(texts)
        return np.fromiter(itertools.chain.from_iterable(made), np.uint32, sum(map(len, made)))

    def _numbers(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every piece, and where each text's begin."""
        if len(self.number) > self.most or self.characters > MOST_CHARACTERS:
            self.forget()
        at = np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])
        flat = list(itertools.chain.from_iterable(split))
        found = np.fromiter(map(self.number.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(flat[i] for i in missing)))
            found[missing] = [self.number[flat[i]] for i in missing]
        return found, at

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        split = [split_safely(t, self.special) for t in texts] if self.cut else [None] * len(texts)
        numbers, at = self._numbers([x or [] for x in split])
        start = self.start.values
        total = np.concatenate([[0], np.cumsum(start[numbers + 1] - start[numbers])])
        out = (total[at[1:]] - total[at[:-1]]).tolist()
        for i, ids in self._whole(texts, split):
            out[i] = len(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian uint32."""
        split = [split_safely(t, self.special) for t in texts] if self.cut else [None] * len(texts)
        numbers, at = self._numbers([x or [] for x in split])
        start = self.start.values[numbers]
        size = self.start.values[numbers + 1] - start
        ends = np.concatenate([[0], np.cumsum(size)])
        all_ids = self.ids.values[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)].astype("<u4")
        out = [all_ids[ends[a] : ends[b]] for a, b in zip(at, at[1:], strict=False)]
        for i, ids in self._whole(texts, split):
            out[i] = np.array(ids, "<u4")
        return out

    def _whole(self, texts: list[str], split: list[list[str] | None]) -> Iterator[tuple[int, list[int]]]:
        """Ids of the texts that are not cut."""
        rows = [i for i, x in enumerate(split) if x is None]
        return zip(rows, self.library([texts[i] for i in rows]) if rows else [], strict=True)


@functools.cache
def encoder(path: str, most: int | None = None) -> Encoder:
    """One in each Python worker: what it remembers has a bound and serves all of a worker's tasks."""
    return Encoder(path, most)


def _groups(words: list[str]) -> Iterator[list[str]]:
    """The library is quickest with texts of about a hundred words."""
    return (words[i : i + WORDS] for i in range(0, len(words), WORDS))


def _slices(words: list[str], many: int = 20_000) -> Iterator[list[str]]:
    """Runs of words of about BATCH_BYTES, by their number where they are as short as words are."""
    for at in range(0, len(words), many):
        some = words[at : at + many]
        yield from [some] if sum(map(len, some)) <= BATCH_BYTES else _batches(some)


def _batches(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about `most` bytes; a longer one is a run of its own."""
    batch, size = [], 0
    for x in texts:
        n = len(x) if x.isascii() else len(x.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += n
    if batch:
        yield batch


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    vocabulary: path of a .json (tokenizers) or .model (sentencepiece) file, readable on every
    executor. batch_bytes: bytes of text that are cut and encoded at a time. Texts are cut at safe
    boundaries (byte-level models only; others get whole texts). Null counts as empty: 0 bytes, 0
    tokens. Rows may repeat; each counts for itself. Columns of df with the names of the results are
    replaced; an empty df gives an empty result. No shuffle, no driver work; a lost task is run again.
    """
    prepare(df)
    kind = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    @F.arrow_udf("struct<n_bytes:bigint,n_tokens:bigint>")
    def measured(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(vocabulary)
        for column in columns:
            totals = [n for batch in _batches([x.as_py() or "" for x in column], batch_bytes) for n in own.counts(batch)]
            yield pa.StructArray.from_arrays([pa.array(lengths(column), pa.int64()), pa.array(totals, pa.int64())], fields=list(kind))

    of, taken = fresh_name(df, "_measured"), {"n_bytes", "n_tokens", "over_limit"}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, measured(F.col(f"`{text}`").cast("string")).alias(of)).select(*kept, F.col(f"{of}.n_bytes").alias("n_bytes"), F.col(f"{of}.n_tokens").alias("n_tokens"), (F.col(f"{of}.n_tokens") > limit).alias("over_limit"))
