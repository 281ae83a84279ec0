"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths over word
hashes, in numpy, measure the characters inside n-grams and lines that a text repeats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_name, lengths, mix, prepare, raw

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_REST = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8: not the first of a character
_SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Length of the windows that n_repeat_words counts.
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits beyond which a text is refused. coverage: for each n-gram length, the share of the
    words' characters inside n-grams that occur twice or more; lines: the share inside lines that
    occur twice or more; symbols: symbols for each word. min_words and repeat_percent: the base."""

    coverage: dict[int, float] = field(default_factory=lambda: {2: 0.5, 3: 0.4, 5: 0.35, 8: 0.3, 10: 0.3})
    lines: float = 0.4
    symbols: float = 0.3
    min_words: int = 20
    repeat_percent: int = 30


def repeated(hashes: np.ndarray, doc: np.ndarray, ends: np.ndarray, ns: list[int]) -> dict[int, np.ndarray]:
    """For each n of ns (ascending), which words lie in an n-gram found twice or more in their own
    document. hashes, doc, ends: of each word its hash, its document, and the end of that document.
    An n-gram can only repeat where the shorter one at its place does, so each length looks at the
    places that the one before it left."""
    found, at, rolling, length = {}, np.arange(len(hashes)), np.zeros(len(hashes), np.uint64), 0
    for n in ns:
        at = at[at + n <= ends[at]]
        rolling = np.zeros(len(at), np.uint64)
        for k in range(n):
            rolling = rolling * _BASE + hashes[at + k]
        keys = mix(rolling ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        hit = np.zeros(len(at), bool)
        hit[order[same]] = hit[order[same + 1]] = True
        at = at[hit]
        steps = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + n, -1)
        found[n] = np.cumsum(steps[:-1]) > 0
    return found


def measure(texts: list[bytes], ns: list[int]) -> dict[str, list]:
    """The measures of each text; see quality()."""
    rows: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "line_share")}
    hashes: list[int] = []
    sizes: list[int] = []
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        words = text.split()
        hashes += map(digest, words)
        plain = text.isascii()
        sizes += map(len, words) if plain else [len(w.translate(None, _REST)) for w in words]
        rows["n_words"].append(len(words))
        chars = len(text.translate(None, _SPACE if plain else _SPACE + _REST))
        rows["word_chars"].append(chars)
        rows["n_symbols"].append(len(text) - len(text.translate(None, _SYMBOLS)))
        again, all_chars, seen = 0, 0, {}
        for line in text.split(b"\n"):
            if size := len(line.translate(None, _SPACE + _REST)):
                again += line in seen
                all_chars += size
                seen.setdefault(line, []).append(size)
        rows["n_dup_lines"].append(again)
        rows["line_share"].append(sum(sum(x) for x in seen.values() if len(x) > 1) / max(1, all_chars))
    count = np.array(rows["n_words"], np.int64)
    doc, last = np.repeat(np.arange(len(texts)), count), np.cumsum(count)
    size = np.array(sizes, np.float64)
    every = sorted({*ns, WINDOW})
    found = repeated(np.array(hashes, np.uint64), doc, np.repeat(last, count), every)
    rows["n_repeat_words"] = np.bincount(doc[found[WINDOW]], minlength=len(texts)).tolist()
    total = np.maximum(1, np.bincount(doc, weights=size, minlength=len(texts)))
    for n in ns:
        rows[f"c{n}"] = (np.bincount(doc[found[n]], weights=size[found[n]], minlength=len(texts)) / total).tolist()
    return rows


def quality(df: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    line_share and coverage (an array, a share for each n-gram length of the rules).

    Null and empty texts have no words: base_failed, not kept. Whole texts are measured, however
    long; rows that repeat are measured each for itself; columns of df with the results' names are
    replaced; an empty df gives an empty result. No shuffle.
    """
    prepare(df)
    rules = rules or Rules()
    ns = sorted(rules.coverage)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = [(c, pa.int64()) for c in counts] + [("line_share", pa.float64()), ("coverage", pa.list_(pa.float64()))]

    @F.arrow_udf(f"struct<{','.join(f'{c}:bigint' for c in counts)},line_share:double,coverage:array<double>>")
    def measured(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts, at, size = [], 0, 0
            bounds = [0]
            for i, n in enumerate(lengths(column)):
                if size and size + n > 2_000_000:
                    bounds.append(i)
                    size = 0
                size += n
            bounds.append(len(column))
            for at, end in zip(bounds, bounds[1:], strict=False):
                got = measure(raw(column.slice(at, end - at)), ns)
                cover = [list(x) for x in zip(*(got[f"c{n}"] for n in ns), strict=True)]
                parts.append(pa.StructArray.from_arrays([*(pa.array(got[c], pa.int64()) for c in counts), pa.array(got["line_share"], pa.float64()), pa.array(cover, pa.list_(pa.float64()))], fields=list(pa.struct(kind))))
            yield pa.concat_arrays(parts)

    new = {*(c for c, _ in kind), "base_failed", "kept"}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    of = fresh_name(df, "_measured")
    out = df.select(*kept, measured(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias(of)).select(*kept, f"{of}.*")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    bad = (F.col("line_share") > rules.lines) | (F.col("n_symbols") > rules.symbols * F.col("n_words"))
    for i, n in enumerate(ns):
        bad = bad | (F.col("coverage")[i] > rules.coverage[n])
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)
