"""Language identification by nearest centroid: TF-IDF vectors of hashed byte n-grams, several
clustered centroids for each language, cosine, and rejection by a distance that depends on how long
a text is."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_name, frugal, lengths, prepare, release

#: Hashed n-gram dimensions; n-gram lengths in bytes.
DIMENSIONS, GRAMS = 4096, (2, 3)
#: Lengths of texts that rejection tells apart, by doubling: up to 2^32 n-grams and more.
LENGTHS = 32
_SALT = np.uint32(0x9E3779B1)
#: Bytes that are no letters of ASCII become a space; bytes of other characters stay.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(texts: list[str]) -> np.ndarray:
    """Occurrences of every hashed n-gram of each whole lower-cased text: float32, texts x DIMENSIONS.
    A long text is counted in blocks that overlap by the n-grams' reach."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    block = 4_000_000
    for row, text in enumerate(texts):
        data = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" "
        for at in range(0, len(data), block):
            b = np.frombuffer(data, np.uint8)[at : at + block + max(GRAMS) - 1].astype(np.uint32)
            for n in GRAMS:
                size = min(block, len(b) - n + 1)
                if size <= 0:
                    continue
                code = b[:size].copy()
                for k in range(1, n):
                    code = (code << np.uint32(8)) | b[k : k + size]
                code = ((code + np.uint32(n)) * _SALT) >> np.uint32(20)
                out[row] += np.bincount(code, minlength=DIMENSIONS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=-1, keepdims=True))


@dataclass
class Model:
    """idf: weight of each dimension. centroids: unit vectors. owner: the language of each
    centroid. radius: by language and length (the binary logarithm of a text's n-grams, rounded down),
    the least cosine at which a text still belongs to that language."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return unit(np.log1p(tf) * self.idf)

    def predict(self, tf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, and whether the distance rejects it."""
        close = self.vectors(tf) @ self.centroids.T
        best = close.argmax(axis=1)
        score = np.clip(close[np.arange(len(best)), best], 0.0, 1.0).astype(np.float64)
        mine = self.owner[best]
        return [self.languages[k] for k in mine], score, score < self.radius[mine, length_bin(tf)]

    def closeness(self, tf: np.ndarray, language: str) -> np.ndarray:
        """Cosines with the nearest centroid of a language."""
        return (self.vectors(tf) @ self.centroids[self.owner == self.languages.index(language)].T).max(axis=1)


def length_bin(tf: np.ndarray) -> np.ndarray:
    return np.minimum(LENGTHS - 1, np.log2(np.maximum(1.0, tf.sum(axis=1, dtype=np.float64)))).astype(int)


def _clusters(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far points."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = unit(np.vstack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def train(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = 400, clusters: int = 4, slack: float = 0.8, least: int = 20) -> Model | None:
    """Learns from rows with a language and a text; None if there are none.

    Document frequencies count all of them, whole, in one pass without a shuffle of texts (a task
    sends its sums alone). The centroids are fitted on a sample of up to `per_language` rows of each
    language (half of a language's rows at most), the smallest hashes of id: the bound of what reaches
    the driver. The next about `per_language` rows are held out to measure the radius: they and
    excerpts of 1, 2, 4, ... words from their middle. It is `slack` times the cosine that all but one
    in a hundred texts of a length reach, and at least that of shorter ones; a length with fewer than
    `least` texts has that of shorter ones, and a language without rows to hold out 0: nothing is rejected.
    """
    prepare(df)
    known = df.select(F.col(f"`{id}`").cast("string").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang")).where("_lang is not null and _text is not null")

    @frugal
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, int] = {}
        found = np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for value, language in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if has_letter(own := value.as_py()):
                    found += counts([own])[0] > 0
                    rows[language] = rows.get(language, 0) + 1
        at = np.flatnonzero(found)
        keys = [None] * len(at) + list(rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*at.tolist(), *[-1] * len(rows)], pa.int64()), pa.array([*found[at].tolist(), *rows.values()], pa.int64())], names=["lang", "gram", "n"])

    # Summed on the executors: one row for each dimension and language reaches the driver.
    seen: dict[str, int] = {}
    total = np.zeros(DIMENSIONS, np.int64)
    for row in known.select("_text", "_lang").mapInArrow(frequencies, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        if row.lang is None:
            total[row.gram] = row.n
        else:
            seen[row.lang] = row.n
    languages = sorted(seen)
    if not languages:
        return None
    n = sum(seen.values())
    idf = (np.log((1 + n) / (1 + total)) + 0.1).astype(np.float32)

    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, 1.3 * per_language / seen[k]))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("_id")), 11) / F.lit(float(1 << 53))
    order = Window.partitionBy("_lang").orderBy("_draw", "_id")

    @F.arrow_udf("string")
    def sparse(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for value in column:
                own = value.as_py()
                tf = counts([own])[0] if has_letter(own) else np.zeros(DIMENSIONS, np.float32)
                at = np.flatnonzero(tf)
                out.append(base64.b64encode(at.astype("<u2").tobytes() + tf[at].astype("<f4").tobytes()).decode())
            yield pa.array(out, pa.string())

    most = F.create_map(*(F.lit(x) for k in languages for x in (k, min(per_language, -(-seen[k] // 2)))))
    drawn = known.withColumn("_draw", draw)
    picked = drawn.where(F.col("_draw") < F.element_at(share, F.col("_lang"))).select("_lang", "_id", "_draw", sparse("_text").alias("tf"))
    picked = picked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.element_at(most, F.col("_lang"))).orderBy("_lang", "_rank").select("_lang", "_draw", "tf").collect()
    by: dict[str, list[np.ndarray]] = {}
    last: dict[str, float] = {}
    for row in picked:
        data = base64.b64decode(row.tf)
        m = len(data) // 6
        last[row._lang] = row._draw
        if m:
            tf = np.zeros(DIMENSIONS, np.float32)
            tf[np.frombuffer(data, "<u2", m)] = np.frombuffer(data, "<f4", m, 2 * m)
            by.setdefault(row._lang, []).append(tf)
    languages = [k for k in languages if k in by]
    centroids, owner = [], []
    for k, language in enumerate(languages):
        centres = _clusters(unit(np.log1p(np.stack(by[language])) * idf), clusters, seed=k)
        centroids.append(centres)
        owner += [k] * len(centres)
    model = Model(languages, idf, np.vstack(centroids).astype(np.float32), np.array(owner), np.zeros((len(languages), LENGTHS)))

    @F.arrow_udf("array<struct<bin:int,close:double>>")
    def measured(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, names in columns:
            rows = []
            for value, name in zip(texts, names.to_pylist(), strict=True):
                tf = counts([x for x in excerpts(value.as_py()) if has_letter(x)])
                rows.append([{"bin": int(b), "close": float(c)} for b, c in zip(length_bin(tf), model.closeness(tf, name), strict=True)] if len(tf) else [])
            yield pa.array(rows, pa.list_(pa.struct([("bin", pa.int32()), ("close", pa.float64())])))

    start, end = (F.create_map(*(F.lit(x) for k in languages for x in (k, last[k] + wide / seen[k]))) for wide in (0.0, 1.3 * per_language))
    held = drawn.where(F.col("_lang").isin(languages) & (F.col("_draw") > F.element_at(start, F.col("_lang"))) & (F.col("_draw") <= F.element_at(end, F.col("_lang"))))
    lengths_ = held.select("_lang", F.explode(measured("_text", "_lang")).alias("m")).groupBy("_lang", "m.bin").agg(F.percentile("m.close", F.lit(0.01)).alias("close"), F.count("*").alias("n")).where(F.col("n") >= least)
    for row in lengths_.collect():  # a row for each language and length
        model.radius[languages.index(row._lang), row.bin] = slack * row.close
    model.radius = np.maximum.accumulate(model.radius, axis=1)
    return model


def excerpts(text: str) -> list[str]:
    """The whole text, and 1, 2, 4, ... words from its middle."""
    own, out, n = text.split(), [text], 1
    while n < len(own):
        at = (len(own) - n) // 2
        out.append(" ".join(own[at : at + n]))
        n *= 2
    return out


def _predictor(model: Model | None):
    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names, scores, refused = ["und"] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
            rows: list[int] = []
            texts: list[str] = []

            def flush() -> None:
                if rows:
                    got, score, far = model.predict(counts(texts))
                    for row, name in zip(rows, got, strict=True):
                        names[row] = name
                    scores[rows], refused[rows] = score, far
                rows.clear(), texts.clear()

            if model is not None:
                size = 0
                for row, n in enumerate(lengths(column)):
                    own = column[row].as_py()
                    if own and has_letter(own):
                        rows.append(row), texts.append(own)
                        size += n
                    if len(rows) >= 512 or size > 8_000_000:
                        flush()
                        size = 0
                flush()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())], names=["lang_pred", "score", "rejected"])
        release()

    return predicted


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred, score (cosine, 0 to 1) and rejected, from the text alone.

    A null text, and one without a letter, is `und` with score 0, and rejected; so is every text if
    there was nothing to learn from. Whole texts count, however long. Columns of df with the
    results' names are replaced. The model is a few hundred KB whatever the input.
    """
    prepare(df)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    of = fresh_name(df, "_predicted")
    return df.select(*kept, _predictor(model)(F.col(f"`{text}`").cast("string")).alias(of)).select(*kept, f"{of}.*")


def keep_identified(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of df that identify() does not reject, with df's columns as they are."""
    prepare(df)
    return df.where(~_predictor(model)(F.col(f"`{text}`").cast("string"))["rejected"])


def fold(id: str, k: int):
    """crc32 of the id as text, modulo k; a null id is like an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary")), F.lit(k))


def fold_of(value: object, k: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % k
