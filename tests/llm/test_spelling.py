"""Spelling variants against brute force: all pairs of words by a plain edit test."""

import collections
import itertools
import re
import zlib

import pytest

from graphloom.llm import catalog, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(documents, slip=None):
    total = collections.Counter()
    for id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{id}:{run}".encode())
            if slip and id is not None and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def judged(words, pairs, ratio=5):
    around = collections.defaultdict(set)
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    form = {}
    for w, of in around.items():
        best = min(of, key=lambda x: (-words[x], x))
        if words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(around[w]), words.get(form.get(w))) for w, n in words.items()}


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query(spark, sf_dir):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = counted(documents, 199)
    # Pairs by the words without one letter or with a hole in its place: the same pairs as near() of all.
    holes = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
            holes[w].add(w)
    pairs = {(a, b) for of in holes.values() for a, b in itertools.combinations(of, 2) if near(a, b)}
    got = rows(catalog.QUERIES["op11_spelling"](spark, sf_dir))
    assert got == sorted(judged(words, pairs), key=str) and any(r[1] for r in got)


def test_small_alphabet(spark):
    """Runs of equal letters, letters of two bytes and of four, chains of forms, ties."""
    words = {"".join(x): 5 ** (k % 4) + k % 3 for k, x in enumerate(itertools.product("aé", repeat=6))}
    words |= {"aaaaaaa": 900, "aaaaaaaa": 5000, "éa" * 4: 7, "😀" * 6: 3, "😀" * 7: 15, "x": 1, "xy": 8}
    pairs = [(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)]
    got = rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got == sorted(judged(words, pairs), key=str)


def test_each_neighbour_once(spark):
    """Without a filter every distinct edit is emitted, each once."""
    import numpy as np

    source = spelling.Neighbours("abz", np.full(1, ~np.uint64(0)))
    for word in ("aabbab", "zzzzzz", "azbazb"):
        made = [x for _, x in source.of([word])]
        edits = {word[:i] + word[i + 1 :] for i in range(6)} | {word[:i] + c + word[i:] for i in range(7) for c in "abz"} | {word[:i] + c + word[i + 1 :] for i in range(6) for c in "abz"}
        assert len(made) == len(set(made)) and set(made) == edits - {word}


def test_full_filter_changes_nothing(spark, monkeypatch):
    words = spark.createDataFrame([("retain", 50), ("retein", 5), ("retains", 6), ("strain", 9)], "word string, n bigint")
    before = rows(spelling.variants(words))
    monkeypatch.setattr(spelling, "MOST_BITS", 64)
    monkeypatch.setattr(spelling, "HELD", 1)
    assert rows(spelling.variants(words)) == before and {r[1] for r in before} == {None, "retain"}


@pytest.mark.parametrize("slip", [None, 3])
def test_odd_texts(spark, slip):
    """Nulls, empty and very long texts, repeated rows, a null id, columns that clash."""
    long = "a" * 30_000
    data = [(1, None), (2, ""), (3, " \n"), (4, f"{long} Straße ÉTUDES×étude÷ 漢字word"), (None, "letters letters"), *[(5, f"Letters LETTERS, {long} words_letters9letters")] * 3, (6, f"{long} lettera {long}")]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id bigint, text string, word string, n int")
    words = counted(data, slip)
    assert dict(map(tuple, spelling.count_words(df, slip=slip).collect())) == words
    pairs = [(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)]
    assert rows(spelling.variants(spelling.count_words(df, slip=slip))) == sorted(judged(words, pairs), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(spelling.variants(spelling.count_words(df))) == []
