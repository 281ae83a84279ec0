"""Ranked search against the score of every document by plain counting."""

import collections
import math
import random
import re

import numpy as np
import pytest

from graphloom.llm import catalog, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(documents, items, k=10):
    found = [(id, collections.Counter(terms_of(text))) for id, text in documents]
    found = [(id, c, sum(c.values())) for id, c in found if c]
    many, whole = len(found), sum(n for _, _, n in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for id, c, n in found:
            m = 10 + 90 * n * many // whole
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, id is None, id or 0, id))
        out += [(item, rank, id, -score) for rank, (score, _, _, id) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, sf_dir):
    documents, items = (list(map(tuple, spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect())) for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(catalog.QUERIES["op12_search"](spark, sf_dir)) == brute(documents, items)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_random_corpora(spark, monkeypatch, block):
    """Few terms, so many ties; small blocks and shards; very frequent and single terms."""
    draw = random.Random(block)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choices(vocabulary, [1 / (i + 1) for i in range(30)], k=draw.randint(1, 12))) for _ in range(400)]
    documents = list(zip(draw.sample(range(1000), 400), texts, strict=True))
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 8)))) for i in range(20)] + [(20, " ".join(vocabulary))]
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SHARD_TERMS", 500)
    monkeypatch.setattr(search, "ITEMS_A_BLOCK", 6)
    index = search.build_index(spark.createDataFrame(documents, "doc_id bigint, text string").repartition(3))
    assert rows(search.search(index, spark.createDataFrame(items, "item_id bigint, text string"))) == brute(documents, items)


def test_blocks_are_skipped():
    """A common term's blocks stay compressed where the rare term's documents are better."""
    n = 64 * 200
    m = np.full(n, 100)
    data, taken = search.pack_numbers(np.stack([np.ones(n, np.int64), np.zeros(n, np.int64)], axis=1).ravel())
    blank = np.concatenate([[0], np.cumsum(taken)])[::2]
    starts = np.arange(0, n, 64)
    common = search.Postings(data.tobytes(), blank[starts], starts, starts + 63, np.full(200, search.impacts(np.array(1), np.array(100))), n, 1)
    few = np.arange(12) * 3 + 640
    coded, size = search.pack_numbers(np.stack([np.diff(few, prepend=few[0]), np.zeros(12, np.int64)], axis=1).ravel())
    rare = search.Postings(coded.tobytes(), np.array([0]), few[:1], few[-1:], np.array([search.impacts(np.array(1), np.array(100))]), 12, 50)
    found = search.best([common, rare], m, 10)
    assert [d for _, d in found] == few[:10].tolist() and common.open.sum() <= 8


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62, 5], np.int64)
    assert (search.unpack_numbers(search.pack_numbers(values)[0]) == values).all()


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and items, other kinds of ids, clashing columns."""
    long = "the long road " * 30_000
    documents = [("b", long), ("a", long), (None, "road"), (None, None), ("c", ""), ("d", " ,;"), *[("e", "naïve 漢字 ROAD")] * 3, ("f", "İstanbul road-road")]
    items = [("x", "Road, naïve"), ("x", "漢字"), (None, "long road"), ("y", None), ("z", "--"), ("nothing", "absent")]
    df = spark.createDataFrame([(*d, 1, "s") for d in documents], "doc_id string, text string, score int, term string")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, rank int")
    got = rows(search.search(search.build_index(df), asked))
    key = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6, None: None}
    back = {v: k for k, v in key.items()}
    assert got == sorted([(i, r, back[d], s) for i, r, d, s in brute([(key[d], t) for d, t in documents], items)], key=str)


@pytest.mark.parametrize("documents", [[], [(1, None), (2, "...")]])
def test_empty(spark, documents):
    index = search.build_index(spark.createDataFrame(documents, "doc_id bigint, text string"))
    assert rows(search.search(index, spark.createDataFrame([(1, "road")], "item_id bigint, text string"))) == []
    index = search.build_index(spark.createDataFrame([(1, "road")], "doc_id bigint, text string"))
    assert rows(search.search(index, spark.createDataFrame([], "item_id bigint, text string"))) == []
