"""Best-fit packing: round trips of whole documents, and plain best fit one piece after the other."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bestfit, catalog

BPE = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    model = Tokenizer.from_file(BPE)
    return [[*x.ids, 2] for x in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, documents, size):
    """Every id in exactly one piece, only longer documents cut, sequences gapless and not too long."""
    left = collections.Counter((id, tuple(x)) for (id, _), x in zip(documents, ids_of([t for _, t in documents]), strict=True))
    by_place = collections.defaultdict(list)
    for r in rows:
        by_place[r.sequence_id].append((r.offset, r.length))
    for of in by_place.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at <= size
    pieces = collections.Counter()
    for (id, ids), n in left.items():
        first = len(ids) % size or size
        stops = range(first, len(ids) + 1, size)
        for k, stop in enumerate(stops):
            start = max(0, stop - size)
            some = np.array(ids[start:stop], "<u4")
            pieces[id, k, start, len(some), zlib.crc32(some)] += n
    assert collections.Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    return len(by_place)


def plain(items, size):
    rooms = []
    for length, count in items:
        for _ in range(count):
            fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
            if fitting:
                rooms[min(fitting)[1]] -= length
            else:
                rooms.append(size - length)
    return rooms


def test_query(spark, sf_dir):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = catalog.QUERIES["op13_best_fit"](spark, sf_dir)
    rows = df.collect()
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    lengths = collections.Counter(r.length for r in rows)
    assert check(rows, documents, 1024) <= len(plain(sorted(lengths.items(), reverse=True), 1024))


def draws(k):
    draw = random.Random(k)
    size = draw.randint(1, 60)
    return draw, size, {draw.randint(1, size): draw.randint(1, 9) for _ in range(draw.randint(1, 12))}


def held(packing):
    out = collections.Counter()
    for kind, many in packing.items():
        for x in kind:
            out[x] += many
    return out


def test_best_fit_is_that_of_single_pieces():
    for k in range(200):
        draw, size, lengths = draws(k)
        items = list(lengths.items())
        draw.shuffle(items)
        packing = bestfit.best_fit({}, items, size)
        assert sorted(size - sum(kind) for kind, many in packing.items() for _ in range(many)) == sorted(plain(items, size))
        assert held(packing) == lengths and bestfit.least_bins(lengths, size) <= sum(packing.values())


def test_children_hold_every_piece_once():
    for k in range(100):
        draw, size, lengths = draws(k)
        a, b = (bestfit.best_fit({}, bestfit.shuffled(lengths, draw, 0.5), size) for _ in range(2))
        for child in (bestfit.crossover(a, b, lengths, size, draw), bestfit.mutate(a, size, draw)):
            assert held(child) == lengths and all(sum(kind) <= size for kind in child) and min(child.values()) > 0


def test_islands_do_better_than_best_fit(spark):
    """Lengths that best fit by descending length packs badly; migration and written epochs run."""
    draw = random.Random(5)
    lengths = collections.Counter(int(draw.gauss(341, 40)) for _ in range(2000))
    first = bestfit.best_fit({}, sorted(lengths.items(), reverse=True), 1024)
    found = bestfit.pack_lengths(spark, lengths, 1024, islands=3, generations=6)
    assert held(found) == lengths and sum(found.values()) < sum(first.values())
    assert found == bestfit.pack_lengths(spark, lengths, 1024, islands=3, generations=6)


def test_every_piece_has_a_place_of_its_own():
    packing = {(5, 3, 3): 4, (5, 5): 2, (3,): 7}
    rows = list(zip(*(x.tolist() for x in bestfit.places(packing)), strict=True))
    seen = set()
    total = held(packing)
    for i, (length, first, sequence, offset) in enumerate(rows):
        stop = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else total[length]
        for n in range(stop - first):
            for k in range(length):
                seen.add((sequence + n, offset + k))
    assert len(seen) == sum(x * n for x, n in total.items())


@pytest.mark.parametrize("size", [8, 1])
def test_odd_rows(spark, size):
    """Nulls, empty and very long texts, ties, repeated rows, special strings, clashing columns; ids as they were."""
    long = "the long road " * 3000
    documents = [(1, None), (2, ""), (3, " "), (None, "no one's"), *[(4, "one two three")] * 5, (5, long if size > 1 else "short one"), (6, "naïve 漢字 <|endoftext|>"), (7, "a b c d e f g")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in documents], "doc_id bigint, text string, length int, _place string, offset int")
    rows = bestfit.pack(df, BPE, size=size, islands=2, population=4, generations=2, epochs=2).collect()
    check(rows, documents, size)
    back = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        if r[0] in (5, 6):
            back[r[0]] += r.ids
    assert [back[5], back[6]] == ids_of([documents[9][1], documents[10][1]])


def test_empty(spark):
    assert bestfit.pack(spark.createDataFrame([], "doc_id bigint, text string"), BPE).collect() == []
