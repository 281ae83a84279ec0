"""What a worker holds and gives back, and seeds and blocks of many texts at once."""

import os
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa

from graphloom.llm import common, passages, tokens


def test_mapped_libraries_are_not_a_workers_own_memory():
    with open("/proc/self/statm") as f:
        resident = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    assert common._resident() < resident


def test_a_pipelines_worker_remembers_fewer_pieces():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = tokens.Encoder(path, 50), [" ".join(f"w{n}x{i}" for i in range(20)) for n in range(20)]
    whole = tokens.Encoder(path).encode(texts)
    for text, ids in zip(texts, whole, strict=True):
        assert np.array_equal(own.encode([text])[0], ids) and len(own.number) <= 80


def test_seeds_of_texts_together_are_those_of_each():
    texts = [b"a b c d", b"a b c d e f g", b"", b"x " * 90, b" ".join(b"w%d" % (i * i % 23) for i in range(200))]
    together = passages._chosen(np.arange(5), texts, 5, 6, 40)
    alone = [passages._chosen(np.array([i]), [x], 5, 6, 40) for i, x in enumerate(texts)]
    assert [x is None for x in alone] == [True, False, True, False, False]
    as_rows = lambda found: sorted(zip(*(x.tolist() for x in found), strict=True))
    assert as_rows(together) == sorted(r for x in alone if x is not None for r in as_rows(x))


def test_codes_part_words_as_hashes_do():
    rng, odd = random.Random(0), [b"", b" \t\x0b\x0c\r\n", b"a\x00 a a\x00\x00 A\x00", b"\x1c\x1f \x85 \xc2\xa0x \x08 \x0e", b"x" * 70 + b" " + b"x" * 71 + b" " + b"X" * 70]
    long = [b" ".join(b"w" * rng.randrange(1, 140) for _ in range(300)), b"abcdefgh abcdefghi abcdefgh\x00 abcdefghabcdefgh abcdefghabcdefg"]
    texts = [*odd, *long, bytes(rng.randrange(256) for _ in range(20_000)), b"end"]
    code, size = passages.word_codes(texts)
    own = [w for t in texts for w in common.words(t)]
    assert size.tolist() == [len(common.words(t)) for t in texts] and len(code) == len(own)
    assert len(dict.fromkeys(own)) == len(set(code.tolist())) == len(set(zip(own, code.tolist(), strict=True)))
    assert passages.word_codes([])[0].tolist() == [] and passages.word_codes([b""])[1].tolist() == [0]


def test_blocks_are_each_texts_own_and_take_less_than_hashing_word_by_word():
    texts = [" ".join(f"w{i * n % 997}" for i in range(n)) for n in (0, 1, 31, 32, 33, 200)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    got = [r for b in passages._blocks(iter([batch, batch.slice(0, 1), batch.slice(0, 0)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = []
    for i, t in enumerate(texts):
        h = passages.word_codes([(t or "").encode()])[0].tobytes()
        want += [(i, n, h[n * 128 : n * 128 + 128]) for n in range(-(-len(h) // 128))]
    assert got == want
    large = [" ".join(f"word{i}" for i in range(5_000))] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(large)], names=["id", "text"])

    def least(f):
        def once():
            began = time.process_time()
            f()
            return time.process_time() - began

        return min(once() for _ in range(3))

    assert least(lambda: list(passages._blocks(iter([batch])))) < 0.7 * least(lambda: [passages.hashes(t.encode()) for t in large])


def test_only_texts_of_many_chains_are_dealt_out(spark):
    texts = spark.createDataFrame([(i, "a b c " * 40) for i in range(200)], "id bigint, text string")
    chain = "chain bigint, id bigint, hub bigint, parts array<bigint>, own_blocks array<bigint>, hub_blocks array<bigint>"
    for hub, dealt in ((lambda i: i - 1, False), (lambda i: 0, True)):
        found = spark.createDataFrame([(i, i, hub(i), [0, 5, 0], [0, 1], [0, 3]) for i in range(1, 200)], chain)
        out = passages._with_words(found, texts)
        assert ("_salt" in out._jdf.queryExecution().analyzed().toString()) == dealt
        rows = sorted((r.chain, r.role, r.block) for r in out.collect())
        assert rows == sorted((i, *x) for i in range(1, 200) for x in ((0, 0), (1, 0), (1, 1), (2, 0), (2, 3)))
