"""Every operator against a brute-force version, on the documents of the smallest scale and on edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import catalog, extract, langid, minhash, mixing, packing, passages, quality, scoring, tokens, vectors

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "The long road goes on, and on. " * 8000


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", None, 3),
        (4, LONG, "en", "a", len(LONG)),
        (5, LONG, "en", "b", len(LONG)),
        (6, "one", "xx", "b", 3),
        (6, "one", "xx", "b", 3),
        (None, "nobody's words", "en", "c", 1),
        (8, "123 456 !!", "en", "a", 1),
        (9, "naïve 漢字 <|endoftext|>   \x85 end", "fr", "é", 1),
    ]
    clash = "id bigint, score double, kept boolean, n_tokens string, text2 string"
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit(7).cast(x.split()[1]).alias(x.split()[0]) for x in clash.split(", ")))


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# 1


def brute_near(texts, k, percent=80):
    sets = [shingle_set(t, k) for t in texts]
    where = collections.defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in where[x])
        links += [(j, i) for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
        for x in s:
            where[x].append(i)
    return sets, components(len(sets), links)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, documents, k):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    sets, parts = brute_near(documents.text, k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=k).collect()}
    ids = documents.doc_id.tolist()
    assert got == {ids[i]: (len(sets[i]), ids[parts[i]], parts[i] == i) for i in range(len(ids))}


def test_near_duplicates_in_a_large_group(spark):
    """One text in hundreds of copies with few or many changes: links beyond the hub's must be found."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = []
    for i in range(300):
        copy = list(base if i % 3 else texts[i - 3].split() if i else base)
        for _ in range(rng.choice([0, 1, 2, 5, 9])):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [copy[at], rng.choice(vocabulary)]])
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    _, parts = brute_near(texts, 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), k=2).collect()}
    assert sum(got[i] != parts[i] for i in got) <= 3  # what no band brings together may be missed
    assert len(set(parts)) > 3


def test_near_duplicates_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, k=2).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert {x[0]: x[2] for x in got}[5] == 4 and (None, 1, None, True) in got and got.count((6, 1, 6, True)) == 2
    left = minhash.remove_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 3, 4, 6, 8, 9, None]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 100, 100))
    sets = [np.concatenate([both, one]), np.concatenate([both, two])]
    h = minhash.signatures(np.concatenate(sets), np.repeat([0, 1], 500), 2, 240)
    assert abs((h[0] == h[1]).mean() - 400 / 600) < 0.1
    small = minhash.signatures(both[:1], np.zeros(1, int), 1, 240)  # one element reaches every place
    assert (small != minhash._LATE).all() and sorted(small[0] >> np.uint64(48)) == list(range(240))


# 2


def test_extraction_of_the_pages(spark, sf_dir):
    import html
    import re

    for r in catalog.op2_extract(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        own = re.sub(r"<[^>]*$", "", article[1]) if article else ""
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", own))
        want = "\n\n".join(x for x in blocks if x)
        assert r.text == want and r.n_chars == len(want)
        for name in ("div", "section", "main", "td"):  # scores decide, not the element's name
            assert extract.main_text(r.html.replace("<article", f"<{name}").replace("</article", f"</{name}")) == want


PROSE = "Plain words, set down with care, that go on for a while, so that nobody takes them for a menu. "


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("just words", "just words"),
        ("<p>a&amp;b &copy &#x41;&#66;", "a&b © AB"),
        (f"<body><div id=nav><ul><li><a href=1>x</a><li><a href=2>y</a></ul></div><div class=content><h1>T</h1><p>{PROSE}<p>{PROSE}</div><div class='sidebar'><p>{PROSE}</p></div><div id=comments><p>{PROSE}</p></div>", f"T\n\n{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<main><article><section><p>{PROSE}</section><section><p>Short end.</section><form><p>{PROSE}</form></article><aside>{PROSE}</aside></main>", f"{PROSE.strip()}\n\nShort end."),
        (f"<div class='cookie-notice'><p>{PROSE * 3}</p></div><div><p>{PROSE}</p><script>if (a<b) document.write('<p>no</p>')</script><style>p{{}}</style></div>", PROSE.strip()),
        (f"<article><p>{PROSE}<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><!-- <p>no --><p>end", f"{PROSE.strip()}\n\none\n\ntwo\n\na b\n\nc\n\nend"),
        ("<article><p>cut off <b", "cut off"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<p data-x=it's>Hello, don't go away from here</p>", "Hello, don't go away from here"),
        ('<p title="x>One two three four five', "One two three four five"),
        (f"<p title='a>b' class = \"c\"\n>{PROSE}", PROSE.strip()),
        (f"<div class='search-results-analysis'><p>{PROSE}</div>", PROSE.strip()),
        (f"<nav><a>x</a></nav><div class='sidebar-less menu'><p>{PROSE}</div>", PROSE.strip()),
        (f"<div class=post><p>{PROSE}</p><div class=legal><p>{PROSE}</p><p>x</p></div></div>", f"{PROSE.strip()}\n\n{PROSE.strip()}\n\nx"),
        (f"<div><ul><li><a>m</a><li><a>n</a><li><a>o</a></ul><p>{PROSE}</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div>", f"{PROSE.strip()}\n\na\n\nb\n\nc"),
        (f"<article><header><div><h1>T</h1></div><p>by N</p></header><div><p>{PROSE}</p></div></article>", f"T\n\n{PROSE.strip()}"),
        (f"<main><article><p>{PROSE}<p>{PROSE}</article><article class='user comment'><p>{PROSE}</article></main>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<div class=ad>{PROSE}</div><article><h1>Short.</h1></article>", "Short."),
        (f"<form action=x><div class=nav><a href=/>Home</a></div><article><p>{PROSE}<p>{PROSE}</article><input></form>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<article><p>{PROSE}<p>{PROSE}</article><form><p>{PROSE}</p><input name=mail></form>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<article><p>{PROSE}<p class=share>{PROSE}<p class=share>Share this with your friends and with all of their friends on every network<p class=advert>{PROSE}</article>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<article><div class=header><h2>T</h2><p>A lead that says what follows.</div><p>{PROSE}</article>", f"T\n\nA lead that says what follows.\n\n{PROSE.strip()}"),
        (f"<article><header><h1>T</h1><p>A lead that says what follows.<p>by N<nav>a b c</nav></header><p>{PROSE}</article>", f"T\n\nA lead that says what follows.\n\n{PROSE.strip()}"),
        (f"<article><ul><li><a href=https://a.example/1>First source<li><a href='//b.example'>Second<li><a href=mailto:c>Third</ul><p>{PROSE}</article>", f"First source\n\nSecond\n\nThird\n\n{PROSE.strip()}"),
        (f"<article><ol><li><a href=#1>One<li><a href='#2'>Two<li><a href=\"#3\">Three</ol><p>{PROSE}</article>", f"One\n\nTwo\n\nThree\n\n{PROSE.strip()}"),
        (f"<article><ul><li><a href=/1>Home<li><a href='two.html'>News<li><a href='?p=3'>Sport</ul><p>{PROSE}</article>", PROSE.strip()),
    ],
)
def test_extraction(html, text):
    assert extract.main_text(html) == text


@pytest.mark.parametrize("seed", [1, 2])
def test_displaced_and_changed_passages(spark, seed):
    """Two documents hold the halves of a passage, a third the whole, a fourth the whole with five of its words
    changed: nearly every fourth is found, as without the halves every one is."""
    draw = random.Random(seed)
    some = lambda n: [f"w{draw.randrange(20_000)}" for _ in range(n)]
    docs, changed = [], []
    for _ in range(60):
        whole = some(60)
        other = list(whole)
        for i in draw.sample(range(60), 5):
            other[i] = some(1)[0]
        for own in (whole[:30], whole[30:], whole, other):
            docs.append((len(docs), " ".join(some(50) + own + some(50))))
        changed.append(len(docs) - 1)
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(found.intersection(changed)) >= 56 and not found.difference(changed, (i - 1 for i in changed))


def test_clashing_names_of_temporary_columns(spark, sf_dir):
    """Names that operators use inside are columns like others."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*", F.lit(1).alias("_measured"), F.lit(2).alias("_predicted"), F.lit("x").alias("_text")).limit(30)
    model = langid.train(df)
    for made in (quality.quality(df), langid.identify(df, model), langid.keep_identified(df, model), tokens.count_tokens(df, BPE)):
        assert {(r["_measured"], r["_predicted"], r["_text"]) for r in made.collect()} == {(1, 2, "x")}
    assert packing.pack(df, BPE).count() > 0


def test_broken_markup_takes_linear_time():
    import time

    start = time.perf_counter()
    for piece in ('<a b="c ', "<a b='c \" ", "<", "<!--", "<a b= = ", "</"):
        extract.main_text(piece * 100_000)
    assert time.perf_counter() - start < 10


def test_extraction_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (2, "", "old")], "page_id int, html string, text string")
    assert [tuple(r) for r in extract.extract(df).collect()] == [(1, None, "", 0), (2, "", "", 0), (2, "", "", 0)]
    assert extract.extract(df.limit(0)).count() == 0


# 3


def brute_quality(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    chars = sum(len(x.decode()) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(inside), failed


def brute_coverage(text, n):
    w = text.encode().split()
    seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j].decode()) for j in inside) / max(1, sum(len(x.decode()) for x in w))


def test_quality(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    for r in quality.quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
        assert np.allclose(r.coverage, [brute_coverage(texts[r.doc_id], n) for n in (2, 3, 5, 8, 10)])


def test_quality_of_odd_rows(spark, odd):
    rows = quality.quality(odd).collect()
    assert len(rows) == 10
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text)
    assert quality.quality(odd.limit(0)).count() == 0


def test_quality_keeps_the_good(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = catalog.op3_quality(spark, sf_dir).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    assert {r.quality: r.kept for r in got}.get(1) == 1.0


# 4


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_token_counts(spark, odd, documents):
    t = library()
    df = odd.select("doc_id", "text").unionAll(spark.createDataFrame(documents[["doc_id", "text"]]))
    for r in tokens.count_tokens(df, BPE, batch_bytes=3000).collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert tokens.count_tokens(odd, BPE).columns == [c for c in odd.columns if c != "n_tokens"] + ["n_bytes", "n_tokens", "over_limit"]
    assert tokens.count_tokens(odd.limit(0), BPE).count() == 0


def test_token_counts_of_a_sentencepiece_model(spark, odd):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r.n_tokens == len(m.encode(r.text or "")) for r in tokens.count_tokens(odd, PIECES).collect())


ALPHABETS = [
    ["a", "Be", " ", "  ", "\n", "'s", "é", "1", "!", "漢", "\t", "<|endoftext|>", " x", "'", "ll"],
    ["漢", "字", "。", "，", "！", "ж", "Я", " ", "\n", "1", "'", "s", "_", "x"],
    list(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff") + ["a", "1", "."],
]


def unicode_classes():
    """Characters of every category."""
    import sys
    import unicodedata

    by = collections.defaultdict(list)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000:
            by[unicodedata.category(chr(c))].append(chr(c))
    return by


@pytest.mark.parametrize("kind", [0, 1, 2, "classes"])
def test_pieces_give_the_library_s_ids(kind, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 12)
    monkeypatch.setattr(tokens, "MOST_PIECES", 500)
    t, rng, encoder, by = library(), random.Random(1), tokens.Encoder(BPE), unicode_classes()
    for _ in range(60):
        texts = [""]
        for _ in range(20):
            if kind == "classes":
                own = [rng.choice(by[rng.choice(sorted(by))]) if rng.random() < 0.6 else rng.choice([" ", " ", "a", "1", "\n"]) for _ in range(rng.randrange(60))]
            else:
                own = [rng.choice(ALPHABETS[kind]) for _ in range(rng.randrange(80))]
            texts.append("".join(own))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in encoder.encode(texts)] == want
        assert encoder.counts(texts) == [len(x) for x in want]


def test_long_texts_give_the_library_s_ids():
    t, encoder, rng = library(), tokens.Encoder(BPE), random.Random(3)
    for alphabet in ALPHABETS:
        text = "".join(rng.choices(alphabet, k=60_000))
        assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


# 5


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32))
    near = np.concatenate([base[:40] + 0.05 * rng.standard_normal((40, 32)), base[50] + 0.08 * rng.standard_normal((120, 32)), base[7:8]])
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [None] + [1.0] * 31), (904, [1.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(3))
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = np.argwhere(u @ u.T >= 0.95)
    links = [(a, b) for a, b in hit if a < b]
    parts, degree = components(len(x), links), collections.Counter(v for p in links for v in p)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    want = {i: (degree[i], parts[i], parts[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(900, 906)}
    assert got == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_counts_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (5, 3, 9, 9)] + [(1, [-2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()) == [(1, 0, 1), (3, 3, 3), (5, 3, 3), (9, 3, 3), (9, 3, 3)]


def test_near_vectors_with_two_vectors_under_an_id(spark):
    rows = [(1, [1.0, 2.0]), (2, [5.0, -1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e200, 2e200]), (None, [1.0, 2.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 4, 1, True)] + [(2, 4, 1, False)] * 3 + [(3, 4, 1, False), (None, 0, None, True)], key=str)


def test_rare_links_are_measured(spark, caplog):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 32))
    x[[5, 700, 1500]] = x[11] + 0.05 * rng.standard_normal((3, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    with caplog.at_level("INFO", logger=vectors.__name__):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).where("n_links > 0").collect()}
    assert got == dict.fromkeys((5, 11, 700, 1500), (3, 5))
    assert "recall 1.0000 of 12 links" in caplog.text
    with pytest.raises(RuntimeError, match="recall"):
        vectors.near_vectors(df, trees=1, leaf=2, k=1, rounds=1, most_rounds=1, queries=3000)


@pytest.mark.parametrize("full", [1.0, 0.4])
def test_blocks_count_like_one_matrix(spark, monkeypatch, full):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(2)
    x = np.array([1.0, 2, 3, 4]) + 0.5 * rng.standard_normal((70, 4))
    whole = rng.random(70) < full
    members = spark.createDataFrame([(i, i % 2, 1 + i % 3, bool(whole[i]), v.tolist()) for i, v in enumerate(x)], "id bigint, component bigint, copies bigint, full boolean, x array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & (np.arange(70)[:, None] % 2 == np.arange(70) % 2)
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in np.argwhere(near & ~whole[:, None] & ~whole[None, :]) if a < b]
    want = {i: n for i, n in enumerate((near @ (1 + np.arange(70) % 3)).tolist()) if n}
    got = {r.id: r.n for r in vectors.count_links(members, spark.createDataFrame(links, "u bigint, v bigint"), 0.95).collect() if r.n}
    assert got == want


@pytest.mark.parametrize("part", [4, 128])
def test_all_neighbours_of_a_vector_meet(spark, monkeypatch, part):
    monkeypatch.setattr(vectors, "BLOCK", part)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(41)], "id bigint, x array<double>")
    lists = spark.createDataFrame([(0, i, 0.9, i % 2) for i in range(1, 41)], "u bigint, v bigint, s double, since int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(r.u, r.v) for r in vectors.refine(df, lists, 50, 1).collect()}
        assert vectors.refine(df, lists, 50, 2).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found >= {(a, b) for a in range(1, 41) for b in range(1, 41) if a != b}


def test_saturated_lists_hide_no_other_cluster(spark):
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    rows = []
    for n, centre in enumerate((axes[0], 0.97 * axes[0] + math.sqrt(1 - 0.97**2) * axes[1])):
        for i in range(30):
            noise = axes[2:].T @ rng.standard_normal(62)
            rows.append((30 * n + i, (centre + 0.08 * noise / np.linalg.norm(noise)).tolist()))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(n) - 1, 0, i == 0) for i, n in enumerate((x @ x.T >= 0.95).sum(axis=1))}
    assert min(n for _, n, _, _ in want) >= 50
    assert {tuple(r) for r in vectors.near_vectors(df, queries=0).select("vec_id", "n_links", "component_id", "kept").collect()} == want


# 6


def brute_passages(texts, least=51):
    """Words of each text inside runs of `least` words that an earlier text holds."""
    seen, out = {}, []
    for t in texts:
        w = words(t)
        hit = set()
        grams = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        for i, g in enumerate(grams):
            if g in seen:
                hit |= set(range(i, i + least))
        for g in grams:
            seen[g] = 1
        out.append(hit)
    return out


def test_passages(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    covered = collections.defaultdict(set)
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    for r in passages.repeated_passages(df).collect():
        assert r.source_doc_id < r.doc_id and r.end_word - r.start_word >= 40
        assert r.n_matched >= 0.8 * max(r.end_word - r.start_word, r.source_end - r.source_start)
        own, source = (words(texts[i])[a:b] for i, a, b in ((r.doc_id, r.start_word, r.end_word), (r.source_doc_id, r.source_start, r.source_end)))
        assert passages.common(np.array([zlib.crc32(x) for x in own]), np.array([zlib.crc32(x) for x in source])) >= r.n_matched
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    exact = dict(zip(documents.doc_id, brute_passages(documents.text), strict=True))
    assert not {i: exact[i] - covered[i] for i in exact if exact[i] - covered[i]}


def test_fuzzy_passages_are_found_and_cut(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(90)
    rows, places = [(0, " ".join(fresh(40) + passage + fresh(30)))], {}
    for i in range(1, 30):
        copy = list(passage)
        for _ in range(i % 4 * 2):
            at = rng.randrange(5, 85)
            copy[at : at + 1] = rng.choice([fresh(1), [], fresh(1) + copy[at : at + 1]])
        before = fresh(rng.randrange(60))
        places[i] = (len(before), len(before) + len(copy))
        rows.append((i, " ".join(before + copy + fresh(20))))
    rows.append((30, " ".join(fresh(200))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit("x"))
    found = passages.repeated_passages(df)
    spans = collections.defaultdict(list)
    for r in found.collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    assert set(spans) == set(places)
    for i, (a, b) in places.items():
        assert min(s for s, _ in spans[i]) - a <= 4 and b - max(e for _, e in spans[i]) <= 4 and all(s >= a - 3 and e <= b + 3 for s, e in spans[i])
    left = {r.doc_id: r.text.split() for r in passages.remove_passages(df, found).collect()}
    assert left[0] == rows[0][1].split() and left[30] == rows[30][1].split()
    assert all(len(left[i]) <= len(rows[i][1].split()) - (b - a) + 8 for i, (a, b) in places.items())


def test_scattered_changes(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 300, 2):
        passage = fresh(50)
        copy = [fresh(1)[0] if n % 7 == 3 else w for n, w in enumerate(passage)]
        rows += [(i, " ".join(fresh(40) + passage + fresh(40))), (i + 1, " ".join(fresh(40) + copy + fresh(40)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, short = set(), 0
    for i in range(0, 300, 2):  # every chain aligned, none dropped before
        hub, own = (_own_seeds(rows[j][1]) for j in (i, i + 1))
        pairs = [(p, hub[h]) for h, p in own.items() if h in hub]
        blocks = [{n: x[n * 32 : n * 32 + 32] for n in range(-(-len(x) // 32))} for x in (passages.hashes(rows[j][1].encode()) for j in (i + 1, i))]
        for chain in passages.chains(passages.segments(*map(np.array, zip(*pairs, strict=True)), 5)) if pairs else []:
            got = [passages.extend(p[:5], p[5], 10**6, *blocks) for p in passages.align([n for p in chain for n in p], *blocks, 0.8)]
            got = [p for p in got if p[1] - p[0] >= 40 and p[4] >= 0.8 * max(p[1] - p[0], p[3] - p[2])]
            want |= {(i + 1, x, y) for x, y, *_ in got}
            short += bool(got) and chain[-1][1] - chain[0][0] < 16
    assert short >= 10 and want == {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(df).collect()}


def _own_seeds(text, k=5, every=6):
    """The place of each seed of a text whose words all differ."""
    h = passages.mix(passages.hashes(text.encode()))
    rolling = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        rolling = rolling * passages._GOLD + h[i : len(h) - k + 1 + i]
    rolling = passages.mix(rolling)
    return {int(rolling[p]): int(p) for p in passages.winnow(rolling, every)}


def _covered(spark, rows):
    out = collections.defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        out[r.doc_id, r.source_doc_id] |= set(range(r.start_word, r.end_word))
    return out


def test_no_passage_is_hidden_by_earlier_documents(spark):
    """Parts of a passage stand first in different documents: what holds it whole must be found."""
    rng = random.Random(11)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    whole = lambda *parts: " ".join(sum(parts, []))
    rows, want, i = [], {}, 0
    for cuts in ((30,), (20, 40), (15, 30, 45), (10, 20, 30, 40, 50), (25, 36)):  # 60 words, in parts
        passage = fresh(60)
        ends = (0, *cuts, 60)
        for a, b in zip(ends, ends[1:], strict=False):
            rows.append((i := i + 1, whole(fresh(20), passage[a:b], fresh(20))))
        rows += [(i + 1, whole(fresh(30), passage, fresh(10))), (i + 2, whole(fresh(7), passage, fresh(30)))]
        want[i + 2, i + 1] = set(range(7, 67))
        i += 2
    # A junction itself stands first in a document that is no source of the passage.
    lines = [fresh(20) for _ in range(3)]
    rows += [(i + 1 + n, whole(fresh(9), line, fresh(9))) for n, line in enumerate(lines)]
    rows += [(i + 4, whole(fresh(9), lines[0][8:], lines[1][:8], fresh(9))), (i + 5, whole(fresh(9), lines[1][8:], lines[2][:8], fresh(9)))]
    rows += [(i + 6, whole(fresh(12), *lines, fresh(9))), (i + 7, whole(fresh(5), *lines))]
    want[i + 7, i + 6] = set(range(5, 65))
    i += 7
    # The first 39 of 120 equal words stand in an earlier document too.
    passage = fresh(120)
    rows += [(i + 1, whole(fresh(9), passage[:39], fresh(9))), (i + 2, whole(fresh(50), passage)), (i + 3, whole(fresh(50), passage, fresh(3)))]
    want[i + 3, i + 2] = set(range(50, 170))
    got = _covered(spark, rows)
    assert {k: v - got[k] for k, v in want.items() if v - got[k]} == {}


def test_passages_against_all_pairs(spark):
    """Random texts of shared lines: every run of 50 equal words of two documents is covered."""
    rng = random.Random(12)
    lines = [[f"l{n}w{j}" for j in range(rng.randrange(8, 38))] for n in range(9)]
    texts = []
    for i in range(60):
        own = []
        for _ in range(rng.randrange(2, 9)):
            own += rng.choice(lines) if rng.random() < 0.8 else [f"d{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]
        texts.append(" ".join(own))
    covered = collections.defaultdict(set)
    for (i, _), spots in _covered(spark, list(enumerate(texts))).items():
        covered[i] |= spots
    exact = brute_passages(texts, 50)
    assert sum(map(len, exact)) > 500 and not [exact[i] - covered[i] for i in range(60) if exact[i] - covered[i]]


def test_passages_of_repeated_ids(spark):
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p = fresh(60)
    rows = [(1, p, "a"), (2, fresh(20) + " " + p, "b"), (2, fresh(400), "c"), (3, p, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _spans string").withColumn("_span_id", F.lit(1)).withColumn("_text_hash", F.lit(1))
    for order in (df, df.orderBy("_spans", ascending=False)):
        cut = passages.remove_passages(order, passages.repeated_passages(order))
        assert cut.columns == df.columns
        left = {r._spans: len(r.text.split()) for r in cut.collect()}
        assert left["a"] == 60 and left["d"] == 0 and left["c"] == 400 and left["b"] in (20, 80)


def test_signs_never_hide_what_reach_finds():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        a = rng.integers(0, 1 << 62, 24, np.uint64) << np.uint64(2)
        b = a[rng.integers(0, 4) :].copy()
        b[rng.random(len(b)) < rng.choice([0.1, 0.3, 0.5, 0.9])] = 7
        b = np.r_[rng.integers(0, 1 << 62, rng.integers(0, 3), np.uint64), b][:24]
        x, y, _ = passages.reach(a, b)
        near, far = passages.may_go_on(passages.signs(a)[:1], passages.signs(b)[:1])
        assert near[0] or not x
        assert far[0] or max(x, y) < passages.REACH - 3


def test_passages_of_odd_rows(spark, odd):
    found = passages.repeated_passages(odd)
    assert {(r.doc_id, r.source_doc_id) for r in found.collect()} == {(5, 4)}
    cut = passages.remove_passages(odd, found)
    assert cut.columns == odd.columns and cut.count() == 10
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[5].split() == [] and texts[4] == LONG and texts[1] is None and texts[3] == " \t\n"
    assert passages.repeated_passages(odd.limit(0)).count() == 0


def test_fenwick_and_chains():
    tree, rng, plain = passages.Fenwick(50), random.Random(0), {}
    for item in range(200):
        place, value = rng.randrange(50), rng.random()
        tree.put(place, value, item)
        plain[place] = max(plain.get(place, -1), value)
        k = rng.randrange(51)
        want = max((v for p, v in plain.items() if p < k), default=-1e18)
        assert tree.most(k)[0] == want
    assert passages.chains([(0, 10, 100), (12, 20, 112), (15, 30, 5)]) == [[(0, 10, 100), (12, 20, 112)], [(15, 30, 5)]]


# 7


def test_mixing(spark, documents, odd):
    own = documents.assign(source=["src%d" % (i % 7) if i % 11 else None for i in range(len(documents))])
    df = spark.createDataFrame(own.astype(object).where(own.notna(), None), SCHEMA)
    for cut in (False, True):
        rows = mixing.mix(df, cut=cut).collect()
        assert len(rows) == len(own)
        sizes = collections.defaultdict(int)
        for r in rows:
            sizes[r.source] += r.size
        names = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        left, pool, goal = set(names), 1.5 * sum(sizes.values()), {}
        while True:
            share = {s: pool * weight[s] / sum(weight[x] for x in left) for s in left}
            full = [s for s in left if share[s] > 2 * sizes[s]]
            if not full:
                break
            for s in full:
                goal[s] = 2.0 * sizes[s]
                pool -= goal[s]
                left.remove(s)
        goal |= share
        taken, longest = collections.defaultdict(int), collections.defaultdict(int)
        for r in rows:
            assert r.size == len(words(own.set_index("doc_id").text[r.doc_id])) and r.source_size == sizes[r.source]
            assert abs(r.target - goal[r.source]) < 1e-6 * (1 + r.target) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
            longest[r.source] = max(longest[r.source], r.size)
        assert all(abs(taken[s] - goal[s]) <= (1 if cut else longest[s] / 2 + 1) for s in names)
    key = lambda df: sorted((str(r.doc_id), r.taken) for r in df.collect())
    assert key(mixing.mix(df)) == key(mixing.mix(df.repartition(5)))
    assert mixing.mix(odd).count() == 10 and mixing.mix(odd.limit(0)).count() == 0
    blank = mixing.mix(odd.where("doc_id < 4")).collect()
    assert all((r.size, r.taken, r.target) == (0, 0, 0.0) for r in blank)


def test_mixed_repeats_whole_documents(spark, documents):
    df = spark.createDataFrame(documents)
    times = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix(df).collect() if r.size}
    got = collections.Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert all(got.get(i, 0) == n for i, n in times.items()) and mixing.mixed(df).columns == df.columns


def test_heavier_documents_are_drawn_more_often(spark):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c d").otherwise("a # # # # #").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(df, share=0.5).collect()
    drawn = collections.Counter(r.doc_id % 2 for r in rows if r.taken)
    assert drawn[0] > 1.25 * drawn[1] > 0


# 8


def test_scores(spark, documents, odd):
    import sentencepiece

    df = odd.select("doc_id", "text").unionAll(spark.createDataFrame(documents[["doc_id", "text"]]))
    learn = langid.fold("doc_id", 7) != 2
    rows = scoring.score(df, learn, PIECES, head=50).collect()
    texts = [(r.doc_id, r.text) for r in df.collect()]
    training = [t for i, t in texts if langid.fold_of(i, 7) != 2]
    c = collections.Counter(w for t in training for w in words(t))
    ends, n, v = len(training), sum(c.values()) + len(training), len(c) + 1
    want = []
    for i, t in texts:
        w = words(t)
        base = sum(math.log10(c[x] + 1) for x in w) + math.log10(ends + 1) - (len(w) + 1) * math.log10(n + v + 1)
        want.append((str(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 4)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    a, b = (sorted((str(r.doc_id), round(r.score, 6)) for r in scoring.score(df.repartition(k), learn, PIECES, head=h).collect()) for k, h in ((1, 5), (6, 100000)))
    assert a == b
    assert scoring.score(odd.limit(0), learn, PIECES).count() == 0
    assert sentencepiece.SentencePieceProcessor(model_file=PIECES).get_piece_size() == scoring.vocabulary(PIECES)[2]


def segmentations(word, log, spell):
    if not word:
        yield 0.0
    for k in range(1, len(word) + 1):
        x = log.get(word[:k])
        if x is None and k == 1:
            x = spell(word[0])
        if x is not None:
            for rest in segmentations(word[k:], log, spell):
                yield x + rest


def test_lattice_sums_all_segmentations():
    scores = scoring.first_scores(PIECES)
    normal, by_byte, size = scoring.vocabulary(PIECES)
    log = {x: float(scores[i]) for x, i in normal.items()}
    spell = lambda c: sum(float(scores[by_byte[b]]) for b in c.encode())
    own = ["the", "houses", "naïve", "ɮ漢x", "", "theation", "z" * 12]
    lattice = scoring.Lattice(PIECES, scores)
    want = [float(np.logaddexp.reduce(list(segmentations("▁" + w, log, spell)))) for w in own]
    assert np.allclose(lattice.marginals(own), want)
    assert np.isfinite(lattice.marginals(["q" * 5000]))
    counts, step = np.zeros(size), 1e-6
    lattice.expect(["houses"], np.ones(1), counts)
    for piece in ("▁house", "s", "▁h"):  # an expected count is the derivative of the log-probability
        moved = scores.copy()
        moved[normal[piece]] += step
        slope = (scoring.Lattice(PIECES, moved).marginals(["houses"]) - lattice.marginals(["houses"]))[0] / step
        assert abs(slope - counts[normal[piece]]) < 1e-3


# 9


def test_language(spark, sf_dir, odd):
    rows = catalog.op9_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (langid.fold_of(r.doc_id, 4) == 2) for r in rows)
    model = langid.train(odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)))
    got = {(r.doc_id, r.text): r.lang_pred for r in langid.identify(odd, model).collect()}
    assert got[(1, None)] == got[(2, "")] == got[(8, "123 456 !!")] == "und" and got[(6, "one")] in ("xx", "en", "fr")
    assert langid.train(odd.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3, 8}.isdisjoint(r.doc_id for r in kept.collect())


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. " * 3,
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 3,
    " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(200)),
    "".join(random.Random(5).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1200)),
]


def brute_language(model, text):
    """Language, cosine and rejection by plain loops over n-grams."""
    data = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode())
    tf = collections.Counter()
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            tf[((int.from_bytes(data[i : i + n], "big") + n) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    x = {g: math.log1p(k) * float(model.idf[g]) for g, k in tf.items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    close = [sum(v * float(c[g]) for g, v in x.items()) / length for c in model.centroids]
    best = max(range(len(close)), key=close.__getitem__)
    far = close[best] < model.radius[model.owner[best], int(math.log2(sum(tf.values())))]
    return model.languages[model.owner[best]], close[best], far, tf


def test_language_against_plain_loops(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text", "lang"]])
    model = langid.train(df)
    seen, n = collections.Counter(), 0
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        if not text or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        name, close, far, tf = brute_language(model, text)
        seen.update(tf.keys())
        n += 1
        assert got[i].lang_pred == name and abs(got[i].score - close) < 1e-4 and got[i].rejected == far
    assert np.allclose(model.idf, [math.log((1 + n) / (1 + seen[g])) + 0.1 for g in range(langid.DIMENSIONS)], atol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and (np.diff(model.radius, axis=1) >= 0).all()


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(langid.fold("doc_id", 4) != 2))
    rows = spark.createDataFrame(list(enumerate(FOREIGN)), "doc_id bigint, text string")
    assert [r.rejected for r in langid.identify(rows, model).orderBy("doc_id").collect()] == [True] * len(FOREIGN)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = langid.identify(docs.join(labels, "doc_id", "left_semi"), model)
    assert clean.where("rejected").count() <= 0.005 * clean.count()


# 10


def test_packing(spark, documents, odd):
    t = library()
    df = odd.select("doc_id", "text").unionAll(spark.createDataFrame(documents[["doc_id", "text"]]).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = packing.pack(df, BPE).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        own = sorted(by[r.doc_id], key=lambda p: p.start)
        if r.doc_id == 6:  # this row is there twice
            own = own[::2]
        assert [x for p in own for x in p.ids] == ids and [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert all(p.doc_tokens == len(ids) and p.offset == 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)
        assert all(p.length & (p.length - 1) == 0 and p.length <= 2048 for p in own)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    order = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert order == sorted(order, reverse=True)
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_decompose():
    assert packing.decompose(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert all(sum(packing.decompose(n, 64)) == n for n in range(300))
