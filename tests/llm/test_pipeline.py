"""The pipeline, stage by stage against brute force, and its contract."""

import collections

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import langid
from tests.llm.test_operators import brute_language, brute_near, brute_passages, words


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir).cache()
        kept[name] = after
        if name != "pack":
            assert after.columns == columns
            docs = after
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    named = {r.doc_id for r in kept["language"].collect()}
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert named == {i for i, text in first.items() if any(map(str.isalpha, text)) and not brute_language(model, text)[2]}
    assert len(named) >= 0.97 * len(first)
    order = sorted(named)
    _, parts = brute_near([first[i] for i in order], 5)
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == {order[i] for i in set(parts)}
    cut = {r.doc_id: r.text for r in kept["repeated_passages"].collect()}
    for i, text in cut.items():  # what stays is in order, and only words go
        it = iter(words(first[i]))
        assert all(w in it for w in words(text))
    left = sorted(r.doc_id for r in kept["near_duplicates"].collect())
    gone = {i: len(words(first[i])) - len(words(cut.get(i))) for i in left}
    for i, exact in zip(left, brute_passages([first[i] for i in left], 50), strict=True):
        assert gone[i] >= len(exact)  # at least what an earlier document holds word for word
        if gone[i] and not exact:
            assert gone[i] >= 40
    times = collections.Counter(r.doc_id for r in kept["mix_sources"].collect())
    assert set(times) <= set(cut) and max(times.values()) <= 2
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(n * (len(t.encode(cut[i], add_special_tokens=False).ids) + 1) for i, n in times.items())
    assert kept["pack"].agg(F.sum("length")).first()[0] == want


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Words of nobody in particular.", "en", None, 3), (4, "Some words in English, and more of them.", "en", "a", 9), (4, "Some words in English, and more of them.", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    for name in ("_gone", "_rank", "_spans", "_span_id", "_text_hash", "_w", "_key", "_of", "_last", "_epochs", "_copy", "_text", "_score"):
        docs = docs.withColumn(name, F.lit(name))
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
        df.collect()


def test_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mix_sources", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None
