"""The corpus pipeline: STAGES applied to documents one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, minhash, mixing, packing, passages
from graphloom.llm.common import discard, materialize, read

#: Pieces of text that a worker remembers the ids of: the stages before have left an executor little memory.
REMEMBER = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language one of the learned ones can be: those that language identification
    rejects (null, without a letter, or too far from every centroid) go. Learns from docs."""
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that with
    the smallest id. Null and empty texts and rows with a null id stay; of rows that repeat an id one
    stays, by the hash of its text; an empty table stays empty, and columns may have any names."""
    return minhash.remove_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; a document that was nothing else, or
    never held a word, goes. Null texts and rows with a null id stay as they are; of rows that repeat an id
    only the text that stands for it is cut; an empty table stays empty, and columns may have any names."""
    cut = passages.remove_passages(docs, passages.repeated_passages(docs))
    return cut.where(F.col("text").isNull() | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, whole, as often as the mix of its source takes it. Rows without a source are one
    source; null texts have no words and cost nothing; repeated rows have equal keys and are taken alike;
    an empty table stays empty, and columns may have any names."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, none across documents. A null text is empty: its only token is the end;
    repeated rows and rows with a null id are packed each for itself; an empty table gives no sequence;
    other columns of docs are left out."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=REMEMBER)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before it kept; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if hasattr(before, "stored_at"):
            discard(before)
    return docs
