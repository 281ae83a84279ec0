"""Mixing sources to target weights by Efraimidis-Spirakis sampling: complete epochs first,
then the documents with the smallest exponential keys -ln(u) / weight up to the rest of the
source's budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, fresh_name, materialize, prepare, raw


def _counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        texts = raw(column)
        symbols = [len(t) - len(t.translate(None, b"#*$%&|<>")) for t in texts]
        yield pa.StructArray.from_arrays([pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(symbols, pa.int64())], names=["size", "symbols"])


def count_words(text: Column) -> Column:
    """Words (runs without space and \\x09-\\x0D) and symbols of each text; none of null."""
    return F.arrow_udf(_counted, "struct<size:bigint,symbols:bigint>")(text)


def quality_weight(size: Column, symbols: Column, least: float = 0.25) -> Column:
    """Between `least` and 1: words against words and symbols."""
    return F.greatest(F.lit(least), F.coalesce(F.try_divide(size, size + symbols), F.lit(1.0)))


def sampling_key(weight: Column, seed: int, *identity: Column) -> Column:
    """-ln(u) / weight; u in (0, 1) comes from 52 bits of the MD5 of what identifies the row."""
    name = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in identity))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, epochs, rest): `share` of all sizes dealt by weight; a target
    stops at `most` times its source's size and the excess goes to the others by weight. The level
    at which the water stands follows from running sums over the sources ordered by capacity to
    weight: no loop."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    deal = F.array(*(F.lit(float(w)) for w in weights))
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(deal, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - before) / left)
    s = s.withColumn("level", F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"])
    s = s.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(F.col("level"), F.lit(float("inf")))))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    return s.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, cut: bool = False) -> DataFrame:
    """One row per row of df: id, size, source_size, target, taken, source, sampling_key, epochs.

    size: words of the text (null: 0). Sources in order of code point, null last, take `weights`
    in turn. taken = epochs * size, plus size for the documents picked for the rest: those with the
    smallest keys, as many as come nearest to it; with `cut`, of the document at the border only the
    words that the rest still has room for. Keys depend on id, size and seed alone, so
    reruns agree; rows that repeat have equal keys, and enough of them are taken to come near.
    Other columns of df are left out; an empty df gives an empty result.

    A source may hold any share of the rows: rows are dealt by ranges of (source, key) that Spark
    balances, sums of whole ranges are carried forward, and only then are rows summed in a range.
    """
    prepare(df)
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{source}`").cast("string").alias("source"), count_words(F.col(f"`{text}`").cast("string")).alias("w")).select("_id", "source", "w.*")
    rows = materialize(rows.select("_id", "source", "size", sampling_key(quality_weight(F.col("size"), F.col("symbols")), seed, F.col("_id"), F.col("size")).alias("sampling_key")), "sizes")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, "source", "sampling_key", "_id").withColumn("part", F.spark_partition_id()), "ranges")
    discard(rows)
    goals = targets(dealt, weights, share, most).withColumnRenamed("source", "_source")
    ranges = dealt.groupBy("source", "part").agg(F.sum("size").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("ahead", ahead).drop("held").join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = ranges.withColumnsRenamed({"source": "_source", "part": "_part"})
    out = dealt.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    inside = Window.partitionBy("source", "part").orderBy("sampling_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    if cut:
        more = F.least(F.col("size"), F.greatest(F.lit(0), F.round(F.col("rest") - prefix)))
    else:
        more = F.when(prefix + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(0)
    return out.select(F.col("_id").alias(id), "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("bigint").alias("taken"), "source", "sampling_key", F.col("epochs").cast("bigint").alias("epochs"))


def mixed(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **options) -> DataFrame:
    """df with every row as often as mix() takes it (0, 1, 2 times); columns are unchanged.

    Texts are not shuffled: a row is taken again if its key is at most the largest one picked in its
    source, a figure for each source. Rows with equal keys (repeated ones) are taken alike. Rows
    without a source are one source, a null text has no words, a null id is a value like others, and
    columns of df may have any names.
    """
    took = mix(df, id, text, source, seed=seed, **options)
    last = F.max(F.when(F.col("taken") > F.col("epochs") * F.col("size"), F.col("sampling_key")))
    of = materialize(took.groupBy(F.col("source").alias("_of")).agg(last.alias("_last"), F.max("epochs").alias("_epochs")), "borders")
    names = df.columns
    counted, key, of_, last_, epochs_, copy = (fresh_name(df, x) for x in ("_w", "_key", "_of", "_last", "_epochs", "_copy"))
    of = of.withColumnsRenamed({"_of": of_, "_last": last_, "_epochs": epochs_})
    keyed = df.withColumn(counted, count_words(F.col(f"`{text}`").cast("string")))
    size, symbols = F.col(counted)["size"], F.col(counted)["symbols"]
    keyed = keyed.withColumn(key, sampling_key(quality_weight(size, symbols), seed, F.col(f"`{id}`"), size))
    # A row for each source, so that side is small; Spark broadcasts it if its size allows.
    joined = keyed.join(of, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(of_)))
    times = F.col(epochs_) + F.when(F.coalesce(F.col(key) <= F.col(last_), F.lit(False)), 1).otherwise(0)
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("bigint"), times)).otherwise(F.array().cast("array<bigint>")))
    return joined.select(*(F.col(f"`{c}`") for c in names), copies.alias(copy)).drop(copy)
