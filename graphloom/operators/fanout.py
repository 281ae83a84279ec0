"""Equality joins whose result is far larger than their sides: a few keys that very many rows of both share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the result that a piece of a key has at least, pieces of the join for each core at most, about, and tasks of other work.
PIECE_ROWS, JOIN_TASKS_PER_CORE, TASKS_PER_CORE = 4_000_000, 128, 8

#: Rows of a side that a piece has at most, about: a join holds one side of a piece.
SIDE_ROWS = 250_000

#: Rows of the left and of the right that meet at once. The right ones are a multiple of 8, as columns are packed by 8.
BLOCK = 128, 256


def tasks(df: DataFrame, per_core: int = TASKS_PER_CORE) -> int:
    """A number of tasks that keeps every core of the session busy, whatever the size of the input in bytes."""
    return per_core * df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to many tasks by its keys: few bytes may be many rows, or much work a row."""
    return df.repartition(tasks(df), *keys)


def _heavy(left: DataFrame, right: DataFrame, key: str, piece_rows: int, pieces: int) -> DataFrame:
    """(key, _p, _q, _first): keys whose rows are dealt, the left ones into p parts and the right ones into q, and the
    number of the first of their p * q pieces. A piece has piece_rows rows, or more where these were more than `pieces`
    in all; its sides are of about one length, as then the fewest rows are written."""
    a, b = (df.groupBy(key).agg(F.count("*").cast("double").alias(n)) for df, n in ((left, "_a"), (right, "_b")))
    made, whole = F.col("_a") * F.col("_b"), Window.partitionBy()
    # A heavy key has more than the root of piece_rows rows on one side: there are few.
    few = a.join(b.hint("merge"), key).where((made > piece_rows) | (F.greatest("_a", "_b") > SIDE_ROWS))
    few = few.withColumn("_side", F.sqrt(F.greatest(F.lit(float(piece_rows)), F.sum(made).over(whole) / pieces)))
    few = few.withColumn("_p", F.ceil(F.col("_a") / SIDE_ROWS)).withColumn("_q", F.ceil(F.col("_b") / SIDE_ROWS))
    few = few.withColumn("_p", F.greatest("_p", F.round(F.least(F.col("_a") / F.col("_side"), made / F.col("_side") ** 2))))
    few = few.withColumn("_q", F.greatest("_q", F.ceil(made / F.col("_side") ** 2 / F.col("_p")))).where("_p * _q > 1")
    before = F.sum(F.col("_p") * F.col("_q")).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return few.select(key, F.col("_p").cast("int").alias("_p"), F.col("_q").cast("int").alias("_q"), F.coalesce(before, F.lit(0)).cast("bigint").alias("_first"))


def fan_out(left: DataFrame, right: DataFrame, key: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """left joined with right on `key`, null keys apart; no other column has a name on both sides.

    Where a key's rows of both sides make more than `piece_rows` together, both are dealt into parts, and each
    pair of parts is a piece with a task of its own. The number of pieces has a bound by the cores, not by the result: a side is
    written at most about as often as the root of that number, so what is shuffled grows as the sides do.
    Bytes of the sides tell nothing of the result, so the number of tasks is fixed. Each pair of rows is made once, and
    nothing is shuffled after the join.

    In a piece blocks of rows meet, not rows: the same few rows of the right come again and again before the next ones, and
    a file of the result holds few distinct values. Written by columns, it takes a small part of its rows.
    """
    n = tasks(left, JOIN_TASKS_PER_CORE)
    heavy = _heavy(left, right, key, piece_rows, n // 4)

    def dealt(df: DataFrame, rows: str, size: int, own: str, over: str, number: Callable[[Column, Column], Column]) -> DataFrame:
        values = [c for c in df.columns if c != key]
        parts = df.where(F.col(key).isNotNull()).join(F.broadcast(heavy), key, "left")
        mine = F.pmod(F.xxhash64(*df.columns), F.col(own))
        # Pieces have numbers below 0, so a task makes theirs first: many distinct values of light keys follow them in its file.
        pieces = F.transform(F.sequence(F.lit(0), F.col(over) - 1), lambda i: -1 - F.col("_first") - number(mine, i))
        light = F.array(F.pmod(F.xxhash64(key), F.lit(tasks(df)).cast("bigint")))
        put = parts.select(key, *values, F.explode(F.coalesce(pieces, light)).alias("_task")).repartition(n, "_task", key)
        place = F.row_number().over(Window.partitionBy("_task", key).orderBy(*values)) - 1
        return put.withColumn("_block", F.floor(place / size)).groupBy("_task", key, "_block").agg(F.collect_list(F.struct(*values)).alias(rows)).drop("_block")

    a = dealt(left, "_a", BLOCK[0], "_p", "_q", lambda mine, i: mine * F.col("_q") + i)
    b = dealt(right, "_b", BLOCK[1], "_q", "_p", lambda mine, i: i * F.col("_q") + mine)
    met = a.join(b.hint("merge"), ["_task", key])
    return met.select(key, "_b", F.inline("_a")).select(key, *[c for c in left.columns if c != key], F.inline("_b"))
