"""Event-time windows, exactly-once processing, retention and pairing on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, `files` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """(window_start, *by, n, total) of windows side by side; later events than `late` are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width, step), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    """(by, session_start, session_end, n): runs of events less than `gap` apart."""
    w = events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return w.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def once(events: DataFrame, id: str, ts: str, late: str = "7 days") -> DataFrame:
    """Every id once. On a stream the ids that are remembered go when the watermark passes them."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])
    return events.dropDuplicates([id])


def pair_runs(starts: DataFrame, ends: DataFrame, id: str, ts: str, within: str = "1 hour") -> DataFrame:
    """Starts with their ends: (id, started, ended, seconds). A stream-stream join whose state is
    bounded by the watermarks; a start without an end in time gives no row."""
    s = starts.withWatermark(ts, within).select(F.col(id), F.col(ts).alias("started"))
    e = ends.withWatermark(ts, within).select(F.col(id).alias("_id"), F.col(ts).alias("ended"))
    joined = s.join(e, (F.col(id) == F.col("_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {within}")))
    return joined.select(id, "started", "ended", (F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")).alias("seconds"))


def keep_newest(events: DataFrame, by: str, id: str, ts: str, limits: dict[str, int], default: int) -> DataFrame:
    """(by, dropped_id) for each event that pushes the oldest of its type out of a list of bounded
    length: retention with state. The state of a type is its list, never longer than its limit."""

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = limits.get(key[0], default)
        held = list(zip(*state.get, strict=True)) if state.exists else []
        gone: list = []
        for frame in frames:
            held += list(zip(frame[ts].astype("int64"), frame[id].astype("int64"), strict=True))
            held.sort()
            gone += held[: max(0, len(held) - limit)]
            held = held[max(0, len(held) - limit) :]
        state.update(([int(x[0]) for x in held], [int(x[1]) for x in held]))
        yield pd.DataFrame({by: [key[0]] * len(gone), "dropped_id": [int(x[1]) for x in gone]})

    return events.groupBy(by).applyInPandasWithState(push, f"{by} string, dropped_id bigint", "times array<bigint>, ids array<bigint>", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(events: DataFrame, path: str, apply: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str) -> StreamingQuery:
    """Applies each batch to the table at `path`, written as a new version; a batch that is repeated
    after a failure finds its version there and is left out, so each counts once."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = finished_versions(spark, path)
        if number in done:
            return
        before = spark.read.parquet(f"{path}/v{max(done)}") if done else None
        apply(batch, before).write.mode("overwrite").parquet(f"{path}/v{number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a table, by Hadoop's file system: any store that Spark reads will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at)]
    return [int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{max(finished_versions(spark, path))}")


def poll(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 seconds") -> StreamingQuery:
    """Hands a batch to the sink at a fixed interval, like a polling daemon; what was handed over is
    remembered in the checkpoint."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
