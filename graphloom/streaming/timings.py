"""How long batches take: the progress of streams, and timed actions, as rows of a metric table."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "name string, value double, labels map<string,string>, ts timestamp"


class Timings:
    """Metric rows (name, value, labels, ts) under a folder. Rows wait in the driver, `most` at the most, until
    they are written as one file of JSON lines by any store that Spark writes; close() writes the rest."""

    def __init__(self, spark: SparkSession, path: str, most: int = 1000):
        self.spark, self.path, self.most = spark, path, most
        self._rows: list[str] = []
        self._lock = threading.Lock()  # listeners run in a thread of their own

    def add(self, name: str, value: float, ts: float | None = None, **labels: str) -> None:
        row = {"name": name, "value": float(value), "labels": labels, "ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(ts or time.time())) + "Z"}
        with self._lock:
            self._rows.append(json.dumps(row))
            full = len(self._rows) >= self.most
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if not rows:
            return
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/part-{time.time_ns()}-{uuid.uuid4().hex}.json")
        out = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(at)
        try:
            out.write(bytearray(("\n".join(rows) + "\n").encode()))
        finally:
            out.close()

    close = flush

    @contextmanager
    def timed(self, name: str, **labels: str) -> Iterator[None]:
        """Times a block, also one that fails: its row then has the label `failed`."""
        start = time.perf_counter()
        try:
            yield
        except BaseException as e:
            labels["failed"] = type(e).__name__
            raise
        finally:
            self.add(name, time.perf_counter() - start, **labels)

    def table(self) -> DataFrame:
        """What was written so far, each row once."""
        return self.spark.read.schema(METRICS).json(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(METRICS).json(self.path)


class BatchTimings(StreamingQueryListener):
    """Feeds Timings with every batch of every stream: seconds of the whole and of each phase, rows in, rows
    a second, and rows of state, labelled with the query's name and the batch. Register it with
    spark.streams.addListener."""

    def __init__(self, timings: Timings):
        self.timings = timings

    def onQueryStarted(self, event) -> None:
        self.timings.add("stream.started", 1.0, query=event.name or str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        labels = {"query": p.name or str(p.id), "batch": str(p.batchId)}
        for phase, ms in p.durationMs.items():
            self.timings.add("batch.seconds" if phase == "triggerExecution" else f"batch.{phase}.seconds", ms / 1000, **labels)
        self.timings.add("batch.rows", p.numInputRows, **labels)
        if p.processedRowsPerSecond == p.processedRowsPerSecond:  # not NaN
            self.timings.add("batch.rows_per_second", p.processedRowsPerSecond, **labels)
        for k, state in enumerate(p.stateOperators):
            self.timings.add("batch.state_rows", state.numRowsTotal, operator=str(k), **labels)

    def onQueryIdle(self, event) -> None:
        self.timings.flush()

    def onQueryTerminated(self, event) -> None:
        self.timings.add("stream.failed" if event.exception else "stream.ended", 1.0, query=str(event.id))
        self.timings.flush()


def slow_batches(metrics: DataFrame, times: float = 2.0, last: int = 1000) -> DataFrame:
    """(query, batch, seconds, median): batches that took more than `times` the median of their query's last ones."""
    from graphloom.operators.history import metric_stats

    batches = metrics.where("name = 'batch.seconds'").select(F.col("labels")["query"].alias("query"), F.col("labels")["batch"].cast("bigint").alias("batch"), F.col("value").alias("seconds"))
    usual = metric_stats(batches, "query", "seconds", [F.desc("batch")], last).select("query", "median")
    return batches.join(usual, "query").where(F.col("seconds") > times * F.col("median"))
