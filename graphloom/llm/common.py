"""What the corpus operators share: batches of bytes, 64-bit mixing and shared storage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most, by a count; with more, the same join shuffles.
MOST_BROADCAST = 2_000_000
#: Bytes of text that are turned into numpy arrays at a time.
CHUNK_BYTES = 1_000_000


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes; a longer text is a slice of its own."""
    at, size = 0, 0
    for i, n in enumerate(lengths(batch.column(column))):
        if size and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def lengths(column: pa.Array) -> list[int]:
    """Bytes of each value, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of bytes other than space and \\x09-\\x0D; bytes.split() cuts at exactly these."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 values that looks random (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def frugal(function):
    """The function over batches, which gives the memory that it used back to the system at its end:
    workers live on, and several of them share an executor's memory."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


#: Bytes of memory of its own up to which a worker has nothing to give back that is worth the time it takes.
SMALL = 96 << 20


def _resident() -> int:
    """Bytes of memory that this process holds without its mapped libraries; more than any bound where the system
    doesn't say."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared = map(int, f.read().split()[:3])
            return (resident - shared) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return 1 << 62


def release() -> None:
    """Gives unused memory back to the system, unless the worker holds little. What has lived through several
    collections is not looked at: modules are most of it, and most of a full collection's time."""
    if _resident() <= SMALL:
        return
    gc.collect(1)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, or with more underscores where df has such a column: temporary columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    temporary one, but only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Tables of this process that are still there: (session, path).
_WRITTEN: dict[str, SparkSession] = {}
#: Spark's setting that deletes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost
    executors, and is computed once however often it is read. Removed by discard(), at the latest when the
    process ends. The shuffles that made it are no longer needed: Spark deletes their files when the
    write is done, so that disk holds one step's, not all. df itself is not to be run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _WRITTEN[path] = spark
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing reads it any more."""
    _delete(df.stored_at)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:  # gone, or the session has ended: its owner clears the folder
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Py4JError, OSError):  # a gateway that has gone first
            _delete(path)


#: Bytes of an Arrow batch between Spark and Python: a batch is held several times over, on both sides.
BATCH_BYTES = 4 << 20


def prepare(df: DataFrame) -> DataFrame:
    """Lowers the session's limit of an Arrow batch to BATCH_BYTES, unless it is lower already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(key)) or 0) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys that are sent to every task at most because they are hot: so many can have more than this share of the rows.
HEAVY_KEYS = 200_000


def heavy_from(count: int, each: int = 64) -> int:
    """The number of rows beyond which a key of `count` rows is hot: fewer than HEAVY_KEYS keys are, whatever the input."""
    return max(each, -(-count // HEAVY_KEYS))


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], by: str, heavy: DataFrame, each: int = 64) -> DataFrame:
    """rows.join(other, keys) where a key may hold any share of `rows`. `heavy` has the hot keys and _n, their
    numbers of rows (fewer than HEAVY_KEYS keys: see heavy_from). Such a key's rows are dealt by `by` over
    parts of about `each` rows, and other's rows with it are copied to each part."""
    parts = F.broadcast(heavy.select(*keys, F.ceil(F.col("_n") / each).cast("int").alias("_parts")))
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
    left = rows.join(parts, keys, "left").withColumn("_salt", salt).drop("_parts")
    right = other.join(parts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
