"""Where iterative plans keep what they have computed."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Unset, a local session takes a temporary
    one; a cluster has to name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed and stored in the shared folder: the plan behind it is forgotten, and lost executors
    cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Tables of this process that written() made: (session, path).
_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df computed once and stored as Parquet in the shared folder, for plans that read it several times: each
    reading takes only the columns it names. Deleted when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_all() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is None:  # the session has ended: its owner clears the folder
            continue
        with contextlib.suppress(Py4JError, OSError):  # a gateway that has gone first
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
