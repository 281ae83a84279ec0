"""Sessions, projects and repositories as tables: life cycle, clearing, order of use, counts by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create_session(sessions: DataFrame, id: str, tags: tuple[str, ...] = (), **metadata: str) -> DataFrame:
    """sessions(id, tags, metadata) with a new one, unless there is one of that id."""
    row = [(id, list(tags), metadata)]
    new = sessions.sparkSession.createDataFrame(row, "id string, tags array<string>, metadata map<string,string>")
    return sessions.unionByName(new.join(sessions.select("id"), "id", "left_anti"), allowMissingColumns=True)


def delete_session(sessions: DataFrame, id: str) -> DataFrame:
    """sessions without that one; rows without an id stay."""
    return sessions.where(~F.col("id").eqNullSafe(id))


def switch_session(sessions: DataFrame, id: str) -> DataFrame:
    """sessions with `current`: true for that one only, false for all where no session has the id."""
    return sessions.withColumn("current", F.col("id").eqNullSafe(id))


def truncated(df: DataFrame) -> DataFrame:
    """df's columns without a row: what remains of nodes, edges or points once all are deleted."""
    return df.where(F.lit(False))


def clear_project(history: DataFrame, project: object, by: str = "project_id") -> DataFrame:
    """history without a project's rows; rows of no project stay."""
    return history.where(~F.col(by).eqNullSafe(F.lit(project)))


def last_used(visits: DataFrame, id: str, ts: str) -> DataFrame:
    """(id, last_used): each id's last time, the latest first, equal times by id; null times come last."""
    return visits.groupBy(id).agg(F.max(ts).alias("last_used")).orderBy(F.desc_nulls_last("last_used"), id)


def status_counts(df: DataFrame, status: str, known: tuple[str, ...]) -> DataFrame:
    """(status, n): a row for each known status, 0 where none has it; other statuses are left out."""
    every = df.sparkSession.createDataFrame([(x,) for x in known], "status string")
    n = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def most_complex(files: DataFrame, n: int = 10, by: Column | None = None) -> DataFrame:
    """The n files(path, highest) of the highest complexity, equal ones by path."""
    return files.orderBy((F.col("highest") if by is None else by).desc_nulls_last(), "path").limit(n)
