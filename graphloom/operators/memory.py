"""Memories and code kept as points: collections, searches with their thresholds, one user's memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import vector
from graphloom.operators.sessions import truncated

#: Least scores and the kind under which code elements are kept.
SIMILAR_CODE, MEMORY, CODE_ELEMENT = 0.7, 0.65, "CODE_ELEMENT"
POINTS = "id string, vector array<double>, payload map<string,string>"


def ensure_collection(spark: SparkSession, path: str, schema: str = POINTS) -> DataFrame:
    """The collection at path, created without a point where there is none; an existing one is kept."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear_collection(points: DataFrame) -> DataFrame:
    return truncated(points)


def similar_code(points: DataFrame, query: Sequence[float], limit: int = 5, session: str | None = None, key: str = "session_id") -> DataFrame:
    """The closest points of a score of SIMILAR_CODE at least, of one session if it is named."""
    return vector.search(points, query, limit, SIMILAR_CODE, None if session is None else vector.matches("payload", **{key: session}))


def memories(points: DataFrame, query: Sequence[float], kind: str | None = None, limit: int = 5, key: str = "type") -> DataFrame:
    """The closest memories of a score of MEMORY at least, of one kind if it is named."""
    return vector.search(points, query, limit, MEMORY, None if kind is None else vector.matches("payload", **{key: kind}))


def related_code(points: DataFrame, query: Sequence[float], limit: int = 3, key: str = "type") -> DataFrame:
    return memories(points, query, CODE_ELEMENT, limit, key)


def of_user(points: DataFrame, user: str, key: str = "user_id") -> DataFrame:
    """All of a user's memories."""
    return points.where(vector.matches("payload", **{key: user}))


def search_user(points: DataFrame, user: str, query: Sequence[float], limit: int = 5, key: str = "user_id") -> DataFrame:
    """The memories of one user that are closest to the query, whatever their score."""
    return vector.search(of_user(points, user, key), query, limit, None)


def forget_user(points: DataFrame, user: str, key: str = "user_id") -> DataFrame:
    """points without a user's; those of no user stay."""
    return vector.delete_where(points, **{key: user})
