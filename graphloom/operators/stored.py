"""A property graph as bucketed, sorted tables: a look-up by id reads one bucket, and neighbours join their
nodes where they lie, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import _check

#: Rows of a bucket, about; and the most buckets of a table.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 4096


class Duplicates(ValueError):
    """Ids that a node table holds more than once, or null ones."""


def violations(nodes: DataFrame) -> DataFrame:
    """(id, n): ids that are null or not unique, with their number of rows."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1")


class StoredGraph:
    """Tables <name>_nodes by id, <name>_out by src and <name>_in by dst, each in the same number of buckets of
    the id's hash and sorted within. Ids are what is stored, so a filter on one prunes buckets and row groups."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def save(cls, nodes: DataFrame, edges: DataFrame, name: str, path: str, buckets: int | None = None) -> StoredGraph:
        """Stores nodes(id, labels, ...) and edges(src, dst, type, ...) under the folder `path` as tables `name`_*;
        tables of that name are replaced. Without `buckets` their number follows that of the edges, one for each core
        at least: a task sorts one bucket, so its memory is bounded. Ids must be there and unique: Duplicates names some that are not."""
        bad = violations(nodes).orderBy("id").limit(5).collect()
        if bad:
            raise Duplicates(", ".join(f"{r.id} ({r.n})" for r in bad))
        spark = nodes.sparkSession
        buckets = buckets or min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-edges.count() // BUCKET_ROWS)))
        for part, df, key, also in (("nodes", nodes, "id", []), ("out", edges, "src", ["type", "dst"]), ("in", edges, "dst", ["type", "src"])):
            table = f"{name}_{part}"
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            # One task a bucket, so that each bucket is one file and keeps its order.
            dealt = df.repartition(buckets, key)
            dealt.write.bucketBy(buckets, key).sortBy(key, *also).option("path", f"{path}/{part}").mode("overwrite").saveAsTable(table)
        return cls(spark, name)

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def node(self, id: str) -> DataFrame:
        """The node's row, out of one bucket."""
        return self.table("nodes").where(F.col("id") == id)

    def edges(self, id: str, direction: str = "out", type: str | None = None) -> DataFrame:
        """(src, dst, type, ...) that leave or reach a node, or both, out of one bucket each."""
        _check(direction)
        found = {d: self.table(d).where(F.col(key) == id) for d, key in (("out", "src"), ("in", "dst"))}
        df = found["out"].unionByName(found["in"]) if direction == "both" else found[direction]
        return df if type is None else df.where(F.col("type") == type)

    def neighbors(self, direction: str = "out") -> DataFrame:
        """Every edge with the node at its other end's opposite: for `out` the columns of the source, for `in`
        those of the target. Edges and nodes lie in the same buckets: no row is shuffled."""
        key = {"out": "src", "in": "dst"}[direction]
        return self.table(direction).join(self.table("nodes").withColumnRenamed("id", key), key)

    def degrees(self, direction: str = "out") -> DataFrame:
        """(id, n): edges that leave or reach each node that has some; counted within its bucket."""
        key = {"out": "src", "in": "dst"}[direction]
        return self.table(direction).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))

    def neighborhood(self, id: str, limit: int = 20) -> DataFrame:
        """(type, direction, id, name, label) around a node, the first `limit` in that order; the few neighbours
        found are looked up by a join that need not read other buckets' edges."""
        around = self.edges(id, "both").select("type", F.when(F.col("src") == id, "OUT").otherwise("IN").alias("direction"), F.when(F.col("src") == id, F.col("dst")).otherwise(F.col("src")).alias("id"))
        first = around.orderBy("type", "direction", "id").limit(limit)
        return first.join(self.table("nodes").select("id", "name", F.col("labels")[0].alias("label")), "id").select("type", "direction", "id", "name", "label").orderBy("type", "direction", "id")

    def drop(self) -> None:
        for part in ("nodes", "out", "in"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
