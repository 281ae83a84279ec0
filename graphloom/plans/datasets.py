"""The driver's tables as graphs, with the same views in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole schema. A node's second label is its kind (segment, status, brand)."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def node(df: DataFrame, kind: str, key: str, name: Column, label: str, prop: Column = none) -> DataFrame:
        return df.select(_id(kind, key).alias("id"), F.array(F.lit(label)).alias("labels"), name.cast("string").alias("name"), prop.alias("kind"))

    nodes = [
        node(t("region"), "region", "r_regionkey", F.col("r_name"), "Region"),
        node(t("nation"), "nation", "n_nationkey", F.col("n_name"), "Nation"),
        node(t("customer"), "customer", "c_custkey", F.col("c_name"), "Customer", F.col("c_mktsegment")),
        node(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), "Supplier"),
        node(t("part"), "part", "p_partkey", F.col("p_name"), "Part", F.col("p_brand")),
        node(t("orders"), "order", "o_orderkey", F.col("o_orderkey"), "Order", F.col("o_orderstatus")),
    ]

    def edge(df: DataFrame, a: Column, b: Column, kind: str) -> DataFrame:
        return df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))

    line = t("lineitem")
    edges = [
        edge(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "IN_REGION"),
        edge(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "IN_NATION"),
        edge(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "IN_NATION"),
        edge(t("orders"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), "ORDERED"),
        edge(line, _id("order", "l_orderkey"), _id("part", "l_partkey"), "CONTAINS"),
        edge(line.select("l_partkey", "l_suppkey").distinct(), _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "SUPPLIED_BY"),
    ]
    return reduce(DataFrame.unionAll, nodes), reduce(DataFrame.unionAll, edges)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between parts, (src, dst), repeats kept: the next part in the same order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    next_ = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return line.select(F.col("l_partkey").alias("src"), next_.alias("dst")).where("dst is not null and src <> dst")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): distinct calls with how often they occur."""
    return transitions(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: id, name, owner (brand: their file), klass, complexity (size), loc, documented."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner"), F.col("p_type").alias("klass"), F.col("p_size").alias("complexity"), F.col("p_size").alias("loc"), (F.col("p_retailprice") > 1000).alias("documented"))


def busiest(edges: DataFrame) -> DataFrame:
    """(id): the node that most edges reach, the smallest of several."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


#: The same in SQL, as common table expressions.
SQL_NODES = """nodes AS (
 SELECT 'region:' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL::VARCHAR AS kind FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, c_mktsegment FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, NULL FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, p_brand FROM part
 UNION ALL SELECT 'order:' || o_orderkey, 'Order', o_orderkey::VARCHAR, o_orderstatus FROM orders)"""
SQL_EDGES = """edges AS (
 SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' FROM supplier
 UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'ORDERED' FROM orders
 UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' FROM lineitem
 UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem)"""
SQL_CALLS = """steps AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS dst FROM lineitem),
 transitions AS (SELECT src, dst FROM steps WHERE dst IS NOT NULL AND src <> dst),
 calls AS (SELECT src, dst, count(*) AS n FROM transitions GROUP BY src, dst)"""
SQL_BUSIEST = "busiest AS (SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
