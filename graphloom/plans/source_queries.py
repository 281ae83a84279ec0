"""Queries on stored graphs, exported pages, plug-ins and models that fail."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import plugins
from graphloom.operators import vector
from graphloom.operators.stored import StoredGraph
from graphloom.plans.catalog import query
from graphloom.plans.datasets import SQL_EDGES, SQL_NODES, star, table
from graphloom.plans.storage import shared_folder
from graphloom.sources import forge


def _stored(spark: SparkSession, sf_dir: str) -> StoredGraph:
    own = uuid.uuid4().hex
    return StoredGraph.save(*star(spark, sf_dir), f"star_{own}", f"{shared_folder(spark)}/star-{own}")


@query(f"WITH {SQL_NODES}, {SQL_EDGES} SELECT 'node' AS what, id, label AS type FROM nodes WHERE id = 'part:5' UNION ALL SELECT 'in', src, type FROM edges WHERE dst = 'part:5' UNION ALL SELECT 'out', dst, type FROM edges WHERE src = 'part:5'")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node and its edges, each out of one bucket."""
    g = _stored(spark, sf_dir)
    found = g.node("part:5").select(F.lit("node").alias("what"), "id", F.col("labels")[0].alias("type"))
    return found.unionAll(g.edges("part:5", "in").select(F.lit("in"), "src", "type")).unionAll(g.edges("part:5", "out").select(F.lit("out"), "dst", "type"))


@query(f"WITH {SQL_NODES}, {SQL_EDGES} SELECT type, label, count(*) AS n, min(name) AS first FROM edges JOIN nodes ON src = id GROUP BY type, label")
def stored_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with their sources, joined bucket by bucket."""
    return _stored(spark, sf_dir).neighbors("out").groupBy("type", F.col("labels")[0].alias("label")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query(f"WITH {SQL_EDGES} SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst")
def stored_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).degrees("in")


@query(f"""WITH {SQL_NODES}, {SQL_EDGES} SELECT type, direction, x.id, name, label FROM
(SELECT type, CASE WHEN src = 'part:7' THEN 'OUT' ELSE 'IN' END AS direction, CASE WHEN src = 'part:7' THEN dst ELSE src END AS id FROM edges WHERE src = 'part:7' OR dst = 'part:7') x
JOIN nodes USING (id) ORDER BY type, direction, x.id LIMIT 20""")
def stored_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).neighborhood("part:7")


def _pages(spark: SparkSession, sf_dir: str) -> str:
    """Every conversation as an issue with a note for each turn, in pages as a forge exports them."""
    c = table(spark, sf_dir, "conversations")
    smile = F.transform(F.sequence(F.lit(1), F.col("turn") % 3), lambda i: F.struct(F.when(i == 1, "heart").otherwise("rocket").alias("name")))
    smile = F.when(F.col("turn") % 3 > 0, smile).otherwise(F.array().cast("array<struct<name:string>>"))
    note = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.struct(F.col("role").alias("username")).alias("author"), F.col("text").alias("body"), smile.alias("award_emoji"))
    issue = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    opened = F.when(F.col("conv_id") % 2 == 0, "opened").otherwise("closed")
    issue = issue.select(F.col("conv_id").alias("iid"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), opened.alias("state"), F.array(F.struct(F.concat(F.lit("u"), (F.col("conv_id") % 4).cast("string")).alias("username"))).alias("assignees"), "notes")
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    issue.select(F.to_json(F.struct("*")).alias("value")).repartition(8, "value").write.text(path)
    return path


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    forge.register(spark)
    return spark.read.format("forge").option("path", _pages(spark, sf_dir)).option("provider", "gitlab").load()


@query("SELECT 'gitlab' AS provider, conv_id AS number, conv_id * 1000 + turn AS id, role AS author, md5(text) AS digest FROM conversations")
def forge_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forge.comments(_items(spark, sf_dir)).select("provider", "number", "id", "author", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("SELECT DISTINCT conv_id AS number, 'Conversation ' || conv_id AS title, CASE WHEN conv_id % 2 = 0 THEN 'open' ELSE 'closed' END AS state FROM conversations WHERE conv_id % 4 = 1")
def forge_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forge.assigned_items(_items(spark, sf_dir), "u1").select("number", "title", "state")


@query("SELECT 'gitlab' AS provider, conv_id AS number, name, sum(n)::BIGINT AS n FROM (SELECT conv_id, 'heart' AS name, 1 AS n FROM conversations WHERE turn % 3 > 0 UNION ALL SELECT conv_id, 'rocket', 1 FROM conversations WHERE turn % 3 = 2) GROUP BY conv_id, name")
def forge_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forge.reaction_counts(_items(spark, sf_dir))


@query("SELECT 'd' || p_partkey || '.md' AS path, 1 AS line, 1 AS level, 'Part ' || p_partkey AS title FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'd' || p_partkey || '.md', 5, 3, p_brand FROM part WHERE p_partkey % 2 = 0")
def plugin_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of Markdown files by a plug-in; files of other endings are not sent to it."""
    key = F.col("p_partkey").cast("string")
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), key, F.when(F.col("p_partkey") % 2 == 0, ".md").otherwise(".txt")).alias("path"), F.concat(F.lit("# Part "), key, F.lit("\n```\n# no\n```\n### "), F.col("p_brand"), F.lit("\n#hash\n")).alias("content"))
    return plugins.BUILT_IN.scan(made, "headings").select("path", "line", "level", "title")


@query("SELECT 'd' || p_partkey AS path, 2 AS line, 'TODO' AS mark, p_name AS text FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'd' || p_partkey, 3, 'FIXME', '' FROM part")
def plugin_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by SQL: the columns of the table function are those of the plug-in that is named."""
    plugins.BUILT_IN.register(spark)
    todo = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("# TODO: "), F.col("p_name"))).otherwise("# done")
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("x = 1\n"), todo, F.lit("\n// FIXME\n")).alias("content"))
    made.createOrReplaceTempView("graphloom_marked")
    return spark.sql("SELECT f.path, p.line, p.mark, p.text FROM graphloom_marked f, LATERAL scan_with('todo', f.path, f.content) p")


def _refusing(texts: list[str]) -> np.ndarray:
    """A model that can't take texts that begin with T, nor any that are with them."""
    if any(t.startswith("T") for t in texts):
        raise ValueError("no")
    return np.array([[zlib.crc32(t.encode()) % 1000 + 1, len(t)] for t in texts], np.float32)


@query("SELECT doc_id, text LIKE 'T%' AS failed, text NOT LIKE 'T%' AND text <> '' AS embedded FROM documents")
def resilient_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a model that fails on whole batches: only the texts that it can't take stay without one."""
    embed = vector.resilient_embedder(_refusing, 2, batch=64, tries=1)
    found = table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("e"))
    return found.select("doc_id", "e.failed", (F.element_at("e.vector", 1) > 0).alias("embedded"))
