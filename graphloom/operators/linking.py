"""Names that stand for nodes: callers in a file, targets by the end of their id, facts in a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, router
from graphloom.operators.impact import suffix_join

#: Fixed value: the edges of a global call graph.
GLOBAL_EDGES = 200


def callers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(file_id, caller, ...) with src, the function of the file that makes the call: `file::caller`,
    else one nested deeper whose id ends with `::caller`, as a method does; the least deep, then the
    smallest id. Null where there is none, as for a caller with a dot in it. functions(file_id, id)."""
    depth = F.size(F.split("id", "::"))
    own = functions.select("file_id", F.substring_index("id", "::", -1).alias("caller"), F.struct(depth.alias("depth"), "id").alias("f"))
    first = own.groupBy("file_id", "caller").agg(F.min("f").alias("_first"))
    return calls.join(first, ["file_id", "caller"], "left").select(*calls.columns, F.col("_first.id").alias("src"))


def targets(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id): of each name of wanted(name) the smallest id of nodes(id) that ends with it, null if
    none does. Ids are exploded into their ends of the names' lengths: a join of equality."""
    hit = suffix_join(wanted, nodes.select(F.col("id").alias("path")), ("",)).groupBy("name").agg(F.min("path").alias("id"))
    return wanted.select("name").distinct().join(hit, "name", "left")


def circular_issues(cycles: DataFrame) -> DataFrame:
    """(type, severity, description) of cycles(path) of more than two entries, the closing one counted:
    a node that only calls itself is no issue."""
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ")
    return cycles.where(F.size("path") > 2).select(F.lit("circular_dependency").alias("type"), F.lit("critical").alias("severity"), text.alias("description"))


def global_call_graph(edges: DataFrame, limit: int = GLOBAL_EDGES) -> DataFrame:
    """One row, `text`: the first edges by (src, dst) as a Mermaid flow chart."""
    return graph.mermaid_graph(edges.select("src", "dst").distinct().orderBy("src", "dst").limit(limit))


def structural_by_facts(questions: DataFrame, triples: DataFrame, nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(qid, nodes, relationships, confidence): what the graph knows of the subjects and objects of a
    question's triples(qid, subject, predicate, object), and the calls that the subjects make where the
    predicate speaks of calls. Questions whose triples name no node are answered by their words; those
    whose words name none either give no row. Each node counts once a question."""
    each = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    named = triples.select("qid", F.explode(F.array("subject", "object")).alias("name"))
    said = triples.where(F.contains(F.lower("predicate"), F.lit("call"))).select("qid", F.col("subject").alias("name"))
    hit = router.met(named, nodes, each).select("qid", "nodes")
    made = router.met(said, nodes, each).where("n > 0").select("qid", F.col("n").alias("relationships"))
    found = hit.join(made, "qid", "left").withColumn("relationships", F.coalesce("relationships", F.lit(0)))
    found = found.withColumn("confidence", F.when(F.col("relationships") > 0, router.WITH_RELATIONS).otherwise(router.WITHOUT_RELATIONS))
    rest = questions.join(hit.select("qid"), "qid", "left_anti")
    return found.unionByName(router.structural(rest, nodes, calls))
