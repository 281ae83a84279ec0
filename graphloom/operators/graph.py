"""Property graphs as two DataFrames: nodes(id, labels, props...) and edges(src, dst, type, ...)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.fanout import fan_out

DIRECTIONS = ("out", "in", "both")


def find_nodes(nodes: DataFrame, label: str | None = None, **props: object) -> DataFrame:
    """Nodes that carry the label and hold every given property; an empty label filters nothing."""
    keep = F.lit(True)
    if label:
        keep = keep & F.array_contains("labels", label)
    for name, value in props.items():
        keep = keep & (F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return nodes.where(keep)


def find_edges(edges: DataFrame, src: str | None = None, dst: str | None = None, type: str | None = None) -> DataFrame:
    """Edges by any of source, target and type."""
    keep = F.lit(True)
    for column, value in (("src", src), ("dst", dst), ("type", type)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    return edges.where(keep)


def get_node(nodes: DataFrame, id: str) -> DataFrame:
    return nodes.where(F.col("id") == id)


def find_by_name(nodes: DataFrame, name: str, paths: bool = False) -> DataFrame:
    """Nodes with that name; with `paths`, also those whose file path is the name or ends with it."""
    keep = F.col("name") == name
    if paths:
        keep = keep | (F.col("file_path") == name) | F.endswith("file_path", F.lit(name))
    return nodes.where(keep)


def fuzzy_search(nodes: DataFrame, keyword: str, labels: tuple[str, ...], limit: int = 5) -> DataFrame:
    """Nodes of the labels whose name contains the keyword in any case: id, name, type (first label).
    Ordered by id, so the limit is the same on every run."""
    kept = nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))) & F.contains(F.lower("name"), F.lit(keyword.lower())))
    return kept.select("id", F.coalesce("name", F.element_at(F.split("file_path", "/"), -1)).alias("name"), F.col("labels")[0].alias("type")).orderBy("id").limit(limit)


def edges_of(edges: DataFrame, id: str, direction: str = "out", type: str | None = None) -> DataFrame:
    """Edges that leave, reach, or touch a node."""
    _check(direction)
    keep = {"out": F.col("src") == id, "in": F.col("dst") == id, "both": (F.col("src") == id) | (F.col("dst") == id)}[direction]
    return edges.where(keep if type is None else keep & (F.col("type") == type))


def neighbors(edges: DataFrame, id: str, direction: str = "both") -> DataFrame:
    """Ids next to a node, with repeats; `both` lists a node once for each edge. Unknown: none."""
    _check(direction)
    into = edges.where(F.col("dst") == id).select(F.lit("in").alias("direction"), F.col("src").alias("id"))
    out = edges.where(F.col("src") == id).select(F.lit("out").alias("direction"), F.col("dst").alias("id"))
    return {"in": into, "out": out, "both": into.unionAll(out)}[direction]


def neighborhood(nodes: DataFrame, edges: DataFrame, id: str, limit: int = 20) -> DataFrame:
    """(type, direction, id, name, label) around a node, the first `limit` in that order."""
    around = edges_of(edges, id, "both").select("type", F.when(F.col("src") == id, "OUT").otherwise("IN").alias("direction"), F.when(F.col("src") == id, F.col("dst")).otherwise(F.col("src")).alias("id"))
    return around.join(nodes.select("id", "name", F.col("labels")[0].alias("label")), "id").select("type", "direction", "id", "name", "label").orderBy("type", "direction", "id").limit(limit)


def file_context(nodes: DataFrame, edges: DataFrame, file_id: str, imports: str = "IMPORTS", defines: str = "DEFINES", calls: str = "CALLS") -> DataFrame:
    """One row about a file: sorted arrays of what it imports, defines, and its symbols call."""
    imported = edges.where((F.col("src") == file_id) & (F.col("type") == imports)).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    defined = edges.where((F.col("src") == file_id) & (F.col("type") == defines)).select(F.col("dst").alias("symbol")).distinct()
    called = defined.join(edges.where(F.col("type") == calls), F.col("symbol") == F.col("src")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    return get_node(nodes, file_id).select("id").crossJoin(F.broadcast(imported)).crossJoin(F.broadcast(defined.agg(F.array_sort(F.collect_list("symbol")).alias("defines")))).crossJoin(F.broadcast(called))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density = m / (n (n - 1)), 0 for fewer than two nodes."""
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return n.crossJoin(m).withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / pairs).otherwise(0.0))


def label_counts(nodes: DataFrame, sets: bool = False) -> DataFrame:
    """Nodes of each label (a node with two labels counts for both), or of each set of labels."""
    label = F.array_join(F.array_sort("labels"), ",") if sets else F.explode("labels")
    return nodes.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def code_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, files, classes, functions and the sum of lines."""
    has = lambda x: F.count_if(F.array_contains("labels", x))
    return nodes.agg(F.count("*").alias("nodes"), has("File").alias("files"), has("Class").alias("classes"), has("Function").alias("functions"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc")).crossJoin(edges.agg(F.count("*").alias("edges")))


def degree(edges: DataFrame, type: str | None = None) -> DataFrame:
    """(id, degree): edges of either direction; a self-loop counts twice."""
    kept = edges if type is None else edges.where(F.col("type") == type)
    return kept.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, limit: int = 5) -> DataFrame:
    return degree(edges).orderBy(F.desc("degree"), "id").limit(limit)


def call_counts(nodes: DataFrame, edges: DataFrame, type: str = "CALLS") -> DataFrame:
    """(id, calls): incoming edges of the type, repeats counted, 0 where there are none."""
    into = edges.where(F.col("type") == type).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls"))
    return nodes.select("id").join(into, "id", "left").select("id", F.coalesce("calls", F.lit(0)).alias("calls"))


def out_degree_above(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], limit: int) -> DataFrame:
    """(id, n): nodes with more than `limit` edges of the types out: god classes, tight coupling."""
    n = edges.where(F.col("type").isin(*types)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return n.join(nodes.select("id"), "id")


def dead_nodes(nodes: DataFrame, edges: DataFrame, type: str = "CALLS", never: tuple[str, ...] = ("__init__", "__main__", "main"), public_only: bool = False) -> DataFrame:
    """Nodes that nothing calls, but for entry points by name, or only public ones."""
    called = edges.where(F.col("type") == type).select(F.col("dst").alias("id")).distinct()
    kept = nodes.where(F.col("is_public")) if public_only else nodes.where(~F.col("name").isin(*never))
    return kept.join(called, "id", "left_anti")


#: Words in a path that name a layer; data outranks api, core applies to the rest.
API_PARTS = ("api/", "server/", "cli/", "routes/")
API_END = "main.py"
DATA_PARTS = ("db/", "models/", "storage/", "schema/", "repository/")
CORE_PARTS = ("core/", "services/", "agents/", "tools/", "utils/")


def tag_layers(df: DataFrame, path: str = "path") -> DataFrame:
    """df with layer (DATA, API, CORE or null) and layers (all labels that apply)."""
    def any_of(parts: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for part in parts:
            found = found | F.contains(F.col(path), F.lit(part))
        return found

    api, data = any_of(API_PARTS) | F.endswith(F.col(path), F.lit(API_END)), any_of(DATA_PARTS)
    core = any_of(CORE_PARTS) & ~api & ~data
    layer = F.when(data, "DATA").when(api, "API").when(core, "CORE")
    return df.withColumn("layer", layer).withColumn("layers", F.array_compact(F.array(F.when(api, "API"), F.when(data, "DATA"), F.when(core, "CORE"))))


def upsert_nodes(nodes: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """The last change of each id wins; columns that a change leaves null keep their old value, and
    labels are replaced."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    old, new = nodes.alias("o"), last.alias("n")
    columns = [F.coalesce(F.col("o.id"), F.col("n.id")).alias("id")] + [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in last.columns else F.col(f"o.{c}") for c in nodes.columns if c != "id"]
    return old.join(new, F.col("o.id") == F.col("n.id"), "full").select(*columns)


def upsert_edges(edges: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("src", "dst"), order: str = "seq") -> DataFrame:
    """One edge for each key, the last written: (src, dst), or (src, type, dst) to keep types apart."""
    columns = edges.columns
    both = edges.withColumn("_o", F.lit(-1).cast("bigint")).unionByName(changes.withColumn("_o", F.col(order).cast("bigint")).select(*columns, "_o"))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_o"), *columns))).where("_n = 1").select(*columns)


def delete_node(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids and what touches them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def adjacency(edges: DataFrame, type: str) -> DataFrame:
    """(src, targets): the sorted set of each node's targets."""
    return edges.where(F.col("type") == type).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def render(df: DataFrame, line: Column, order: list[str], head: str) -> DataFrame:
    """One row, `text`: head and a line for each row, in order."""
    lines = df.select(F.struct(*order).alias("k"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("x"))
    return lines.select(F.concat_ws("\n", F.lit(head), F.transform("x", lambda r: r["line"])).alias("text"))


def mermaid_id(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("."), F.lit("_")), F.lit(" "), F.lit("_"))


def mermaid_graph(edges: DataFrame) -> DataFrame:
    """The edges as a Mermaid flow chart; labels are what follows the last `::`."""
    def node(c: str) -> Column:
        return F.concat(mermaid_id(F.replace(F.col(c), F.lit(":"), F.lit("_"))), F.lit('["'), F.substring_index(c, "::", -1), F.lit('"]'))

    once = edges.select("src", "dst").distinct()
    return render(once, F.concat(F.lit("    "), node("src"), F.lit(" --> "), node("dst")), ["src", "dst"], "graph TD")


def mermaid_classes(classes: DataFrame) -> DataFrame:
    """classes(name, bases, methods) as a Mermaid class diagram."""
    body = F.concat(F.lit("    class "), mermaid_id(F.col("name")), F.lit(" {\n"), F.array_join(F.transform(F.array_sort("methods"), lambda m: F.concat(F.lit("        +"), m, F.lit("()"))), "\n"), F.lit("\n    }"))
    bases = F.array_join(F.transform(F.array_sort("bases"), lambda b: F.concat(F.lit("\n    "), mermaid_id(b), F.lit(" <|-- "), mermaid_id(F.col("name")))), "")
    return render(classes, F.concat(body, bases), ["name"], "classDiagram")


def build_targets(targets: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and DEPENDS_ON edges of targets(name, files)."""
    id = F.concat(F.lit(f"{repo}:build:"), "name")
    nodes = targets.select(id.alias("id"), F.array(F.lit("BuildTarget")).alias("labels"), "name")
    return nodes, targets.select(id.alias("src"), F.explode("files").alias("f")).select("src", F.concat(F.lit(f"{repo}:"), "f").alias("dst"), F.lit("DEPENDS_ON").alias("type"))


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst): calls(file_id, caller, callee) between functions(file_id, name, id): the caller by its
    file and name, every function of the callee's name. Each edge once: both sides of the join on names are
    made distinct before it, so only edges to ids of several names can come twice and are compared."""
    a = functions.select("file_id", F.col("name").alias("caller"), F.col("id").alias("src"))
    said = calls.select("file_id", "caller", "callee").distinct().join(a, ["file_id", "caller"]).select("src", "callee").distinct()
    named = functions.select(F.col("name").alias("callee"), F.col("id").alias("dst")).distinct()
    several = named.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    once = fan_out(said, named.join(several, "dst", "left_anti"), "callee").select("src", "dst")
    return once.unionAll(fan_out(said, named.join(several, "dst", "left_semi"), "callee").select("src", "dst").distinct())


class PropertyGraph:
    """A thin handle on nodes and edges, for those who prefer methods."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def find_nodes(self, label: str | None = None, **props: object) -> DataFrame:
        return find_nodes(self.nodes, label, **props)

    def find_edges(self, **by: str) -> DataFrame:
        return find_edges(self.edges, **by)

    def neighbors(self, id: str, direction: str = "both") -> DataFrame:
        return neighbors(self.edges, id, direction)

    def stats(self) -> DataFrame:
        return stats(self.nodes, self.edges)

    def save(self, path: str, partition: Mapping[str, str] | None = None) -> None:
        """Both tables as Parquet; edges in one folder for each type, so reads of a type skip the rest."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy(*(partition or {"type": ""})).parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark, path: str) -> PropertyGraph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def _check(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
