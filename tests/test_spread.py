"""Work is dealt to all cores, and names exploded out of files are joined by shuffles."""

from graphloom.functions.parsing import analysis_graph, parse_files
from graphloom.operators import fanout, resolution
from graphloom.plans import code_queries


def test_parts_are_many_tasks_before_they_are_texts(spark, sf_dir):
    many = fanout.PIECES_PER_CORE * spark.sparkContext.defaultParallelism
    assert code_queries.sources(spark, sf_dir).rdd.getNumPartitions() == many
    assert code_queries.modules(spark, sf_dir).rdd.getNumPartitions() == many


def test_linked_names_are_not_broadcast(spark):
    files = spark.createDataFrame([("a.py", "import b\ndef f(): b.g()\n"), ("b.py", "def g(): pass\n")], "path string, content string")
    found = resolution.call_graph(parse_files(files), "r")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r) for r in found.collect()] == [("r:a.py::f", "r:b.py::g", 1)]


def test_analysis_graph_parses_a_file_once_for_nodes_and_edges(spark):
    files = spark.createDataFrame([("a.py", "import os\nimport os\nclass A:\n    def f(self): pass\ndef g(): pass\n"), ("b.go", "package b\n")], "path string, content string")
    kept = []

    def keep(rows):
        kept.append(rows.localCheckpoint())
        return kept[0]

    nodes, edges = analysis_graph(parse_files(files), "r", keep)
    plan = nodes.select("id").unionAll(edges.select("dst"))._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 1 and "MapInArrow" not in plan and plan.count("Scan ExistingRDD") == 2
    assert sorted(r.id for r in nodes.collect()) == ["r:a.py", "r:a.py::A", "r:a.py::A::f", "r:a.py::g", "r:b.go"]
    assert sorted(map(tuple, edges.collect())) == [
        ("r:a.py", "os", "IMPORTS"),
        ("r:a.py", "r:a.py::A", "CONTAINS"),
        ("r:a.py", "r:a.py::g", "DEFINES_FUNCTION"),
        ("r:a.py::A", "r:a.py::A::f", "DEFINES_METHOD"),
    ]


def test_languages_are_found_after_the_parts_are_dealt(spark, sf_dir):
    plan = parse_files(code_queries.sources(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan.upper().split("EXCHANGE")[-1] and "CASE WHEN" not in plan.upper().split("EXCHANGE")[-1]


def test_files_without_a_parser_are_left_out(spark):
    files = spark.createDataFrame([("a.py", "x = 1\n"), ("b.txt", "y"), ("c.go", None), (None, "z")], "path string, content string")
    assert sorted(r.path for r in parse_files(files).collect()) == ["a.py", "c.go"]
