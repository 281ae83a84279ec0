"""Graph operators on small graphs whose answers are known."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, impact, paths


@pytest.fixture(scope="module")
def chain(spark):
    """main -> controller -> service -> db.connect."""
    rows = [("main", "handle", "CALLS"), ("handle", "process", "CALLS"), ("process", "connect", "CALLS")]
    return spark.createDataFrame(rows, "src string, dst string, type string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_impact_of_the_call_chain(spark, chain):
    target = spark.createDataFrame([("connect",)], "id string")
    assert ids(impact.direct_callers(chain, target)) == ["process"]
    assert [tuple(r) for r in impact.second_callers(chain, target).collect()] == [("handle", "process")]
    assert tuple(impact.impact(chain, target).first()) == (1, 1, 22.5)
    assert tuple(impact.impact(chain, target, "rename").first()) == (1, 1, 30.0)
    assert tuple(impact.impact(chain, spark.createDataFrame([("nobody",)], "id string")).first()) == (0, 0, 0.0)


def test_ripple_goes_one_hop_further(spark, chain):
    target = spark.createDataFrame([("connect",)], "id string")
    found = {r.id: r.distance for r in paths.ripple(chain, target, depth=1).collect()}
    assert found == {"process": 1, "handle": 2}
    assert paths.ripple_summary(chain, target, 3).first().severity == "medium"


def test_cycles_drop_self_loops_and_rotations(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    found = [(r.path, r.length) for r in paths.cycles(edges).collect()]
    assert found == [(["a", "b", "a"], 2), (["a", "b", "c", "a"], 3)]


def test_shortest_path(spark, chain):
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert tuple(paths.shortest_path(chain, one("main"), one("connect")).first()) == (["main", "handle", "process", "connect"], 3)
    assert tuple(paths.shortest_path(chain, one("main"), one("main")).first()) == (["main"], 0)
    assert paths.shortest_path(chain, one("connect"), one("main")).count() == 0


def test_importance(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r.id: r.score for r in paths.importance(nodes, edges).collect()} == {"a": 0.4, "b": 1.0, "c": 0.4}


def test_neighbors(spark, chain):
    assert ids(graph.neighbors(chain, "handle", "both")) == ["main", "process"]
    assert ids(graph.neighbors(chain, "unknown", "out")) == []
    with pytest.raises(ValueError):
        graph.neighbors(chain, "handle", "sideways")


def test_density_of_small_graphs(spark):
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([], "src string, dst string, type string")
    assert tuple(graph.stats(nodes, edges).first()) == (1, 0, 0.0)
    assert graph.stats(nodes.limit(0), edges).first().density == 0.0


def test_layers(spark):
    df = spark.createDataFrame([("api/models/x.py",), ("core/api/y.py",), ("tools/z.py",), ("q.py",)], "path string")
    found = {r.path: (r.layer, r.layers) for r in graph.tag_layers(df).collect()}
    assert found == {"api/models/x.py": ("DATA", ["API", "DATA"]), "core/api/y.py": ("API", ["API"]), "tools/z.py": ("CORE", ["CORE"]), "q.py": (None, [])}


def test_save_and_load(spark, chain, tmp_path):
    nodes = spark.createDataFrame([("main", ["Function"])], "id string, labels array<string>")
    graph.PropertyGraph(nodes, chain).save(str(tmp_path))
    again = graph.PropertyGraph.load(spark, str(tmp_path))
    assert again.edges.count() == 3 and ids(again.find_nodes("Function")) == ["main"]
    assert "PartitionFilters: [isnotnull(type" in again.find_edges(type="CALLS")._jdf.queryExecution().toString()


def test_suffix_and_prefix_joins(spark):
    wanted = spark.createDataFrame([("util",), ("a/b.h",)], "name string")
    files = spark.createDataFrame([("src/util.py",), ("src/util.h",), ("x/a/b.h",), ("nutil",)], "path string")
    assert sorted(map(tuple, impact.suffix_join(wanted, files).collect())) == [("a/b.h", "x/a/b.h"), ("util", "nutil"), ("util", "src/util.h"), ("util", "src/util.py")]
    names = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "name string")
    modules = spark.createDataFrame([("a", "a/__init__.py"), ("a.b", "a/b.py")], "module string, path string")
    assert sorted(map(tuple, impact.longest_prefix_join(names, modules).collect())) == [("a.b.c", "a.b", "a/b.py"), ("a.x", "a", "a/__init__.py"), ("z", None, None)]


def test_relative_imports(spark):
    df = spark.createDataFrame([("x", 0, "a.b"), ("x", 1, "a.b"), ("", 1, "a.b"), ("x", 2, "a.b"), ("x", 5, "a")], "m string, l int, p string")
    assert [r[0] for r in df.select(impact.relative_module(F.col("m"), F.col("l"), F.col("p"))).collect()] == ["x", "a.b.x", "a.b", "a.x", "x"]


def test_range_join_takes_the_first(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50), ("g", 5)], "file string, line int")
    ranges = spark.createDataFrame([("f", 1, 10, "outer"), ("f", 4, 6, "inner")], "file string, a int, b int, name string")
    found = impact.range_join(points, ranges, "file", "line", "a", "b", "name")
    assert sorted(map(tuple, found.collect())) == [("f", 5, "outer"), ("f", 50, "<global>"), ("g", 5, "<global>")]


def test_shortest_path_has_no_bound(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(3, 3), (9, 0)], "src bigint, dst bigint")
    one = lambda x: spark.createDataFrame([(x,)], "id bigint")
    assert paths.shortest_path(edges, one(0), one(9)).first().distance == 9
    assert paths.shortest_path(edges, one(0), one(77)).count() == 0


def test_cycles_end_where_the_limit_is_met(spark):
    edges = spark.createDataFrame([(a, b) for a in range(7) for b in range(7)], "src bigint, dst bigint")
    every = sorted(((r.length, r.path) for r in paths.cycles(edges, 2, 4, limit=None).collect()))
    for limit in (5, 21, 22, 40):
        assert [(r.length, r.path) for r in paths.cycles(edges, 2, 4, limit).collect()] == every[:limit]


def test_call_graph_stops_at_its_limit(spark):
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src bigint, dst bigint")
    start = spark.createDataFrame([(0,)], "id bigint")
    for limit in (1, 4, 6, 20, 1000):
        first = paths.bounded_paths(edges, start, 3).orderBy("hops", "path").limit(limit).collect()
        want = {}
        for r in first:
            for e in zip(r.path, r.path[1:], strict=False):
                want[e] = want.get(e, 0) + 1
        assert {(r.src, r.dst): r.n for r in paths.call_graph(edges, start, 3, limit).collect()} == want


def test_loose_tests(spark):
    sources = spark.createDataFrame([("a/util.py", 1), ("b/util_x.py", 2), ("c/other.py", 3), ("d/long_name_indeed.py", 4), ("e/.py", 5)], "path string, n int")
    tests = spark.createDataFrame([("t/test_util.py",), ("x",)], "path string")
    assert sorted(r.n for r in impact.loose_tests(sources, tests).collect()) == [2, 3, 4]
