"""Joins on names that very many rows share, against brute force; what they make is not shuffled again."""

import random

import pytest

from graphloom.functions.parsing import parse_files
from graphloom.operators import fanout, graph, writers


def top(df):
    """The operator at the top of the plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().split(None, 1)[0]


@pytest.mark.parametrize("piece_rows", [1, 7, 10_000])
def test_fan_out(spark, piece_rows):
    draw = random.Random(piece_rows)
    left = [(draw.choice("aaab") if i % 9 else None, i) for i in range(60)] + [("l", 99)]
    right = [(draw.choice("aaac") if i % 7 else None, i) for i in range(40)] + [("b", 41), ("b", 41)]
    want = sorted((k, x, y) for k, x in left for other, y in right if k == other and k is not None)
    found = fanout.fan_out(spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int"), "k", piece_rows)
    assert found.columns == ["k", "x", "y"] and sorted(map(tuple, found.collect())) == want


def test_a_heavy_key_is_many_tasks(spark):
    one = spark.range(300).selectExpr("if(id < 0, 'j', 'k') AS k", "id AS x")
    found = fanout.fan_out(one, one.withColumnRenamed("x", "y"), "k", 1000)
    sizes = [len(part) for part in found.rdd.glom().collect()]
    assert sum(sizes) == 90_000 and max(sizes) < 30_000


def test_call_edges_are_distinct_before_the_join(spark):
    draw = random.Random(3)
    functions = [(draw.randrange(3), draw.choice("abcd"), draw.randrange(12)) for _ in range(40)]
    calls = [(draw.randrange(3), draw.choice("abcd"), draw.choice("abcde")) for _ in range(30)] * 2
    want = sorted({(s, d) for f, caller, callee in calls for g, name, s in functions if (f, caller) == (g, name) for _, other, d in functions if other == callee})
    found = graph.call_edges(spark.createDataFrame(calls, "file_id int, caller string, callee string"), spark.createDataFrame(functions, "file_id int, name string, id int"))
    assert sorted(map(tuple, found.collect())) == want
    assert top(found) == "Union"


SOURCES = {
    "a/x.py": "import y\ndef f(): g(); h()\ndef g(): f(); f(); gone()\nclass K:\n    def h(self): self.g(); K()\n",
    "b/x.py": "import y\nimport b.y\ndef f(): g(); y()\ndef h(): h()\n",
    "b/y.py": "def y(): f(); h()\n",
}


@pytest.mark.parametrize("build", [lambda p: writers.named_graph(p, "r"), writers.module_graph])
def test_graphs_by_names_are_not_shuffled_again(spark, build):
    files = [*SOURCES.items(), *SOURCES.items()]
    found = build(parse_files(spark.createDataFrame(files, "path string, content string")))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(set(got)) and len([r for r in got if r[2] == "CALLS"]) > 10
    assert top(found) == "Union"


def written_rows(plan):
    """Rows that the shuffles of an executed plan have written, by the rows of each."""
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}
    name = plan.getClass().getSimpleName()
    if name in inner:
        return written_rows(getattr(plan, inner[name])())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
    return own + [n for i in range(plan.children().size()) for n in written_rows(plan.children().apply(i))]


def sides(spark, n):
    left = spark.range(n).selectExpr("if(id < 0, 'j', 'k') AS k", "concat('some/file', id, '.c::caller') AS x")
    return left, spark.range(n).selectExpr("if(id < 0, 'j', 'k') AS k", "concat('some/other/file', id, '.py::callee') AS y")


def test_sides_are_written_as_often_whatever_the_result(spark):
    most = []
    for n in (200, 800):
        found = fanout.fan_out(*sides(spark, n), "k", 10)
        assert len(found.collect()) == n * n
        most.append(max(written_rows(found._jdf.queryExecution().executedPlan())) / n)
    assert most[1] <= 1.2 * most[0] and most[1] <= fanout.tasks(found, fanout.JOIN_TASKS_PER_CORE) ** 0.5


def test_few_distinct_rows_of_the_right_come_in_turn(spark):
    parts = fanout.fan_out(*sides(spark, 600), "k").rdd.glom().collect()
    assert len({row for part in parts for row in part}) == 360_000
    assert max(len({row.y for row in part[:20_000]}) for part in parts) <= fanout.BLOCK[1]


def test_long_sides_are_dealt_even_if_the_result_is_small(spark, monkeypatch):
    monkeypatch.setattr(fanout, "SIDE_ROWS", 100)
    left, right = sides(spark, 1000)
    for a, b in ((left.where("x LIKE '%file7.c%'"), right), (left, right.where("y LIKE '%file7.py%'"))):
        found = fanout.fan_out(a, b, "k")
        sizes = [len(part) for part in found.rdd.glom().collect()]
        assert sum(sizes) == 1000 and max(sizes) < 600


def test_null_and_equal_rows(spark):
    rows = [("k", None), ("k", 1), ("k", 1), (None, 2), ("l", 3)]
    found = fanout.fan_out(spark.createDataFrame(rows, "k string, x int"), spark.createDataFrame(rows, "k string, y int"), "k", 1)
    want = [(k, x, y) for k, x in rows for other, y in rows if k is not None and k == other]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("build", [lambda p, keep: writers.named_graph(p, "r", keep), writers.module_graph])
def test_only_names_are_kept_of_parsed_files(spark, build):
    kept = []
    parsed = parse_files(spark.createDataFrame(list(SOURCES.items()), "path string, content string"))
    assert build(parsed, lambda rows: kept.append(rows) or rows).count() == build(parsed, lambda rows: rows).count()
    assert [rows.columns for rows in kept] == [["path", "functions", "classes", "imports", "calls"]]
    assert not any("start_line" in kind for _, kind in kept[0].dtypes)
