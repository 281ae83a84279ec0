"""Sessions, memories and names that stand for nodes, on small tables."""

from graphloom.operators import linking, memory, sessions

SESSIONS = "id string, tags array<string>, metadata map<string,string>"


def test_sessions_are_made_once_deleted_and_switched(spark):
    empty = spark.createDataFrame([], SESSIONS)
    made = sessions.create_session(sessions.create_session(empty, "a", ("x",), owner="me"), "a", ("y",))
    assert [(r.id, r.tags, r.metadata) for r in made.collect()] == [("a", ["x"], {"owner": "me"})]
    both = sessions.switch_session(sessions.create_session(made, "b"), "b")
    assert {r.id: r.current for r in both.collect()} == {"a": False, "b": True}
    assert [r.id for r in sessions.delete_session(both, "a").collect()] == ["b"]
    assert sessions.truncated(both).count() == 0 and sessions.truncated(both).columns == both.columns


def test_projects_cleared_and_ordered(spark):
    df = spark.createDataFrame([("p", 1), ("q", 5), (None, 2), ("p", 9)], "project_id string, ts int")
    assert sorted(r.ts for r in sessions.clear_project(df, "p").collect()) == [2, 5]
    assert [r.project_id for r in sessions.last_used(df, "project_id", "ts").collect()] == ["p", "q", None]
    assert {r.status: r.n for r in sessions.status_counts(df, "project_id", ("p", "z")).collect()} == {"p": 2, "z": 0}


def test_collections_and_memories(spark, tmp_path):
    path = str(tmp_path / "points")
    assert memory.ensure_collection(spark, path).count() == 0
    rows = [("a", [1.0, 0.0], {"type": "CODE_ELEMENT", "user_id": "u"}), ("b", [0.72, 0.7], {"type": "note", "user_id": "v"}), ("c", [0.0, 1.0], {"type": "note"}), ("d", [0.68, 0.74], {})]
    points = spark.createDataFrame(rows, memory.POINTS)
    points.write.mode("append").parquet(path)
    assert memory.ensure_collection(spark, path).count() == 4
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(memory.similar_code(points, [1.0, 0.0])) == ["a", "b"]
    assert ids(memory.memories(points, [1.0, 0.0])) == ["a", "b", "d"]
    assert ids(memory.memories(points, [1.0, 0.0], "note")) == ["b"]
    assert ids(memory.related_code(points, [1.0, 0.0])) == ["a"]
    assert ids(memory.search_user(points, "v", [1.0, 0.0])) == ["b"]
    assert sorted(ids(memory.forget_user(points, "u"))) == ["b", "c", "d"]
    assert memory.clear_collection(points).count() == 0


def test_callers_in_a_file(spark):
    functions = spark.createDataFrame([("f", "f::K::run"), ("f", "f::run"), ("f", "f::K::go"), ("f", "f::A::go"), ("g", "g::only")], "file_id string, id string")
    calls = spark.createDataFrame([(1, "f", "run"), (2, "f", "go"), (3, "f", "K.go"), (4, "f", "only"), (5, None, "run")], "call_id int, file_id string, caller string")
    assert {r.call_id: r.src for r in linking.callers(calls, functions).collect()} == {1: "f::run", 2: "f::A::go", 3: None, 4: None, 5: None}


def test_targets_by_the_end_of_their_id(spark):
    nodes = spark.createDataFrame([("b::run",), ("a::run",), ("a::runner",)], "id string")
    wanted = spark.createDataFrame([("run",), ("run",), ("walk",)], "name string")
    assert {r.name: r.id for r in linking.targets(wanted, nodes).collect()} == {"run": "a::run", "walk": None}


def test_facts_come_before_words(spark):
    nodes = spark.createDataFrame([("1", "load", ["Function"]), ("2", "save", ["Function"]), ("3", "Thing", ["Class"])], "id string, name string, labels array<string>")
    calls = spark.createDataFrame([("1", "2"), ("1", "3"), ("3", "2")], "src string, dst string")
    questions = spark.createDataFrame([(1, "who calls save?"), (2, "what is Thing?"), (3, "and so on")], "qid int, text string")
    triples = spark.createDataFrame([(1, "load", "CALLS", "save"), (3, "no", "calls", "none")], "qid int, subject string, predicate string, object string")
    got = {r.qid: (r.nodes, r.relationships, r.confidence) for r in linking.structural_by_facts(questions, triples, nodes, calls).collect()}
    assert got == {1: (2, 2, 0.85), 2: (1, 0, 0.5)}
