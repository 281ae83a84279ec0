"""History, vectors, questions and streams on small inputs."""

import time
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from graphloom.operators import history, quality, router, vector
from graphloom.sources import forge, state
from graphloom.streaming import streams


def test_point_ids_are_version_5_uuids(spark):
    names = ["a", "b.example.com", "é", ""]
    df = spark.createDataFrame([(x,) for x in names], "n string").select(vector.point_id(F.col("n")))
    assert [r[0] for r in df.collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in names]


def test_search(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0]), ("c", [-1.0, 0.0])], "id string, vector array<float>")
    found = vector.search(points, [1.0, 0.0], 5, 0.0).collect()
    assert [(r.id, round(r.score, 5)) for r in found] == [("a", 1.0), ("b", 0.6)]


def test_ladder_boundaries(spark):
    df = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (59.9,)], "s double")
    assert [r[0] for r in df.select(quality.health(F.col("s"))).collect()] == ["healthy", "warning", "warning", "critical"]


def test_score_of_nothing(spark):
    none = spark.createDataFrame([], "complexity int, documented boolean")
    one = quality.quality_score(none, none, none).first()
    assert (one.complexity_score, one.documentation_score, one.total_score) == (100.0, 100.0, 100.0)


def test_tasks(spark):
    rows = [("a", "COMPLETED", "low", []), ("b", "PENDING", "low", ["a"]), ("c", "PENDING", "critical", ["b"]), ("d", "PENDING", "high", []), ("e", "PENDING", "high", ["nobody"])]
    tasks = spark.createDataFrame(rows, "id string, status string, priority string, dependencies array<string>")
    assert sorted(r.id for r in history.runnable_tasks(tasks).collect()) == ["b", "d"]
    assert history.next_task(tasks).first().id == "d"


def test_skip_decisions(spark):
    projects = spark.createDataFrame([("p", True, "x"), ("q", True, "y"), ("r", False, None), ("s", True, None), ("t", True, "z")], "project_id string, is_git boolean, commit_hash string")
    past = spark.createDataFrame([("p", "x", 1), ("q", "y", 1), ("q", "old", 2)], "project_id string, commit_hash string, ts int")
    got = {r.project_id: r.decision for r in history.skip_decision(projects, past).collect()}
    assert got == {"p": "NO_CHANGES", "q": "NEW_COMMIT", "r": "NOT_GIT_REPO", "s": "NO_COMMIT", "t": "FIRST_TIME"}


def test_classification(spark):
    rows = [("where is it",), ("what calls this?",), ("calls history",), ("nothing here",), (None,)]
    got = [r.query_type for r in router.classify(spark.createDataFrame(rows, "text string")).collect()]
    assert got == ["semantic", "structural", "combined", "semantic", "semantic"]


def test_metadata(spark):
    s = spark.createDataFrame([("1", {"a": "x", "b": "y"}), ("2", {"a": "x"})], "id string, metadata map<string,string>")
    got = {r.id: r.metadata for r in history.update_metadata(s, "1", b="z", c="w").collect()}
    assert got == {"1": {"a": "x", "b": "z", "c": "w"}, "2": {"a": "x"}}


def events(spark, path):
    rows = [(i, datetime(2024, 1, 1, i // 60 % 24, i % 60), i % 3, ("view", "click")[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    df.repartition(3).write.parquet(path)
    return df


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams(spark, tmp_path):
    path = str(tmp_path / "events")
    batch = events(spark, path)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    run(streams.tumbling(streams.stream(spark, path, schema), "ts", "1 hour", ["event_type"], "value"), "tumbling", "complete")
    want = sorted(map(tuple, streams.tumbling(batch, "ts", "1 hour", ["event_type"], "value").collect()))
    assert sorted(map(tuple, spark.table("tumbling").collect())) == want
    run(streams.once(streams.stream(spark, path, schema), "event_id", "ts"), "once")
    assert spark.table("once").count() == 200
    run(streams.keep_newest(streams.stream(spark, path, schema, files=1), "event_type", "event_id", "ts", {"view": 10}, 20), "newest")
    gone = {r.event_type: r.n for r in spark.table("newest").groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert gone == {"view": 90, "click": 80}


def test_upsert_batches_count_once(spark, tmp_path):
    path, table, checkpoint = str(tmp_path / "events"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    events(spark, path)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"

    def add(batch, before):
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"))
        return new if before is None else before.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"))

    for _ in range(2):  # the second run finds nothing new
        streams.upsert_batches(streams.stream(spark, path, schema, files=1), table, add, checkpoint).awaitTermination(120)
        time.sleep(0.1)
    assert {r.user_id: r.n for r in streams.current(spark, table).collect()} == {0: 67, 1: 67, 2: 66}


def test_json_state_and_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "tags": ["x"],\n "metadata": {"k": "v"}}')
    (tmp_path / "b.json").write_text("no json")
    assert [(r.id, r.tags, r.name) for r in state.read_json(spark, str(tmp_path), state.SESSION).collect()] == [("1", ["x"], None)]
    for day, score in ((1, 50.0), (2, 60.0)):
        state.snapshot(spark.createDataFrame([(score,)], "score double"), str(tmp_path / "reports"), F.lit(datetime(2024, 1, day)))
    reports = spark.read.schema("score double, ts string").json(str(tmp_path / "reports"))
    assert [r.score for r in state.latest_snapshot(reports).collect()] == [60.0]
    state.append_log(spark.createDataFrame([(1, "found")], "ts int, text string"), str(tmp_path / "log"), "finding")
    assert spark.read.json(str(tmp_path / "log")).first().kind == "finding"


def test_git_relations(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    git("remote", "add", "origin", "https://github.com/x/y.git")
    (tmp_path / "b.py").write_text("y")
    forge.register(spark)
    read = lambda r: spark.read.format("git").option("path", str(tmp_path)).option("relation", r).load()
    assert [r.path for r in read("files").collect()] == ["a.py"]
    assert [(r.state, r.path) for r in forge.status(read("status")).collect()] == [("??", "b.py")]
    assert [(r.name, r.url, r.provider) for r in forge.remotes(read("remotes")).collect()] == [("origin", "https://github.com/x/y.git", "github")]
    assert read("ancestors").count() == 1 and read("branches").count() == 1
    log = spark.read.format("gitlog").option("path", str(tmp_path)).load()
    assert [r.path for r in forge.changed_files(log).collect()] == ["a.py"] and log.first().subject == "one"
