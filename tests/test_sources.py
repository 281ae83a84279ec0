"""Stored graphs, exported pages, histories, plug-ins, timings and models that fail."""

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.plugins import BUILT_IN, Plugin
from graphloom.operators import history, stored, vector
from graphloom.sources import forge
from graphloom.streaming import timings


@pytest.fixture(scope="module")
def stored_graph(spark, tmp_path_factory):
    nodes = spark.range(1000).select(F.concat(F.lit("n:"), "id").alias("id"), F.array(F.lit("N")).alias("labels"), (F.col("id") % 7).cast("string").alias("name"))
    edges = spark.range(4000).select(F.concat(F.lit("n:"), F.col("id") % 1000).alias("src"), F.concat(F.lit("n:"), (F.col("id") * 7) % 1000).alias("dst"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("type"))
    return nodes, edges, stored.StoredGraph.save(nodes, edges, "test_graph", str(tmp_path_factory.mktemp("graph")), buckets=16)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_read_one_bucket(spark, stored_graph, tmp_path):
    nodes, edges, g = stored_graph
    for df in (g.node("n:77"), g.edges("n:77"), g.edges("n:77", "in", "B")):
        assert "EqualTo" in plan(df) and "Exchange" not in plan(df)
    assert g.node("n:77").first().name == "0" and g.node("nobody").count() == 0
    want = edges.where("src = 'n:77'").count() + edges.where("dst = 'n:77'").count()
    assert g.edges("n:77", "both").count() == want
    # With all other buckets spoilt a look-up gives the same, and a read of the table fails.
    spoilt = stored.StoredGraph.save(nodes, edges, "spoilt_graph", str(tmp_path), buckets=4)
    own = spoilt.node("n:77").select(F.input_file_name()).first()[0].rsplit("/", 1)[1]
    for file in (tmp_path / "nodes").glob("*.parquet"):
        if file.name != own:
            file.write_bytes(b"x" * file.stat().st_size)
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert spoilt.node("n:77").first().name == "0"
    with pytest.raises(Exception, match="Parquet|parquet|magic"):
        spoilt.table("nodes").select("name").collect()


def test_neighbours_join_without_a_shuffle(spark, stored_graph):
    nodes, edges, g = stored_graph
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for direction, key in (("out", "src"), ("in", "dst")):
            df = g.neighbors(direction)
            assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
            assert sorted(map(tuple, df.select("src", "dst", "type", "name").collect())) == sorted(map(tuple, edges.join(nodes.withColumnRenamed("id", key), key).select("src", "dst", "type", "name").collect()))
        assert "Exchange" not in plan(g.degrees("out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.id: r.n for r in g.degrees("in").collect()} == {r.dst: r["count"] for r in edges.groupBy("dst").count().collect()}


def test_ids_must_be_there_and_unique(spark, tmp_path):
    nodes = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    assert {(r.id, r.n) for r in stored.violations(nodes).collect()} == {("a", 2), (None, 1)}
    with pytest.raises(stored.Duplicates, match="a \\(2\\)"):
        stored.StoredGraph.save(nodes, spark.createDataFrame([], "src string, dst string, type string"), "bad_graph", str(tmp_path))


GITHUB = {"id": 1, "number": 7, "title": "T", "body": "see @me", "state": "open", "html_url": "u", "user": {"login": "a"}, "labels": [{"name": "bug"}, {"name": "x"}], "assignees": [{"login": "me"}], "requested_reviewers": [{"login": "b"}], "head": {"ref": "f"}, "base": {"label": "o:main", "ref": "main"}, "created_at": "2024-01-02T03:04:05Z", "comments": 2, "comments_list": [{"id": 5, "user": {"login": "c"}, "body": "+1", "created_at": "2024-01-03T00:00:00Z", "reactions": [{"content": "heart"}, {"content": "heart"}]}]}
GITLAB = {"id": 2, "iid": 8, "title": "G", "description": None, "state": "opened", "web_url": "w", "author": {"username": "a"}, "labels": ["bug"], "assignees": [], "reviewers": [{"username": "me"}], "source_branch": "f", "target_branch": "main", "updated_at": "2024-01-02T03:04:05+01:00", "notes": [{"id": 6, "author": {"username": "d"}, "body": "n", "award_emoji": [{"name": "tada"}]}, {"id": 7}]}


def test_items_of_each_forge():
    one, two, three = (dict(zip([x.split()[0] for x in forge.ITEM.split(", ")], forge.item_row(i, p, "issues"), strict=True)) for i, p in ((GITHUB, "github"), (GITLAB, "gitlab"), ({"id": "3", "user": None, "labels": [None]}, "gitea")))
    assert (one["number"], one["labels"], one["assignees"], one["reviewers"], one["head"], one["base"]) == (7, ["bug", "x"], ["me"], ["b"], "f", "o:main")
    assert [(c[0], c[1], c[4]) for c in one["comments"]] == [(5, "c", [("heart", 2)])]
    assert (two["number"], two["state"], two["url"], two["body"], two["reviewers"], two["head"]) == (8, "open", "w", None, ["me"], "f")
    assert [(c[0], c[1], c[4]) for c in two["comments"]] == [(6, "d", [("tada", 1)]), (7, None, [])] and two["updated_at"].hour == 3
    assert (three["id"], three["author"], three["labels"], three["comments"], three["created_at"]) == (3, None, [], [], None)


def test_pages_are_read_once(spark, tmp_path):
    """A stream that is started again goes on after the last page; a batch reads all."""
    forge.register(spark)
    pages, checkpoint, out = tmp_path / "pages", str(tmp_path / "checkpoint"), str(tmp_path / "out")
    pages.mkdir()
    source = lambda reader: reader.format("forge").option("path", str(pages)).option("provider", "github").option("pages", "1").load()
    for k in range(3):
        for n in range(2):
            name = f"page-{2 * k + n:04d}.json"
            page = [GITHUB | {"id": 10 * (2 * k + n) + i} for i in range(3)]
            (pages / name).write_text(json.dumps({"items": page} if n else page))
        query = source(spark.readStream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
        query.processAllAvailable()
        query.stop()
        ids = [r.id for r in spark.read.parquet(out).collect()]
        assert sorted(ids) == sorted(10 * p + i for p in range(2 * k + 2) for i in range(3))
    found = source(spark.read)
    assert found.count() == 18 and found.rdd.getNumPartitions() == 6
    assert forge.reaction_counts(found).first().n == 36 // 1 and forge.comments(found).count() == 18
    with pytest.raises(Exception, match="provider must be"):
        spark.read.format("forge").option("path", str(pages)).option("provider", "x").load().count()


def test_histories_are_read_in_ranges(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(7):
        (tmp_path / f"f{k}.py").write_text(str(k))
        git("add", ".")
        git("commit", "-qm", f"number {k}")
    forge.register(spark)
    read = lambda **o: spark.read.format("gitlog").option("path", str(tmp_path)).options(**o).load()
    log = read(commits="3")
    assert log.rdd.getNumPartitions() == 3
    assert sorted((r.subject, r.files) for r in log.collect()) == [(f"number {k}", [f"f{k}.py"]) for k in range(7)]
    assert {r.subject for r in read(commits="2", max="5").collect()} == {f"number {k}" for k in range(2, 7)}
    assert sorted(r.path for r in forge.changed_files(read(since="HEAD~2")).collect()) == ["f5.py", "f6.py"] and read(since="HEAD").count() == 0


def test_plugins_have_schemas_of_their_own(spark):
    files = spark.createDataFrame([("a.md", "# A\n## B"), ("b.txt", "# no\nTODO: x"), ("c.MD", None), ("d.md", "bad")], "path string, content string")

    def words(path, text):
        if text == "bad":
            raise KeyError("bad")
        yield len(text.split()), path

    own = BUILT_IN.add(Plugin("words", "n int, of string", words, (".md",)))
    assert sorted((r.path, r.n, r.of, r.error) for r in own.scan(files, "words").collect()) == [("a.md", 4, "a.md", None), ("c.MD", 0, "c.MD", None), ("d.md", None, None, "KeyError: 'bad'")]
    own.register(spark, "scan_own")
    files.createOrReplaceTempView("plugin_files")
    found = spark.sql("SELECT f.path, p.* FROM plugin_files f, LATERAL scan_own('headings', f.path, f.content) p")
    assert found.columns == ["path", "line", "level", "title", "error"] and [(r.level, r.title) for r in found.orderBy("line").collect()] == [(1, "A"), (2, "B")]
    assert spark.sql("SELECT p.* FROM plugin_files f, LATERAL scan_own('todo', f.path, f.content) p").first().text == "x"
    with pytest.raises(Exception, match="no plug-in"):
        spark.sql("SELECT * FROM scan_own('nobody', 'a', 'b')")


def test_timings_of_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(10).repartition(4).write.parquet(str(tmp_path / "in" / "x"))
    kept = timings.Timings(spark, str(tmp_path / "metrics"), most=5)
    listener = timings.BatchTimings(kept)
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "x"))
        query = source.writeStream.format("noop").queryName("timed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        query.awaitTermination(120)
        with kept.timed("action", what="count"):
            spark.range(5).count()
        with pytest.raises(ValueError), kept.timed("action", what="none"):
            raise ValueError
        for _ in range(100):  # listeners run behind
            kept.flush()
            rows = kept.table().collect() if list((tmp_path / "metrics").glob("*.json")) else []
            if any(r.name in ("stream.ended", "stream.failed") for r in rows):
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    whole = [r for r in rows if r.name == "batch.seconds"]
    assert len(whole) == len({r.labels["batch"] for r in whole}) >= 4 and {r.labels["query"] for r in whole} == {"timed"}
    assert sum(r.value for r in rows if r.name == "batch.rows") == 10
    assert sorted((r.labels["what"], r.labels.get("failed")) for r in rows if r.name == "action") == [("count", None), ("none", "ValueError")]
    stats = {r.name: r.n for r in history.metric_stats(kept.table(), "name", "value", [F.desc("ts")]).collect()}
    assert stats["batch.seconds"] == len(whole)
    made = spark.createDataFrame([("batch.seconds", float(v), {"query": "q", "batch": str(i)}, None) for i, v in enumerate([1, 1, 1, 5])], timings.METRICS)
    assert [(r.batch, r.seconds) for r in timings.slow_batches(made).collect()] == [(3, 5.0)]


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_only_bad_texts_stay_without_a_vector(spark, batch):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        if any("nan" in t for t in texts):
            return np.full((len(texts), 2), np.nan)
        return np.array([[len(t), 1] for t in texts])

    rows = [(i, "bad" if i == 13 else "nan" if i == 40 else None if i == 5 else "" if i == 6 else "x" * (i + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r.id: (list(r.e.vector), r.e.failed) for r in df.select("id", vector.resilient_embedder(model, 2, batch, tries=2)("text").alias("e")).collect()}
    assert got == {i: ([0.0, 0.0], i in (13, 40)) if not t or t in ("bad", "nan") else ([len(t), 1.0], False) for i, t in rows}
    assert batch != 64 or calls.value < 50
