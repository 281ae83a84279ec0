"""Queries on history, state and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import history
from graphloom.plans.catalog import query
from graphloom.plans.datasets import table
from graphloom.streaming import streams

at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
SQL_AT = "'%Y-%m-%d %H:%M:%S'"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("commit_hash"), F.col("o_orderdate").alias("ts"), "o_totalprice")


@query("SELECT project_id, commit_hash FROM (SELECT o_custkey AS project_id, o_orderkey AS commit_hash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 10")
def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.keep_last(orders(spark, sf_dir), 10, ["project_id"], [F.desc("ts"), F.desc("commit_hash")]).select("project_id", "commit_hash")


@query("SELECT o_custkey AS project_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS commit_hash FROM orders GROUP BY o_custkey")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(orders(spark, sf_dir), "project_id", ["ts", "commit_hash"]).select("project_id", "commit_hash")


@query("SELECT o_custkey AS project_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_commit_hash, count(*) AS total FROM orders GROUP BY o_custkey")
def upsert_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.upsert_counter(orders(spark, sf_dir), "project_id", "commit_hash", ["ts", "commit_hash"])


@query("""WITH old AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), new AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT k, v FROM old UNION ALL SELECT k, v FROM new WHERE k NOT IN (SELECT k FROM old)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    return history.insert_if_absent(old, o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), ["k"], ["v"])


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS ORDER BY ts DESC, event_id DESC LIMIT 2000")
def prune_age_then_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.prune(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= CASE event_type WHEN 'click' THEN 50 WHEN 'view' THEN 1000 ELSE 2147483647 END")
def memory_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.memory_limits(table(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], {"click": 50, "view": 1000}).select("event_id", "event_type")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS lowest, max(value) AS highest, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM k WHERE r <= 1000 GROUP BY event_type""")
def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.metric_stats(table(spark, sf_dir, "events"), "event_type", "value", [F.desc("ts"), F.desc("event_id")])
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median")), "lowest", "highest", F.round("deviation", 6).alias("deviation"))


@query("SELECT event_type, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.counters(table(spark, sf_dir, "events"), "event_type", "value").withColumn("total", F.round("total", 2))


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS h FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id) WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of documents made from the table: each lacks some, and the second changes some."""
    d = table(spark, sf_dir, "documents")
    before = d.where("doc_id % 5 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    after = d.where("doc_id % 4 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary")).alias("h"))
    return history.incremental_diff(before, after, "doc_id", "h")


@query("SELECT doc_id, sha256(text) AS hash, c.n AS analysis FROM documents LEFT JOIN (SELECT sha256(text) AS h, length(text) AS n FROM documents GROUP BY text HAVING count(*) > 1) c ON h = sha256(text)")
def cached_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cache = d.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").select(F.sha2("text", 256).alias("hash"), F.length("text").alias("analysis"))
    return history.cached(d.select("doc_id", "text"), cache, "text").select("doc_id", "hash", "analysis")


@query("""WITH last AS (SELECT o_custkey AS project_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS l FROM orders GROUP BY 1), p AS (SELECT c_custkey AS project_id, c_custkey % 11 <> 0 AS is_git, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN l ELSE -1 END AS h FROM customer LEFT JOIN last ON project_id = c_custkey)
SELECT p.project_id, CASE WHEN NOT is_git THEN 'NOT_GIT_REPO' WHEN h IS NULL THEN 'NO_COMMIT' WHEN l IS NULL THEN 'FIRST_TIME' WHEN l = h THEN 'NO_CHANGES' ELSE 'NEW_COMMIT' END AS decision FROM p LEFT JOIN last USING (project_id)""")
def skip_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = orders(spark, sf_dir).select("project_id", "commit_hash", F.struct("ts", "commit_hash").alias("ts"))
    last = h.groupBy("project_id").agg(F.max_by("commit_hash", "ts").alias("l"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id")).join(last, "project_id", "left")
    commit = F.when(F.col("project_id") % 7 == 0, None).when(F.col("project_id") % 2 == 0, F.col("l")).otherwise(F.lit(-1))
    return history.skip_decision(c.select("project_id", (F.col("project_id") % 11 != 0).alias("is_git"), commit.alias("commit_hash")), h).select("project_id", "decision")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED")
    priority = F.element_at(F.create_map(*map(F.lit, ("1-URGENT", "critical", "2-HIGH", "high", "3-MEDIUM", "medium", "5-LOW", "low"))), F.col("o_orderpriority"))
    need = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.floor(F.col("o_orderkey") / 2), F.floor(F.col("o_orderkey") / 3)))
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), priority.alias("priority"), need.alias("dependencies"))


SQL_TASKS = """t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 99 END AS p FROM orders),
done AS (SELECT id FROM t WHERE status = 'COMPLETED'), runnable AS (SELECT id, p FROM t WHERE status = 'PENDING' AND (id % 3 = 0 OR (id // 2 IN (SELECT id FROM done) AND id // 3 IN (SELECT id FROM done))))"""


@query(f"WITH {SQL_TASKS} SELECT id FROM runnable")
def runnable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.runnable_tasks(tasks(spark, sf_dir)).select("id")


@query(f"WITH {SQL_TASKS} SELECT id, p FROM runnable ORDER BY p, id LIMIT 1")
def schedule_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.next_task(tasks(spark, sf_dir)).select("id", history.priority_rank(F.col("priority")).alias("p"))


@query("SELECT o_custkey AS id, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT o_custkey, CASE WHEN o_custkey = 7 AND o_orderstatus = 'F' THEN 'new' ELSE o_orderstatus END AS t FROM orders UNION ALL SELECT 7, 'new') GROUP BY o_custkey")
def session_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderstatus").alias("tags"))
    return history.retag(s, "7", ("new",), ("F",)).select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role <> 'assistant' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def unprocessed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("conv_id").alias("id"), F.col("role").alias("author"))
    return history.unprocessed(c, c.where("author = 'system'"), "assistant").select(F.col("key").alias("id"))


@query(f"SELECT user_id AS id, min(event_type) AS url, strftime(max(ts), {SQL_AT}) AS last_accessed FROM events GROUP BY user_id")
def touch_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.groupBy(F.col("user_id").alias("id")).agg(F.min("event_type").alias("url"), F.min("ts").alias("last_accessed"))
    return history.touch_repos(first, e.select(F.col("user_id").alias("id"), F.col("event_type").alias("url"), "ts")).select("id", "url", at("last_accessed").alias("last_accessed"))


@query("SELECT event_id, CASE WHEN v < 60 THEN v || 's' WHEN v < 3600 THEN (v // 60) || 'm' ELSE (v // 3600) || 'h' END AS text FROM (SELECT event_id, (event_id * 37) % 9000 AS v FROM events)")
def elapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", history.elapsed(F.col("event_id") * 37 % 9000).alias("text"))


# Time


@query(f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {SQL_AT}) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = streams.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")
    return w.select(at("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"SELECT strftime(s, {SQL_AT}) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = streams.sliding(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour", ["event_type"], "value")
    return w.select(at("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), {SQL_AT}) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id").select("user_id", at("session_start").alias("session_start"), "n")


@query("SELECT DISTINCT event_id FROM events")
def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return streams.once(e.unionAll(e), "event_id", "ts").select("event_id")


@query(f"WITH s AS (SELECT user_id * 10 AS k, event_id, ts FROM events WHERE event_type = 'view'), e AS (SELECT user_id * 10 AS k, ts FROM events WHERE event_type = 'purchase') SELECT s.k AS id, strftime(s.ts, {SQL_AT}) AS started, strftime(e.ts, {SQL_AT}) AS ended FROM s JOIN e ON s.k = e.k AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("id", F.col("user_id") * 10)
    found = streams.pair_runs(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "id", "ts")
    return found.select("id", at("started").alias("started"), at("ended").alias("ended"))


@query("""SELECT event_id, 'task_' || n AS task_id, CASE WHEN n = 1 THEN event_type ELSE '' END AS description, CASE WHEN n = 1 THEN 'high' ELSE 'medium' END AS priority FROM events, (SELECT unnest([1, 2]) AS n) WHERE event_id % 3 <> 2""")
def normalize_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 3 == 0, "tasks").otherwise("subtasks")
    said = F.when(F.col("event_id") % 3 == 2, "no json").otherwise(F.concat(F.lit('{"'), key, F.lit('": [{"description": "'), F.col("event_type"), F.lit('", "priority": "high"}, {}]}')))
    return history.normalize_tasks(e.select("event_id", said.alias("t")), "event_id", "t").select("event_id", "task_id", "description", "priority")


@query("""WITH t AS (SELECT o_orderkey::VARCHAR AS id, 'order ' || o_orderkey AS d FROM orders) SELECT id, CASE WHEN id::BIGINT % 2 = 0 THEN (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest([(id::BIGINT // 2)::VARCHAR, (id::BIGINT // 3)::VARCHAR]) AS x) WHERE true) ELSE '' END AS dependencies FROM t WHERE id::BIGINT // 2 <> id::BIGINT // 3
UNION ALL SELECT id, CASE WHEN id::BIGINT % 2 = 0 THEN (id::BIGINT // 2)::VARCHAR ELSE '' END FROM t WHERE id::BIGINT // 2 = id::BIGINT // 3""")
def resolve_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    half, third = F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string")
    need = F.when(k % 2 == 0, F.array(half, F.concat(F.lit("order "), third), F.lit("unknown"))).otherwise(F.array(F.lit("nobody")))
    t = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.concat(F.lit("order "), k.cast("string")).alias("description"), need.alias("dependencies"))
    return history.resolve_dependencies(t).select("id", F.array_join("dependencies", ",").alias("dependencies"))
