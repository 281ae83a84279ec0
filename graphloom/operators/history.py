"""State and history tables: upserts, retention, sessions, tasks, incremental decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table and those of `new` whose key it lacks; of several new rows with a key, the first."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert_counter(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, last value, total): what upserting each event in order with total + 1 leaves."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(f"last_{value}"), F.count("*").alias("total"))


def keep_last(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The newest n rows of each key. Spark stops at n rows of a key before it shuffles them."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The newest row of each key: a hash aggregation, no sort."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(by, "_r.*")


def prune(df: DataFrame, ts: str, id: str, days: int = 7, most: int = 2000) -> DataFrame:
    """Rows of the last `days` before the newest one, and of those the newest `most`: by age first.
    The newest come from a top-k, not from numbering the table in one task."""
    cutoff = df.agg(F.max(ts).alias("_top"))
    young = df.join(F.broadcast(cutoff), F.col(ts) >= F.col("_top") - F.expr(f"INTERVAL {days} DAYS")).drop("_top")
    return young.orderBy(F.desc(ts), F.desc(id)).limit(most)


#: How many memories of a type are kept.
MEMORY_LIMITS = {"short_term": 50, "long_term": 1000}


def memory_limits(df: DataFrame, type: str, order: list[Column], limits: dict[str, int] | None = None) -> DataFrame:
    """The newest rows of each type, as many as its limit; types without one keep all."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in (limits or MEMORY_LIMITS).items() for x in pair)), F.col(type)), F.lit(2**31 - 1))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(type).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def metric_stats(df: DataFrame, name: str, value: str, order: list[Column], last: int = 1000) -> DataFrame:
    """count, mean, median, min, max and sample deviation (0 of one value) of each name's last values."""
    kept = keep_last(df, last, [name], order)
    return kept.groupBy(name).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"))


def counters(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.sum(value).alias("total"))


def incremental_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) of two snapshots: added, removed, changed; what is equal is left out."""
    a, b = before.select(key, F.col(digest).alias("_a")), after.select(key, F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def cached(files: DataFrame, cache: DataFrame, content: str = "content") -> DataFrame:
    """files with the cached analysis of equal content (by SHA-256), null where there is none."""
    return files.withColumn("hash", F.sha2(content, 256)).join(cache.select("hash", "analysis"), "hash", "left")


def skip_decision(projects: DataFrame, history: DataFrame) -> DataFrame:
    """projects(project_id, is_git, commit_hash) with decision: NOT_GIT_REPO, NO_COMMIT, FIRST_TIME,
    NO_CHANGES or NEW_COMMIT, by the last commit in history(project_id, commit_hash, ts)."""
    last = history.groupBy("project_id").agg(F.max_by("commit_hash", "ts").alias("last_commit"))
    decision = F.when(~F.col("is_git"), "NOT_GIT_REPO").when(F.col("commit_hash").isNull(), "NO_COMMIT").when(F.col("last_commit").isNull(), "FIRST_TIME").when(F.col("last_commit") == F.col("commit_hash"), "NO_CHANGES").otherwise("NEW_COMMIT")
    return projects.join(last, "project_id", "left").withColumn("decision", decision)


def runnable_tasks(tasks: DataFrame) -> DataFrame:
    """tasks(id, status, priority, dependencies) that are PENDING with all dependencies COMPLETED; a
    dependency on an unknown task is not completed."""
    need = tasks.where("status = 'PENDING'").select("id", F.explode("dependencies").alias("dep"))
    done = tasks.where("status = 'COMPLETED'").select(F.col("id").alias("dep"))
    blocked = need.join(done, "dep", "left_anti").select("id").distinct()
    return tasks.where("status = 'PENDING'").join(blocked, "id", "left_anti")


def priority_rank(priority: Column) -> Column:
    """The order of priorities."""
    return F.when(priority == "critical", 0).when(priority == "high", 1).when(priority == "medium", 2).when(priority == "low", 3).otherwise(99)


def next_task(tasks: DataFrame) -> DataFrame:
    return runnable_tasks(tasks).orderBy(priority_rank(F.col("priority")), "id").limit(1)


def advance_task(tasks: DataFrame, id: str, status: str, at: Column) -> DataFrame:
    """tasks with one's status set, and completed_at when it is COMPLETED."""
    mine = F.col("id") == id
    return tasks.withColumn("completed_at", F.when(mine & F.lit(status == "COMPLETED"), at).otherwise(F.col("completed_at"))).withColumn("status", F.when(mine, status).otherwise(F.col("status")))


def retag(sessions: DataFrame, id: str, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> DataFrame:
    """sessions(id, tags) with one's tags changed."""
    tags = F.array_except(F.array_union("tags", F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>"))
    return sessions.withColumn("tags", F.when(F.col("id") == id, tags).otherwise(F.col("tags")))


def with_tag(sessions: DataFrame, tag: str) -> DataFrame:
    return sessions.where(F.array_contains("tags", tag))


def update_metadata(sessions: DataFrame, id: str, **values: str) -> DataFrame:
    """sessions(id, metadata) with one's metadata merged, new values last."""
    keys = F.array(*map(F.lit, values))
    kept = F.map_filter("metadata", lambda k, v: ~F.array_contains(keys, k))
    new = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return sessions.withColumn("metadata", F.when(F.col("id") == id, F.map_concat(kept, new)).otherwise(F.col("metadata")))


def unprocessed(items: DataFrame, processed: DataFrame, me: str) -> DataFrame:
    """items(id, author) that are new and not one's own."""
    return items.where(F.col("author") != me).join(processed.select("id"), "id", "left_anti")


def touch_repos(repos: DataFrame, visits: DataFrame) -> DataFrame:
    """repos(id, url, last_accessed) after visits(id, url, ts): known ones are touched, others added."""
    last = visits.groupBy("id").agg(F.max("ts").alias("_ts"), F.max_by("url", "ts").alias("_url"))
    both = repos.join(last, "id", "full")
    return both.select("id", F.coalesce("url", "_url").alias("url"), F.greatest("last_accessed", "_ts").alias("last_accessed"))


def elapsed(seconds: Column) -> Column:
    """A duration as text: seconds below a minute, minutes below an hour, else hours."""
    return F.when(seconds < 60, F.format_string("%ds", seconds.cast("int"))).when(seconds < 3600, F.format_string("%dm", (seconds / 60).cast("int"))).otherwise(F.format_string("%dh", (seconds / 3600).cast("int")))


def changed_python(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changed Python paths that still exist."""
    return changes.where(F.endswith("path", F.lit(".py"))).join(files.select("path"), "path", "left_semi")


def is_test(path: Column) -> Column:
    """Whether a path of a change is a test: in a folder of tests, or named as one."""
    return F.startswith(path, F.lit("test")) | F.contains(path, F.lit("/test")) | F.contains(path, F.lit("_test."))


TASKS = "array<struct<id:string,description:string,priority:string,dependencies:array<string>>>"


def normalize_tasks(answers: DataFrame, id: str, text: str) -> DataFrame:
    """(id, task_id, description, priority, status, dependencies): tasks of JSON answers under `subtasks`
    or `tasks`; what a task lacks has a default; answers that are no JSON give none."""
    parsed = F.from_json(text, f"subtasks {TASKS}, tasks {TASKS}")
    rows = answers.select(id, F.posexplode(F.coalesce(parsed["subtasks"], parsed["tasks"])).alias("n", "t"))
    return rows.select(id, F.coalesce("t.id", F.concat(F.lit("task_"), (F.col("n") + 1).cast("string"))).alias("task_id"), F.coalesce("t.description", F.lit("")).alias("description"), F.coalesce("t.priority", F.lit("medium")).alias("priority"), F.lit("PENDING").alias("status"), F.coalesce("t.dependencies", F.array().cast("array<string>")).alias("dependencies"))


def resolve_dependencies(tasks: DataFrame) -> DataFrame:
    """tasks(id, description, dependencies) whose dependencies, given by id or description, become ids;
    unknown ones go."""
    names = tasks.select(F.col("id").alias("_to"), F.explode(F.array_distinct(F.array("id", "description"))).alias("_name"))
    found = tasks.select("id", F.explode("dependencies").alias("_name")).join(names, "_name").groupBy("id").agg(F.array_sort(F.collect_set("_to")).alias("_deps"))
    return tasks.join(found, "id", "left").withColumn("dependencies", F.coalesce("_deps", F.array().cast("array<string>"))).drop("_deps")


def head_distinct(first: Column, second: Column, n: int = 5) -> Column:
    """The first n of both arrays together, then without repeats."""
    return F.array_distinct(F.slice(F.concat(first, second), 1, n))
