"""Queries on sessions, memories and names that stand for nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import linking, memory, quality, sessions
from graphloom.plans.catalog import query
from graphloom.plans.datasets import SQL_CALLS, calls, table
from graphloom.plans.quality_queries import SQL_POINTS, first_vector, points


@query("SELECT n_nationkey::VARCHAR AS id, n_nationkey = 5 AS current FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'new', false")
def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.array("n_name").alias("tags"), F.create_map(F.lit("name"), "n_name").alias("metadata"))
    made = sessions.create_session(sessions.create_session(own, "new", ("fresh",)), "7")
    return sessions.switch_session(sessions.delete_session(made, "3"), "5").select("id", "current")


@query("SELECT o_custkey AS project_id, count(*) AS n FROM orders WHERE o_custkey <> (SELECT min(o_custkey) FROM orders) GROUP BY o_custkey")
def clear_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"))
    return sessions.clear_project(o, o.agg(F.min("project_id")).first()[0]).groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT user_id AS id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used FROM events GROUP BY user_id")
def repos_by_last_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.last_used(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts"), "id", "ts")
    return found.withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT status, (SELECT count(*) FROM events WHERE event_type = status) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('failed')) AS k(status)")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.status_counts(table(spark, sf_dir, "events"), "event_type", ("click", "view", "purchase", "failed"))


@query("SELECT p_type AS path, max(p_size) AS highest FROM part GROUP BY p_type ORDER BY max(p_size) DESC, p_type LIMIT 10")
def most_complex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "part").select(F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("complexity"))
    return sessions.most_complex(quality.file_complexity(functions)).select("path", "highest")


@query(f"WITH {SQL_POINTS} SELECT id, round(list_cosine_similarity(v, qv), 6) AS score FROM p, q WHERE list_cosine_similarity(v, qv) >= 0.7 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT 5")
def similar_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.similar_code(points(spark, sf_dir), first_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_POINTS}, own AS (SELECT label AS l FROM p ORDER BY id LIMIT 1) SELECT id, round(list_cosine_similarity(v, qv), 6) AS score FROM p, q, own WHERE label = l AND list_cosine_similarity(v, qv) >= 0.65 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT 5")
def memories_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    kind = p.orderBy("id").select(F.col("payload")["label"]).first()[0]
    return memory.memories(p, first_vector(spark, sf_dir), kind, key="label").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_POINTS} SELECT id, round(list_cosine_similarity(v, qv), 6) AS score FROM p, q WHERE label = 3 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT 7")
def memories_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.search_user(points(spark, sf_dir), "3", first_vector(spark, sf_dir), 7, "label").select("id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT c_custkey AS call_id, 'f' || (c_nationkey % 3) AS file_id, CASE WHEN c_custkey % 5 = 0 THEN 'K.' ELSE '' END || 'm' || (c_custkey % 9) AS caller FROM customer),
f AS (SELECT DISTINCT 'f' || (s_nationkey % 3) AS file_id, 'm' || (s_suppkey % 7) AS name, CASE WHEN s_suppkey % 2 = 0 THEN '::' ELSE '::K::' END AS part FROM supplier)
SELECT call_id, (SELECT f.file_id || f.part || f.name FROM f WHERE f.file_id = c.file_id AND f.name = c.caller ORDER BY length(f.part) LIMIT 1) AS src FROM c""")
def link_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = lambda key: F.concat(F.lit("f"), (F.col(key) % 3).cast("string"))
    dotted = F.when(F.col("c_custkey") % 5 == 0, "K.").otherwise("")
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), file("c_nationkey").alias("file_id"), F.concat(dotted, F.lit("m"), (F.col("c_custkey") % 9).cast("string")).alias("caller"))
    part = F.when(F.col("s_suppkey") % 2 == 0, "::").otherwise("::K::")
    own = table(spark, sf_dir, "supplier").select(file("s_nationkey").alias("file_id"), F.concat(file("s_nationkey"), part, F.lit("m"), (F.col("s_suppkey") % 7).cast("string")).alias("id"))
    return linking.callers(made, own).select("call_id", "src")


@query("SELECT name, (SELECT min('supplier::' || s_name) FROM supplier WHERE ends_with('supplier::' || s_name, name)) AS id FROM (SELECT DISTINCT right(c_name, 4) AS name FROM customer)")
def targets_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier::"), "s_name").alias("id"))
    return linking.targets(table(spark, sf_dir, "customer").select(F.right("c_name", F.lit(4)).alias("name")), nodes)


@query(f"""WITH {SQL_CALLS}, e AS (SELECT DISTINCT 'part:' || src AS s, 'part:' || dst AS d FROM calls ORDER BY 1, 2 LIMIT 200)
SELECT 'graph TD' || chr(10) || string_agg('    ' || replace(s, ':', '_') || '["' || s || '"] --> ' || replace(d, ':', '_') || '["' || d || '"]', chr(10) ORDER BY s, d) AS text FROM e""")
def global_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string")).alias(c)
    return linking.global_call_graph(calls(spark, sf_dir).select(part("src"), part("dst")))


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS qid, text, string_split_regex(text, '\\s+') AS w, role = 'user' AS told, turn % 2 = 0 AS says FROM conversations),
docs AS (SELECT doc_id AS id, string_split_regex(text, '\\s+')[1] AS name FROM documents), made AS (SELECT id, count(*) AS n FROM (SELECT doc_id % 7 AS id FROM documents) GROUP BY id),
th AS (SELECT DISTINCT qid, id FROM (SELECT qid, w[1] AS name FROM q WHERE told UNION ALL SELECT qid, w[2] FROM q WHERE told) JOIN docs USING (name)),
tr AS (SELECT qid, count(*) AS relationships FROM (SELECT DISTINCT qid, id FROM q JOIN docs ON name = w[1] WHERE told AND says) GROUP BY qid),
rh AS (SELECT DISTINCT qid, id FROM (SELECT qid, unnest(list_distinct(list_filter(string_split_regex(replace(text, '?', ''), '\\s+'), lambda x: length(x) > 3))) AS name FROM q WHERE qid NOT IN (SELECT qid FROM th)) JOIN docs USING (name)),
rr AS (SELECT qid, sum(n) AS relationships FROM rh JOIN made USING (id) GROUP BY qid),
n AS (SELECT qid, count(*) AS nodes FROM th GROUP BY qid UNION ALL SELECT qid, count(*) FROM rh GROUP BY qid), r AS (SELECT * FROM tr UNION ALL SELECT * FROM rr)
SELECT qid, nodes, coalesce(relationships, 0)::BIGINT AS relationships, CASE WHEN coalesce(relationships, 0) > 0 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM n LEFT JOIN r USING (qid)""")
def structural_by_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
    words = F.split("text", r"\s+")
    told = q.where("role = 'user'").select("qid", F.get(words, 0).alias("subject"), F.when(F.col("turn") % 2 == 0, "Calls").otherwise("uses").alias("predicate"), F.get(words, 1).alias("object"))
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select(F.col("doc_id").alias("id"), F.get(words, 0).alias("name"), F.array(F.lit("Function")).alias("labels"))
    return linking.structural_by_facts(q.select("qid", "text"), told, nodes, docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") % 7).alias("dst")))
