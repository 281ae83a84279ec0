"""Queries on code quality, vectors, and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import paths, quality, router, vector
from graphloom.plans.catalog import query
from graphloom.plans.datasets import SQL_CALLS, calls, parts, star, table, transitions

SQL_ISSUES = f"""{SQL_CALLS}, issues AS (
 SELECT 'dead_code' AS issue_type, 'medium' AS severity, p_partkey::VARCHAR AS id FROM part WHERE p_partkey NOT IN (SELECT dst FROM calls)
 UNION ALL SELECT 'high_complexity', 'high', p_partkey::VARCHAR FROM part WHERE p_size > 10
 UNION ALL SELECT 'tight_coupling', 'medium', src::VARCHAR FROM calls GROUP BY src HAVING count(*) > 10
 UNION ALL SELECT 'god_class', 'high', p_brand FROM part GROUP BY p_brand HAVING count(*) > 15)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = parts(spark, sf_dir), calls(spark, sf_dir)
    dead = p.join(c.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("n", F.lit(0))
    many = p.where(F.col("complexity") > quality.COMPLEX).withColumn("n", F.col("complexity"))
    tight = c.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > quality.TIGHT)
    god = p.groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > quality.GOD_CLASS)
    return quality.union_issues(quality.issue(dead, "dead_code", "medium", "%s is never called (%s)"), quality.issue(many, "high_complexity", "high", "%s has complexity %s"), quality.issue(tight, "tight_coupling", "medium", "%s depends on %s others"), quality.issue(god, "god_class", "high", "%s holds %s members"))


@query(f"WITH {SQL_ISSUES} SELECT issue_type, severity, id FROM issues")
def all_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).select("issue_type", "severity", "id")


@query(f"WITH {SQL_ISSUES} SELECT CASE WHEN issue_type IS NOT NULL THEN 'type' WHEN severity IS NOT NULL THEN 'severity' ELSE 'total' END AS \"by\", coalesce(issue_type, severity, 'all') AS value, count(*) AS n FROM issues GROUP BY GROUPING SETS ((issue_type), (severity), ())")
def issues_by_type_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(issues(spark, sf_dir))


@query(f"WITH {SQL_ISSUES} SELECT issue_type, count(*) AS n, CASE issue_type WHEN 'dead_code' THEN 'Remove unused functions' WHEN 'high_complexity' THEN 'Simplify complex functions' WHEN 'tight_coupling' THEN 'Reduce coupling' ELSE 'Split large classes' END AS advice FROM issues GROUP BY issue_type")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.recommendations(issues(spark, sf_dir))


@query(f"WITH {SQL_CALLS} SELECT p_partkey AS id, 1 + count(dst) AS complexity, p_size - 1 AS loc, 2 AS params FROM part LEFT JOIN transitions ON src = p_partkey GROUP BY p_partkey, p_size")
def complexity_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = parts(spark, sf_dir).select("id", F.lit(1).alias("start_line"), F.col("loc").alias("end_line"), F.array(F.lit("a"), F.lit("b")).alias("args"))
    return quality.complexity_estimate(f, transitions(spark, sf_dir))


@query("SELECT p_partkey AS id, p_size AS complexity FROM part WHERE p_size > 5 ORDER BY p_size DESC, p_partkey LIMIT 10")
def top_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where("complexity > 5").orderBy(F.desc("complexity"), "id").limit(10).select("id", "complexity")


def _score_sql() -> str:
    from graphloom.plans.graph_queries import _cycles_sql

    found = _cycles_sql()
    return f"""{found[: found.index("SELECT array_to_string")].rstrip()}, f AS (SELECT count(*) AS n, avg(p_size) AS a, count(*) FILTER (p_retailprice > 1000) AS d FROM part),
x AS (SELECT greatest(0, 100 - 5 * a) AS complexity_score, greatest(0, 100.0 - 5 * (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT dst FROM calls)))::DOUBLE AS dead_code_score,
greatest(0, 100.0 - 10 * (SELECT count(*) FROM (SELECT 1 FROM c WHERE r = 1 LIMIT 10)))::DOUBLE AS architecture_score, 100.0::DOUBLE * d / n AS documentation_score FROM f)
SELECT round(complexity_score, 6) AS complexity_score, dead_code_score, architecture_score, round(documentation_score, 6) AS documentation_score,
CASE WHEN t >= 80 THEN 'healthy' WHEN t >= 60 THEN 'warning' ELSE 'critical' END AS health FROM (SELECT *, complexity_score * 0.3 + dead_code_score * 0.25 + architecture_score * 0.25 + documentation_score * 0.2 AS t FROM x)"""


@query(_score_sql())
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    c = calls(spark, sf_dir)
    dead = p.join(c.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    one = quality.quality_score(p, dead, paths.cycles(c))
    return one.select(F.round("complexity_score", 6).alias("complexity_score"), "dead_code_score", "architecture_score", F.round("documentation_score", 6).alias("documentation_score"), quality.health(F.col("total_score")).alias("health"))


@query("SELECT count(*) AS total, round(avg(p_size), 6) AS average, max(p_size) AS highest, count(*) FILTER (p_size > 8) AS high FROM part")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_summary(parts(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query(f"""WITH {SQL_CALLS}, n AS (SELECT dst, count(*) AS n FROM calls GROUP BY dst) SELECT dst AS id, n, CASE WHEN n > 10 THEN 'critical' WHEN n > 5 THEN 'high' WHEN n > 1 THEN 'medium' ELSE 'low' END AS severity FROM n""")
def severity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = calls(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return n.withColumn("severity", paths.severity(F.col("n")))


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal / 100 >= 80 THEN 'healthy' WHEN s_acctbal / 100 >= 60 THEN 'warning' ELSE 'critical' END AS health FROM supplier""")
def health_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), quality.health(F.col("s_acctbal") / 100).alias("health"))


@query(f"""WITH {SQL_ISSUES}, d AS (SELECT issue_type, least(10, count(*) % 9 + 1) AS p FROM issues GROUP BY issue_type),
r AS (SELECT issue_type, least(10, least(10, p + 2) + CASE WHEN issue_type IN ('dead_code', 'circular_dependency') THEN 1 ELSE 0 END) AS priority FROM d)
SELECT issue_type, priority, row_number() OVER (ORDER BY priority DESC, issue_type) AS rank FROM r""")
def prioritize_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = issues(spark, sf_dir).groupBy("issue_type").agg(F.least(F.lit(10), (F.count("*") % 9 + 1).cast("int")).alias("priority"))
    return quality.prioritize(d, F.lit(55.0))


@query("""WITH f AS (SELECT event_type AS issue_type, sign(sum(CASE WHEN value > 20 THEN 1 ELSE -1 END))::INT AS b FROM events GROUP BY event_type) SELECT issue_type, greatest(1, least(10, 5 + coalesce(b, 0))) AS priority FROM (SELECT DISTINCT event_type AS issue_type FROM events UNION SELECT 'none') LEFT JOIN f USING (issue_type)""")
def learned_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("event_type").alias("issue_type")).distinct().union(spark.createDataFrame([("none",)], "issue_type string")).withColumn("priority", F.lit(5))
    return quality.learn_priorities(d, e.select(F.col("event_type").alias("issue_type"), (F.col("value") > 20).alias("good")))


@query("""SELECT p_partkey AS path, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END, CASE WHEN p_size % 3 = 1 THEN p_size * 2.0 END, 1.0)::DOUBLE AS complexity, CASE WHEN p_size % 3 = 0 THEN 50.0 ELSE 100.0 END::DOUBLE AS maintainability FROM part WHERE p_size > 5""")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size")
    lines = p.select("path", F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0).alias("code"))
    python = p.where("p_size % 3 = 0").select("path", F.col("p_size").cast("double").alias("complexity"), F.lit(50.0).alias("maintainability"))
    generic = p.where("p_size % 3 = 1").select("path", (F.col("p_size") * 2.0).alias("complexity"))
    return quality.file_metrics(lines, python, generic).select("path", "complexity", "maintainability")


@query("SELECT c_custkey AS id, coalesce(CASE WHEN o.n > 10 THEN o.n END, 0) AS orders, c_nationkey AS nation FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def enrich_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("bigint").alias("orders"), F.col("c_nationkey").alias("nation"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders")).where("orders > 10")
    return quality.enrich(base, n, "id")


@query("""WITH i AS (SELECT o_orderkey AS issue_id, list(DISTINCT l_partkey) AS affected FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT issue_id FROM i WHERE list_has_any(affected, [1, 2, 3])""")
def related_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("issue_id")).agg(F.collect_set("l_partkey").alias("affected"))
    return quality.related_issues(i, spark.createDataFrame([(1,), (2,), (3,)], "id bigint")).select("issue_id")


@query()
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues(spark, sf_dir)
    return quality.report({"counts": quality.issue_counts(found), "critical": paths.criticality(parts(spark, sf_dir), transitions(spark, sf_dir)), "summary": quality.quality_summary(parts(spark, sf_dir))})


# Vectors


SQL_POINTS = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT v AS qv FROM p WHERE id = (SELECT min(id) FROM p))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query(f"WITH {SQL_POINTS} SELECT id, round(list_cosine_similarity(v, qv), 6) AS score FROM p, q WHERE list_cosine_similarity(v, qv) >= 0 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(points(spark, sf_dir), first_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_POINTS} SELECT id, round(list_cosine_similarity(v, qv), 6) AS score FROM p, q WHERE label = 3 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.search(points(spark, sf_dir), first_vector(spark, sf_dir), threshold=None, where=vector.matches("payload", label=3))
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_POINTS} SELECT id, round(list_cosine_similarity(v, qv), 6) AS score FROM p, q WHERE list_cosine_similarity(v, qv) >= 0.2 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT 50")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(points(spark, sf_dir), first_vector(spark, sf_dir), 50, 0.2).select("id", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.v, b.v) AS score FROM p a JOIN p b ON a.id <> b.id WHERE a.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    queries = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return vector.batch_search(p, queries).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id AS id, CASE WHEN vec_id = 1 THEN 2 ELSE 64 END AS size, CASE WHEN vec_id = 1 THEN 'new' ELSE label::VARCHAR END AS label FROM embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(1, 1, [1.0], {"label": "old"}), (2, 1, [1.0, 2.0], {"label": "new"}), (3, 2, [], {"label": "none"})], "seq int, id bigint, vector array<float>, payload map<string,string>")
    return vector.upsert(points(spark, sf_dir), new).select("id", F.size("vector").alias("size"), F.col("payload.label").alias("label"))


@query("SELECT vec_id AS id FROM embeddings WHERE label <> 3")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.delete_where(points(spark, sf_dir), label=3).select("id")


@query("SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def vector_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "event_type", F.array(F.lit(1.0)).alias("vector"))
    return vector.recent(e, "ts").select("id", "event_type")


def _uuid5_sql(name: str) -> str:
    """The version-5 UUID of a name in the DNS namespace, from its SHA-1."""
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return f"""(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(position(h[17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"""


@query(f"SELECT page_id, {_uuid5_sql('url')} AS id FROM pages")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", vector.point_id(F.col("url")).alias("id"))


@query(f"""WITH s AS (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(0, ceil((length(text) - 2000) / 1600.0))::INT + 1)) AS i FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id || '::part' || CASE WHEN n > 2000 THEN i + 1 ELSE 0 END AS name FROM s) SELECT {_uuid5_sql('name')} AS id, 64 AS size, 4 AS keys FROM c""")
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.functions.text import sliding_chunks

    chunks = sliding_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    named = chunks.select(F.concat_ws("::part", F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("chunk_id"), F.col("chunk").alias("text"), F.col("doc_id").cast("string").alias("source"), F.create_map(F.lit("part"), F.col("part").cast("string")).alias("metadata"))
    return vector.points_from_chunks(named, "s1", vector.hashing_embedder()).select("id", F.size("vector").alias("size"), F.size("payload").alias("keys"))


# Questions


def _keyword_sql() -> str:
    parts_ = [f"len(list_intersect(w, [{', '.join(repr(x) for x in words)}])) AS {k}_score" for k, words in router.KEYWORDS.items()]
    names = [f"{k}_score" for k in router.KEYWORDS]
    ties = " + ".join(f"({n} = greatest({', '.join(names)}))::INT" for n in names)
    cases = " ".join(f"WHEN {k}_score = greatest({', '.join(names)}) THEN '{k}'" for k in router.KEYWORDS)
    return f"""w AS (SELECT qid, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM asked), s AS (SELECT qid, {', '.join(parts_)} FROM w),
kinds AS (SELECT qid, CASE WHEN greatest({', '.join(names)}) = 0 THEN 'semantic' WHEN {ties} > 1 THEN 'combined' {cases} END AS query_type FROM s)"""


QUESTIONS = ("where is the parser", "which calls depend on main", "show the history before", "quality report please", "find callers and list usage", "did this break before")
SQL_ASKED = "asked AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, '{q}')" for i, q in enumerate(QUESTIONS, 1)) + ") AS v(qid, text))"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-i, q) for i, q in enumerate(QUESTIONS, 1)], "qid bigint, text string")
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text").unionAll(own)


@query(f"WITH {SQL_ASKED}, {_keyword_sql()} SELECT qid, query_type FROM kinds")
def classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.classify(asked(spark, sf_dir)).select("qid", "query_type")


@query(f"""WITH {SQL_ASKED}, {_keyword_sql()} SELECT qid, unnest(CASE query_type WHEN 'semantic' THEN ['vector'] WHEN 'structural' THEN ['graph'] WHEN 'analytical' THEN ['graph'] WHEN 'temporal' THEN ['history'] ELSE ['vector', 'graph', 'history'] END) AS source FROM kinds""")
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.routes(router.classify(asked(spark, sf_dir))).select("qid", "source")


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS qid, list_distinct(list_filter(string_split_regex(replace(text, '?', ''), '\\s+'), lambda x: length(x) > 3)) AS w FROM conversations),
docs AS (SELECT doc_id AS id, string_split_regex(text, '\\s+')[1] AS name FROM documents), a AS (SELECT qid, unnest(w) AS name FROM w), hit AS (SELECT DISTINCT qid, id FROM a JOIN docs USING (name)),
n AS (SELECT qid, count(*) AS nodes FROM hit GROUP BY qid), r AS (SELECT qid, count(*) AS relationships FROM hit JOIN labels ON doc_id = id GROUP BY qid)
SELECT qid, nodes, coalesce(relationships, 0) AS relationships, CASE WHEN coalesce(relationships, 0) > 0 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM n LEFT JOIN r USING (qid)""")
def structural_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("text", r"\s+")[0].alias("name"), F.array(F.lit("Function")).alias("labels"))
    return router.structural(q, nodes, table(spark, sf_dir, "labels").select(F.col("quality").alias("src"), F.col("doc_id").alias("dst")))


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS qid, conv_id, turn, role, list_distinct(list_filter(string_split_regex(replace(lower(text), '?', ''), '\\s+'), lambda x: length(x) > 3)) AS w FROM conversations),
a AS (SELECT qid, unnest(w) AS word FROM w WHERE role = 'system'), t AS (SELECT qid AS id, conv_id AS ts, unnest(w) AS word FROM w WHERE role = 'user'),
b AS (SELECT a.qid, t.id, t.ts, row_number() OVER (PARTITION BY a.qid ORDER BY t.ts DESC, t.id DESC) AS r FROM a JOIN t USING (word)) SELECT qid, id, ts, 0.78::DOUBLE AS confidence FROM b WHERE r = 1""")
def temporal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
    return router.temporal(c.where("role = 'system'"), c.where("role = 'user'").select(F.col("qid").alias("id"), "text", "conv_id"), "conv_id")


def _fused(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    near = vector.search(points(spark, sf_dir), first_vector(spark, sf_dir), 5).select(F.col("id").cast("string").alias("id"), F.round("score", 6).alias("confidence"))
    hubs = star(spark, sf_dir)[1].groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(5).select("id", F.lit(router.WITH_RELATIONS).alias("confidence"))
    last = table(spark, sf_dir, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).limit(3).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit(router.TEMPORAL).alias("confidence"))
    return {"vector": near, "graph": hubs, "history": last}


SQL_FUSED = f"""{SQL_POINTS}, edges AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem),
fused AS ((SELECT 'vector' AS source, id::VARCHAR AS id, round(list_cosine_similarity(v, qv), 6) AS confidence FROM p, q WHERE list_cosine_similarity(v, qv) >= 0 ORDER BY list_cosine_similarity(v, qv) DESC, p.id LIMIT 5)
UNION ALL (SELECT 'graph', dst, 0.85 FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5) UNION ALL (SELECT 'history', conv_id || ':' || turn, 0.78 FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 3))"""


@query(f"WITH {SQL_FUSED} SELECT source, id, confidence::DOUBLE AS confidence FROM fused ORDER BY confidence DESC, source, id LIMIT 10")
def route_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.fuse(_fused(spark, sf_dir)).select("source", "id", "confidence")


@query(f"""WITH {SQL_FUSED}, b AS (SELECT source, max(confidence) AS c, sum(confidence) AS s, count(*) AS n FROM fused GROUP BY source), o AS (SELECT avg(c) AS overall, sum(s) / sum(n) AS items, count(*) AS sources FROM b)
SELECT round(overall::DOUBLE, 6) AS overall, round(items::DOUBLE, 6) AS items, sources, CASE WHEN sources = 0 THEN 'nothing found' WHEN items < 0.6 THEN 'refine' WHEN items > 0.8 THEN 'go on' ELSE 'look closer' END AS advice FROM o""")
def fused_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = router.confidence(router.fuse(_fused(spark, sf_dir), 1000))
    return one.select(F.round("overall", 6).alias("overall"), F.round("items", 6).alias("items"), "sources", "advice")


@query(f"WITH {SQL_FUSED}, top AS (SELECT source, id, confidence::DOUBLE AS confidence FROM fused ORDER BY confidence DESC, source, id LIMIT 10), lines AS (SELECT confidence, format('- [{{}}] {{}} ({{:.2f}})', source, id, confidence) AS line FROM top) SELECT string_agg(line, chr(10) ORDER BY confidence DESC, line) AS text FROM lines")
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.render_context(router.fuse(_fused(spark, sf_dir)))


@query(f"WITH {SQL_CALLS} SELECT src, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, src) AS rank FROM calls GROUP BY src ORDER BY n DESC, src LIMIT 10")
def ranked_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = calls(spark, sf_dir).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "src")))


@query("""SELECT p_brand AS path, round(avg(p_size), 2) AS average, max(p_size) AS highest, coalesce(string_agg(CASE WHEN p_size > 40 THEN lpad(p_partkey::VARCHAR, 9, '0') END, ',' ORDER BY p_size DESC, lpad(p_partkey::VARCHAR, 9, '0')), '') AS complex FROM part GROUP BY p_brand""")
def file_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = parts(spark, sf_dir).select(F.col("owner").alias("path"), F.lpad(F.col("id").cast("string"), 9, "0").alias("name"), "complexity")
    found = quality.file_complexity(f, 40)
    return found.select("path", "average", "highest", F.array_join("complex", ",").alias("complex"))


@query("SELECT round(avg(s_acctbal), 2) AS score FROM supplier")
def repository_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repository_score(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("maintainability")))


@query()
def task_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.plans.datasets import busiest

    c = calls(spark, sf_dir)
    node = busiest(c)
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("issue_id")).agg(F.collect_set("l_partkey").alias("affected"))
    return quality.task_context(node, paths.ripple(c, node), paths.criticality(parts(spark, sf_dir), transitions(spark, sf_dir), 5), i)


@query("SELECT vec_id AS id, 'unknown' AS name, label::VARCHAR AS type, 'text ' || vec_id AS snippet FROM embeddings WHERE label = 3")
def shaped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label = 3")
    hits = e.select(F.col("vec_id").alias("id"), F.lit(1.0).alias("score"), F.create_map(F.lit("type"), F.col("label").cast("string"), F.lit("content"), F.concat(F.lit("text "), F.col("vec_id").cast("string"))).alias("payload"))
    return router.shape(hits).drop("score")


@query()
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.sources import state

    return state.markdown(quality_report(spark, sf_dir))
