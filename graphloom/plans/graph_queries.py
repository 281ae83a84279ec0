"""Queries on graphs: look-ups, neighbourhoods, links, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, impact, linking, paths
from graphloom.plans.catalog import query
from graphloom.plans.datasets import SQL_BUSIEST, SQL_CALLS, SQL_EDGES, SQL_NODES, busiest, calls, parts, star, table, transitions


def text_path(c: str = "path"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ">")


@query("""WITH o AS (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS nxt FROM lineitem)
SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS weight FROM o JOIN part a ON l_partkey = a.p_partkey JOIN part b ON nxt = b.p_partkey
WHERE l_partkey <> nxt AND a.p_brand <> b.p_brand GROUP BY 1, 2 HAVING count(*) > 5 ORDER BY weight DESC, a, b LIMIT 20""")
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.coupling(transitions(spark, sf_dir), parts(spark, sf_dir).select("id", "owner"))


@query(f"WITH {SQL_NODES} SELECT id, name FROM nodes WHERE label = 'Customer' AND kind = 'BUILDING'")
def find_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_nodes(star(spark, sf_dir)[0], "Customer", kind="BUILDING").select("id", "name")


@query(f"WITH {SQL_EDGES} SELECT src, dst, type FROM edges WHERE dst = 'nation:3' AND type = 'IN_NATION'")
def find_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_edges(star(spark, sf_dir)[1], dst="nation:3", type="IN_NATION")


@query(f"WITH {SQL_NODES} SELECT id, name, label AS type FROM nodes WHERE label IN ('Region', 'Nation', 'Supplier', 'Part') AND contains(lower(name), 'ring') ORDER BY id LIMIT 5")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star(spark, sf_dir)[0].withColumn("file_path", F.lit(None).cast("string"))
    return graph.fuzzy_search(nodes, "RING", ("Region", "Nation", "Supplier", "Part"))


@query(f"WITH {SQL_NODES} SELECT id, label FROM nodes WHERE name = 'ASIA' OR name = 'NATION_7' OR name = '7'")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star(spark, sf_dir)[0]
    found = graph.find_by_name(nodes, "ASIA").unionAll(graph.find_by_name(nodes, "NATION_7")).unionAll(graph.find_by_name(nodes, "7"))
    return found.select("id", F.col("labels")[0].alias("label"))


@query(f"WITH {SQL_NODES} SELECT id, label, name FROM nodes WHERE id = 'part:5'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.get_node(star(spark, sf_dir)[0], "part:5").select("id", F.col("labels")[0].alias("label"), "name")


@query(f"WITH {SQL_EDGES} SELECT 'in' AS direction, src AS id FROM edges WHERE dst = 'nation:3' UNION ALL SELECT 'out', dst FROM edges WHERE src = 'nation:3'")
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(star(spark, sf_dir)[1], "nation:3", "both")


@query(f"""WITH {SQL_NODES}, {SQL_EDGES} SELECT type, direction, x.id, name, label FROM
(SELECT type, CASE WHEN src = 'part:7' THEN 'OUT' ELSE 'IN' END AS direction, CASE WHEN src = 'part:7' THEN dst ELSE src END AS id FROM edges WHERE src = 'part:7' OR dst = 'part:7') x
JOIN nodes USING (id) ORDER BY type, direction, x.id LIMIT 20""")
def neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(*star(spark, sf_dir), "part:7")


@query(f"""WITH {SQL_EDGES}, d AS (SELECT DISTINCT dst AS symbol FROM edges WHERE src = 'customer:1' AND type = 'ORDERED')
SELECT 'customer:1' AS id, (SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges WHERE src = 'customer:1' AND type = 'IN_NATION') AS imports,
coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM d), '') AS defines, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges JOIN d ON src = symbol WHERE type = 'CONTAINS'), '') AS calls""")
def file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.file_context(*star(spark, sf_dir), "customer:1", imports="IN_NATION", defines="ORDERED", calls="CONTAINS")
    return found.select("id", *(F.array_join(c, ",").alias(c) for c in ("imports", "defines", "calls")))


@query(f"WITH {SQL_NODES}, {SQL_EDGES}, n AS (SELECT count(*) AS nodes FROM nodes), m AS (SELECT count(*) AS edges FROM edges) SELECT nodes, edges, round(1e6 * edges / (nodes::DOUBLE * (nodes - 1)), 6) AS density_ppm FROM n, m")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(*star(spark, sf_dir)).select("nodes", "edges", F.round(F.col("density") * 1e6, 6).alias("density_ppm"))


@query(f"WITH {SQL_NODES} SELECT label, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT kind, count(*) FROM nodes WHERE kind IS NOT NULL GROUP BY kind")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_counts(star(spark, sf_dir)[0].withColumn("labels", F.array_compact(F.array(F.col("labels")[0], F.col("kind")))))


@query(f"WITH {SQL_NODES} SELECT CASE WHEN kind IS NULL THEN label WHEN kind < label THEN kind || ',' || label ELSE label || ',' || kind END AS label, count(*) AS n FROM nodes GROUP BY 1")
def label_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_counts(star(spark, sf_dir)[0].withColumn("labels", F.array_compact(F.array(F.col("labels")[0], F.col("kind")))), sets=True)


@query(f"""WITH {SQL_CALLS} SELECT (SELECT count(*) + count(DISTINCT p_brand) + count(DISTINCT (p_brand, p_type)) FROM part) AS nodes, (SELECT count(DISTINCT p_brand) FROM part) AS files,
(SELECT count(DISTINCT (p_brand, p_type)) FROM part) AS classes, (SELECT count(*) FROM part) AS functions, (SELECT sum(p_size)::BIGINT FROM part) AS loc, (SELECT count(*) FROM calls) AS edges""")
def codegraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    label = lambda x: F.array(F.lit(x)).alias("labels")
    none = F.lit(None).cast("int").alias("loc")
    nodes = p.select(label("Function"), "loc").unionAll(p.select("owner").distinct().select(label("File"), none)).unionAll(p.select("owner", "klass").distinct().select(label("Class"), none))
    return graph.code_stats(nodes, calls(spark, sf_dir))


@query(f"WITH {SQL_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 5")
def hubs_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(star(spark, sf_dir)[1])


@query(f"WITH {SQL_CALLS} SELECT p_partkey AS id, count(dst) AS calls FROM part LEFT JOIN transitions ON dst = p_partkey GROUP BY p_partkey")
def call_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.call_counts(parts(spark, sf_dir), transitions(spark, sf_dir).withColumn("type", F.lit("CALLS")))


@query(f"WITH {SQL_CALLS} SELECT src, string_agg(DISTINCT dst::VARCHAR, ',' ORDER BY dst::VARCHAR) AS targets FROM calls GROUP BY src")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = calls(spark, sf_dir).select("src", F.col("dst").cast("string").alias("dst"), F.lit("CALLS").alias("type"))
    return graph.adjacency(edges, "CALLS").select("src", F.array_join("targets", ",").alias("targets"))


@query("""SELECT url AS path, CASE WHEN regexp_matches(url, 'db/|models/|storage/|schema/|repository/') THEN 'DATA' WHEN regexp_matches(url, 'api/|server/|cli/|routes/|main\\.py$') THEN 'API'
WHEN regexp_matches(url, 'core/|services/|agents/|tools/|utils/') THEN 'CORE' END AS layer FROM
(SELECT url FROM pages UNION ALL SELECT unnest(['api/db/x.py', 'src/core/a.py', 'x/main.py', 'models/m.py', 'core/api/y.py', 'z.py']))""")
def layer_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(x,) for x in ("api/db/x.py", "src/core/a.py", "x/main.py", "models/m.py", "core/api/y.py", "z.py")], "path string")
    return graph.tag_layers(table(spark, sf_dir, "pages").select(F.col("url").alias("path")).unionAll(made)).select("path", "layer")


@query(f"WITH {SQL_CALLS} SELECT f.p_partkey AS id FROM part f WHERE NOT EXISTS (SELECT 1 FROM transitions JOIN part c ON src = c.p_partkey WHERE dst = f.p_partkey AND c.p_brand = f.p_brand) AND f.p_name NOT IN ('__init__', '__main__', 'main')")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that no function of their own file calls."""
    p, t = parts(spark, sf_dir), transitions(spark, sf_dir)
    a, b = (p.select(F.col("id").alias(x), F.col("owner").alias(f"of_{x}")) for x in ("src", "dst"))
    inside = t.join(a, "src").join(b, "dst").where("of_src = of_dst").select("src", "dst", F.lit("CALLS").alias("type"))
    return graph.dead_nodes(p, inside).select("id")


@query(f"WITH {SQL_EDGES} SELECT src AS id, count(*) AS n FROM edges WHERE type = 'ORDERED' GROUP BY src HAVING count(*) > 15")
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree_above(*star(spark, sf_dir), ("ORDERED",), 15).select("id", "n")


@query(f"WITH {SQL_EDGES} SELECT src AS id, count(*) AS n FROM edges WHERE type IN ('ORDERED', 'IN_NATION') GROUP BY src HAVING count(*) > 10")
def tight_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree_above(*star(spark, sf_dir), ("ORDERED", "IN_NATION"), 10).select("id", "n")


@query(f"WITH {SQL_NODES} SELECT CASE WHEN id = 'part:1' THEN 'renamed' ELSE name END AS name, id, CASE WHEN id = 'part:new' THEN 'k' ELSE kind END AS kind FROM (SELECT id, name, kind FROM nodes UNION ALL SELECT 'part:new', 'made', NULL)")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star(spark, sf_dir)[0].select("id", "name", "kind")
    changes = spark.createDataFrame([(1, "part:1", "first", None), (2, "part:1", "renamed", None), (1, "part:new", "made", "k")], "seq int, id string, name string, kind string")
    return graph.upsert_nodes(nodes, changes)


@query(f"""WITH {SQL_EDGES}, d AS (SELECT src, dst, max(type) AS type FROM (SELECT DISTINCT src, dst, type FROM edges) GROUP BY src, dst)
SELECT src, dst, CASE WHEN src = 'nation:1' AND dst = 'region:1' THEN 'MOVED' ELSE type END AS type FROM d UNION ALL SELECT 'nation:1', 'region:9', 'NEW'""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star(spark, sf_dir)[1]
    changes = spark.createDataFrame([(1, "nation:1", "region:1", "OLD"), (2, "nation:1", "region:1", "MOVED"), (1, "nation:1", "region:9", "NEW")], "seq int, src string, dst string, type string")
    return graph.upsert_edges(edges, changes)


@query(f"WITH {SQL_NODES}, {SQL_EDGES} SELECT 'node' AS what, count(*) AS n FROM nodes WHERE id NOT IN ('nation:3', 'part:7') UNION ALL SELECT 'edge', count(*) FROM edges WHERE src NOT IN ('nation:3', 'part:7') AND dst NOT IN ('nation:3', 'part:7')")
def delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph.delete_node(*star(spark, sf_dir), spark.createDataFrame([("nation:3",), ("part:7",)], "id string"))
    return nodes.agg(F.lit("node").alias("what"), F.count("*").alias("n")).unionAll(edges.agg(F.lit("edge"), F.count("*")))


@query("""SELECT 'graph TD' || chr(10) || string_agg('    nation_' || n_nationkey || '["nation:' || n_nationkey || '"] --> region_' || n_regionkey || '["region:' || n_regionkey || '"]', chr(10) ORDER BY 'nation:' || n_nationkey, 'region:' || n_regionkey) AS text FROM nation""")
def mermaid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mermaid_graph(graph.find_edges(star(spark, sf_dir)[1], type="IN_REGION"))


# Links


@query("""WITH c AS (SELECT event_id AS call_id, event_type || '.' || (CASE WHEN user_id % 2 = 0 THEN 'Supplier#' || lpad((user_id % 9)::VARCHAR, 9, '0') ELSE 'none' END) AS callee FROM events)
SELECT call_id, (SELECT min(id) FROM (SELECT 'supplier::' || s_name AS id, s_name AS name FROM supplier) f WHERE f.name = string_split(callee, '.')[-1] OR f.id LIKE '%::' || string_split(callee, '.')[-1]) AS target_id FROM c""")
def link_calls_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 9).cast("string"), 9, "0"))).otherwise("none")
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.concat_ws(".", "event_type", made).alias("callee"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier::"), "s_name").alias("id"), F.col("s_name").alias("name"))
    return impact.link_by_simple_name(asked, known).select("call_id", "target_id")


@query("""WITH c AS (SELECT o_orderkey AS call_id, o_custkey % 25 AS file_id, (o_orderkey % 40)::VARCHAR AS callee FROM orders)
SELECT call_id, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = file_id AND (s_suppkey % 40)::VARCHAR = callee), (SELECT min(c_custkey) + 1000000 FROM customer WHERE c_nationkey = file_id AND (c_custkey % 40)::VARCHAR = callee)) AS target FROM c""")
def link_local_or_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 25).alias("file_id"), (F.col("o_orderkey") % 40).cast("string").alias("callee"))
    local = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("file_id"), (F.col("s_suppkey") % 40).cast("string").alias("name"), F.col("s_suppkey").alias("id"))
    other = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("file_id"), (F.col("c_custkey") % 40).cast("string").alias("name"), (F.col("c_custkey") + 1000000).alias("id"))
    return impact.link_local_or_imported(asked, local, other).select("call_id", "target")


@query("""WITH n AS (SELECT DISTINCT regexp_extract(url, '([^/]+)$', 1) AS name FROM pages WHERE url LIKE '%.html')
SELECT DISTINCT name, url AS path FROM n JOIN pages ON url LIKE '%' || replace(replace(name, '_', '\\_'), '%', '\\%') ESCAPE '\\' OR url LIKE '%' || replace(replace(name, '_', '\\_'), '%', '\\%') || '.h' ESCAPE '\\' OR url LIKE '%' || replace(replace(name, '_', '\\_'), '%', '\\%') || '.py' ESCAPE '\\'""")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wanted = pages.where("url like '%.html'").select(F.regexp_extract("url", "([^/]+)$", 1).alias("name")).distinct()
    return impact.suffix_join(wanted, pages.select(F.col("url").alias("path")))


@query("""WITH names AS (SELECT DISTINCT replace(p_name, ' ', '.') || '.' || p_brand || '.' || p_size AS name FROM part), mods AS (SELECT DISTINCT replace(p_name, ' ', '.') AS module FROM part WHERE p_size < 20 UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)
SELECT name, (SELECT max_by(module, length(module)) FROM mods WHERE name = module OR starts_with(name, module || '.')) AS module FROM names""")
def longest_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    dotted = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    names = p.select(F.concat_ws(".", dotted, "p_brand", F.col("p_size").cast("string")).alias("name")).distinct()
    modules = p.where("p_size < 20").select(dotted.alias("module")).union(p.select(F.substring_index("p_name", " ", 1))).distinct()
    return impact.longest_prefix_join(names, modules.withColumn("path", F.col("module"))).select("name", "module")


@query("""WITH r AS (SELECT o_custkey % 50 AS k, o_orderkey % 1000 AS a, o_orderkey % 1000 + 10 AS b, o_orderkey::VARCHAR AS name FROM orders), e AS (SELECT event_id, user_id % 60 AS k, event_id % 1000 AS line FROM events)
SELECT event_id, coalesce((SELECT arg_min(name, (a, name)) FROM r WHERE r.k = e.k AND line BETWEEN a AND b), '<global>') AS name FROM e""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), (F.col("o_orderkey") % 1000).alias("a"), (F.col("o_orderkey") % 1000 + 10).alias("b"), F.col("o_orderkey").cast("string").alias("name"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 60).alias("k"), (F.col("event_id") % 1000).alias("line"))
    return impact.range_join(e, o, "k", "line", "a", "b", "name").select("event_id", "name")


@query("""WITH p AS (SELECT unnest(['a/b/c.py', 'a/b/__init__.py', 'top.py', '__init__.py', 'x/y.txt']) AS path UNION ALL SELECT 'pkg' || (p_size % 7) || '/' || replace(p_name, ' ', '/') || '/m' || p_partkey || '.py' FROM part)
SELECT replace(regexp_replace(path, '(/__init__)?\\.py$', ''), '/', '.') AS module, path FROM p WHERE path LIKE '%.py'""")
def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(x,) for x in ("a/b/c.py", "a/b/__init__.py", "top.py", "__init__.py", "x/y.txt")], "path string")
    own = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg"), (F.col("p_size") % 7).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return impact.module_map(made.unionAll(own))


@query("""SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 'tests/test_' || replace(p_name, ' ', '_') || p_partkey || '.py' AS path FROM part WHERE p_size > 25) t
WHERE contains(t.path, replace(p_name, ' ', '_') || p_partkey))""")
def loose_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), "p_size")
    tests = p.where("p_size > 25").select(F.concat(F.lit("tests/test_"), F.replace("path", F.lit("src/"), F.lit(""))).alias("path")).distinct()
    return impact.loose_tests(p.select("id", "path"), tests).select("id")


# Impact and paths


@query(f"""WITH {SQL_CALLS}, {SQL_BUSIEST}, d AS (SELECT DISTINCT src AS id FROM calls WHERE dst = (SELECT id FROM busiest)), s AS (SELECT DISTINCT src AS id FROM calls WHERE dst IN (SELECT id FROM d)), x AS (SELECT (SELECT count(*) FROM d) AS direct, (SELECT count(*) FROM s) AS transitive)
SELECT direct, transitive, (direct * 10 + transitive * 5) * 1.5::DOUBLE AS risk_score FROM x""")
def impact_direct_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return impact.impact(c, busiest(c))


@query(f"""WITH {SQL_CALLS}, {SQL_BUSIEST}, d AS (SELECT DISTINCT src AS via FROM calls WHERE dst = (SELECT id FROM busiest)) SELECT src AS id, min(via) AS via FROM calls JOIN d ON dst = via GROUP BY src""")
def second_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return impact.second_callers(c, busiest(c))


@query(f"""WITH {SQL_CALLS}, own AS (SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')) SELECT id FROM own UNION SELECT src FROM calls WHERE dst IN (SELECT id FROM own)""")
def affected_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    defines = parts(spark, sf_dir).select(F.col("owner").alias("src"), F.col("id").alias("dst"))
    return impact.affected(defines, calls(spark, sf_dir), spark.createDataFrame([("Brand#1",), ("Brand#2",)], "id string"))


@query(f"""WITH {SQL_CALLS}, {SQL_BUSIEST}, one AS (SELECT src, dst FROM calls WHERE dst = (SELECT id FROM busiest)), two AS (SELECT m.src, m.dst FROM calls m JOIN one o ON m.dst = o.src),
x AS (SELECT src FROM one UNION ALL SELECT t.src FROM two t) SELECT count(*) AS paths, count(DISTINCT src) AS nodes, (SELECT count(DISTINCT src) FROM one) AS direct, CASE WHEN count(DISTINCT src) > 5 THEN 'High' ELSE 'Low' END AS risk_level FROM x""")
def impact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return impact.impact_paths(c, busiest(c))


@query(f"""WITH {SQL_CALLS}, {SQL_BUSIEST}, p0 AS (SELECT [id] AS path FROM busiest), p1 AS (SELECT list_append(path, dst) AS path FROM p0 JOIN calls ON src = path[-1]),
p2 AS (SELECT list_append(path, dst) AS path FROM p1 JOIN calls ON src = path[-1]),
p3 AS (SELECT list_append(path, dst) AS path FROM p2 JOIN calls ON src = path[-1] WHERE NOT (path[1] = src AND path[2] = dst)),
a AS (SELECT path, len(path) - 1 AS hops FROM (SELECT path FROM p0 UNION ALL SELECT path FROM p1 UNION ALL SELECT path FROM p2 UNION ALL SELECT path FROM p3) ORDER BY hops, path LIMIT 50),
e AS (SELECT path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, hops + 1)) AS i FROM a)) SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst""")
def call_graph_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return paths.call_graph(c, busiest(c))


def _cycles_sql(result: str = "SELECT array_to_string(path, '>') AS path, length FROM found", within: str | None = None) -> str:
    """Cycles by length; those of a length are sought only where shorter ones are fewer than ten sets of nodes."""
    steps, shorter = [], []
    held = f" AND list_has_any([e1.src, e1.dst, {{}}], (SELECT list(id) FROM {within}))" if within else ""
    for n in range(2, 6):
        few = " + ".join(f"(SELECT count(DISTINCT list_sort(list_distinct(path))) FROM c{m})" for m in shorter) or "0"
        steps.append(f"f{n} AS (SELECT src, dst FROM calls WHERE {few} < 10)")
        joins = " ".join(f"JOIN f{n} e{i} ON e{i}.src = e{i - 1}.dst" for i in range(2, n + 1))
        distinct = " AND ".join(f"(e{i}.src, e{i}.dst) <> (e{j}.src, e{j}.dst)" for i in range(1, n + 1) for j in range(1, i)) or "true"
        steps.append(f"c{n} AS (SELECT [{', '.join(f'e{i}.src' for i in range(1, n + 1))}, e1.src] AS path, {n} AS length FROM f{n} e1 {joins} WHERE e{n}.dst = e1.src AND {distinct}{held.format(', '.join(f'e{i}.dst' for i in range(2, n + 1)))})")
        shorter.append(n)
    return f"""WITH {SQL_CALLS}, {SQL_MEMBERS + ', ' if within else ''}{', '.join(steps)}, a AS ({' UNION ALL '.join(f'SELECT * FROM c{n}' for n in shorter)}), b AS (SELECT path, length, list_sort(list_distinct(path)) AS s FROM a),
c AS (SELECT path, length, row_number() OVER (PARTITION BY s ORDER BY length, path) AS r FROM b),
found AS (SELECT path, length FROM c WHERE r = 1 ORDER BY length, c.path LIMIT 10) {result}"""


#: Parts tied to the first two brands as their files: those of the brand, and those that such a part defines (the next key, of a big part).
SQL_MEMBERS = """ties AS (SELECT p_brand AS a, p_partkey::VARCHAR AS b FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey::VARCHAR, (p_partkey + 1)::VARCHAR FROM part WHERE p_size > 25), undirected AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
files AS (SELECT DISTINCT p_brand AS id FROM part ORDER BY 1 LIMIT 2), near AS (SELECT b AS id FROM undirected WHERE a IN (SELECT id FROM files)), tied AS (SELECT try_cast(id AS BIGINT) AS id FROM (SELECT id FROM near UNION SELECT b FROM undirected WHERE a IN (SELECT id FROM near)) WHERE id NOT IN (SELECT id FROM files) AND try_cast(id AS BIGINT) IS NOT NULL)"""


@query(_cycles_sql())
def cycles_2_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.cycles(calls(spark, sf_dir)).select(text_path().alias("path"), "length")


@query(_cycles_sql(within="tied"))
def repository_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of calls that hold a function tied to the files of a repository by one or two definitions."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    ties = p.where("p_size <= 25").select(F.col("p_brand").alias("src"), key.cast("string").alias("dst")).unionAll(p.where("p_size > 25").select(key.cast("string"), (key + 1).cast("string")))
    own = paths.members(ties, p.select(F.col("p_brand").alias("id")).distinct().orderBy("id").limit(2)).select(F.col("id").try_cast("bigint").alias("id")).where("id is not null")
    return paths.cycles(calls(spark, sf_dir), within=own).select(text_path().alias("path"), "length")


@query(_cycles_sql("SELECT 'circular_dependency' AS type, 'critical' AS severity, array_to_string(path, ' -> ') AS description FROM found"))
def circular_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.circular_issues(paths.cycles(calls(spark, sf_dir)))


#: Three relations between parts: calls of odd orders only, imports of the part 7 keys on, dependencies within a brand and size.
SQL_TYPED = """typed AS (SELECT DISTINCT src, dst, 'CALLS' AS type FROM calls WHERE (src + dst) % 5 = 0 UNION ALL SELECT p_partkey, p_partkey + 7, 'IMPORTS' FROM part UNION ALL SELECT a.p_partkey, b.p_partkey, 'DEPENDS_ON' FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 60)"""


def _typed_sql(most: int = 14) -> str:
    """Breadth first, level by level: a node's place is that of the path that reaches it first."""
    steps = ["l0 AS (SELECT (SELECT min(p_partkey) FROM part) AS id, []::BIGINT[] AS place, [(SELECT min(p_partkey) FROM part)] AS path)"]
    for i in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(i))
        done = " OR ".join(f"EXISTS (SELECT 1 FROM l{j} WHERE id = (SELECT id FROM goal))" for j in range(i))
        steps.append(f"""l{i} AS (SELECT dst AS id, min(list_concat(place, [CASE type WHEN 'CALLS' THEN 1 WHEN 'IMPORTS' THEN 2 ELSE 3 END, dst])) AS place, arg_min(list_append(path, dst), list_concat(place, [CASE type WHEN 'CALLS' THEN 1 WHEN 'IMPORTS' THEN 2 ELSE 3 END, dst])) AS path
FROM l{i - 1} JOIN typed ON src = id WHERE dst NOT IN ({seen}) AND NOT ({done}) GROUP BY dst)""")
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(most + 1))
    return f"WITH {SQL_CALLS}, {SQL_TYPED}, goal AS (SELECT max(p_partkey) AS id FROM part), {', '.join(steps)} SELECT array_to_string(path, '>') AS path, len(path) - 1 AS distance FROM ({every}) WHERE id = (SELECT id FROM goal)"


@query(_typed_sql())
def typed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path over calls, imports and dependencies, in this order of preference."""
    p, edge = table(spark, sf_dir, "part"), calls(spark, sf_dir)
    made = edge.where("(src + dst) % 5 = 0").select("src", "dst", F.lit("CALLS").alias("type"))
    made = made.unionAll(p.select("p_partkey", F.col("p_partkey") + 7, F.lit("IMPORTS")))
    a, b = p.select("p_brand", F.col("p_partkey").alias("src")), p.select("p_brand", F.col("p_partkey").alias("dst"))
    near = a.select("p_brand", "src", F.explode(F.sequence(F.col("src") + 1, F.col("src") + 60)).alias("dst")).join(b, ["p_brand", "dst"])
    made = made.unionAll(near.select("src", "dst", F.lit("DEPENDS_ON"))).withColumn("place", F.col("dst"))
    ends = p.agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    return paths.typed_path(made, ends.select(F.col("a").alias("id")), ends.select(F.col("b").alias("id"))).select(text_path().alias("path"), "distance")


@query(f"""WITH {SQL_CALLS}, {SQL_BUSIEST}, d1 AS (SELECT DISTINCT src AS id FROM calls WHERE dst = (SELECT id FROM busiest) AND src <> (SELECT id FROM busiest)),
d2 AS (SELECT DISTINCT src AS id FROM calls WHERE dst IN (SELECT id FROM d1)), d3 AS (SELECT DISTINCT src AS id FROM calls WHERE dst IN (SELECT id FROM d2)), d4 AS (SELECT DISTINCT src AS id FROM calls WHERE dst IN (SELECT id FROM d3))
SELECT id, min(distance) AS distance FROM (SELECT id, 1 AS distance FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3 UNION ALL SELECT id, 4 FROM d4) WHERE id <> (SELECT id FROM busiest) GROUP BY id""")
def ripple_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return paths.ripple(c, busiest(c))


def _shortest_sql(most: int = 8) -> str:
    """Level by level; the tables' graphs are far less deep than `most`."""
    steps = ["l0 AS (SELECT min(src) AS id, [min(src)] AS path FROM calls)"]
    for i in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(i))
        steps.append(f"l{i} AS (SELECT dst AS id, min(list_append(path, dst)) AS path FROM l{i - 1} JOIN calls ON src = id WHERE dst NOT IN ({seen}) GROUP BY dst)")
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(most + 1))
    return f"WITH {SQL_CALLS}, {SQL_BUSIEST}, {', '.join(steps)} SELECT array_to_string(path, '>') AS path, len(path) - 1 AS distance FROM ({every}) WHERE id = (SELECT id FROM busiest)"


@query(_shortest_sql())
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return paths.shortest_path(c, c.agg(F.min("src").alias("id")), busiest(c)).select(text_path().alias("path"), "distance")


def _importance_sql(rounds: int = 5) -> str:
    steps = ["s0 AS (SELECT p_partkey AS id, 1.0::DOUBLE AS score FROM part)"]
    for i in range(1, rounds + 1):
        steps.append(f"s{i} AS (SELECT p_partkey AS id, 1 + coalesce(more, 0) AS score FROM part LEFT JOIN (SELECT dst, sum(score * n / 2) AS more FROM s{i - 1} JOIN calls ON id = src GROUP BY dst) x ON dst = p_partkey)")
    return f"WITH {SQL_CALLS}, {', '.join(steps)}, scored AS (SELECT id, score / (SELECT max(score) FROM s{rounds}) AS score FROM s{rounds})"


@query(f"{_importance_sql()} SELECT id, round(score, 6) AS score FROM scored")
def importance_5rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.importance(parts(spark, sf_dir), transitions(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"""{_importance_sql()}, c AS (SELECT dst AS id, count(*) AS calls FROM transitions GROUP BY dst), t AS (SELECT id, score, coalesce(calls, 0) AS calls FROM scored LEFT JOIN c USING (id) ORDER BY score DESC, id LIMIT 10)
SELECT id, round(score, 6) AS score, calls, score > 0.5 AS is_critical, CASE WHEN score > 0.7 AND calls > 5 THEN 'critical' WHEN score > 0.5 AND calls > 3 THEN 'important' WHEN score > 0.3 THEN 'watch' ELSE 'fine' END AS suggestion FROM t""")
def criticality_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.criticality(parts(spark, sf_dir), transitions(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT 's' || s_suppkey AS src, 'c' || c_custkey AS dst FROM (SELECT o_custkey % 25 AS f, (o_orderkey % 30)::VARCHAR AS caller, (o_orderkey % 90)::VARCHAR AS callee FROM orders) JOIN supplier ON s_nationkey = f AND (s_suppkey % 30)::VARCHAR = caller JOIN customer ON (1000 + c_custkey % 90)::VARCHAR = '10' || lpad(callee, 2, '0')")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("int").alias("file_id"), (F.col("o_orderkey") % 30).cast("string").alias("caller"), F.concat(F.lit("10"), F.lpad((F.col("o_orderkey") % 90).cast("string"), 2, "0")).alias("callee"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file_id"), (F.col("s_suppkey") % 30).cast("string").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    c = table(spark, sf_dir, "customer").select(F.lit(-1).alias("file_id"), (1000 + F.col("c_custkey") % 90).cast("string").alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.call_edges(o, s.unionAll(c))


@query("SELECT 'r:build:' || p_brand AS src, 'r:' || p_partkey AS dst, 'DEPENDS_ON' AS type FROM part")
def build_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parts(spark, sf_dir).groupBy(F.col("owner").alias("name")).agg(F.collect_list(F.col("id").cast("string")).alias("files"))
    return graph.build_targets(t, "r")[1]
