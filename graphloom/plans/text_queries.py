"""Queries on texts, code and file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import code, text
from graphloom.plans.catalog import query
from graphloom.plans.datasets import table
from graphloom.sources import files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("""WITH l AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN [] ELSE list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) END AS l FROM documents),
n AS (SELECT doc_id, len(l) AS total, len(list_filter(l, lambda x: x = '')) AS blank, len(list_filter(l, lambda x: regexp_matches(x, '^(#|//|/\\*|\\*|--|%)'))) AS comment FROM l) SELECT doc_id, total, blank, comment, total - blank - comment AS code FROM n""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.line_counts(F.col("text")).alias("x")).select("doc_id", "x.*")


@query("""SELECT doc_id, round(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 6) AS ratio FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents)""")
def unique_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(text.unique_ratio(F.col("text")), 6).alias("ratio"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g'), '[\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g') AS t FROM documents), w AS (SELECT doc_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM a)
SELECT doc_id, trim(left(CASE WHEN len(w) > 30 AND len(list_distinct(w)) < 0.1 * len(w) THEN array_to_string(w[1:30], ' ') ELSE t END, 800)) AS text FROM w""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps but the shortening of runs, which SQL without back-references can't express; that is
    normalize_runs."""
    return documents(spark, sf_dir).select("doc_id", text.cap(text.collapse(F.col("text"))).alias("text"))


@query()
def normalize_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("text"))


@query("""WITH s AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(0, ceil((length(text) - 2000) / 1600.0))::INT + 1)) AS i FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, n, i, substring(text, i * 1600 + 1, 2000) AS w FROM s), b AS (SELECT *, position(chr(10) IN reverse(w)) AS p FROM w)
SELECT doc_id, CASE WHEN n > 2000 THEN i + 1 ELSE 0 END AS part, i * 1600 AS start, md5(CASE WHEN i * 1600 + 2000 < n AND p > 0 AND p < 100 THEN left(w, length(w) - p + 1) ELSE w END) AS digest FROM b""")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.sliding_chunks(documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "part", "start", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 3000 THEN left(text, 2000) || '~' || right(text, 500) ELSE text END) AS digest FROM documents")
def head_tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(text.head_tail(F.col("text"), 3000, 2000, 500, "~").cast("binary")).alias("digest"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT page_id, unnest(regexp_extract_all(url, '\\b[\\w-]+\\.\\w+\\b')) AS name FROM pages")
def file_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.mentions(F.col("url"))).alias("name"))


def _fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    path = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(":src/m"), F.col("conv_id").cast("string"), F.lit(".py"))).otherwise("")
    return c.select("id", F.concat(F.col("text"), F.lit("\n```python"), path, F.lit("\nx = "), F.col("id").cast("string"), F.lit("\n```\n```\nplain\n```\n")).alias("text"))


@query("""SELECT conv_id * 1000 + turn AS id, k AS n, CASE WHEN k = 0 AND turn % 2 = 0 THEN 'src/m' || conv_id || '.py' ELSE '' END AS path, CASE WHEN k = 0 THEN 'x = ' || (conv_id * 1000 + turn) || chr(10) ELSE 'plain' || chr(10) END AS code FROM conversations, (SELECT unnest([0, 1]) AS k)""")
def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.fences(_fenced(spark, sf_dir), "id", "text")


@query("SELECT o_custkey AS id, 'f' || o_orderkey || '.py' AS path, 'diff --git a/f' || o_orderkey || '.py b/f' || o_orderkey || '.py' || chr(10) || '+' || o_orderstatus AS hunk FROM orders")
def diff_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".py"))
    hunk = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n+"), F.col("o_orderstatus"))
    diffs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("about\n"), F.array_join(F.array_sort(F.collect_list(hunk)), "\n")).alias("diff"))
    return text.split_diff(diffs, "id", "diff")


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) >= 4 THEN array_to_string(l[2:4], chr(10)) ELSE '' END) AS digest FROM d""")
def line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(text.line_range(F.col("text"), F.lit(2), F.lit(4)).cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT event_id, 'user ' || user_id AS s, event_type AS p, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE 'value' END AS o, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'x' ELSE (value / 100)::VARCHAR END AS c FROM events)
SELECT event_id, coalesce(try_cast(c AS DOUBLE), 1.0) AS confidence FROM t WHERE trim(o) <> '' AND coalesce(try_cast(c AS DOUBLE), 1.0) > 0.6""")
def valid_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sure = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, "x").otherwise((F.col("value") / 100).cast("string"))
    t = e.select("event_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.when(F.col("event_id") % 7 == 0, "  ").otherwise("value").alias("object"), sure.alias("confidence"))
    return text.valid_triples(t).select("event_id", "confidence")


@query("SELECT 'user ' || user_id AS src, 'DID_' || upper(event_type) AS type, 'it' AS dst, max(value) AS confidence FROM events GROUP BY user_id, event_type")
def fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), F.concat(F.lit(" did "), F.col("event_type")).alias("predicate"), F.lit("it").alias("object"), F.col("value").alias("confidence"))
    return text.fact_edges(t)[1]


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN props END AS json FROM events""")
def salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done"))).otherwise("no json")
    return e.select("event_id", text.salvage_json(said).alias("json"))


# Lists of files: every page and part gives a path


SQL_PATHS = """paths AS (SELECT url || '/' || CASE page_id % 9 WHEN 0 THEN 'a.py' WHEN 1 THEN 'venv/b.js' WHEN 2 THEN 'Makefile' WHEN 3 THEN '.git/c.ts' WHEN 4 THEN 'd.TSX' WHEN 5 THEN 'e.bin' WHEN 6 THEN 'src/env.go' WHEN 7 THEN 'x.so' ELSE 'build/f.c' END AS path, length(html) AS length FROM (SELECT page_id, 'r' || page_id AS url, html FROM pages))"""


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("a.py", "venv/b.js", "Makefile", ".git/c.ts", "d.TSX", "e.bin", "src/env.go", "x.so", "build/f.c")
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("r"), F.col("page_id").cast("string"), F.lit("/"), pick).alias("path"), F.length("html").cast("bigint").alias("length"), F.col("html").cast("binary").alias("content"))


@query(f"WITH {SQL_PATHS} SELECT path FROM paths WHERE NOT regexp_matches(path, '(^|/)(venv|__pycache__|node_modules|dist|build|\\.[^/]*)(/|$)') AND regexp_matches(path, '(?i)\\.(py|js|ts|tsx|go|c)$|(^|/)Makefile$')")
def repo_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.repo_files(file_list(spark, sf_dir)).select("path")


@query(f"""WITH {SQL_PATHS} SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript (React)' WHEN '.go' THEN 'Go' WHEN '.c' THEN 'C' ELSE 'Unknown' END AS language,
CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.c' THEN 'c' END AS parser FROM paths""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_list(spark, sf_dir).select("path", files.language_of(F.col("path")).alias("language"), code.parser_of(F.col("path")).alias("parser"))


@query(f"WITH {SQL_PATHS} SELECT path FROM paths WHERE regexp_matches(path, '(?i)\\.(py|js|ts|tsx|go|c)$') AND NOT regexp_matches(path, '__pycache__|\\.git|venv|env|node_modules|build|dist') AND NOT path LIKE '%.so'")
def metric_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.metric_files(file_list(spark, sf_dir)).select("path")


@query(f"WITH {SQL_PATHS} SELECT lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS extension, count(*) AS files, sum(length)::BIGINT AS bytes FROM paths WHERE NOT contains(path, '.git') GROUP BY 1")
def scan_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.overview(file_list(spark, sf_dir))


@query("SELECT page_id, 'repo_' || substr(md5(regexp_replace(lower(trim(url)), '\\.git$', '')), 1, 8) AS repo FROM pages")
def repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.repo_id(F.col("url")).alias("repo"))


@query(f"WITH {SQL_PATHS} SELECT page_id, path FROM pages JOIN paths ON path LIKE 'r' || page_id || '/%'")
def expanded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = file_list(spark, sf_dir)
    said = listed.select(F.regexp_extract("path", r"^r(\d+)/", 1).cast("bigint").alias("page_id"), F.concat(F.lit("see @"), F.col("path"), F.lit(", and @missing/file")).alias("text"))
    return files.expand_references(said, listed, "page_id", "text").select("page_id", "path")
