"""State kept in files: JSON documents, snapshots, logs, and the tables of graphs and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "id string, name string, created_at timestamp, tags array<string>, metadata map<string,string>"
REPORT = "ts string, score double, body string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents with a fixed schema; fields that a document lacks are null, documents
    that are no JSON are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(report: DataFrame, path: str, ts: Column) -> None:
    """Appends a report under the second it was made in: one folder each, so the newest is found by name."""
    report.withColumn("ts", F.date_format(ts, "yyyyMMdd_HHmmss")).write.mode("append").partitionBy("ts").json(path)


def latest_snapshot(reports: DataFrame, name: str = "ts") -> DataFrame:
    """The rows of the report with the greatest name. The names are read from the folders alone."""
    return reports.join(F.broadcast(reports.agg(F.max(name).alias(name))), name)


def append_log(lines: DataFrame, path: str, kind: str) -> None:
    """Appends lines(ts, text) to a log of findings, progress or plans."""
    lines.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").json(path)


def markdown(sections: DataFrame) -> DataFrame:
    """One row: report sections(section, rows) as Markdown, in order of their names."""
    block = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r)), "\n"))
    return sections.agg(F.array_sort(F.collect_list(F.struct("section", block.alias("b")))).alias("x")).select(F.concat(F.lit("# Report\n\n"), F.array_join(F.transform("x", lambda r: r["b"]), "\n\n")).alias("text"))


def summaries(files: DataFrame) -> DataFrame:
    """files(path, language, loc, functions) as one sentence each, to be embedded."""
    return files.select("path", F.format_string("%s is a %s file of %d lines; it defines %s.", "path", "language", "loc", F.coalesce(F.nullif(F.array_join("functions", ", "), F.lit("")), F.lit("nothing"))).alias("content"))
