"""Parsers and scanners of one's own: each reads the files of its endings into rows of its own schema, as a
table function of SQL or over a table of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass(frozen=True)
class Plugin:
    """read: from a path and its text to rows of `schema` (a DDL string). endings: of the paths it reads, none
    for all. A file that `read` fails on gives a row whose columns are null; see `errors`."""

    name: str
    schema: str
    read: Callable[[str, str], Iterable[tuple]]
    endings: tuple[str, ...] = ()

    def reads(self, path: str | None) -> bool:
        return path is not None and (not self.endings or path.lower().endswith(self.endings))

    def rows(self, path: str | None, text: str | None, columns: int) -> Iterable[tuple]:
        """(rows..., error): error is what `read` raised, null for the rows that it gave, of so many columns."""
        if not self.reads(path):
            return
        try:
            for row in self.read(path, text or ""):
                yield (*row, None)
        except Exception as e:  # whatever a plug-in raises concerns its file only
            yield (*[None] * columns, f"{type(e).__name__}: {e}")

    def fields(self) -> list[StructField]:
        """Of its schema; asked for in the driver, where there is a session that reads it."""
        return list(DataType.fromDDL(self.schema).fields)


class Plugins:
    """A set of plug-ins by name. register() makes them one polymorphic table function: its columns are those of
    the plug-in that is named: `SELECT f.path, p.* FROM files f, LATERAL scan_with('todo', f.path, f.content) p`."""

    def __init__(self, *plugins: Plugin):
        self.plugins = {p.name: p for p in plugins}

    def add(self, plugin: Plugin) -> Plugins:
        return Plugins(*(self.plugins | {plugin.name: plugin}).values())

    def register(self, spark: SparkSession, name: str = "scan_with") -> None:
        known, fields = self.plugins, {n: p.fields() for n, p in self.plugins.items()}

        class ScanWith:
            @staticmethod
            def analyze(plugin: AnalyzeArgument, path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
                if plugin.value not in known:
                    raise ValueError(f"no plug-in {plugin.value!r}; there are {', '.join(sorted(known)) or 'none'}")
                return AnalyzeResult(schema=StructType([*fields[plugin.value], StructField("error", StringType())]))

            def eval(self, plugin: str, path: str, content: str):
                yield from known[plugin].rows(path, content, len(fields[plugin]))

        spark.udtf.register(name, udtf(ScanWith))

    def scan(self, files: DataFrame, name: str) -> DataFrame:
        """(path, columns of the plug-in, error) of files(path, content); only files of its endings are sent to Python."""
        plugin = self.plugins[name]
        columns = len(plugin.fields())

        class Scan:
            def eval(self, path: str, content: str):
                yield from plugin.rows(path, content, columns)

        made = udtf(Scan, returnType=f"{plugin.schema}, error string")
        own = files.select("path", F.col("content").cast("string").alias("content"))
        if plugin.endings:
            any_of = F.lit(False)
            for end in plugin.endings:
                any_of = any_of | F.endswith(F.lower("path"), F.lit(end))
            own = own.where(any_of)
        return own.lateralJoin(made(F.col("path").outer(), F.col("content").outer())).drop("content")


def _todos(path: str, text: str) -> Iterable[tuple]:
    for n, line in enumerate(text.splitlines(), 1):
        for mark in ("TODO", "FIXME"):
            at = line.find(mark)
            if at >= 0:
                yield n, mark, line[at + len(mark) :].lstrip(": ").strip()


def _markdown(path: str, text: str) -> Iterable[tuple]:
    fenced = False
    for n, line in enumerate(text.splitlines(), 1):
        fenced ^= line.startswith("```")
        level = len(line) - len(line.lstrip("#"))
        if not fenced and 0 < level < 7 and line[level : level + 1] == " ":
            yield n, level, line[level:].strip()


#: Two to begin with: marked lines of any file, and the headings of Markdown.
BUILT_IN = Plugins(Plugin("todo", "line int, mark string, text string", _todos), Plugin("headings", "line int, level int, title string", _markdown, (".md", ".markdown")))
