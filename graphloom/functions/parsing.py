"""Whole files as rows of symbols: each file is parsed once, in an Arrow function, by the parser of its
ending; what lies in what, and the graphs, are expressions and explosions of that one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from graphloom.functions.brace import Symbols
from graphloom.functions.code import PARSED, parse, parser_of

#: What is known of a function only where a tree is.
_NO = {"args": None, "signature": None, "returns": None, "docstring": None, "complexity": None, "last": None, "within": None}


def _read(language: str | None, source: str | None) -> dict | None:
    if language == "python":
        return parse(source)
    if language is None:
        return None
    found = Symbols(language, source or "")
    return {
        "functions": [_NO | f for f in found.functions],
        "classes": [{"bases": None, "docstring": None, "last": None, "methods": None} | c for c in found.classes],
        "imports": [{"module": x, "names": None, "alias": None, "level": 0} for x in found.imports],
        "calls": [{"caller": None, "confidence": 1.0, "is_dynamic": False} | c for c in found.calls],
        "loc": len((source or "").splitlines()),
        "lines": (source or "").count("\n") + 1,
    }


def _parsed(files: DataFrame) -> DataFrame:
    """(path, language, p) of files(path, language, content): a file that can't be read is left out."""
    schema = f"path string, language string, p {PARSED}"
    kind = to_arrow_type(DataType.fromDDL(schema)["p"].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            rows = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x for x in found if x is not None], kind)], names=["path", "language", "p"])

    return files.mapInArrow(read, schema)


def _first(rows: Column, holds) -> Column:
    return F.get(F.filter(rows, holds), 0)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, language, functions, classes, imports, calls, loc, lines) of files(path, content), one row a file
    that its language's parser can read; others, and Python that is none, are left out. Null content is empty.

    Python is read by its syntax tree, C, C++, Java, Go, JavaScript, TypeScript and Rust by their
    brackets. In the latter a function belongs to the first class whose lines hold it, and a call to the
    first function whose lines hold it, or to <global>. No shuffle: all of it happens within the row.
    """
    language = parser_of(F.col("path"))
    # A filter on the language would be moved before the shuffle that deals out files, into the few tasks that read them.
    read = files.select("path", language.alias("language"), F.when(language.isNotNull(), F.col("content").cast("string")).alias("content"))
    p = _parsed(read).select("path", "language", "p.*")
    python = F.col("language") == "python"
    holds = lambda c, f: (c["start_line"] <= f["start_line"]) & (f["end_line"] <= c["end_line"])
    p = p.withColumnsRenamed({"functions": "_functions", "classes": "_classes", "calls": "_calls"})  # names of their own inside of lambdas
    number = F.transform("_classes", lambda c, i: F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), i.alias("i")))
    owned = F.transform("_functions", lambda f: F.struct(f.alias("f"), _first(number, lambda c: holds(c, f))["i"].alias("i")))
    own = lambda i: F.transform(F.filter("_owned", lambda x: x["i"] == i), lambda x: x["f"])
    caller = lambda c: F.coalesce(_first(F.col("_functions"), lambda f: c["line"].between(f["start_line"], f["end_line"]))["name"], F.lit("<global>"))
    p = p.withColumn("_owned", F.when(~python, owned))
    return p.select(
        "path",
        "language",
        F.when(python, F.col("_functions")).otherwise(F.transform(F.filter("_owned", lambda x: x["i"].isNull()), lambda x: x["f"])).alias("functions"),
        F.when(python, F.col("_classes")).otherwise(F.transform("_classes", lambda c, i: c.withField("methods", own(i)))).alias("classes"),
        "imports",
        F.when(python, F.col("_calls")).otherwise(F.transform("_calls", lambda c: c.withField("caller", caller(c)))).alias("calls"),
        "loc",
        "lines",
    )


def symbols(parsed: DataFrame) -> DataFrame:
    """(path, language, kind, name, owner, start_line, end_line): a row for each class, function, method (owner:
    its class), import and call (name: what is called, owner: the caller)."""
    out = F.concat(
        F.transform("classes", lambda c: _row("class", c["name"], None, c["start_line"], c["end_line"])),
        F.transform("functions", lambda f: _row("function", f["name"], None, f["start_line"], f["end_line"])),
        F.flatten(F.transform("classes", lambda c: F.transform(c["methods"], lambda m: _row("method", m["name"], c["name"], m["start_line"], m["end_line"])))),
        F.transform("imports", lambda i: _row("import", i["module"], None, None, None)),
        F.transform("calls", lambda c: _row("call", c["callee"], c["caller"], c["line"], c["line"])),
    )
    return parsed.select("path", "language", F.inline(out))


def _row(kind: str, name: Column, owner: Column | None, start: Column | None, end: Column | None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), (null.cast("string") if owner is None else owner).alias("owner"), (null.cast("int") if start is None else start).alias("start_line"), (null.cast("int") if end is None else end).alias("end_line"))


def structure(files: DataFrame) -> DataFrame:
    """(path, functions, classes, imports): names in the files that have a parser; methods of languages with braces
    are among the functions."""
    p = parse_files(files)
    methods = F.flatten(F.transform("classes", lambda c: F.when(F.col("language") == "python", F.array()).otherwise(F.transform(c["methods"], lambda m: m["name"]))))
    return p.select("path", F.concat(F.transform("functions", lambda f: f["name"]), methods).alias("functions"), F.transform("classes", lambda c: c["name"]).alias("classes"), F.transform("imports", lambda i: i["module"]).alias("imports"))


def analysis_graph(parsed: DataFrame, repo: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed files(path, language, functions, classes, imports, ...): ids repo:path, repo:path::name and
    repo:path::Class::method; CONTAINS, DEFINES_FUNCTION, DEFINES_METHOD and IMPORTS edges.

    A file gives all its rows at once. keep: stores the rows that nodes and edges are read from, so that
    a file is parsed once for both; only edges are shuffled."""
    file, null = F.concat(F.lit(f"{repo}:"), "path"), F.lit(None)

    def node(id: Column, label: str, name: Column, x: Column | None, complexity: Column | None = None) -> Column:
        start, end = (x["start_line"], x["end_line"]) if x is not None else (null.cast("int"), null.cast("int"))
        return F.struct(id.alias("id"), F.array(F.lit(label)).alias("labels"), name.alias("name"), F.col("path").alias("file_path"), start.alias("start_line"), end.alias("end_line"), (null.cast("int") if complexity is None else complexity).alias("complexity"), *(null.cast("string").alias(c) for c in ("src", "dst", "type")))

    def edge(src: Column, dst: Column, kind: str) -> Column:
        none = {"id": "string", "labels": "array<string>", "name": "string", "file_path": "string", "start_line": "int", "end_line": "int", "complexity": "int"}
        return F.struct(*(null.cast(t).alias(c) for c, t in none.items()), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))

    def each(column: str, row) -> Column:
        return F.coalesce(F.transform(column, row), F.array())

    def methods(row) -> Column:
        return F.flatten(each("classes", lambda c: F.coalesce(F.transform(c["methods"], lambda m: row(of(c), of(c, m), m)), F.array())))

    of = lambda *x: F.concat_ws("::", file, *(y["name"] for y in x))
    rows = F.concat(
        F.array(node(file, "File", null.cast("string"), None)),
        each("classes", lambda c: node(of(c), "Class", c["name"], c)),
        each("functions", lambda f: node(of(f), "Function", f["name"], f, f["complexity"])),
        methods(lambda _, id, m: node(id, "Function", m["name"], m, m["complexity"])),
        each("classes", lambda c: edge(file, of(c), "CONTAINS")),
        each("functions", lambda f: edge(file, of(f), "DEFINES_FUNCTION")),
        methods(lambda owner, id, m: edge(owner, id, "DEFINES_METHOD")),
        each("imports", lambda i: edge(file, i["module"], "IMPORTS")),
    )
    kept = keep(parsed.select(F.inline(rows)))
    nodes = kept.where("type is null").select("id", "labels", "name", "file_path", "start_line", "end_line", "complexity")
    return nodes, kept.where("type is not null").select("src", "dst", "type").distinct()


def code_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed Python files.

    nodes: (id, type, name, file_path, line_number, signature, is_public, docstring, loc), ids file:path,
    class:path:name and func:path:name; of several definitions with one id the last one stays. edges:
    (src, dst, type, weight, n), n the times it occurs. Every function and class is DEFINED_IN its file, a
    method in its class too. Calls in a function, and in what is nested in it, count for it: to
    func:path:name, or by half to method:name; those of a method count twice, as it is met in its file and
    in its class. Edges are counted in each task before they are shuffled.
    """
    f = parsed.where("language = 'python'").withColumn("file", F.concat(F.lit("file:"), "path"))
    klass = f.select("file", "path", F.explode("classes").alias("c")).withColumn("own", F.concat(F.lit("class:"), "path", F.lit(":"), "c.name"))
    free = f.select("file", "path", F.lit(None).cast("string").alias("own"), F.explode("functions").alias("x"))
    every = free.unionAll(klass.select("file", "path", "own", F.explode("c.methods").alias("x"))).withColumn("id", F.concat(F.lit("func:"), "path", F.lit(":"), "x.name"))
    null = F.lit(None).cast("string")

    def node(df: DataFrame, id: str, kind: str, x: str, signature: Column) -> DataFrame:
        size = F.col(f"{x}.end_line") - F.col(f"{x}.start_line")
        return df.where(f"{x}.last").select(F.col(id).alias("id"), F.lit(kind).alias("type"), F.col(f"{x}.name").alias("name"), F.col("path").alias("file_path"), F.col(f"{x}.start_line").alias("line_number"), signature.alias("signature"), (~F.startswith(F.col(f"{x}.name"), F.lit("_"))).alias("is_public"), F.col(f"{x}.docstring").alias("docstring"), size.alias("loc"))

    base = F.element_at(F.split("path", "/"), -1)
    nodes = f.select(F.col("file").alias("id"), F.lit("File").alias("type"), base.alias("name"), F.col("path").alias("file_path"), null.cast("int").alias("line_number"), null.alias("signature"), F.lit(True).alias("is_public"), null.alias("docstring"), F.col("lines").alias("loc"))
    nodes = nodes.unionAll(node(klass, "own", "Class", "c", null)).unionAll(node(every, "id", "Function", "x", F.col("x.signature")))

    def edge(df: DataFrame, src: Column, dst: Column, kind: str, weight: Column | None = None, n: Column | None = None) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.lit(1.0) if weight is None else weight).alias("weight"), (F.lit(1) if n is None else n).alias("n"))

    called = every.select("path", "id", F.when(F.col("own").isNull(), 1).otherwise(2).alias("times"), F.explode("x.within").alias("y"))
    imported = f.select("file", F.explode("imports").alias("i")).select("file", "i.module", F.explode(F.when(F.size("i.names") > 0, F.col("i.names")).otherwise(F.array(null))).alias("name"))
    edges = [
        edge(every, F.col("id"), F.col("file"), "DEFINED_IN"),
        edge(every.where("own is not null"), F.col("id"), F.col("own"), "DEFINED_IN"),
        edge(klass, F.col("own"), F.col("file"), "DEFINED_IN"),
        edge(klass.select("path", "own", F.explode("c.bases").alias("b")), F.col("own"), F.concat(F.lit("class:"), "path", F.lit(":"), "b"), "INHERITS"),
        edge(imported, F.col("file"), F.concat_ws(":", F.lit("import"), "module", "name"), "IMPORTS"),
        edge(called, F.col("id"), F.when(F.col("y.method"), F.concat(F.lit("method:"), "y.name")).otherwise(F.concat(F.lit("func:"), "path", F.lit(":"), "y.name")), "CALLS", F.when(F.col("y.method"), 0.5).otherwise(1.0), F.col("times")),
    ]
    whole = edges[0]
    for more in edges[1:]:
        whole = whole.unionAll(more)
    return nodes, whole.groupBy("src", "dst", "type", "weight").agg(F.sum("n").alias("n"))
