"""Source code as rows: Python by its syntax tree, other languages by patterns."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Nodes that a path through a function can turn at.
TURNS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert)

_FUNCTION = "struct<name:string,args:array<string>,signature:string,returns:string,docstring:string,start_line:int,end_line:int,complexity:int,last:boolean,within:array<struct<name:string,method:boolean>>>"
_CALL = "struct<caller:string,callee:string,line:int,confidence:double,is_dynamic:boolean>"
PARSED = f"struct<functions:array<{_FUNCTION}>,classes:array<struct<name:string,bases:array<string>,docstring:string,start_line:int,end_line:int,last:boolean,methods:array<{_FUNCTION}>>>,imports:array<struct<module:string,names:array<string>,alias:string,level:int>>,calls:array<{_CALL}>,loc:int,lines:int>"


def mccabe(nodes: Iterable[ast.AST]) -> int:
    """Of a tree's nodes: 1 and one for each turn and each further operand of `and` and `or`."""
    return 1 + sum(isinstance(x, TURNS) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in nodes)


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, last: bool) -> dict:
    a = node.args
    args = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
    inside = list(ast.walk(node))
    called = [x.func for x in inside if isinstance(x, ast.Call)]
    within = [{"name": f.id, "method": False} if isinstance(f, ast.Name) else {"name": f.attr, "method": True} for f in called if isinstance(f, (ast.Name, ast.Attribute))]
    signature = f"{node.name}({', '.join(x.arg for x in a.args)})"
    return {"name": node.name, "args": args, "signature": signature, "returns": ast.unparse(node.returns) if node.returns else None, "docstring": ast.get_docstring(node), "start_line": node.lineno, "end_line": node.end_lineno, "complexity": mccabe(inside), "last": last, "within": within}


def parse(source: str | None) -> dict | None:
    """Functions (nested ones too, methods apart), classes with methods, imports, calls and lines, from one
    tree; null if the text is no Python. `within`: names called in a function and in what is nested
    in it. `last`: no definition of that name is found later, level by level."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    every = [x for x in ast.walk(tree) if isinstance(x, (*kinds, ast.ClassDef, ast.Import, ast.ImportFrom))]
    latest = {(isinstance(x, ast.ClassDef), x.name): x for x in every if not isinstance(x, (ast.Import, ast.ImportFrom))}
    methods = {m for x in every if isinstance(x, ast.ClassDef) for m in x.body if isinstance(m, kinds)}
    functions = {x: _function(x, latest[False, x.name] is x) for x in every if isinstance(x, kinds)}
    out: dict = {"functions": [f for x, f in functions.items() if x not in methods], "classes": [], "imports": [], "loc": len((source or "").splitlines()), "lines": (source or "").count("\n") + 1}
    for x in every:
        if isinstance(x, ast.ClassDef):
            own = [functions[m] for m in x.body if isinstance(m, kinds)]
            out["classes"].append({"name": x.name, "bases": [ast.unparse(b) for b in x.bases], "docstring": ast.get_docstring(x), "start_line": x.lineno, "end_line": x.end_lineno, "last": latest[True, x.name] is x, "methods": own})
        elif isinstance(x, ast.Import):
            out["imports"] += [{"module": n.name, "names": [], "alias": n.asname, "level": 0} for n in x.names]
        elif isinstance(x, ast.ImportFrom):
            out["imports"].append({"module": x.module or "", "names": [n.name for n in x.names], "alias": None, "level": x.level})
    for k in ("functions", "classes"):
        out[k].sort(key=lambda r: (r["start_line"], r["name"]))
    out["calls"] = [dict(zip(("caller", "callee", "line", "confidence", "is_dynamic"), c, strict=True)) for c in calls_of(tree)]
    return out


def parse_python(source: Column | str) -> Column:
    """parse() as a column."""
    return F.udf(parse, PARSED, useArrow=True)(source)


def callee(node: ast.AST) -> tuple[str | None, float, bool]:
    """(dotted name, confidence, dynamic) of what is called. The attributes down to the root of the chain are
    the end of the name; a root that is a call itself is known by half, one without a name is left out."""
    ends: list[str] = []
    while isinstance(node, ast.Attribute):
        ends.insert(0, node.attr)
        node = node.value
    made = callee(node.func)[0] if isinstance(node, ast.Call) else None
    root = f"{made}(...).Result" if made else getattr(node, "id", None)
    name = ".".join([root, *ends] if root else ends)
    return name or None, (0.5 if made else 1.0) if name else 0.0, made is not None


def calls(source: str | None) -> Iterator[tuple[str, str, int, float, bool]]:
    """(caller, callee, line, confidence, is_dynamic); caller is <module>, a function or Class.method."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    yield from calls_of(tree)


def calls_of(tree: ast.AST) -> Iterator[tuple[str, str, int, float, bool]]:
    todo: list[tuple[ast.AST, str | None, str | None]] = [(tree, None, None)]
    while todo:
        node, owner, function = todo.pop()
        if isinstance(node, ast.Call):
            name, sure, dynamic = callee(node.func)
            if name:
                yield function or "<module>", name, node.lineno, sure, dynamic
        if isinstance(node, ast.ClassDef):
            owner = node.name
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function = f"{owner}.{node.name}" if owner else node.name
        todo += [(x, owner, function) for x in reversed(list(ast.iter_child_nodes(node)))]


class PythonCalls:
    """The calls in a Python text: `SELECT ... FROM files, LATERAL python_calls(content)`."""

    returns = "caller string, callee string, line int, confidence double, is_dynamic boolean"

    def eval(self, source: str):
        yield from calls(source)


class PythonErrors:
    """What is wrong with a Python text: a syntax error, and calls of eval and exec."""

    returns = "line int, message string"

    def eval(self, source: str):
        try:
            tree = ast.parse(source or "")
        except SyntaxError as e:
            yield e.lineno, f"syntax error: {e.msg}"
            return
        except (ValueError, RecursionError, MemoryError) as e:
            yield None, f"unreadable: {e}"
            return
        for x in ast.walk(tree):
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in ("eval", "exec"):
                yield x.lineno, f"use of {x.func.id}"


def register(spark: SparkSession) -> None:
    """Makes the functions available to SQL."""
    spark.udf.register("parse_python", F.udf(parse, PARSED, useArrow=True))
    for name, table in (("python_calls", PythonCalls), ("python_errors", PythonErrors)):
        spark.udtf.register(name, udtf(table, returnType=table.returns))


#: Patterns of languages in the manner of C, and words that only look like functions.
C_FUNCTION = r"(?m)^\s*(?:[\w\*]+\s+)+(\w+)\s*\("
C_CLASS = r"(?m)^\s*class\s+(\w+)"
C_INCLUDE = r'#include\s+[<"](.+)[>"]'
C_CALL = r"(\w+)\s*\("
NOT_FUNCTIONS = ("if", "while", "switch", "for", "catch", "return", "sizeof", "else", "define")


def c_symbols(text: Column) -> Column:
    """A struct of functions, classes and imports of a C-like text."""
    no = F.array(*map(F.lit, NOT_FUNCTIONS))
    functions = F.filter(F.regexp_extract_all(text, F.lit(C_FUNCTION), F.lit(1)), lambda x: ~F.array_contains(no, x))
    return F.struct(functions.alias("functions"), F.regexp_extract_all(text, F.lit(C_CLASS), F.lit(1)).alias("classes"), F.regexp_extract_all(text, F.lit(C_INCLUDE), F.lit(1)).alias("imports"))


def c_calls(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line, caller, callee): calls on the lines after one that opens a function."""
    from graphloom.functions.text import carry_forward, lines_of

    lines = lines_of(df, id, text)
    opened = F.when(F.contains("content", F.lit("{")), F.nullif(F.regexp_extract("content", C_FUNCTION, 1), F.lit("")))
    inside = carry_forward(lines.withColumn("_open", opened), id, "line", F.col("_open"), "caller").where("caller is not null and _open is null")
    found = inside.select(id, "line", "caller", F.explode(F.regexp_extract_all("content", F.lit(C_CALL), F.lit(1))).alias("callee"))
    return found.where(~F.col("callee").isin(*NOT_FUNCTIONS) & (F.col("callee") != F.col("caller")))


#: Which parser reads which ending.
PARSERS = {
    "python": (".py",),
    "cpp": (".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".ino"),
    "c": (".c", ".h"),
    "java": (".java",),
    "go": (".go",),
    "javascript": (".js", ".jsx"),
    "typescript": (".ts", ".tsx"),
    "rust": (".rs",),
}


def parser_of(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    found = None
    for name, ends in PARSERS.items():
        found = (F if found is None else found).when(end.isin(*ends), name)
    return found


def scan_issues(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, line, message) of all scanners that apply to files(path, content): errors and risky calls
    in Python, long lines in every language that has a parser."""
    errors = udtf(PythonErrors, returnType=PythonErrors.returns)
    known = files.where(parser_of(F.col("path")).isNotNull()).select("path", F.col("content").cast("string").alias("content"))
    python = known.where(F.endswith("path", F.lit(".py"))).lateralJoin(errors(F.col("content").outer()))
    from graphloom.functions.text import lines_of

    long = lines_of(known, "path", "content").where(F.length("content") > 120).select("path", "line", F.lit("line over 120 characters").alias("message"))
    return python.select("path", "line", "message").unionAll(long)
