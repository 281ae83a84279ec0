"""Files in eight languages as symbols and as a graph."""

import ast
import collections

import pytest
from pyspark.sql import functions as F

from graphloom.functions import code, parsing
from graphloom.functions.brace import Symbols

CPP = """
    #include <iostream>

    // Global function
    int add(int a, int b) {
        return a + b;
    }

    class Calculator {
    public:
        // Method inside class
        int multiply(int x, int y) {
            return x * y;
        }
    };

    // Function returning pointer
    int* create_int(int val) {
        return new int(val);
    }
"""
PYTHON = """
def global_func(a, b):
    return a + b

class MyClass:
    def method_one(self, x):
        return x * 2

    def method_two(self, y: int = 10):
        print("hello")
"""
C = """
#include <stdio.h>

int add(int a, int b) {
    return a + b;
}

int main() {
    int res = add(5, 10);
    printf("Result: %d\\n", res);
    return 0;
}
"""
GO = """
package main

import "fmt"

func add(a int, b int) int {
	return a + b
}

func main() {
	res := add(5, 10)
	fmt.Println("Result:", res)
}
"""


@pytest.fixture(scope="module")
def parsed(spark):
    files = [("a/test.cpp", CPP), ("a/test.py", PYTHON), ("test.c", C), ("test.GO", GO), ("test.xyz", "some content"), ("bad.py", "def (:"), ("none.java", None), ("empty.rs", "")]
    df = parsing.parse_files(spark.createDataFrame([(*f, 1, "x") for f in files], "path string, content string, loc int, functions string"))
    return {r.path: r for r in df.collect()}


def test_published_snippets(parsed):
    cpp, py, c, go = (parsed[x] for x in ("a/test.cpp", "a/test.py", "test.c", "test.GO"))
    assert [(k.name, [(m.name, m.args) for m in k.methods]) for k in cpp.classes] == [("Calculator", [("multiply", ["int x", "int y"])])]
    assert [(f.name, f.args) for f in cpp.functions] == [("add", ["int a", "int b"]), ("create_int", ["int val"])]
    assert [(k.name, [m.name for m in k.methods], k.methods[0].args) for k in py.classes] == [("MyClass", ["method_one", "method_two"], ["self", "x"])]
    assert [(f.name, f.args) for f in py.functions] == [("global_func", ["a", "b"])]
    assert [f.name for f in c.functions] == ["add", "main"] and ("main", "add") in [(x.caller, x.callee) for x in c.calls]
    assert [f.name for f in go.functions] == ["add", "main"] and [i.module for i in go.imports] == ["fmt"]
    assert [(x.caller, x.callee) for x in go.calls] == [("main", "add"), ("main", "Println")]


def test_what_has_no_parser_is_left_out(parsed):
    assert set(parsed) == {"a/test.cpp", "a/test.py", "test.c", "test.GO", "none.java", "empty.rs"}
    assert [(r.loc, r.functions, r.calls) for r in (parsed["none.java"], parsed["empty.rs"])] == [(0, [], [])] * 2


#: What no reader of brackets may trip over, with the functions, classes and calls that are there.
SHAPES = [
    ("c", 'char *s = "int f(void) { g(); }"; /* int h() { } */ int k(void) { return 0; }', ["k"], [], []),
    ("c", "#define F(x) \\\n  int x() { call(); }\nint a() { if (b()) { } else if (c()) { } return sizeof(int); }", ["a"], [], ["b", "c"]),
    ("c", "int a() { '\"'; b('}'); '\\''; c(); }", ["a"], [], ["b", "c"]),
    ("c", "int unclosed() { a(", ["unclosed"], [], ["a"]),
    ("c", "} } ) int a() { b(); }", ["a"], [], ["b"]),
    ("cpp", 'auto s = R"x( int no() { } )x"; enum class E { A }; struct S; class T final : public U { };', [], ["T"], []),
    ("cpp", "void A::run() const noexcept { b->c(1); A::d(2); }", ["run"], [], ["c"]),
    ("cpp", "class A { ~A() { x(); } A() : b(1), c{2} { y(); } bool operator==(const A& o) const { return z(o); } };", ["~A", "A"], ["A"], ["x", "y", "z"]),
    ("java", "class A { enum B { C(1), D(2); } void m() { new E(f()); this.g(); } @H(1) int i = j(); }", ["m"], ["A"], ["f", "g", "j"]),
    ("java", 'interface A { default int b() { return c(); } int d(int x); String e = """ f() """; }', ["b", "d"], ["A"], ["c"]),
    ("go", "func (a *A[T]) B(c func(int) bool) (d struct{ e int }, err error) {\n return f(`g(`)\n}\nvar h = func() { i() }\n", ["B"], [], ["f", "i"]),
    ("go", "type (\n A struct {\n  b func(int)\n }\n C = int\n)\ntype D interface { E() }\n", [], ["A", "C", "D"], []),
    ("javascript", "const a = b / c(1) / d; x = /[/(]e(/g.test(f(y)); function* g() { yield h(); }", ["g"], [], ["c", "test", "f", "h"]),
    ("javascript", "class A { static b() { c(); } #d() { e(); } get f() { return g`h(`; } }\nif (i()) { j(); }", ["b", "d", "f"], ["A"], ["c", "e", "i", "j"]),
    ("typescript", "abstract class A<T extends B> { abstract c(): void; d = (x: number) => e(x); f?(y: string): void; g(): { h: number } { return i(); } }", ["g"], ["A"], ["e", "i"]),
    ("rust", "impl A { fn b<'a, T: C<D>>(x: &'a T) -> Vec<E> where T: F { g(x); h!(i()); J::k(); l.m::<N>() } }", ["b"], [], ["g", "i", "m"]),
    ("rust", 'fn a() { let b = r#"c("#; let d = b\'(\'; e(\'\\u{41}\'); } struct F(u8); trait G { }', ["a"], ["F", "G"], ["e"]),
]


@pytest.mark.parametrize("language, source, functions, classes, calls", SHAPES)
def test_shapes(language, source, functions, classes, calls):
    found = Symbols(language, source)
    assert ([f["name"] for f in found.functions], [c["name"] for c in found.classes], [c["callee"] for c in found.calls]) == (functions, classes, calls)


def test_any_text_is_read():
    for language in ("c", "cpp", "java", "go", "javascript", "typescript", "rust"):
        for source in ("((((", "))))}}}}", "\"'`/*", "class", "func (", "fn x<", "import", "type (", "#", "R\"", "a(" * 2000, "{" * 3000, "/" * 999, "é漢字(1)", "template <"):
            Symbols(language, source)


def brute_graph(path, source):
    """Nodes by id and all edges of a file, met one after the other: first all definitions level by level, a
    class's methods with the class and again by themselves."""
    tree, nodes, edges = ast.parse(source), {}, []
    file = f"file:{path}"
    nodes[file] = ("File", path.split("/")[-1], None, source.count("\n") + 1)

    def function(x, parent):
        own = f"func:{path}:{x.name}"
        nodes[own] = ("Function", x.name, x.lineno, x.end_lineno - x.lineno)
        edges.append((own, parent, "DEFINED_IN", 1.0))
        for call in (y.func for y in ast.walk(x) if isinstance(y, ast.Call)):
            if isinstance(call, ast.Name):
                edges.append((own, f"func:{path}:{call.id}", "CALLS", 1.0))
            elif isinstance(call, ast.Attribute):
                edges.append((own, f"method:{call.attr}", "CALLS", 0.5))

    for x in ast.walk(tree):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(x, file)
        elif isinstance(x, ast.ClassDef):
            own = f"class:{path}:{x.name}"
            nodes[own] = ("Class", x.name, x.lineno, x.end_lineno - x.lineno)
            edges.append((own, file, "DEFINED_IN", 1.0))
            edges += [(own, f"class:{path}:{ast.unparse(b)}", "INHERITS", 1.0) for b in x.bases]
            for m in x.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(m, own)
        elif isinstance(x, ast.ImportFrom):
            edges += [(file, f"import:{x.module or ''}:{n.name}", "IMPORTS", 1.0) for n in x.names]
        elif isinstance(x, ast.Import):
            edges += [(file, f"import:{n.name}", "IMPORTS", 1.0) for n in x.names]
    return nodes, collections.Counter(edges)


def test_code_graph(spark):
    """Nested and repeated definitions, methods of one name in two classes, decorators, default values."""
    sources = {
        "p/a.py": PYTHON + "\nimport os, sys as s\nfrom . import x, y\nfrom .z import *\n",
        "p/b.py": "@deco(1)\nasync def f(a=g()):\n    def f():\n        return h(f()).i()\n    class C(D, e.F):\n        def f(self): return self.f()\n        class G:\n            def f(self): pass\n    return C\ndef f(): f()()\nclass C:\n    x = f()\n    def f(self, *, k): super().f(k)\n",
    }
    nodes, edges = parsing.code_graph(parsing.parse_files(spark.createDataFrame(list(sources.items()), "path string, content string")))
    want_nodes, want_edges = {}, collections.Counter()
    for path, source in sources.items():
        n, e = brute_graph(path, source)
        want_nodes |= n
        want_edges += e
    assert {r.id: (r.type, r.name, r.line_number, r.loc) for r in nodes.collect()} == want_nodes and nodes.count() == len(want_nodes)
    assert {(r.src, r.dst, r.type, r.weight): r.n for r in edges.collect()} == want_edges


def test_callee_of_chains():
    name = lambda s: code.callee(ast.parse(s, mode="eval").body)
    assert name("a.b.c") == ("a.b.c", 1.0, False) and name("a().b") == ("a(...).Result.b", 0.5, True)
    assert name("x[0].a.b") == ("a.b", 1.0, False) and name("x[0]().a") == ("a", 1.0, False) and name("x[0]") == (None, 0.0, False)
    assert name("a()().b") == ("a(...).Result(...).Result.b", 0.5, True)


def test_one_parse_serves_all(spark):
    """No shuffle between the files and their symbols, and one evaluation of the parser."""
    df = parsing.symbols(parsing.parse_files(spark.createDataFrame([("a.c", C)], "path string, content string")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow ") == 1 and "EvalPython" not in plan and "Exchange" not in plan
    assert df.where(F.col("kind") == "call").count() == 2
