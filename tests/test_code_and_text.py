"""Source code, chunks and texts."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import code, text
from graphloom.sources import files, forge


@pytest.mark.parametrize("source, n", [("def f():\n    return 1\n", 1), ("def f(x):\n    if x:\n        return 1\n", 2), ("def f(a, b):\n    if a and b:\n        for i in a:\n            while b:\n                pass\n", 5)])
def test_mccabe(source, n):
    assert code.parse(source)["functions"][0]["complexity"] == n


def test_broken_source_is_null(spark):
    df = spark.createDataFrame([("def (:",), (None,), ("x = 1",)], "s string").select(code.parse_python("s").alias("p"))
    assert [r.p is None for r in df.collect()] == [True, False, False]


def test_calls():
    source = "class MyClass:\n    def method_a(self):\n        self.method_b()\n    def method_b(self):\n        os.path.join(get().send())\n\ndef other():\n    MyClass().method_a()\n\nother()\n"
    assert sorted(code.calls(source)) == sorted(
        [
            ("MyClass.method_a", "self.method_b", 3, 1.0, False),
            ("MyClass.method_b", "os.path.join", 5, 1.0, False),
            ("MyClass.method_b", "get(...).Result.send", 5, 0.5, True),
            ("MyClass.method_b", "get", 5, 1.0, False),
            ("other", "MyClass(...).Result.method_a", 8, 0.5, True),
            ("other", "MyClass", 8, 1.0, False),
            ("<module>", "other", 10, 1.0, False),
        ]
    )


def test_c_symbols(spark):
    source = "#include <a.h>\nint add(int a) {\n  foo(a);\n}\nclass X {};\nelse if (x) {\n"
    df = spark.createDataFrame([("m", source)], "id string, t string")
    s = df.select(code.c_symbols(F.col("t")).alias("s")).first().s
    assert (s.functions, s.classes, s.imports) == (["add"], ["X"], ["a.h"])
    assert [(r.caller, r.callee) for r in code.c_calls(df, "id", "t").collect()] == [("add", "foo")]


def brute_chunks(t):
    if len(t) <= 2000:
        return [(0, t)] if t else []
    out, start = [], 0
    while True:
        end = min(start + 2000, len(t))
        if end < len(t):
            cut = t.rfind("\n", start, end)
            if cut > end - 100:
                out.append((start, t[start : cut + 1]))
            else:
                out.append((start, t[start:end]))
        else:
            out.append((start, t[start:end]))
        if start + 2000 >= len(t):
            return out
        start += 1600


def test_sliding_chunks(spark):
    texts = ["", "short", "x" * 2000, "y" * 2001, ("word " * 30 + "\n") * 60, "é\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "id int, t string")
    got = {}
    for r in text.sliding_chunks(df, "id", "t").orderBy("id", "start").collect():
        got.setdefault(r.id, []).append((r.start, r.chunk))
    assert got == {i: brute_chunks(t) for i, t in enumerate(texts) if t}


def test_normalize(spark):
    df = spark.createDataFrame([("a\t\n b  " + "=" * 30,), ("w " * 40,), ("x" * 21,), ("x" * 20,)], "t string")
    assert [r[0] for r in df.select(text.normalize(F.col("t"))).collect()] == ["a b ===", " ".join(["w"] * 30), "xxx", "x" * 20]


def test_diff_and_fences(spark):
    df = spark.createDataFrame([(1, "noise\ndiff --git a/x b/x\n+1\ndiff --git a/y b/y\n-2")], "id int, t string")
    assert sorted((r.path, r.hunk) for r in text.split_diff(df, "id", "t").collect()) == [("x", "diff --git a/x b/x\n+1"), ("y", "diff --git a/y b/y\n-2")]
    df = spark.createDataFrame([(1, "see ```python:a/b.py\nx=1\n``` and ```\ny\n```")], "id int, t string")
    assert [(r.path, r.code) for r in text.fences(df, "id", "t").orderBy("n").collect()] == [("a/b.py", "x=1\n"), ("", "y\n")]


def test_structural_chunks(spark):
    source = "def add(a, b) -> int:\n    '''Adds.'''\n    return a + b\n\nclass C(Base):\n    '''Doc.'''\n    def m(self):\n        return 1\n"
    df = spark.createDataFrame([("f.py", source), ("plain.txt", "hello")], "path string, content string")
    df = df.select("path", "content", code.parse_python("content").alias("p")).select("path", "content", "p.functions", "p.classes")
    got = {r.chunk_id: r.text for r in text.structural_chunks(df).collect()}
    assert set(got) == {"f.py::add", "f.py::C", "f.py::C.m", "plain.txt::whole"}
    assert got["f.py::add"].startswith("File: f.py\nType: Function\nName: add\nSignature: def add(a, b) -> int\nDocstring: Adds.\nCode:\ndef add")
    assert got["f.py::C"] == "File: f.py\nType: Class\nName: C\nDocstring: Doc.\nBases: Base\n"


def test_files(spark, tmp_path):
    for name, body in {"main.c": "int main() {}", "Makefile": "main: main.c\n\tcc main.c\nother: x.c\n", "go.mod": "module x\nrequire gin", "app.go": "package x", "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"vue": "2"}}', "requirements.txt": "Django\nnumpy\n", ".git/config": "x", "venv/a.py": "1", "pkg/__init__.py": "", "bin.dat": "x"}.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(body)
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in files.repo_files(found).collect()) == ["Makefile", "app.go", "main.c", "package.json", "pkg/__init__.py", "requirements.txt"]
    assert files.project_type(found).first()[0] == "python"
    assert sorted(r.type for r in files.build_systems(found).collect()) == ["go", "make", "npm"]
    assert tuple(files.build_context(found, "main.c").first()) == ("make", ["make main"])
    assert tuple(files.build_context(found, "app.go").first()) == ("go", ["go test ./...", "go build ./..."])
    assert sorted(r[0] for r in files.frameworks(found).collect()) == ["django", "gin", "numpy", "react", "vue"]


def test_is_text(spark):
    whole = ("é" * 400).encode()
    df = spark.createDataFrame([(b"\xff\xfe\x00",), (whole,), (b"x" + whole,), (b"",)], "c binary")
    assert [r[0] for r in df.select(files.is_text(F.col("c"))).collect()] == [False, True, True, True]


def test_tool_output(spark):
    df = spark.createDataFrame([("30,12,1,2,40,f@1-9@a.c,a.c,f",), ("3,2,1,2,40,g@1-9@a.c,a.c,g",)], "value string")
    assert [tuple(r) for r in files.tool_complexity(df).collect()] == [("f", 12)]
    df = spark.createDataFrame([("a.py:3:1: E501 too long",), ("noise",)], "value string")
    assert [tuple(r) for r in files.lint_lines(df).collect()] == [("a.py", 3, 1, "E501", "too long")]


def test_forge(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"id": 1, "title": "a", "body": "hi @me", "requested_reviewers": [{"login": "me"}], "head": {"label": "me:fix"}}, {"id": 2, "title": "b", "assignees": [{"login": "you"}]}]')
    df = forge.items(spark, str(tmp_path / "i.json"))
    assert [(r.id, r.reasons) for r in forge.feed(df, "me").collect()] == [(1, ["mention", "review"])]
    assert [r.id for r in forge.pull_request_of(df, "fix").collect()] == [1]
