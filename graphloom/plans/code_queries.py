"""Queries on source code: every part gives a file in one of eight languages, whose names and lengths follow
from its key and size, so that SQL can say what is in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import code, parsing, text
from graphloom.operators import graph, impact, resolution, writers
from graphloom.operators.fanout import spread
from graphloom.plans.catalog import query
from graphloom.plans.datasets import table
from graphloom.plans.storage import cut, shared_folder, written

#: By language: ending, text with {k} (the key) and one place for lines that repeat r times (the size modulo 7).
TEMPLATES = {
    "python": (
        ".py",
        '''import os
from lib.m{k} import helper_{k} as h


class Part{k}(Base):
    """Part {k}."""

    def size(self, a, *rest):
        # eval("no")
        return self.step(a) if a and rest else os.path.join(str(a))

    def step(self, a) -> int:
{R}        return a


def build_{k}(n):
    return Part{k}().size(n)


build_{k}(1)
''',
        "        if a > 1:\n            a = a - 1\n",
    ),
    "c": (
        ".c",
        """#include <lib{k}.h>
/* int hidden(int a) { return no(1); } */
struct P{k} { int a; };
static int make_{k}(int a, char *b)
{
    // skipped(1);
{R}    return use_{k}(a, "call(\\"no\\")");
}
int main(void) {
    return make_{k}(1, "}");
}
""",
        "    if (step(a)) { a = a - 1; }\n",
    ),
    "cpp": (
        ".cpp",
        """#include "lib{k}.hpp"
namespace n {
template <class T> class Box{k} : public Base<T, 2> {
public:
    Box{k}(int a) : a_(a), b_{0} { reset(a); }
    virtual int none(int a) const = 0;
    int get(int a) const override {
{R}        return other->find(a) + std::max(a, 1);
    }
};
Box{k}<int> *make_{k}() { return new Box{k}<int>(1); }
}
""",
        "        if (a > 1) { log_(a); }\n",
    ),
    "go": (
        ".go",
        """package m{k}

import (
	"fmt"
	l "lib/m{k}"
)

type T{k} struct {
	a int
}

func (t *T{k}) Get(a int) (int, error) {
{R}	return t.a, fmt.Errorf("no(%d)", a)
}

func Make{k}(a int) *T{k} { // skip(1)
	return wrap(&T{k}{a})
}
""",
        "\tif a > 1 { a = step(a) }\n",
    ),
    "java": (
        ".java",
        """package p.m{k};
import java.util.List;
import static p.lib.Lib{k}.help;
/** hidden(1) */
@Named("x(1)")
public class C{k}<T extends Comparable<T>> extends Base implements Runnable {
    private int n = start(3);
    public C{k}(int n) { this.n = n; }
    @Override
    public List<String> names(Map<String, Integer> m) throws IOException {
{R}        return help(new ArrayList<String>(n)).subList(0, 1);
    }
    abstract void none();
}
""",
        "        if (m.isEmpty()) { n = n - 1; }\n",
    ),
    "javascript": (
        ".jsx",
        """import { lib{k} } from './lib{k}.js';
const pattern = /skip\\(1\\)/g;
async function load{k}(a, b = 2) {
{R}  return lib{k}(`x(${a})`, b).then(done);
}
class V{k} extends View {
  constructor(a) { super(a); this.a = a; }
  async draw() { for (const x of list(this.a)) { x.paint(); } }
}
load{k}(1);
""",
        "  if (a > 1) { a = step(a); }\n",
    ),
    "typescript": (
        ".ts",
        """import type { A } from '../lib{k}';
export class S{k}<T> {
  constructor(private a: A) {}
  find(id: string, opt?: { a: number }): Promise<T> {
{R}    return this.a.get<T>(id);
  }
}
export function pick{k}<T>(x: T): T { return ident(x); }
""",
        "    if (id) { this.log(id); }\n",
    ),
    "rust": (
        ".rs",
        """use std::collections::{HashMap, HashSet};
pub struct R{k}<'a> { a: &'a str }
pub trait Show{k} {
    fn sig(&self) -> i32;
    fn shown(&self) -> i32 { self.sig() }
}
impl<'a> R{k}<'a> {
    pub fn make(a: &'a str) -> Self {
{R}        println!("x({})", a);
        R{k} { a }
    }
}
""",
        "        if a.is_empty() { note('('); }\n",
    ),
}

#: What is in the texts: kind, name, owner, first and last line; r* marks a row for each repeated line.
INSIDE = {
    "python": "class Part{k} - 5 13+2*r|method size Part{k} 8 10|method step Part{k} 12 13+2*r|function build_{k} - 16+2*r 17+2*r|import os - - -|import lib.m{k} - - -|call self.step Part{k}.size 10 10|call os.path.join Part{k}.size 10 10|call str Part{k}.size 10 10|call Part{k}(...).Result.size build_{k} 17+2*r 17+2*r|call Part{k} build_{k} 17+2*r 17+2*r|call build_{k} <module> 20+2*r 20+2*r",
    "c": "class P{k} - 3 3|function make_{k} - 4 8+r|function main - 9+r 11+r|import lib{k}.h - - -|call step make_{k} r*6 r*6|call use_{k} make_{k} 7+r 7+r|call make_{k} main 10+r 10+r",
    "cpp": "class Box{k} - 3 10+r|method Box{k} Box{k} 5 5|method get Box{k} 7 9+r|function make_{k} - 11+r 11+r|import lib{k}.hpp - - -|call reset Box{k} 5 5|call log_ get r*7 r*7|call find get 8+r 8+r",
    "go": "class T{k} - 8 10|function Get - 12 14+r|function Make{k} - 16+r 18+r|import fmt - - -|import lib/m{k} - - -|call step Get r*12 r*12|call Errorf Get 13+r 13+r|call wrap Make{k} 17+r 17+r",
    "java": "class C{k} - 5 14+r|method C{k} C{k} 8 8|method names C{k} 9 12+r|method none C{k} 13+r 13+r|import java.util.List - - -|import p.lib.Lib{k}.help - - -|call start <global> 7 7|call isEmpty names r*10 r*10|call help names 11+r 11+r|call subList names 11+r 11+r",
    "javascript": "function load{k} - 3 5+r|class V{k} - 6+r 9+r|method constructor V{k} 7+r 7+r|method draw V{k} 8+r 8+r|import ./lib{k}.js - - -|call step load{k} r*3 r*3|call lib{k} load{k} 4+r 4+r|call then load{k} 4+r 4+r|call list draw 8+r 8+r|call paint draw 8+r 8+r|call load{k} <global> 10+r 10+r",
    "typescript": "class S{k} - 2 7+r|method constructor S{k} 3 3|method find S{k} 4 6+r|function pick{k} - 8+r 8+r|import ../lib{k} - - -|call log find r*4 r*4|call get find 5+r 5+r|call ident pick{k} 8+r 8+r",
    "rust": "class R{k} - 2 2|class Show{k} - 3 6|method shown Show{k} 5 5|function make - 8 11+r|call sig shown 5 5|call is_empty make r*8 r*8|call note make r*8 r*8",
}

_ENDS = ", ".join(f"'{end}'" for end, _, _ in TEMPLATES.values())
SQL_SOURCES = f"""s AS (SELECT p_partkey AS k, p_size % 7 AS r, 'src/m' || p_partkey || [{_ENDS}][p_partkey % 8 + 1] AS path, {list(TEMPLATES)}[p_partkey % 8 + 1] AS language, p_partkey % 8 = 0 AND p_partkey % 40 = 0 AS broken FROM part)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file of each part. One in five of Python's is broken. Parts are dealt to tasks before they
    become texts: a few bytes of the table are much to parse."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    part = part.select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_size") % 7).cast("int").alias("r"), (F.col("p_partkey") % 8).cast("int").alias("n"), (F.col("p_partkey") % 40 == 0).alias("broken"))
    path, content = None, None
    for n, (end, whole, line) in enumerate(TEMPLATES.values()):
        made = F.replace(F.replace(F.lit(whole), F.lit("{k}"), F.col("k")), F.lit("{R}"), F.repeat(F.lit(line), F.col("r")))
        path = (F if path is None else path).when(F.col("n") == n, end)
        content = (F if content is None else content).when(F.col("n") == n, made)
    bad = F.when((F.col("n") == 0) & F.col("broken"), F.concat(F.lit("def (:\n"), content)).otherwise(content)
    return part.select(F.concat(F.lit("src/m"), "k", path).alias("path"), bad.alias("content"))


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).where(F.endswith("path", F.lit(".py")))


def _name_sql(x: str) -> str:
    return "NULL" if x == "-" else "'" + x.replace("{k}", "' || k || '") + "'"


def _inside_sql(languages: tuple[str, ...] = tuple(INSIDE), kinds: tuple[str, ...] = ("class", "method", "function", "import", "call")) -> str:
    """Rows of (path, language, kind, name, owner, start_line, end_line) out of s."""
    out = []
    for language in languages:
        for entry in INSIDE[language].split("|"):
            kind, name, owner, start, end = entry.split(" ")
            if kind in kinds:
                many = start.startswith("r*")
                lines = ("i + " + start[2:], "i + " + end[2:]) if many else tuple("NULL" if x == "-" else x for x in (start, end))
                source = "(SELECT *, unnest(range(1, r + 1)) AS i FROM s)" if many else "s"
                out.append(f"SELECT path, language, '{kind}' AS kind, {_name_sql(name)} AS name, {_name_sql(owner)} AS owner, ({lines[0]})::INT AS start_line, ({lines[1]})::INT AS end_line FROM {source} WHERE language = '{language}' AND NOT broken")
    if "rust" in languages and "import" in kinds:
        out.append("SELECT path, language, 'import', 'std::collections::{HashMap, HashSet}', NULL, NULL, NULL FROM s WHERE language = 'rust'")
    return " UNION ALL ".join(out)


BRACES = tuple(x for x in INSIDE if x != "python")


@query(f"WITH {SQL_SOURCES} {_inside_sql()}")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, functions, methods, imports and calls of files in eight languages."""
    return parsing.symbols(parsing.parse_files(sources(spark, sf_dir)))


@query(f"""WITH {SQL_SOURCES}, x AS ({_inside_sql()}) SELECT path,
string_agg(name, ' ' ORDER BY name) FILTER (kind = 'function' OR kind = 'method' AND language <> 'python') AS functions, string_agg(name, ' ' ORDER BY name) FILTER (kind = 'class') AS classes, coalesce(string_agg(name, ' ' ORDER BY name) FILTER (kind = 'import'), '') AS imports FROM x GROUP BY path""")
def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsing.structure(sources(spark, sf_dir))
    return found.select("path", *(F.array_join(F.array_sort(c), " ").alias(c) for c in ("functions", "classes", "imports")))


@query(f"WITH {SQL_SOURCES} SELECT path, (19 + 2 * r + 1)::INT AS loc, 'build_' || k AS functions, 'Part' || k AS classes, 'size(self, a) step(self, a)' AS methods, 'os lib.m' || k AS imports, 'Part ' || k || '.' AS docstring FROM s WHERE language = 'python' AND NOT broken")
def parse_python_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = python_sources(spark, sf_dir).select("path", code.parse_python("content").alias("p")).where("p is not null")
    joined = lambda c, f: F.array_join(F.transform(c, f), " ")
    return parsed.select("path", F.col("p.loc").alias("loc"), joined("p.functions", lambda f: f["name"]).alias("functions"), joined("p.classes", lambda c: c["name"]).alias("classes"), joined(F.flatten(F.transform("p.classes", lambda c: c["methods"])), lambda m: m["signature"]).alias("methods"), joined("p.imports", lambda i: i["module"]).alias("imports"), F.element_at("p.classes", 1)["docstring"].alias("docstring"))


@query(f"WITH {SQL_SOURCES}, p AS (SELECT * FROM s WHERE language = 'python' AND NOT broken) SELECT path, 'build_' || k AS name, 1 AS complexity FROM p UNION ALL SELECT path, 'size', 2 FROM p UNION ALL SELECT path, 'step', (1 + r)::INT FROM p")
def mccabe(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsing.parse_files(python_sources(spark, sf_dir))
    every = F.concat("functions", F.flatten(F.transform("classes", lambda c: c["methods"])))
    return parsed.select("path", F.explode(every).alias("f")).select("path", F.col("f.name").alias("name"), F.col("f.complexity").alias("complexity"))


@query(f"WITH {SQL_SOURCES}, x AS ({_inside_sql(('python',), ('call',))}) SELECT path, owner AS caller, name AS callee, start_line AS line, CASE WHEN contains(name, 'Result') THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, contains(name, 'Result') AS is_dynamic FROM x")
def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    code.register(spark)
    python_sources(spark, sf_dir).createOrReplaceTempView("graphloom_sources")
    return spark.sql("SELECT path, c.* FROM graphloom_sources, LATERAL python_calls(content) AS c")


def _parsed(spark: SparkSession, sf_dir: str, python: bool = False) -> DataFrame:
    """Parsed once and kept: nodes and edges read it several times."""
    return cut(parsing.parse_files((python_sources if python else sources)(spark, sf_dir)))


SQL_PYTHON = f"{SQL_SOURCES}, p AS (SELECT *, 'file:' || path AS file, 'class:' || path || ':Part' || k AS klass, 'func:' || path || ':' AS f FROM s WHERE language = 'python' AND NOT broken)"


@query(f"""WITH {SQL_PYTHON}, e AS (SELECT f || x AS src, file AS dst, 'DEFINED_IN' AS type, 1.0::DOUBLE AS weight, 1 AS n FROM (SELECT *, unnest(['size', 'step', 'build_' || k]) AS x FROM p)
UNION ALL SELECT f || x, klass, 'DEFINED_IN', 1.0, 1 FROM (SELECT *, unnest(['size', 'step']) AS x FROM p) UNION ALL SELECT klass, file, 'DEFINED_IN', 1.0, 1 FROM p UNION ALL SELECT klass, 'class:' || path || ':Base', 'INHERITS', 1.0, 1 FROM p
UNION ALL SELECT file, 'import:os', 'IMPORTS', 1.0, 1 FROM p UNION ALL SELECT file, 'import:lib.m' || k || ':helper_' || k, 'IMPORTS', 1.0, 1 FROM p
UNION ALL SELECT f || 'size', x, 'CALLS', 0.5, 2 FROM (SELECT *, unnest(['method:step', 'method:join']) AS x FROM p) UNION ALL SELECT f || 'size', f || 'str', 'CALLS', 1.0, 2 FROM p
UNION ALL SELECT f || 'build_' || k, 'method:size', 'CALLS', 0.5, 1 FROM p UNION ALL SELECT f || 'build_' || k, f || 'Part' || k, 'CALLS', 1.0, 1 FROM p) SELECT src, dst, type, weight, n::BIGINT AS n FROM e""")
def python_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.code_graph(_parsed(spark, sf_dir, True))[1]


@query(f"""WITH {SQL_PYTHON} SELECT file AS id, 'File' AS type, 'm' || k || '.py' AS name, NULL::INT AS line_number, NULL AS signature, NULL AS docstring, (21 + 2 * r)::INT AS loc FROM p
UNION ALL SELECT klass, 'Class', 'Part' || k, 5, NULL, 'Part ' || k || '.', 8 + 2 * r FROM p UNION ALL SELECT f || 'size', 'Function', 'size', 8, 'size(self, a)', NULL, 2 FROM p
UNION ALL SELECT f || 'step', 'Function', 'step', 12, 'step(self, a)', NULL, 1 + 2 * r FROM p UNION ALL SELECT f || 'build_' || k, 'Function', 'build_' || k, 16 + 2 * r, 'build_' || k || '(n)', NULL, 1 FROM p""")
def python_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsing.code_graph(_parsed(spark, sf_dir, True))[0]
    return nodes.select("id", "type", "name", "line_number", "signature", "docstring", "loc")


@query(f"WITH {SQL_SOURCES} SELECT path, 1 AS line, 'syntax error' AS message FROM s WHERE language = 'python' AND broken UNION ALL SELECT 'run' || p_partkey, 2, 'use of ' || CASE WHEN p_partkey % 2 = 0 THEN 'eval' ELSE 'exec' END FROM part WHERE p_size > 40")
def python_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code.register(spark)
    risky = table(spark, sf_dir, "part").select(F.concat(F.lit("run"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_size") > 40, F.when(F.col("p_partkey") % 2 == 0, "x = 1\neval('x')\n").otherwise("x = 1\nexec('x')\n")).otherwise("# eval(1)\n").alias("content"))
    python_sources(spark, sf_dir).unionAll(risky).createOrReplaceTempView("graphloom_sources")
    return spark.sql("SELECT path, e.line, regexp_replace(e.message, ':.*', '') AS message FROM graphloom_sources, LATERAL python_errors(content) AS e")


@query(f"""WITH {SQL_SOURCES}, x AS ({_inside_sql()}) SELECT 'r:' || path || CASE kind WHEN 'method' THEN '::' || owner ELSE '' END || '::' || name AS id, CASE kind WHEN 'class' THEN 'Class' ELSE 'Function' END AS what, start_line, end_line FROM x WHERE kind IN ('class', 'method', 'function')
UNION ALL SELECT 'r:' || path, 'File', NULL, NULL FROM s WHERE NOT broken
UNION ALL SELECT DISTINCT 'r:' || path || CASE kind WHEN 'method' THEN '::' || owner ELSE '' END || ' -> ' || CASE kind WHEN 'import' THEN name ELSE 'r:' || path || CASE kind WHEN 'method' THEN '::' || owner ELSE '' END || '::' || name END, CASE kind WHEN 'class' THEN 'CONTAINS' WHEN 'method' THEN 'DEFINES_METHOD' WHEN 'function' THEN 'DEFINES_FUNCTION' ELSE 'IMPORTS' END, NULL, NULL FROM x WHERE kind <> 'call'""")
def analysis_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = parsing.analysis_graph(parsing.parse_files(sources(spark, sf_dir)), "r", written)
    null = F.lit(None).cast("int")
    return nodes.select("id", F.col("labels")[0].alias("what"), "start_line", "end_line").unionAll(edges.select(F.concat_ws(" -> ", "src", "dst"), "type", null, null))


@query(f"""WITH {SQL_SOURCES}, x AS ({_inside_sql(('python',), ('class', 'function', 'method'))}), p AS (SELECT * FROM s WHERE language = 'python')
SELECT path || '::' || CASE kind WHEN 'method' THEN owner || '.' ELSE '' END || name AS chunk_id, kind AS type, end_line - start_line AS more_lines FROM x WHERE kind <> 'class'
UNION ALL SELECT path || '::' || name, kind, 5 FROM x WHERE kind = 'class' UNION ALL SELECT path || '::whole', 'window', 21 + 2 * r FROM p WHERE broken""")
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """more_lines: the lines of a chunk's code after its first; of a class's and a broken file's, of all its text."""
    parsed = python_sources(spark, sf_dir).select("path", "content", code.parse_python("content").alias("p")).select("path", "content", "p.functions", "p.classes")
    after = F.when(F.col("type").isin("class", "window"), F.col("text")).otherwise(F.regexp_replace("text", r"(?s)^.*?\nCode:\n", ""))
    return text.structural_chunks(parsed).select("chunk_id", "type", (F.length(after) - F.length(F.replace(after, F.lit("\n"), F.lit("")))).alias("more_lines"))


@query(f"""WITH {SQL_SOURCES} SELECT path, 'make_' || k || ' use_' || k || ' main make_' || k AS functions, '' AS classes, 'lib' || k || '.h' AS imports FROM s WHERE language = 'c'""")
def c_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By patterns alone, which take `return f(x)` for a definition: the fallback where a text has no parser."""
    found = sources(spark, sf_dir).where(F.endswith("path", F.lit(".c"))).select("path", code.c_symbols(F.col("content")).alias("s"))
    return found.select("path", *(F.array_join(f"s.{c}", " ").alias(c) for c in ("functions", "classes", "imports")))


@query(f"""WITH {SQL_SOURCES} SELECT path, (10 + r)::INT AS line, 'main' AS caller, 'make_' || k AS callee FROM s WHERE language = 'c'""")
def c_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By patterns alone: a function whose brace is on the next line opens nothing."""
    return code.c_calls(sources(spark, sf_dir).where(F.endswith("path", F.lit(".c"))), "path", "content")


@query(f"WITH {SQL_SOURCES} SELECT path, 1 AS line, 'syntax error' AS message FROM s WHERE language = 'python' AND broken UNION ALL SELECT 'long' || p_partkey || '.rs', 1, 'line over 120 characters' FROM part WHERE p_size > 20")
def scanner_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "part").select(F.concat(F.lit("long"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("path"), F.repeat(F.lit("// 3"), F.when(F.col("p_size") > 20, 31).otherwise(30)).alias("content"))
    found = code.scan_issues(spark, sources(spark, sf_dir).unionAll(long))
    return found.select("path", "line", F.regexp_replace("message", ":.*", "").alias("message"))


# Imports and calls across files: every part is a module of one package, which calls that of the next key


#: By the key modulo 4: an absolute import, a relative one of a module, one of a name, and one of a longer name with an alias.
MODULES = (
    "import lib.m{j}\n\ndef f{k}():\n    lib.m{j}.f{j}()\n    return g{k}()\n\ndef g{k}():\n    return missing()\n",
    "from . import m{j}\n\ndef f{k}():\n    m{j}.f{j}()\n    m{j}.C{j}.run()\n",
    "from .m{j} import f{j}\nimport os\n\nclass C{k}:\n    def run(self):\n        m{j}.f{j}()\n        os.remove(1)\n\ndef f{k}():\n    return C{k}()\n",
    "import lib.m{j}.deep as d{j}\n\ndef f{k}():\n    d{j}.f{j}()\n\nf{k}()\n",
)
SQL_MODULES = """m AS (SELECT p_partkey AS k, p_partkey + 1 AS j, p_partkey % 4 AS n, p_partkey + 1 IN (SELECT p_partkey FROM part) AS there, 'lib/m' || p_partkey || '.py' AS path, 'r:lib/m' || p_partkey || '.py' AS own, 'r:lib/m' || (p_partkey + 1) || '.py' AS other FROM part)"""
SQL_LINKS = f"""WITH {SQL_MODULES}, e AS (SELECT own || CASE n WHEN 2 THEN '::C' || k || '::run' ELSE '::f' || k END AS src, other || '::f' || j AS dst FROM m WHERE there UNION ALL SELECT own || '::f' || k, other || '::C' || j || '::run' FROM m WHERE there AND n = 1
UNION ALL SELECT own || '::f' || k, own || '::g' || k FROM m WHERE n = 0 UNION ALL SELECT own || '::f' || k, own || '::C' || k FROM m WHERE n = 2 UNION ALL SELECT own, own || '::f' || k FROM m WHERE n = 3)"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a Python module of each part."""
    key = F.col("p_partkey")
    pick = F.element_at(F.array(*map(F.lit, MODULES)), (key % 4 + 1).cast("int"))
    filled = F.replace(F.replace(pick, F.lit("{k}"), key.cast("string")), F.lit("{j}"), (key + 1).cast("string"))
    part = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return part.select(F.concat(F.lit("lib/m"), key.cast("string"), F.lit(".py")).alias("path"), filled.alias("content"))


def _resolved(parsed: DataFrame) -> DataFrame:
    return resolution.resolve_imports(resolution.candidates(resolution.imports_of(parsed)), impact.module_map(parsed.select("path")))


@query(f"""WITH {SQL_MODULES} SELECT path, CASE n WHEN 0 THEN 'lib.m' || j WHEN 3 THEN 'lib.m' || j || '.deep' ELSE 'm' || j END AS key, 'lib/m' || j || '.py' AS target, (n = 1 OR n = 3)::INT AS rank FROM m WHERE there UNION ALL SELECT path, 'd' || j, 'lib/m' || j || '.py', 1 FROM m WHERE there AND n = 3""")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(_modules(spark, sf_dir))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(parsing.parse_files(modules(spark, sf_dir)))


@query(f"{SQL_LINKS} SELECT src, dst, 1::BIGINT AS n FROM e")
def linked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.call_graph(_modules(spark, sf_dir), "r")


def _stored_links(spark: SparkSession, sf_dir: str) -> resolution.LinkStore:
    store = resolution.LinkStore(spark, f"{shared_folder(spark)}/links-{uuid.uuid4().hex}", "r")
    whole = modules(spark, sf_dir)
    for number in range(2):
        store.add(whole.where(F.pmod(F.xxhash64("path"), F.lit(2)) == number), number)
    return store


@query(f"{SQL_LINKS} SELECT src, dst, 1::BIGINT AS n FROM e")
def links_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links as linked_calls, of files that arrive in two batches."""
    return _stored_links(spark, sf_dir).edges()


@query(f"""WITH {SQL_MODULES} SELECT own || '::g' || k AS src, 'missing' AS callee, 1::BIGINT AS n FROM m WHERE n = 0 UNION ALL SELECT own || '::C' || k || '::run', 'os.remove', 1 FROM m WHERE n = 2
UNION ALL SELECT own || CASE n WHEN 2 THEN '::C' || k || '::run' ELSE '::f' || k END, CASE n WHEN 0 THEN 'lib.m' WHEN 3 THEN 'd' ELSE 'm' END || j || '.f' || j, 1 FROM m WHERE NOT there UNION ALL SELECT own || '::f' || k, 'm' || j || '.C' || j || '.run', 1 FROM m WHERE NOT there AND n = 1""")
def external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_links(spark, sf_dir).external_calls()


@query(f"""WITH {SQL_MODULES} SELECT path FROM m WHERE there AND j IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def importing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("lib/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return resolution.importers(_resolved(_modules(spark, sf_dir)), big)


# Graphs in the shapes in which they are stored


SQL_NAMES = f"""{SQL_SOURCES}, x AS ({_inside_sql()}), named AS (SELECT DISTINCT path, regexp_extract(path, '[^/]+$') AS file, name, CASE kind WHEN 'class' THEN 'Class' ELSE 'Function' END AS label FROM x WHERE kind IN ('class', 'function', 'method')),
defined AS (SELECT path, file, name, max(label) AS label FROM named GROUP BY ALL), py AS (SELECT * FROM s WHERE language = 'python' AND NOT broken),
calls AS (SELECT DISTINCT path, owner AS caller, name AS callee FROM x WHERE kind = 'call' AND language <> 'python' AND owner <> '<global>' UNION ALL SELECT path, 'size', unnest(['step', 'join', 'str']) FROM py UNION ALL SELECT path, 'build_' || k, unnest(['size', 'Part' || k]) FROM py)"""


@query(f"""WITH {SQL_NAMES} SELECT 'r:' || path AS src, 'r:' || path || '::' || name AS dst, 'CONTAINS' AS type FROM defined UNION ALL SELECT 'r:' || c.path || '::' || caller, 'r:' || c.path || '::' || callee, 'CALLS' FROM calls c JOIN defined d ON d.path = c.path AND d.name = callee""")
def structure_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.structure_graph(_parsed(spark, sf_dir), "r")[1]


@query(f"""WITH {SQL_NAMES} SELECT 'r:' || path || '::' || name AS id, label, coalesce((SELECT string_agg(callee, ' ' ORDER BY callee) FROM calls c WHERE c.path = defined.path AND caller = name AND callee NOT IN (SELECT name FROM defined d WHERE d.path = c.path)), '') AS external_calls FROM defined""")
def structure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = writers.structure_graph(_parsed(spark, sf_dir), "r")[0].where("label <> 'File'")
    return nodes.select("id", "label", F.array_join(F.array_sort("external_calls"), " ").alias("external_calls"))


@query(f"""WITH {SQL_NAMES}, files AS (SELECT DISTINCT path FROM x) SELECT 'r:' || path AS src, 'r:' || path || '::' || name AS dst, 'CONTAINS' AS type FROM defined
UNION ALL SELECT DISTINCT 'r:' || x.path, 'r:' || f.path, 'IMPORTS' FROM x JOIN files f ON ends_with(f.path, x.name) OR ends_with(f.path, x.name || '.h') OR ends_with(f.path, x.name || '.py') WHERE kind = 'import'
UNION ALL SELECT 'r:' || c.path || '::' || caller, 'r:' || t.path || '::' || callee, 'CALLS' FROM calls c JOIN defined t ON t.name = callee AND t.label = 'Function' WHERE EXISTS (SELECT 1 FROM defined d WHERE d.path = c.path AND d.name = caller AND d.label = 'Function')""")
def named_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.named_graph(parsing.parse_files(sources(spark, sf_dir)), "r", written)


@query(f"""WITH {SQL_NAMES}, known AS (SELECT name, label || ':' || file || ':' || name AS id FROM defined UNION SELECT name, 'Module:' || name FROM x WHERE kind = 'import' UNION SELECT regexp_extract(path, '[^/]+$'), 'File:' || regexp_extract(path, '[^/]+$') FROM x),
c AS (SELECT regexp_extract(path, '[^/]+$') AS file, caller, callee FROM calls) SELECT 'File:' || file AS src, label || ':' || file || ':' || name AS dst, 'DEFINES' AS type FROM defined UNION ALL SELECT DISTINCT 'File:' || regexp_extract(path, '[^/]+$'), 'Module:' || name, 'IMPORTS' FROM x WHERE kind = 'import'
UNION ALL SELECT 'Function:' || file || ':' || caller, coalesce(id, 'name:' || callee), 'CALLS' FROM c LEFT JOIN known ON name = callee WHERE EXISTS (SELECT 1 FROM defined d WHERE d.file = c.file AND d.name = caller AND d.label = 'Function')""")
def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.module_graph(parsing.parse_files(sources(spark, sf_dir)), written)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "Class").when(F.col("p_size") % 3 == 1, "Function").otherwise("Snippet")
    key = F.col("p_partkey").cast("string")
    about = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("repo_name"), F.col("p_brand"), F.lit("is_code"), F.lit("no")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py")).alias("file_path"), F.concat(F.lit("s"), key).alias("symbol_name"), kind.alias("symbol_type"), F.repeat(F.lit("code "), F.col("p_size") * 20).alias("snippet"), about.alias("metadata"))


SQL_ELEMENTS = "e AS (SELECT p_partkey AS k, 'src/f' || (p_partkey % 50) || '.py' AS path, 's' || p_partkey AS name, ['Class', 'Function', 'Snippet'][p_size % 3 + 1] AS kind, repeat('code ', p_size * 20) AS code, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS repo FROM part)"


@query(f"WITH {SQL_ELEMENTS} SELECT md5(kind || ' ' || name || ' in ' || path || chr(10) || 'Running code:' || chr(10) || left(code, 2000)) AS digest, repo AS repo_name, 'true' AS is_code, name AS symbol_name FROM e")
def element_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writers.element_memories(_elements(spark, sf_dir))
    of = lambda k: F.col("payload")[k].alias(k)
    return found.select(F.md5(F.col("content").cast("binary")).alias("digest"), of("repo_name"), of("is_code"), of("symbol_name"))


@query(f"WITH {SQL_ELEMENTS} SELECT coalesce(repo, 'unknown') || ':' || path AS src, coalesce(repo, 'unknown') || ':' || path || '::' || name AS dst, 'CONTAINS' AS type FROM e WHERE kind <> 'Snippet'")
def element_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.element_graph(_elements(spark, sf_dir))[1]


@query(f"""WITH {SQL_SOURCES}, p AS (SELECT 'Part' || k AS name FROM s WHERE language = 'python' AND NOT broken ORDER BY 1 LIMIT 20) SELECT 'classDiagram' || chr(10) || string_agg('    class ' || name || chr(10) || '    ' || name || ' : +size()' || chr(10) || '    ' || name || ' : +step()' || chr(10) || '    Base <|-- ' || name, chr(10) ORDER BY name) AS text FROM p""")
def class_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.class_diagram(parsing.parse_files(python_sources(spark, sf_dir)), 20)


@query("SELECT 'run' || p_partkey AS path, CASE WHEN p_size % 5 = 0 THEN 'Security Risk: Use of eval near ' || p_brand ELSE 'use of eval' END AS message, 'ERROR' AS severity FROM part WHERE p_size > 40")
def security_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    code.register(spark)
    part = table(spark, sf_dir, "part").where("p_size > 40")
    path = F.concat(F.lit("run"), F.col("p_partkey").cast("string")).alias("path")
    part.select(path, F.lit("x = eval('1')\n").alias("content")).createOrReplaceTempView("graphloom_risky")
    checked = spark.sql("SELECT path, e.message FROM graphloom_risky, LATERAL python_errors(content) AS e")
    told = part.select(path, F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Use of eval near "), "p_brand")).otherwise("  ").alias("value"))
    return writers.security_issues(told, checked)


@query(f"""WITH {SQL_PYTHON} SELECT f || x AS id FROM (SELECT *, unnest(['size', 'step', 'build_' || k]) AS x FROM p)""")
def dead_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public functions that no function calls by name: calls of attributes name no function."""
    nodes, edges = parsing.code_graph(_parsed(spark, sf_dir, True))
    return graph.dead_nodes(nodes.where("type = 'Function'"), edges, public_only=True).select("id")
