"""Imports, calls across files, links in batches, and paths over several relations."""

import collections
import itertools
import random

import pytest

from graphloom.functions.parsing import parse_files
from graphloom.operators import impact, paths, resolution

CHAIN = {
    "db.py": "\ndef connect():\n    print('Connecting to DB')\n",
    "service.py": "\nimport db\n\ndef process_data():\n    db.connect()\n    print('Processing')\n",
    "controller.py": "\nimport service\n\ndef handle_request():\n    service.process_data()\n",
    "main.py": "\nimport controller\n\ndef main():\n    controller.handle_request()\n\nif __name__ == '__main__':\n    main()\n",
}
PACKAGE = {
    "top.py": "import pkg.sub.leaf as l, pkg\nfrom pkg import tool\ndef go():\n    l.f()\n    pkg.start()\n    pkg.sub.leaf.K.m()\n    pkg.tool.f()\n    K().m()\n",
    "pkg/__init__.py": "def start(): pass\n",
    "pkg/tool.py": "from . import sub\nfrom .sub import leaf\nfrom .. import top\nfrom ... import beyond\nfrom .nowhere import x\ndef f():\n    sub.s()\n    top.go()\n    sub.leaf.f()\n    beyond.f()\n",
    "pkg/sub/__init__.py": "def s(): return s()\n",
    "pkg/sub/leaf.py": "from .. import tool\nfrom ..tool import f as g\nclass K:\n    def m(self): tool.f(); helper()\n    def n(self): m()\ndef helper(): K.m(1); K.m(2)\ndef f(): pass\n",
    "beyond.py": "def f(): pass\n",
}


def files(spark, sources):
    return spark.createDataFrame(list(sources.items()), "path string, content string")


def links(df):
    return {(r.src.removeprefix("r:"), r.dst.removeprefix("r:")): r.n for r in df.collect()}


def test_chain_of_files(spark):
    parsed = parse_files(files(spark, CHAIN))
    want = {("service.py::process_data", "db.py::connect"), ("controller.py::handle_request", "service.py::process_data"), ("main.py::main", "controller.py::handle_request"), ("main.py", "main.py::main")}
    found = resolution.call_graph(parsed, "r")
    assert set(links(found)) == want
    target = spark.createDataFrame([("r:db.py::connect",)], "id string")
    assert [r.id for r in impact.direct_callers(found, target).collect()] == ["r:service.py::process_data"]
    assert [r.id for r in impact.second_callers(found, target).collect()] == ["r:controller.py::handle_request"]


def brute_resolve(module, names, level, path, modules):
    """As a reader of one import does it."""
    if level:
        folder = path.split("/")[:-1]
        for _ in range(level - 1):
            folder = folder[:-1]
        name = ".".join(folder + (module.split(".") if module else []))
        if name in modules:
            return modules[name]
        return modules.get(".".join(filter(None, [name, names[0]]))) if not module and names else None
    parts = module.split(".")
    while parts and ".".join(parts) not in modules:
        parts.pop()
    return modules.get(".".join(parts)) if parts else None


def test_imports_resolve(spark):
    parsed = parse_files(files(spark, PACKAGE))
    modules = {p.removesuffix(".py").removesuffix("/__init__").replace("/", "."): p for p in PACKAGE}
    want = {}
    for r in resolution.imports_of(parsed).orderBy("path", "place").collect():
        target = brute_resolve(r.module, r.names or [], r.level, r.path, modules)
        if target:
            want[r.path, r.module or r.names[0]] = target
            if r.alias:
                want[r.path, r.alias] = target
    got = resolution.resolve_imports(resolution.candidates(resolution.imports_of(parsed)), impact.module_map(parsed.select("path")))
    assert {(r.path, r.key): r.target for r in got.collect()} == want
    assert (want["pkg/tool.py", "top"], want["pkg/tool.py", "beyond"], want["top.py", "l"]) == ("top.py", "beyond.py", "pkg/sub/leaf.py")


#: tool's sub and leaf's tool mean modules by their last import; `from . import x` alone means the package.
PACKAGE_LINKS = {
    ("top.py::go", "pkg/sub/leaf.py::f"): 1,
    ("top.py::go", "pkg/__init__.py::start"): 1,
    ("pkg/tool.py::f", "pkg/sub/__init__.py::s"): 1,
    ("pkg/sub/leaf.py::K::m", "pkg/tool.py::f"): 1,
    ("pkg/tool.py::f", "top.py::go"): 1,
    ("pkg/tool.py::f", "beyond.py::f"): 1,
    ("pkg/sub/__init__.py::s", "pkg/sub/__init__.py::s"): 1,
    ("pkg/sub/leaf.py::K::m", "pkg/sub/leaf.py::helper"): 1,
    ("pkg/sub/leaf.py::helper", "pkg/sub/leaf.py::K::m"): 2,
    ("top.py::go", "pkg/sub/leaf.py::K::m"): 1,
}


def test_links_of_a_package(spark):
    got = links(resolution.call_graph(parse_files(files(spark, PACKAGE)), "r"))
    assert {k: n for k, n in got.items() if k in PACKAGE_LINKS} == PACKAGE_LINKS
    assert not {k for k in got if k not in PACKAGE_LINKS and "K" not in k[1]}


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_batches_give_the_links_of_all_files(spark, tmp_path, order):
    names = list(PACKAGE)
    random.Random(order).shuffle(names)
    batches = [names] if not order else [names[:2], names[2:5], names[5:]] if order > 1 else [[n] for n in names]
    store = resolution.LinkStore(spark, str(tmp_path), "r")
    for number, some in enumerate(batches):
        store.add(files(spark, {n: PACKAGE[n] for n in some}), number)
    store.add(files(spark, {"top.py": "changed"}), len(batches) - 1)  # done already
    store.add(files(spark, {names[0]: PACKAGE[names[0]]}), len(batches))  # a file that is known
    assert links(store.edges()) == links(resolution.call_graph(parse_files(files(spark, PACKAGE)), "r"))
    assert ("m" in {r.callee for r in store.external_calls().collect()}) and "K" not in {r.callee for r in store.external_calls().where("src = 'r:pkg/sub/leaf.py::helper'").collect()}


def test_links_of_a_stream(spark, tmp_path):
    """Files as a stream; a restart goes on where the checkpoint ends."""
    feed, table = tmp_path / "feed", tmp_path / "links"
    store = resolution.LinkStore(spark, str(table), "r")
    for number, name in enumerate(CHAIN):
        files(spark, {name: CHAIN[name]}).coalesce(1).write.mode("append").parquet(str(feed))
        source = spark.readStream.schema("path string, content string").parquet(str(feed))
        source.writeStream.foreachBatch(store.add).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        assert len(store._batches()) == number + 1
    assert len(links(store.edges())) == 4


def brute_path(edges, source, target, types):
    """Breadth first, one node after the other."""
    queue, parent = collections.deque([source]), {source: None}
    while queue:
        node = queue.popleft()
        if node == target:
            out = [node]
            while parent[out[0]] is not None:
                out.insert(0, parent[out[0]])
            return out
        for kind in types:
            for _, dst in sorted((p, d) for s, d, t, p in edges if s == node and t == kind):
                if dst not in parent:
                    parent[dst] = node
                    queue.append(dst)
    return None


@pytest.mark.parametrize("seed", range(4))
def test_typed_paths(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 14), draw.randint(0, 14), draw.choice([*paths.DEPENDENCIES, "INHERITS"]), draw.randint(0, 9)) for _ in range(26)]
    df = spark.createDataFrame(edges, "src int, dst int, type string, place int")
    one = lambda x: spark.createDataFrame([(x,)], "id int")
    for source, target in itertools.islice(itertools.permutations(range(15), 2), seed, 210, 71):
        got = paths.typed_path(df, one(source), one(target)).first()
        want = brute_path([(s, d, t, (p, d)) for s, d, t, p in edges], source, target, paths.DEPENDENCIES)
        assert (got.path if got else None) == want and (not got or got.distance == len(want) - 1)


def test_path_to_itself(spark):
    one = spark.createDataFrame([(1,)], "id int")
    edges = spark.createDataFrame([], "src int, dst int, type string, place int")
    assert paths.typed_path(edges, one, one).first().path == [1]


def test_cycles_of_a_repository(spark):
    """Cycles that hold a member, directly or over a class; without a limit they are those of all, sorted out."""
    draw = random.Random(7)
    calls = [(draw.randint(0, 9), draw.randint(0, 9)) for _ in range(30)]
    defines = spark.createDataFrame([("f", "1"), ("c", "f"), ("c", "2"), ("2", "3"), ("g", "4")], "src string, dst string")
    own = paths.members(defines, spark.createDataFrame([("f",)], "id string"))
    assert sorted(r.id for r in own.collect()) == ["1", "2", "c"]
    within = own.where("id <> 'c'").selectExpr("try_cast(id as int) as id").where("id is not null")
    df = spark.createDataFrame(calls, "src int, dst int")
    every = {tuple(r.path) for r in paths.cycles(df, limit=None).collect()}
    assert {tuple(r.path) for r in paths.cycles(df, limit=None, within=within).collect()} == {p for p in every if {1, 2} & {*p}} and every
