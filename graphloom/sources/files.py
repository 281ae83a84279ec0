"""Repositories of files as DataFrames: scans, markers, build rules and tool output."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Endings and names of the files that a scan keeps, folders that it leaves out.
EXTENSIONS = (
    ".py .pyi .pyx .ipy"
    " .js .jsx .ts .tsx .mjs .cjs .vue .svelte .astro .html .htm .css .scss .sass .less .styl .json .json5 .xml .yaml .yml .toml .graphql .gql"
    " .c .cpp .cxx .cc .cp .h .hpp .hxx .hh .inl .m .mm .ino"
    " .java .kt .kts .scala .groovy .clj .cljs"
    " .cs .fs .vb"
    " .go .rs"
    " .sh .bash .zsh .fish .bat .ps1 .cmd .awk .sed .rb .php .pl .pm .lua .r .dart .el .vim"
    " .ini .conf .cfg .properties .env .env.example .csv .tsv .sql .dockerfile .editorconfig .gitignore .gitattributes"
    " .md .markdown .rst .txt .tex .asc .adoc"
).split()
NAMES = ("Dockerfile", "Makefile", "LICENSE", "Gemfile", "Rakefile")
FOLDERS = ("venv", "__pycache__", "node_modules", "dist", "build")
#: Parts of a path, and endings, that the metrics scan leaves out.
IGNORED = "__pycache__ .git .venv venv env node_modules .pytest_cache .mypy_cache .tox build dist .egg-info .eggs .coverage htmlcov .DS_Store Thumbs.db".split()
IGNORED_ENDS = ".pyc .pyo .so .dll .exe .o .a .log".split()
#: Endings that the structure scan parses.
PARSED = ".py .js .ts .jsx .tsx .java .go .rs .c .cpp .h".split()
#: The language of an ending.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript (React)", ".ts": "TypeScript", ".tsx": "TypeScript (React)",
    ".java": "Java", ".go": "Go", ".rs": "Rust", ".c": "C", ".cpp": "C++", ".cc": "C++", ".h": "C/C++ Header", ".hpp": "C++ Header",
    ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".r": "R", ".sh": "Shell",
    ".bash": "Bash", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".sql": "SQL", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON",
    ".xml": "XML", ".md": "Markdown",
}
#: Files that tell a project's type, the first that matches counts, and a build system.
PROJECT_TYPES = {
    "python": ("setup.py", "pyproject.toml", "requirements.txt", "Pipfile"),
    "go": ("go.mod",),
    "rust": ("Cargo.toml",),
    "nodejs": ("package.json",),
    "java": ("pom.xml", "build.gradle"),
}
BUILD_SYSTEMS = {"make": "Makefile", "cmake": "CMakeLists.txt", "go": "go.mod", "npm": "package.json"}
#: Words that name a framework in a manifest, and keys in package.json.
PYTHON_FRAMEWORKS = {"django": "django", "fastapi": "fastapi", "flask": "flask", "numpy": "numpy", "pandas": "pandas", "torch": "pytorch", "tensorflow": "tensorflow", "sqlalchemy": "sqlalchemy", "pydantic": "pydantic"}
PYTHON_MANIFESTS = ("requirements.txt", "requirements-dev.txt", "setup.py", "pyproject.toml")
GO_FRAMEWORKS = ("gin", "echo", "gorm")
NODE_FRAMEWORKS = {"react": "react", "next": "next.js", "express": "express", "nestjs": "nestjs", "@nestjs/core": "nestjs", "vue": "vue", "angular": "angular", "@angular/core": "angular", "tensorflow": "tensorflow.js", "tf.js": "tensorflow.js"}


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last ending in lower case; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]*[^.])$", 1))


FILE = "path string, length bigint, modificationTime timestamp, content binary"


class RepoFiles(DataSource):
    """All files under a folder, hidden ones and ones that begin with an underscore too, which Spark's
    own readers leave out. Options: path (any URI that pyarrow opens), glob of names, content (false:
    null), split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "repofiles"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return _RepoReader(dict(self.options))


class _RepoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _open(self):
        from pyarrow import fs

        root = self.options["path"]
        return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._open()
        glob = self.options.get("glob", "*")
        found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and fnmatch.fnmatchcase(x.base_name, glob)]
        most, parts, size = int(self.options.get("split", 33554432)), [[]], 0
        for x in sorted(found, key=lambda x: x.path):
            if parts[-1] and size + x.size > most:
                parts.append([])
                size = 0
            parts[-1].append((x.path, x.size, x.mtime))
            size += x.size
        return [InputPartition((root, p)) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = self._open()
        root, rows = partition.value
        below = len(root.split("://", 1)[-1].rstrip("/")) + 1 if "://" not in root else len(self._open()[1].rstrip("/")) + 1
        want = self.options.get("content", "true") != "false"
        for path, size, at in rows:
            data = None
            if want:
                with store.open_input_stream(path) as f:
                    data = f.read()
            yield path[below:], size, at, data


def scan(spark: SparkSession, root: str, glob: str = "*", content: bool = True) -> DataFrame:
    """(path below root, length, modificationTime, content) of every file."""
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repofiles").option("path", root).option("glob", glob).option("content", str(content).lower()).load()


def scan_store(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The same from any store that Spark reads, by its own reader: it leaves out files without bytes
    and names that begin with an underscore or a dot."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    start = re.escape(root.split("://", 1)[-1].strip("/"))
    return df.withColumn("path", F.regexp_replace("path", rf"^.*?{start}/", "")).select("path", "length", "modificationTime", "content")


def repo_files(files: DataFrame) -> DataFrame:
    """The files of a scan that hold code or text: known endings and names, outside hidden and built folders."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(".", "..")) | F.arrays_overlap(parts, F.array(*map(F.lit, FOLDERS)))
    return files.where(~hidden & (extension(F.col("path")).isin(*EXTENSIONS) | name_of(F.col("path")).isin(*NAMES)))


def python_files(files: DataFrame) -> DataFrame:
    return files.where(F.endswith("path", F.lit(".py")))


def ignored(path: Column) -> Column:
    """Whether the metrics scan leaves a path out: a part may stand anywhere in it."""
    found = F.lit(False)
    for part in IGNORED:
        found = found | F.contains(path, F.lit(part))
    for end in IGNORED_ENDS:
        found = found | F.endswith(path, F.lit(end))
    return found


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(table, extension(path)), F.lit("Unknown"))


def metric_files(files: DataFrame) -> DataFrame:
    """Text files in a known language that the metrics scan doesn't ignore."""
    return files.where(~ignored(F.col("path")) & (language_of(F.col("path")) != "Unknown") & is_text(F.col("content")))


def is_text(content: Column) -> Column:
    """Whether the first 512 bytes, less a character cut off at their end, are UTF-8."""
    head = F.substring(content, 1, 512)
    found = F.is_valid_utf8(head.cast("string"))
    for less in (1, 2, 3):
        found = found | (F.length(content) > 512) & F.is_valid_utf8(F.substring(head, F.lit(1), F.lit(512 - less)).cast("string"))
    return found


def overview(files: DataFrame) -> DataFrame:
    """(extension, files, bytes), the commonest first; paths through .git are left out."""
    kept = files.where(~F.contains("path", F.lit(".git")))
    return kept.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("files"), "extension")


def project_type(files: DataFrame) -> DataFrame:
    """One row: the project's type by the marker files in its root."""
    has = files.where(~F.contains("path", F.lit("/"))).agg(F.collect_set("path").alias("names"))
    kind = None
    for name, markers in PROJECT_TYPES.items():
        kind = (F if kind is None else kind).when(F.arrays_overlap("names", F.array(*map(F.lit, markers))), name)
    sharp = F.exists("names", lambda n: F.endswith(n, F.lit(".csproj")) | F.endswith(n, F.lit(".sln")))
    return has.select(kind.when(sharp, "csharp").otherwise("unknown").alias("project_type"))


def build_systems(files: DataFrame) -> DataFrame:
    """(type, file) of the build systems whose marker is in the root."""
    table = F.create_map(*(F.lit(x) for k, v in BUILD_SYSTEMS.items() for x in (v, k)))
    return files.select("path", F.element_at(table, F.col("path")).alias("type")).where("type is not null").select("type", F.col("path").alias("file"))


def make_targets(makefile: DataFrame, name: str, content: str = "content") -> DataFrame:
    """(target): rules of a Makefile whose line names the file."""
    pattern = rf"^(\w+):.*{re.escape(name)}"
    lines = makefile.select(F.explode(F.split(F.col(content).cast("string"), "\n")).alias("line"))
    return lines.select(F.regexp_extract("line", pattern, 1).alias("target")).where("target <> ''")


def build_context(files: DataFrame, path: str) -> DataFrame:
    """One row for a file: build_type and commands. A Makefile that names it wins, then Go's tools."""
    targets = make_targets(files.where("path = 'Makefile'"), path.rsplit("/", 1)[-1]).agg(F.collect_list(F.concat(F.lit("make "), "target")).alias("made"))
    go = F.lit(path.endswith(".go"))
    made = F.size("made") > 0
    kind = F.when(made, "make").when(go, "go").otherwise("unknown")
    commands = F.when(made, F.col("made")).when(go, F.array(F.lit("go test ./..."), F.lit("go build ./..."))).otherwise(F.array().cast("array<string>"))
    return targets.select(kind.alias("build_type"), commands.alias("commands"))


def frameworks(files: DataFrame) -> DataFrame:
    """(framework): those that the manifests in the root name."""
    text = files.select("path", F.col("content").cast("string").alias("t"))
    python = text.where(F.col("path").isin(*PYTHON_MANIFESTS)).select(F.explode(F.array_compact(F.array(*(F.when(F.contains(F.lower("t"), F.lit(k)), v) for k, v in PYTHON_FRAMEWORKS.items())))).alias("framework"))
    go = text.where("path = 'go.mod'").select(F.explode(F.array_compact(F.array(*(F.when(F.contains("t", F.lit(k)), k) for k in GO_FRAMEWORKS)))).alias("framework"))
    deps = F.from_json("t", "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.array_union(F.coalesce(F.map_keys(deps["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(deps["devDependencies"]), F.array().cast("array<string>")))
    table = F.create_map(*(F.lit(x) for pair in NODE_FRAMEWORKS.items() for x in pair))
    node = text.where("path = 'package.json'").select(F.explode(F.array_compact(F.transform(keys, lambda k: F.element_at(table, k)))).alias("framework"))
    return python.union(go).union(node).distinct()


def tool_complexity(csv: DataFrame, line: str = "value", above: int = 10) -> DataFrame:
    """(name, complexity) from the lines of a complexity tool's CSV: field 2 is the number, 8 the name."""
    f = F.from_csv(line, "nloc int, ccn int, tokens int, params int, length int, location string, file string, name string")
    return csv.select(f["name"].alias("name"), f["ccn"].alias("complexity")).where(F.col("complexity") > above)


def lint_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """(path, line, column, code, message) from `path:line:column: CODE message` lines."""
    pattern = r"^(.+?):(\d+):(\d+): (\S+) (.*)$"
    part = lambda n: F.regexp_extract(line, pattern, n)
    return df.where(F.regexp_like(line, F.lit(pattern))).select(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(4).alias("code"), part(5).alias("message"))


def expand_references(messages: DataFrame, files: DataFrame, id: str, text: str) -> DataFrame:
    """(id, path, content) of the files that a text names as @path."""
    from graphloom.functions.text import AT_FILE, mentions

    named = messages.select(id, F.explode(F.array_distinct(mentions(F.col(text), AT_FILE))).alias("path"))
    return named.join(files.select("path", F.col("content").cast("string").alias("content")), "path").select(id, "path", "content")


def repo_id(url: Column) -> Column:
    """repo_ and eight digits of the MD5 of the trimmed lower-case URL without .git."""
    return F.concat(F.lit("repo_"), F.substring(F.md5(F.regexp_replace(F.lower(F.trim(url)), r"\.git$", "").cast("binary")), 1, 8))


def shard(hash: Column) -> Column:
    """The folder of a hash in a cache: its first two digits."""
    return F.substring(hash, 1, 2)


def write_cache(analyses: DataFrame, path: str) -> None:
    """analyses(hash, analysis) as Parquet, one folder a shard, so a look-up reads the shards it needs."""
    analyses.withColumn("shard", shard(F.col("hash"))).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)
