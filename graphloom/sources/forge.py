"""Exports of code forges and version control: JSON of issues and reviews, and a `gitlog` source."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ISSUE = "id bigint, number bigint, title string, body string, state string, html_url string, user struct<login:string>, labels array<struct<name:string>>, assignees array<struct<login:string>>, requested_reviewers array<struct<login:string>>, head struct<label:string,ref:string>, base struct<label:string,ref:string>, created_at timestamp, updated_at timestamp"


def items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Issues or pull requests of JSON files with a fixed schema: missing fields are null."""
    return spark.read.schema(ISSUE).option("multiLine", multi_line).json(path)


def assigned_to(df: DataFrame, me: str) -> DataFrame:
    return df.where(F.exists("assignees", lambda a: a["login"] == me))


def review_requests(df: DataFrame, me: str) -> DataFrame:
    return df.where(F.exists("requested_reviewers", lambda r: r["login"] == me))


def mentions(df: DataFrame, me: str) -> DataFrame:
    return df.where(F.contains(F.coalesce("body", F.lit("")), F.lit(f"@{me}")))


def pull_request_of(df: DataFrame, branch: str) -> DataFrame:
    """Pull requests whose head label holds the branch, or is held by it."""
    label = F.coalesce("head.label", "head.ref")
    return df.where(F.contains(label, F.lit(branch)) | F.contains(F.lit(branch), label))


def feed(df: DataFrame, me: str) -> DataFrame:
    """Mentions, assignments and review requests in one feed, each item once with all its reasons."""
    tagged = [f(df, me).select("id", "title", "html_url", F.lit(reason).alias("reason")) for f, reason in ((mentions, "mention"), (assigned_to, "assignment"), (review_requests, "review"))]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).groupBy("id", "title", "html_url").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def provider(url) -> str:
    """The kind of forge of a remote URL."""
    host = url if not isinstance(url, str) else F.lit(url)
    return F.when(F.contains(host, F.lit("github")), "github").when(F.contains(host, F.lit("gitlab")), "gitlab").otherwise("gitea")


class GitLog(DataSource):
    """Commits of a local clone: spark.read.format("gitlog").option("path", ...).load(). Options:
    path, since (a revision; only later ones), max (commits), commits (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "commit string, parents array<string>, author string, ts timestamp, subject string, files array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _GitLogReader(dict(self.options))


class _GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Ranges of commits, counted from a head that is fixed here, so that all tasks see one history."""
        o = self.options
        head = _git(o["path"], "rev-parse", "HEAD").strip()
        span = f"{o['since']}..{head}" if o.get("since") else head
        count = int(_git(o["path"], "rev-list", "--count", span))
        count = min(count, int(o["max"])) if o.get("max") else count
        each = int(o.get("commits", COMMITS))
        return [_Commits(span, at, min(each, count - at)) for at in range(0, count, each)] or [_Commits(span, 0, 0)]

    def read(self, partition: _Commits) -> Iterator[tuple]:
        from datetime import datetime, timezone

        if not partition.many:
            return
        call = ("log", "--name-only", "--format=%x1e%H%x1f%P%x1f%an%x1f%ct%x1f%s%x1f", f"--skip={partition.skip}", f"--max-count={partition.many}", partition.span)
        for record in _records(self.options["path"], call, "\x1e"):
            if "\x1f" in record:
                commit, parents, author, at, subject, files = record.split("\x1f")
                yield commit, parents.split(), author, datetime.fromtimestamp(int(at), timezone.utc), subject, [f for f in files.split("\n") if f]


#: Commits of a partition, unless the option `commits` says otherwise.
COMMITS = 10_000


class _Commits(InputPartition):
    def __init__(self, span: str, skip: int, many: int):
        self.span, self.skip, self.many = span, skip, many


def _git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def _records(path: str, args: tuple[str, ...], separator: str, check: bool = True) -> Iterator[str]:
    """What git writes, record by record, as it is written: no more than one record and a block is held."""
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", path, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        held, sign = b"", separator.encode()
        while block := run.stdout.read(1 << 16):
            *whole, held = (held + block).split(sign)
            yield from (x.decode("utf-8", "replace") for x in whole)
        if held:
            yield held.decode("utf-8", "replace")
    if check and run.returncode:
        raise RuntimeError(f"git {args[0]} ended with {run.returncode}")


#: What `git` lists line by line, as (arguments, columns parted by tabs).
RELATIONS = {
    "files": (["ls-files", "--format=%(objectname)%x09%(path)"], "hash string, path string"),
    "branches": (["for-each-ref", "--format=%(refname:short)%09%(objectname)%09%(HEAD)", "refs/heads"], "name string, commit string, head string"),
    "remotes": (["config", "--get-regexp", r"^remote\..*\.url$"], "line string"),
    "status": (["status", "--porcelain=v1"], "line string"),
    "ancestors": (["rev-list", "HEAD"], "commit string"),
    "diff": (["diff", "HEAD"], "line string"),
}


class GitRelation(DataSource):
    """Relations of a local clone: spark.read.format("git").option("path", ...).option("relation", ...):
    files, branches, remotes, status, ancestors (is a commit one? how many?), diff."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return RELATIONS[self.options["relation"]][1]

    def reader(self, schema) -> DataSourceReader:
        return _GitRelationReader(dict(self.options))


class _GitRelationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        args, columns = RELATIONS[self.options["relation"]]
        n = columns.count(",") + 1
        for line in _records(self.options["path"], tuple(args), "\n", check=False):
            yield tuple(line.split("\t", n - 1))


def remotes(lines: DataFrame) -> DataFrame:
    """(name, url, provider) of the relation `remotes`."""
    url = F.regexp_extract("line", r"^\S+ (.*)$", 1)
    return lines.select(F.regexp_extract("line", r"^remote\.(.*)\.url ", 1).alias("name"), url.alias("url"), provider(url).alias("provider"))


def status(lines: DataFrame) -> DataFrame:
    """(state, path) of the relation `status`."""
    return lines.select(F.trim(F.left("line", F.lit(2))).alias("state"), F.substring("line", 4, 1 << 20).alias("path"))


def register(spark: SparkSession) -> None:
    for source in (GitLog, GitRelation, ForgePages):
        spark.dataSource.register(source)


#: One item of any forge, with its comments and their reactions.
ITEM = "provider string, kind string, id bigint, number bigint, title string, body string, state string, url string, author string, labels array<string>, assignees array<string>, reviewers array<string>, head string, base string, created_at timestamp, updated_at timestamp, comments array<struct<id:bigint,author:string,body:string,created_at:timestamp,reactions:array<struct<name:string,n:bigint>>>>"
#: Where each forge keeps what an item is made of; several places are tried in order.
FIELDS = {
    "github": {"id": "id", "number": "number", "title": "title", "body": "body", "state": "state", "url": "html_url", "author": "user.login", "labels": "labels.name", "assignees": "assignees.login", "reviewers": "requested_reviewers.login", "head": "head.label head.ref", "base": "base.label base.ref", "created_at": "created_at", "updated_at": "updated_at", "comments": "comments_list comments", "comment_author": "user.login", "comment_body": "body", "reaction": "content"},
    "gitlab": {"id": "id", "number": "iid", "title": "title", "body": "description", "state": "state", "url": "web_url", "author": "author.username", "labels": "labels", "assignees": "assignees.username", "reviewers": "reviewers.username", "head": "source_branch", "base": "target_branch", "created_at": "created_at", "updated_at": "updated_at", "comments": "notes", "comment_author": "author.username", "comment_body": "body", "reaction": "name"},
}
FIELDS["gitea"] = FIELDS["github"]
#: States of one forge that others call otherwise.
STATES = {"opened": "open", "reopened": "open", "locked": "closed"}


def _at(item: object, places: str) -> object:
    """The first value found at one of the places; a list on the way gives the values of its entries."""
    for place in places.split():
        found = item
        for name in place.split("."):
            if isinstance(found, list):
                found = [x.get(name) if isinstance(x, dict) else x for x in found]
            else:
                found = found.get(name) if isinstance(found, dict) else None
        if found is not None:
            return found
    return None


def _time(text: object):
    from datetime import datetime, timezone

    try:
        found = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def item_row(item: dict, provider: str, kind: str) -> tuple:
    """A row of ITEM out of an item as the forge's interface gives it; what is missing is null or empty."""
    of = FIELDS[provider]
    get = lambda name: _at(item, of[name])
    texts = lambda x: [str(v["name"]) if isinstance(v, dict) else str(v) for v in x if v is not None] if isinstance(x, list) else []
    text = lambda x: None if x is None else str(x)
    number = lambda x: int(x) if isinstance(x, int) or isinstance(x, str) and x.isdigit() else None
    comments = []
    for c in get("comments") if isinstance(get("comments"), list) else []:
        counted: dict[str, int] = {}
        for r in _at(c, "reactions award_emoji") or []:
            name = _at(r, of["reaction"])
            if name is not None:
                counted[str(name)] = counted.get(str(name), 0) + 1
        comments.append((number(_at(c, "id")), text(_at(c, of["comment_author"])), text(_at(c, of["comment_body"])), _time(_at(c, "created_at")), sorted(counted.items())))
    state = text(get("state"))
    return (provider, kind, number(get("id")), number(get("number")), text(get("title")), text(get("body")), STATES.get(state, state), text(get("url")), text(get("author")), texts(get("labels")), texts(get("assignees")), texts(get("reviewers")), text(get("head")), text(get("base")), _time(get("created_at")), _time(get("updated_at")), comments)


class ForgePages(DataSource):
    """Items of exported pages, in a batch or as a stream: spark.readStream.format("forge").

    Options: path (a folder, any that pyarrow opens), provider (github, gitlab or gitea), kind (issues, pulls,
    notifications, ...: it only labels rows), pages (of a batch of the stream at most). A page is a
    file of JSON, a list of items or an object with `items`, or lines of such; pages follow each other by name,
    and names that begin with `_` or `.` are none. The stream's offset is the name of the last page, so a restart
    goes on after it and repeats nothing; a page is read by one task.
    """

    @classmethod
    def name(cls) -> str:
        return "forge"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PagesStream(dict(self.options))


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.options = options
        if options.get("provider") not in FIELDS:
            raise ValueError(f"provider must be one of {', '.join(FIELDS)}")

    def _open(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def names(self) -> list[str]:
        from pyarrow import fs

        system, path = self._open()
        return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.is_file and x.base_name[:1] not in "_.")

    def read(self, partition: _Page) -> Iterator[tuple]:
        import json

        system, path = self._open()
        with system.open_input_stream(f"{path.rstrip('/')}/{partition.path}") as f:
            text = f.read().decode("utf-8", "replace")
        try:
            pages = [json.loads(text)]
        except ValueError:
            pages = [json.loads(line) for line in text.splitlines() if line.strip()]
        for page in pages:
            for item in (page["items"] if "items" in page else [page]) if isinstance(page, dict) else page:
                yield item_row(item, self.options["provider"], self.options.get("kind", "issues"))


class _PagesReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Page(x) for x in self.names()]


class _PagesStream(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.reached: str | None = None  # where this run's batches have got to

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = self.names()
        most = self.options.get("pages")
        if most and self.reached is not None:
            names = [x for x in names if x <= self.reached] + [x for x in names if x > self.reached][: int(most)]
        elif most:
            names = names[: int(most)]
        self.reached = max([*names, self.reached or ""])
        return {"after": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = max(end["after"], self.reached or "")
        return [_Page(x) for x in self.names() if start["after"] < x <= end["after"]]

    def commit(self, end: dict) -> None:
        return None


def comments(items: DataFrame) -> DataFrame:
    """(provider, number, id, author, body, created_at, reactions): one row a comment."""
    return items.select("provider", "number", F.inline("comments"))


def reaction_counts(items: DataFrame) -> DataFrame:
    """(provider, number, name, n): reactions to an item's comments."""
    return comments(items).select("provider", "number", F.inline("reactions")).groupBy("provider", "number", "name").agg(F.sum("n").alias("n"))


def assigned_items(items: DataFrame, me: str) -> DataFrame:
    return items.where(F.array_contains("assignees", me))


def changed_files(log: DataFrame) -> DataFrame:
    """(path): files that any of the commits touched."""
    return log.select(F.explode("files").alias("path")).distinct()
