"""Text as columns: normalization, chunks, lines, diffs, code fences. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of normalization: longest run of a character, words, share of distinct words, length.
RUN, MANY_WORDS, FEW_DISTINCT, KEEP_WORDS, KEEP_CHARS = 20, 30, 0.1, 30, 800
#: Fixed values of the sliding window.
WINDOW, STEP, NEAR_END = 2000, 1600, 100


def collapse(text: Column) -> Column:
    """White space runs become a space, then control characters go."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[\x00-\x1f\x7f-\x9f]", "")


def shorten_runs(text: Column) -> Column:
    """More than RUN times the same character becomes three."""
    return F.regexp_replace(text, rf"(.)\1{{{RUN},}}", "$1$1$1")


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def unique_ratio(text: Column) -> Column:
    """Distinct words of all words, null without words."""
    w = word_list(text)
    return F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0))


def cap(text: Column) -> Column:
    """Repetitive texts keep KEEP_WORDS words; all keep KEEP_CHARS characters; the ends are trimmed."""
    w = word_list(text)
    dull = (F.size(w) > MANY_WORDS) & (F.size(F.array_distinct(w)) < FEW_DISTINCT * F.size(w))
    return F.trim(F.substring(F.when(dull, F.array_join(F.slice(w, 1, KEEP_WORDS), " ")).otherwise(text), 1, KEEP_CHARS))


def normalize(text: Column) -> Column:
    return cap(shorten_runs(collapse(text)))


def sliding_chunks(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, part, start, chunk): a text of WINDOW characters or fewer is one chunk, part 0. Longer ones
    give windows every STEP characters from part 1; a window that isn't the last ends after its
    last line break, if that is within NEAR_END of its end. Empty and null texts give none."""
    length = F.length(text)
    last = F.ceil(F.greatest(F.lit(0), length - WINDOW) / STEP).cast("int")
    starts = df.where(length > 0).select(F.col(id), F.col(text).alias("_t"), length.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    window = F.substring(F.col("_t"), F.col("_i") * STEP + 1, F.lit(WINDOW))
    back = F.instr(F.reverse(window), "\n")
    cut = (F.col("_i") * STEP + WINDOW < F.col("_n")) & (back > 0) & (back < NEAR_END)
    chunk = F.when(cut, F.substring(window, F.lit(1), F.length(window) - back + 1)).otherwise(window)
    return starts.select(id, F.when(F.col("_n") > WINDOW, F.col("_i") + 1).otherwise(0).alias("part"), (F.col("_i") * STEP).alias("start"), chunk.alias("chunk"))


def head_tail(text: Column, most: int = 20000, head: int = 15000, tail: int = 5000, mark: str = "\n... [truncated] ...\n") -> Column:
    """A long text's beginning and end with a mark between."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


#: What a comment line begins with.
COMMENTS = ("#", "//", "/*", "*", "--", "%")


def line_counts(text: Column) -> Column:
    """A struct of total, blank, comment and code lines; a final line break ends the last line."""
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    lines = F.when(F.length(text) > 0, lines).otherwise(F.array().cast("array<string>"))
    bare = F.transform(lines, lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")))

    def is_comment(x: Column) -> Column:
        found = F.lit(False)
        for mark in COMMENTS:
            found = found | F.startswith(x, F.lit(mark))
        return found

    total, blank = F.size(lines), F.size(F.filter(bare, lambda x: x == ""))
    comment = F.size(F.filter(bare, is_comment))
    return F.struct(total.alias("total"), blank.alias("blank"), comment.alias("comment"), (total - blank - comment).alias("code"))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, both included; empty if either is not a line."""
    lines = F.split(text, "\n")
    inside = (start > 0) & (end > 0) & (start <= F.size(lines)) & (end <= F.size(lines)) & (start <= end)
    return F.when(inside, F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")).otherwise("")


def lines_of(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line, content), lines from 1."""
    return df.select(id, F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def carry_forward(df: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null at or before each row of its key."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def split_diff(df: DataFrame, id: str, diff: str) -> DataFrame:
    """(id, path, hunk): a unified diff by its files; lines before the first file are left out."""
    lines = carry_forward(lines_of(df, id, diff), id, "line", F.nullif(F.regexp_extract("content", r"^diff --git a/\S+ b/(\S+)", 1), F.lit("")), "path")
    return lines.where("path is not null").groupBy(id, "path").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("x")).select(id, "path", F.array_join(F.transform("x", lambda r: r["content"]), "\n").alias("hunk"))


#: A fenced block with an optional path after the language, and a file name in prose.
FENCE = r"(?s)```(?:\w+)?(?::([^\n]+))?\n(.*?)```"
FILE_NAME = r"\b[\w-]+\.\w+\b"
AT_FILE = r"@([\w.\-/]+)"


def fences(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, path, code): fenced blocks in order; path is empty where none is given."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(FENCE), 1).alias("path"), F.regexp_extract_all(text, F.lit(FENCE), 2).alias("code"))
    return df.select(id, F.posexplode(pairs).alias("n", "x")).select(id, "n", F.trim("x.path").alias("path"), F.col("x.code").alias("code"))


def writable(path: Column) -> Column:
    """Whether a fence's path can be a file: not empty, a folder, or a phrase."""
    return ~path.isin("", ".", "./") & ~F.endswith(path, F.lit("/")) & ~F.regexp_like(path, F.lit(r"[ (=]"))


def mentions(text: Column, pattern: str = FILE_NAME) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if "(" in pattern else 0))


def salvage_json(text: Column) -> Column:
    """The text if it is JSON, else its first to last brace if that is, else null."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull(), inner)


def valid_triples(df: DataFrame, least: float = 0.6) -> DataFrame:
    """Triples (subject, predicate, object, confidence as text) whose parts aren't blank, with a
    confidence (1 where there is none or it is no number) above `least`."""
    c = F.coalesce(F.expr("try_cast(confidence AS DOUBLE)"), F.lit(1.0))
    full = F.lit(True)
    for name in ("subject", "predicate", "object"):
        full = full & (F.coalesce(F.trim(name), F.lit("")) != "")
    return df.where(full).withColumn("confidence", c).where(F.col("confidence") > least)


def fact_edges(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept nodes and typed edges of triples; a predicate becomes an upper-case type."""
    kind = F.replace(F.upper(F.trim("predicate")), F.lit(" "), F.lit("_"))
    edges = triples.groupBy(F.trim("subject").alias("src"), kind.alias("type"), F.trim("object").alias("dst")).agg(F.max("confidence").alias("confidence"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("labels", F.array(F.lit("Concept")))
    return nodes, edges


def chunk_text(kind: str, path: Column, name: Column, source: Column, signature: Column | None = None, docstring: Column | None = None, bases: Column | None = None, owner: Column | None = None, code: int = 0) -> Column:
    """The text of a function, class or method chunk; null where its source is blank."""
    doc = F.coalesce(docstring, F.lit("")) if docstring is not None else F.lit("")
    head = [F.lit("File: "), path, F.lit(f"\nType: {kind}\n")] + ([F.lit("Class: "), owner, F.lit("\n")] if owner is not None else []) + [F.lit("Name: "), name, F.lit("\n")]
    if kind == "Class":
        body = [F.lit("Docstring: "), doc, F.lit("\nBases: "), F.array_join(bases, ", "), F.lit("\n")]
    else:
        body = [F.lit("Signature: "), signature, F.when(doc != "", F.concat(F.lit("\nDocstring: "), doc)).otherwise(""), F.lit("\nCode:\n"), F.substring(source, 1, code)]
    return F.when(F.trim(F.regexp_replace(source, r"\s+", " ")) != "", F.concat(*head, *body))


def signature(name: Column, args: Column, returns: Column | None = None) -> Column:
    base = F.concat(F.lit("def "), name, F.lit("("), F.array_join(args, ", "), F.lit(")"))
    return base if returns is None else F.concat(base, F.when(F.coalesce(returns, F.lit("")) != "", F.concat(F.lit(" -> "), returns)).otherwise(""))


def structural_chunks(files: DataFrame) -> DataFrame:
    """(chunk_id, path, type, text) of files(path, content, functions, classes) as parse_python gives
    them: functions with 800 characters of code, classes without, methods with 2000. A file without
    either gives sliding windows."""
    f = files.select("path", "content", F.explode("functions").alias("f"))
    function = f.select(F.concat_ws("::", "path", "f.name").alias("chunk_id"), "path", F.lit("function").alias("type"), chunk_text("Function", F.col("path"), F.col("f.name"), line_range(F.col("content"), F.col("f.start_line"), F.col("f.end_line")), signature(F.col("f.name"), F.col("f.args"), F.col("f.returns")), F.col("f.docstring"), code=800).alias("text"))
    c = files.select("path", "content", F.explode("classes").alias("c"))
    klass = c.select(F.concat_ws("::", "path", "c.name").alias("chunk_id"), "path", F.lit("class").alias("type"), chunk_text("Class", F.col("path"), F.col("c.name"), line_range(F.col("content"), F.col("c.start_line"), F.col("c.end_line")), docstring=F.col("c.docstring"), bases=F.col("c.bases")).alias("text"))
    m = c.select("path", "content", F.col("c.name").alias("owner"), F.explode("c.methods").alias("m"))
    method = m.select(F.concat(F.col("path"), F.lit("::"), F.col("owner"), F.lit("."), F.col("m.name")).alias("chunk_id"), "path", F.lit("method").alias("type"), chunk_text("Method", F.col("path"), F.col("m.name"), line_range(F.col("content"), F.col("m.start_line"), F.col("m.end_line")), signature(F.col("m.name"), F.col("m.args")), F.col("m.docstring"), owner=F.col("owner"), code=2000).alias("text"))
    none = files.where((F.coalesce(F.size("functions"), F.lit(0)) <= 0) & (F.coalesce(F.size("classes"), F.lit(0)) <= 0))
    window = sliding_chunks(none, "path", "content").select(F.when(F.col("part") == 0, F.concat("path", F.lit("::whole"))).otherwise(F.concat(F.col("path"), F.lit("::part"), F.col("part").cast("string"))).alias("chunk_id"), "path", F.lit("window").alias("type"), F.col("chunk").alias("text"))
    return function.unionAll(klass).unionAll(method).where("text is not null").unionAll(window)
