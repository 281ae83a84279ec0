"""Questions: classification, routing to sources, fusion of their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell a question's kind.
KEYWORDS = {
    "semantic": "where find locate search show list get how count contains has includes".split(),
    "structural": (
        "call calls caller callee called depend depends dependency dependencies chain path impact affect ripple break circular"
        " import imports imported usage uses used reference references hierarchy relation relationship relationships"
    ).split(),
    "temporal": "before did history previous last past solved tried attempt remember encounter".split(),
    "analytical": "quality complexity issue smell critical important report analyze metric insight".split(),
}
#: Which sources answer which kind.
ROUTES = {"semantic": ("vector",), "structural": ("graph",), "analytical": ("graph",), "temporal": ("history",), "combined": ("vector", "graph", "history")}
#: Confidence of structural answers with and without relationships.
WITH_RELATIONS, WITHOUT_RELATIONS, TEMPORAL = 0.85, 0.5, 0.78


def words(text: Column) -> Column:
    """The set of lower-case words between white space; punctuation stays with them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each kind's score and the query_type: the kind with most words, `combined` if several
    have as many, `semantic` if none has any."""
    found = words(F.col(text))
    scores = {k: F.size(F.array_intersect(found, F.array(*map(F.lit, w)))) for k, w in KEYWORDS.items()}
    out = df.select("*", *(F.coalesce(c, F.lit(0)).alias(f"{k}_score") for k, c in scores.items()))
    names = [f"{k}_score" for k in KEYWORDS]
    top = F.greatest(*names)
    ties = sum((F.when(F.col(n) == top, 1).otherwise(0) for n in names), F.lit(0))
    kind = F.when(top == 0, "semantic").when(ties > 1, "combined")
    for k in KEYWORDS:
        kind = kind.when(F.col(f"{k}_score") == top, k)
    return out.withColumn("query_type", kind)


def routes(df: DataFrame) -> DataFrame:
    """One row for each source that a question goes to."""
    table = F.create_map(*(x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return df.withColumn("source", F.explode(F.element_at(table, F.col("query_type"))))


def names_in(text: Column) -> Column:
    """Words of more than three characters, question marks removed: names to look up."""
    return F.array_distinct(F.filter(F.split(F.replace(text, F.lit("?"), F.lit("")), r"\s+"), lambda w: F.length(w) > 3))


def met(asked: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, nodes, n): how many of nodes(id, name) each question of asked(qid, name) names, once each, and the sum
    of n of weights(id, n) over them. An id of one name is counted with all others of its name, in one row a
    name, and no list of ids is made; only ids of several names are listed for each question, to count once."""
    ids = nodes.select("id", "name").where("name is not null").distinct()
    asked = asked.select("qid", "name").distinct()
    n = F.coalesce("n", F.lit(0)).alias("n")
    weighed = lambda df: df.join(weights.select("id", "n"), "id", "left").select("id", "name", n)
    names = ids.groupBy("id").agg(F.count("*").alias("_names"), F.min("name").alias("name"))
    several = names.where("_names > 1").select(F.col("id").alias("_id"))
    alone = weighed(names.where("_names = 1").select("id", "name")).groupBy("name").agg(F.count("*").alias("nodes"), F.sum("n").alias("n"))
    listed = asked.join(weighed(ids.join(several, F.col("id").eqNullSafe(F.col("_id")), "left_semi")), "name").select("qid", "id", "n").distinct().select("qid", F.lit(1).cast("bigint").alias("nodes"), "n")
    return asked.join(alone, "name").select("qid", "nodes", "n").unionAll(listed).groupBy("qid").agg(F.sum("nodes").alias("nodes"), F.sum("n").alias("n"))


def structural(questions: DataFrame, nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(qid, nodes, relationships, confidence): what the graph knows of the names in a question, and
    the calls of the functions among them. Questions with no known name give no row."""
    asked = questions.select("qid", F.explode(names_in(F.col("text"))).alias("name"))
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    # A node counts once for each of its sets of labels, and only one with the label of functions has calls.
    told = nodes.select(F.struct("id", "labels").alias("id"), "name")
    weights = nodes.select("id", "labels").distinct().where(F.array_contains("labels", "Function")).join(into, "id").select(F.struct("id", "labels").alias("id"), "n")
    found = met(asked, told, weights).select("qid", "nodes", F.col("n").alias("relationships"))
    return found.withColumn("confidence", F.when(F.col("relationships") > 0, WITH_RELATIONS).otherwise(WITHOUT_RELATIONS))


def temporal(questions: DataFrame, history: DataFrame, ts: str, limit: int = 1) -> DataFrame:
    """(qid, id, ts, confidence): the newest history(id, text, ts) that shares a long word with the
    question, by an equality join on words: each word's newest is found before it."""
    asked = questions.select("qid", F.explode(names_in(F.lower("text"))).alias("word"))
    told = history.select("id", F.col(ts).alias("ts"), F.explode(names_in(F.lower("text"))).alias("word"))
    newest = told.groupBy("word").agg(F.max(F.struct("ts", "id")).alias("h"))
    best = asked.join(newest, "word").groupBy("qid").agg(F.max("h").alias("h"))
    return best.select("qid", "h.id", "h.ts", F.lit(TEMPORAL).alias("confidence"))


def fuse(results: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """Rows of several sources, each tagged with its source, by confidence, then source and id. The
    frames have confidence and id; other columns may differ."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).orderBy(F.desc("confidence"), "source", "id").limit(limit)


def confidence(results: DataFrame) -> DataFrame:
    """One row: the mean confidence of the sources (0 if none), that of the items, and what to do next."""
    by_source = results.groupBy("source").agg(F.max("confidence").alias("c"), F.sum("confidence").alias("s"), F.count("*").alias("n"))
    one = by_source.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("overall"), F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("items"), F.count("*").alias("sources"))
    advice = F.when(F.col("sources") == 0, "nothing found").when(F.col("items") < 0.6, "refine").when(F.col("items") > 0.8, "go on").otherwise("look closer")
    return one.withColumn("advice", advice)


def context_lines(text: Column, limit: int = 3) -> Column:
    """The first lines that speak of relations: an arrow, CALLS or IMPORTS."""
    return F.slice(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("->")) | F.contains(x, F.lit("CALLS")) | F.contains(x, F.lit("IMPORTS"))), 1, limit)


def render_context(fused: DataFrame) -> DataFrame:
    """One row: the results as lines of text for a prompt, the surest first."""
    line = F.format_string("- [%s] %s (%.2f)", F.col("source"), F.col("id").cast("string"), F.col("confidence"))
    return fused.agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), line.alias("line")))).alias("x")).select(F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


def shape(hits: DataFrame) -> DataFrame:
    """Search hits(id, score, payload) as (id, name, type, snippet, score): what a payload lacks is
    unknown, a snippet has 200 characters at most."""
    unknown = F.lit("unknown")
    return hits.select("id", F.coalesce(F.col("payload")["name"], unknown).alias("name"), F.coalesce(F.col("payload")["type"], unknown).alias("type"), F.substring(F.coalesce(F.col("payload")["content"], F.lit("")), 1, 200).alias("snippet"), "score")


class Registry:
    """Named queries: the commands of an analysis engine, a repository client or a tool box."""

    def __init__(self) -> None:
        self.entries: dict = {}

    def register(self, name: str):
        def keep(f):
            self.entries[name] = f
            return f

        return keep

    def run(self, name: str, *args, **options) -> DataFrame:
        if name not in self.entries:
            raise KeyError(f"unknown command {name}; known: {', '.join(sorted(self.entries))}")
        return self.entries[name](*args, **options)
