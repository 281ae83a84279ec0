"""Code quality: detectors, scores, ladders, decisions and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the detectors and weights of the score.
GOD_CLASS, TIGHT, COMPLEX = 15, 10, 10
WEIGHTS = {"complexity": 0.3, "dead_code": 0.25, "architecture": 0.25, "documentation": 0.2}


def issue(df: DataFrame, kind: str, level: str, text: str) -> DataFrame:
    """Rows of a detector in the common form; `text` is a format of id and n."""
    return df.select(F.lit(kind).alias("issue_type"), F.lit(level).alias("severity"), F.col("id").cast("string").alias("id"), F.format_string(text, F.col("id").cast("string"), F.col("n").cast("string")).alias("description"))


def union_issues(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by type, by severity and in all, in one pass of grouping sets."""
    g = issues.groupingSets([["issue_type"], ["severity"], []], "issue_type", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return g.select(F.when(F.col("level") == 1, "type").when(F.col("level") == 2, "severity").otherwise("total").alias("by"), F.coalesce("issue_type", "severity", F.lit("all")).alias("value"), "n")


def complexity_estimate(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, complexity, loc, params): 1 + calls out, lines between start and end, arguments."""
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return functions.join(out, "id", "left").select("id", (1 + F.coalesce("n", F.lit(0))).alias("complexity"), (F.col("end_line") - F.col("start_line")).alias("loc"), F.coalesce(F.size("args"), F.lit(0)).alias("params"))


def floor0(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def quality_score(functions: DataFrame, dead: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row of scores of 0 to 100. functions(complexity, documented): empty gives complexity and
    documentation 100. dead and cycles count by their rows. Halves round to even, to one place."""
    f = functions.agg(F.count("*").alias("functions"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average"), F.count_if(F.col("documented")).alias("documented"))
    one = f.crossJoin(dead.agg(F.count("*").alias("dead"))).crossJoin(cycles.agg(F.count("*").alias("cycles")))
    one = one.withColumn("complexity_score", floor0(100 - 5 * F.col("average"))).withColumn("dead_code_score", floor0(100.0 - 5 * F.col("dead"))).withColumn("architecture_score", floor0(100.0 - 10 * F.col("cycles")))
    one = one.withColumn("documentation_score", F.when(F.col("functions") > 0, 100.0 * F.col("documented") / F.col("functions")).otherwise(100.0))
    total = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return one.withColumn("total_score", F.bround(total, 1))


def health(score: Column) -> Column:
    """The ladder of a total score."""
    return F.when(score >= 80, "healthy").when(score >= 60, "warning").otherwise("critical")


def quality_summary(functions: DataFrame, high: int = 8) -> DataFrame:
    """One row: functions, average and highest complexity, and how many are above `high`."""
    return functions.agg(F.count("*").alias("total"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average"), F.coalesce(F.max("complexity"), F.lit(0)).alias("highest"), F.count_if(F.col("complexity") > high).alias("high"))


#: Kinds of issue whose repair pays most; their priority rises by one.
PAYS = ("dead_code", "circular_dependency")


def prioritize(decisions: DataFrame, score: Column) -> DataFrame:
    """decisions(issue_type, priority) ranked: all priorities rise by 2 below a score of 60, those that
    pay most by 1 more, to 10 at most each time; rank by priority, then type. One row for each kind
    of issue, so one task ranks them."""
    urgent = F.least(F.lit(10), F.col("priority") + F.when(score < 60, 2).otherwise(0))
    raised = decisions.withColumn("priority", F.least(F.lit(10), urgent + F.when(F.col("issue_type").isin(*PAYS), 1).otherwise(0)))
    return raised.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "issue_type")))


def learn_priorities(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Priorities one up for a type with more good than bad feedback(issue_type, good), one down for
    the reverse, within 1 and 10."""
    balance = feedback.groupBy("issue_type").agg(F.signum(F.sum(F.when(F.col("good"), 1).otherwise(-1))).cast("int").alias("_b"))
    return decisions.join(balance, "issue_type", "left").withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(10), F.col("priority") + F.coalesce("_b", F.lit(0))))).drop("_b")


#: What to do about each kind of issue.
ADVICE = {
    "circular_dependency": "Break dependency cycles",
    "dead_code": "Remove unused functions",
    "god_class": "Split large classes",
    "high_complexity": "Simplify complex functions",
    "tight_coupling": "Reduce coupling",
}


def recommendations(issues: DataFrame) -> DataFrame:
    """(issue_type, n, advice), the commonest kind first."""
    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return issues.groupBy("issue_type").agg(F.count("*").alias("n")).withColumn("advice", F.element_at(advice, F.col("issue_type"))).orderBy(F.desc("n"), "issue_type")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, body): every part as sorted JSON rows, for a snapshot or a page of text."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.array_sort(F.collect_list("j")).alias("rows")).select(F.lit(name).alias("section"), "rows")

    return reduce(DataFrame.unionAll, [one(n, d) for n, d in parts.items()])


def enrich(metrics: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """metrics with the values of a static analysis where it has them."""
    columns = [c for c in metrics.columns if c != key]
    s = static.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns if c in static.columns))
    return metrics.join(s, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in static.columns else F.col(c) for c in columns))


def related_issues(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """issues(issue_id, affected) whose array holds one of ids(id)."""
    hit = issues.select("issue_id", F.explode("affected").alias("id")).join(ids.select("id"), "id", "left_semi").select("issue_id").distinct()
    return issues.join(hit, "issue_id", "left_semi")


def file_metrics(lines: DataFrame, python: DataFrame, generic: DataFrame) -> DataFrame:
    """lines(path, code, ...) with complexity from the Python analysis, else the generic one, else 1;
    files without code are left out; maintainability is 100 where nobody measured it."""
    p = python.select("path", F.col("complexity").alias("_p"), F.col("maintainability").alias("_m"))
    g = generic.select("path", F.col("complexity").alias("_g"))
    found = lines.where("code > 0").join(p, "path", "left").join(g, "path", "left")
    return found.withColumn("complexity", F.coalesce("_p", "_g", F.lit(1.0))).withColumn("maintainability", F.coalesce("_m", F.lit(100.0))).drop("_p", "_g", "_m")


def file_complexity(functions: DataFrame, above: int = COMPLEX) -> DataFrame:
    """(path, average, highest, complex): mean to two places, maximum, and the names above the limit by
    complexity of functions(path, name, complexity)."""
    hard = F.array_sort(F.collect_list(F.when(F.col("complexity") > above, F.struct((-F.col("complexity")).alias("k"), F.col("name")))))
    return functions.groupBy("path").agg(F.round(F.avg("complexity"), 2).alias("average"), F.max("complexity").alias("highest"), F.transform(hard, lambda x: x["name"]).alias("complex"))


def repository_score(files: DataFrame) -> DataFrame:
    """One row: the mean maintainability to two places."""
    return files.agg(F.round(F.avg("maintainability"), 2).alias("score"))


def task_context(node: DataFrame, ripple: DataFrame, critical: DataFrame, issues: DataFrame) -> DataFrame:
    """One row about node(id): how much hangs on it, whether it is among the critical, and its issues."""
    n = ripple.agg(F.count("*").alias("affected"), F.array_sort(F.collect_list(F.when(F.col("distance") == 1, F.col("id")))).alias("direct"))
    known = critical.select(F.col("id"), F.lit(True).alias("is_critical"))
    own = related_issues(issues, node).agg(F.array_sort(F.collect_list("issue_id")).alias("issues"))
    return node.join(known, "id", "left").select("id", F.coalesce("is_critical", F.lit(False)).alias("is_critical")).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(own))
