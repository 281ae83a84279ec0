"""What a change touches: callers, coupling, call and import linking, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.paths import first_match, transitive_paths

#: Points of a direct and a transitive caller, factors of the kinds of change.
DIRECT, TRANSITIVE, SIGNATURE, RENAME = 10, 5, 1.5, 2.0


def risk(direct: Column, transitive: Column, change: str = "signature") -> Column:
    factor = {"signature": SIGNATURE, "rename": RENAME}.get(change, 1.0)
    return (direct * DIRECT + transitive * TRANSITIVE) * factor


def direct_callers(edges: DataFrame, target: DataFrame) -> DataFrame:
    """(id): distinct callers of target(id)."""
    return edges.join(target.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def second_callers(edges: DataFrame, target: DataFrame) -> DataFrame:
    """(id, via): callers of the direct callers, once each, with the smallest caller between. A direct
    caller that also calls another one is among them."""
    one = direct_callers(edges, target).select(F.col("id").alias("via"))
    return edges.join(one, F.col("dst") == F.col("via")).groupBy(F.col("src").alias("id")).agg(F.min("via").alias("via"))


def impact(edges: DataFrame, target: DataFrame, change: str = "signature") -> DataFrame:
    """One row: direct, transitive, risk_score."""
    n = direct_callers(edges, target).agg(F.count("*").alias("direct"))
    m = second_callers(edges, target).agg(F.count("*").alias("transitive"))
    return n.crossJoin(m).withColumn("risk_score", risk(F.col("direct"), F.col("transitive"), change))


def impact_paths(edges: DataFrame, target: DataFrame, depth: int = 2) -> DataFrame:
    """One row: direct dependents, paths, nodes on them and the level: High if more than 5 nodes."""
    found = transitive_paths(edges, target, depth).crossJoin(direct_callers(edges, target).agg(F.count("*").alias("direct")))
    return found.withColumn("risk_level", F.when(F.col("nodes") > 5, "High").otherwise("Low"))


def affected(defines: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(id): functions defined in the files, and those that call them."""
    own = defines.join(files.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    callers = calls.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return own.union(callers).distinct()


def coupling(calls: DataFrame, owner: DataFrame, threshold: int = 5, limit: int = 20) -> DataFrame:
    """(a, b, weight): pairs of different owners with more than `threshold` calls from a's members to
    b's; the heaviest `limit`. owner(id, owner). Calls are summed by pair of members before the
    owners are looked up, so the joins see each pair once."""
    pairs = calls.groupBy("src", "dst").agg(F.count("*").alias("n"))
    a, b = owner.select(F.col("id").alias("src"), F.col("owner").alias("a")), owner.select(F.col("id").alias("dst"), F.col("owner").alias("b"))
    found = pairs.join(a, "src").join(b, "dst").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("weight"))
    return found.where(F.col("weight") > threshold).orderBy(F.desc("weight"), "a", "b").limit(limit)


def link_by_simple_name(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Unresolved calls(call_id, callee) with the function they mean: by the last dotted part of the
    callee, equal to a name or to what follows the last `::` of an id; the smallest id of several.
    Both keys are exploded, so the join is one of equality."""
    keys = functions.select("id", F.explode(F.array_distinct(F.array("name", F.substring_index("id", "::", -1)))).alias("key"))
    best = keys.groupBy("key").agg(F.min("id").alias("target_id"))
    return calls.withColumn("key", F.element_at(F.split("callee", r"\."), -1)).join(best, "key", "left").drop("key")


def link_local_or_imported(calls: DataFrame, local: DataFrame, imported: DataFrame) -> DataFrame:
    """calls(file_id, caller, callee) with target: the file's own function of that name, else the
    imported one. local(file_id, name, id), imported(file_id, name, id); first by id."""
    def one(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("file_id", F.col("name").alias("callee")).agg(F.min("id").alias(out))

    found = calls.join(one(local, "_local"), ["file_id", "callee"], "left").join(one(imported, "_imported"), ["file_id", "callee"], "left")
    return found.withColumn("target", F.coalesce("_local", "_imported")).drop("_local", "_imported")


def suffix_join(wanted: DataFrame, paths: DataFrame, endings: tuple[str, ...] = ("", ".h", ".py")) -> DataFrame:
    """(name, path): every path that ends with a name of wanted(name), or with that and an ending.
    Each path is exploded into its suffixes that begin after a separator or at any character that a
    name could begin with; lengths that no name has are left out, so the join stays one of equality
    instead of a nested loop."""
    lengths = wanted.select(F.explode(F.transform(F.array(*map(F.lit, endings)), lambda e: F.length("name") + F.length(e))).alias("n")).distinct().agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    keys = wanted.select("name", F.explode(F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat("name", e))).alias("key"))
    ends = paths.select("path").distinct().crossJoin(F.broadcast(lengths)).select("path", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.right(F.col("path"), n))).alias("key"))
    return ends.join(keys, "key").select("name", "path").distinct()


def longest_prefix_join(names: DataFrame, modules: DataFrame, separator: str = ".") -> DataFrame:
    """names(name) with module and path of modules(module, path): the module itself, else its longest
    dotted prefix, else null. Prefixes are exploded into an equality join."""
    parts = F.split("name", "\\" + separator)
    prefixes = names.select("name").distinct().select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))).alias("module"))
    best = prefixes.join(modules, "module").groupBy("name").agg(F.max_by(F.struct("module", "path"), F.length("module")).alias("m"))
    return names.join(best, "name", "left").select(*names.columns, F.col("m.module").alias("module"), F.col("m.path").alias("path"))


def relative_module(module: Column, level: Column, package: Column) -> Column:
    """The absolute name of an import `level` dots up from a module in `package`."""
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - level + 1)), ".")
    return F.when(level == 0, module).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(module, F.lit(""))))


def module_map(paths: DataFrame) -> DataFrame:
    """(module, path) of Python files: a/b/c.py is a.b.c, a package's __init__ is the package."""
    stem = F.regexp_replace("path", r"(/__init__)?\.py$", "")
    return paths.where(F.endswith("path", F.lit(".py"))).select(F.translate(stem, "/", ".").alias("module"), "path")


def range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, value: str, default: str = "<global>", width: int = 64) -> DataFrame:
    """points with `value` of the first range (by start, then value) of the same key that holds them,
    else the default. Ranges are cut into bins of `width`, so that the join is one of equality on key
    and bin, and a point meets only the ranges of its bin."""
    bin = lambda c: F.floor(c / width).cast("bigint")
    r = ranges.where(F.col(start) <= F.col(end)).select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(value).alias("_value"))
    r = r.withColumn("_bin", F.explode(F.sequence(bin(F.col("_start")), bin(F.col("_end")))))
    asked = points.select(F.col(key).alias("_key"), F.col(at).alias("_at")).where("_key is not null and _at is not null").distinct().withColumn("_bin", bin(F.col("_at")))
    hit = asked.join(r, ["_key", "_bin"]).where(F.col("_at").between(F.col("_start"), F.col("_end")))
    first = hit.groupBy("_key", "_at").agg(F.min(F.struct("_start", "_value")).alias("_first"))
    found = points.join(first, (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_at")), "left")
    return found.select(*points.columns, F.coalesce("_first._value", F.lit(default)).alias(value))


def loose_tests(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """sources(path) whose base name, without its ending, is in no path of tests(path); an empty name is in
    all. Test paths are exploded into their parts of the names' lengths, so that the join is one of equality."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = sources.withColumn("_stem", stem)
    lengths = named.agg(F.array_sort(F.collect_set(F.length("_stem"))).alias("_lengths"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("path") - n + 1), lambda i: F.substr(F.col("path"), i, n))
    inside = F.array_distinct(F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), at)))
    held = tests.select("path").distinct().crossJoin(F.broadcast(lengths)).select(F.explode(inside).alias("_stem")).distinct()
    return named.join(held, "_stem", "left_anti").select(*sources.columns)
