"""Keyword queries over sections, and their expansion along imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.languages import basename
from corpusloom.functions.predicates import query_words
from corpusloom.shared import stored

PRE = "pre: "
#: What a hit in the name, the content, the exports or a dependency is worth.
NAME, CONTENT, EXPORTS, IMPORT = 10, 3, 8, 5


def declared(content: Column, key: str) -> Column:
    """The rest of the first line that starts with ``key``; null without one."""
    found = F.regexp_extract(content, rf"(?md)^{key}: ([^\n]*)$", 1)
    return F.when(content.rlike(rf"(?md)^{key}: "), found)


def dependency_list(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take the place as what to trim


def import_edges(sections: DataFrame, path: str = "path", content: str = "content", deps: Column | None = None) -> DataFrame:
    """``(path, dep)``: a declared list where the content has one, else ``deps``."""
    line = declared(F.col(content), "deps")
    own = F.array().cast("array<string>") if deps is None else deps
    return sections.select(F.col(path).alias("path"), F.explode(F.when(line.isNotNull(), dependency_list(line)).otherwise(own)).alias("dep"))


def score(path: Column, content: Column, deps: Column, query: str) -> Column:
    """The sum of all hits; a word that the query repeats counts again in content and dependencies."""
    words = F.array(*map(F.lit, query_words(query)))
    lower = F.lower(content)
    exports = F.lower(F.coalesce(declared(content, "exports"), F.lit("")))
    name = F.when(F.exists(words, lambda w: F.contains(F.lower(basename(path)), w)), NAME).otherwise(0)
    inside = F.size(F.filter(words, lambda w: F.contains(lower, w))) * CONTENT
    exported = F.when(F.exists(words, lambda w: F.contains(exports, w)), EXPORTS).otherwise(0)
    imported = F.aggregate(F.transform(deps, lambda d: F.size(F.filter(words, lambda w: F.contains(F.lower(d), w)))), F.lit(0), lambda a, x: a + x) * IMPORT
    return name + inside + exported + imported


def keys(path: Column) -> Column:
    """Names under which a file is imported: its path, and its name up to the first dot."""
    return F.array(path, F.substring_index(basename(path), ".", 1))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """``(dep, path)``: importers under the dependency and under its last component up to the first dot."""
    return edges.select(F.explode(F.array_distinct(F.array("dep", F.substring_index(F.substring_index("dep", "/", -1), ".", 1)))).alias("dep"), "path").distinct()


def expand(matched: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``(path)``: the matched paths and what imports them, over ``depth`` steps; only the last step's finds are followed."""
    reverse = stored(reverse_edges(edges), "reverse-edges")
    reached = stored(matched.select("path").distinct(), "matched")
    last = reached
    for _ in range(depth):
        names = last.select(F.explode(F.array_distinct(keys(F.col("path")))).alias("dep"))
        last = reverse.join(names, "dep", "left_semi").select("path").distinct().join(reached, "path", "left_anti")
        last = stored(last, "importers")
        reached = reached.union(last)
    return reached


def filtered(sections: DataFrame, query: str | None, deps: str = "deps", include_pre: bool = False, depth: int = 2, path: str = "path", content: str = "content") -> DataFrame:
    """The sections that score, and those that import them; outputs of commands only on demand; all for an empty query."""
    if not query_words(query or ""):
        return sections
    pre = F.startswith(F.col(path), F.lit(PRE))
    files = sections.where(~pre)
    line = declared(F.col(content), "deps")
    listed = F.when(line.isNotNull(), dependency_list(line)).otherwise(F.col(deps))
    scored = files.select(F.col(path).alias("path"), F.col(content).alias("__content"), listed.alias("deps")).withColumn("hit", score(F.col("path"), F.col("__content"), F.col("deps"), query) > 0)
    scored = stored(scored.select("path", "deps", "hit"), "scored")
    reached = expand(scored.where("hit"), scored.select("path", F.explode("deps").alias("dep")), depth)
    kept = files.join(reached.withColumnRenamed("path", "__path"), F.col(path) == F.col("__path"), "left_semi")
    return kept.unionByName(sections.where(pre)) if include_pre else kept
