"""Mixing sources to target weights by systematic sampling.

Targets. Sources weigh by their rank; together they share a budget of words. No source's target exceeds ``most_copies``
times its words; what is cut off goes to the others by weight, until none exceeds. That fixed point is found in closed
form: in ascending order of the share at which a source is full, the full ones are a prefix.

Sampling. A source's expected copies of each of its documents are its target over its words. Its documents stand in
descending order of size; with one random offset in [0, 1) for the source, a document is emitted once for each integer
that the running sum of expected copies crosses in it. Neighbours in that order are of like size, so the words taken
stay near the target, and no document is emitted more than ``most_copies`` times, rounded up.

The running sum needs each document's rank in its source. It is found in two levels, so that no source, however large, is one
task's: documents fall into size classes (at most a few hundred) times 256 buckets of a hash of their id and text; cells are
counted, the counts are summed up over the classes of a source and over the buckets of a class, and documents are numbered
within their own cell only.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source without words has
target 0 and gives nothing; a null doc_id is an id; rows of one id and size stand in order of a hash of their texts, repeated rows are numbered each for
itself; an empty table gives an empty table. Reruns agree: the offset and the order come from hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import SPACE_CLASS, free_name, numbered, stored

#: Weights by rank of the source, repeating; share of all words; most copies; seed of the offsets.
WEIGHTS, BUDGET, MOST_COPIES, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, a row for each source."""
    everything = Window.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source"))
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    by_fill = everything.orderBy("full_at", F.col("source"))
    so_far, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    budgeted = ranked.withColumn("left", budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
    levelled = budgeted.withColumn("level", F.col("left") / F.sum("w").over(rest))
    #: the level at which the first source isn't full holds for all from there on; below it sources are full. First is by the order of filling, also among equals
    first = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "source", "level"))).over(everything)
    level = F.coalesce(first["level"], F.lit(float("inf")))
    return levelled.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def size_class(size: Column) -> Column:
    """About sixteen classes to each doubling; larger sizes have larger numbers. The little more keeps powers of two on one side."""
    return F.floor(16 * F.ln(size + 1.0) / F.lit(0.6931471805599453) + 1e-9).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = (), weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` for every row; ``keep`` names further columns to carry, as one struct ``kept``; they should be narrow."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("a"), F.col(f"`{source_col}`").cast("string")), F.lit("z")).alias("source"),  # a null is last, and a key like any other
        words(text).alias("size"),
        F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("none")), F.lit(":"), F.coalesce(text, F.lit("")), F.lit(f":{seed}")).cast("binary")).alias("mark"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    ).withColumns({"class": -size_class(F.col("size")), "bucket": F.substring("mark", 1, 2)})
    rows = stored(rows, "sizes")  # a few numbers and a name: cheaper to keep than to count the words again
    cell = ["source", "class", "bucket"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    goals = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    preceding = lambda keys, by: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n")).select("source", "class", preceding(["source"], "class").alias("larger"))
    placed = cells.withColumn("before", preceding(["source", "class"], "bucket")).join(classes, ["source", "class"]).withColumn("before", F.col("before") + F.col("larger"))
    offset = F.conv(F.substring(F.md5(F.concat("source", F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = placed.join(goals, "source").select(
        *cell, "before", "source_size", "target", offset.alias("offset"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )
    in_cell = Window.partitionBy(*cell).orderBy(F.col("size").desc(), "mark")
    numbered_rows = rows.withColumn("at", F.row_number().over(in_cell))
    crossed = lambda end: F.floor(F.col("offset") + F.col("rate") * end)
    end = F.col("before") + F.col("at")
    out = numbered_rows.join(placed, cell).withColumn("copies", (crossed(end) - crossed(end - 1)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else []))


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: every row of ``docs``, all columns, as often as it is drawn. Texts meet their counts at the end only."""
    rows, row = numbered(docs)
    drawn = mix(rows, keep=[row], **how).where("copies > 0").select(F.col(f"kept.`{row}`").alias(row), F.col("copies").cast("int").alias(copies := free_name(rows, "copies")))
    met = rows.join(drawn, row)
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*[F.col(f"`{c}`") for c in docs.columns])
