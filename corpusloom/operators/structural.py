"""Differences by code blocks and by signatures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.parsers import blocks, blocks_of
from corpusloom.operators.textdiff import text_diff


def exploded_blocks(files: DataFrame) -> DataFrame:
    """``(path, name, signature, body)`` of ``(path, lang, content)``."""
    return files.select("path", F.explode(blocks(F.col("content"), F.col("lang"))).alias("b")).select("path", "b.*")


def block_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, name, state, signature_changed, body_changed, old_signature, new_signature)`` of blocks, joined on path and name."""
    side = lambda df, name: df.select("path", "name", F.col("signature").alias(f"{name}_signature"), F.col("body").alias(f"{name}_body"), F.lit(True).alias(name))
    both = side(old, "old").join(side(new, "new"), ["path", "name"], "full_outer")
    differ = lambda x: ~F.col(f"old_{x}").eqNullSafe(F.col(f"new_{x}"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(differ("signature") | differ("body"), "modified").otherwise("same")
    return both.select("path", "name", state.alias("state"), differ("signature").alias("signature_changed"), differ("body").alias("body_changed"), "old_signature", "new_signature", "old_body", "new_body")


def block_label(name: Column, signature: Column) -> Column:
    starts = lambda *words: F.rlike(signature, F.lit("^(?:%s) " % "|".join(words)))
    return F.when(starts("class", "interface"), F.concat(F.lit("class "), name)).when(starts("def", "function", "func", "fn"), F.concat(F.lit("function "), name)).otherwise(name)


def signature_lines(changes: DataFrame) -> DataFrame:
    """``(path, content)``: ``+``, ``-`` and ``~`` lines of the signatures of each path, in order of name; paths without changes are left out."""
    line = (
        F.when(F.col("state") == "added", F.concat(F.lit("+ "), F.col("new_signature"), F.lit("\n")))
        .when(F.col("state") == "deleted", F.concat(F.lit("- "), F.col("old_signature"), F.lit("\n")))
        .when(F.col("signature_changed"), F.concat(F.lit("~ "), F.col("old_signature"), F.lit("\n  -> "), F.col("new_signature"), F.lit("\n")))
        .otherwise(F.concat(F.lit("  "), F.col("old_signature"), F.lit("  (body changed)\n")))
    )
    told = changes.where("state <> 'same'").select("path", F.struct("name", line.alias("line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "")
    return told.groupBy("path").agg(F.concat(F.lit("### "), F.first("path"), F.lit("\n"), joined).alias("content"))


def _label(name: str, signature: str) -> str:
    kind = signature.partition(" ")[0]
    return f"class {name}" if kind in ("class", "interface") else f"function {name}" if kind in ("def", "function", "func", "fn") else name


def structural_text(old: str, new: str, path: str, lang: str, fmt: str = "markdown", scoped: bool = False) -> str:
    """The difference by blocks, ``scoped`` as ``blocks_of`` takes it; by lines for languages without blocks and texts with errors."""
    before, after = blocks_of(old, lang, scoped), blocks_of(new, lang, scoped)
    if before is None or after is None:
        return text_diff(old, new, path, fmt)
    out = [f"### {path}\n"]
    for name in sorted({*before, *after}):
        a, b = before.get(name), after.get(name)
        if a == b:
            continue
        if a is None:
            out.append(f"ADDED: {_label(name, b[0])}\n{b[0]}\n{b[1]}\n\n")
        elif b is None:
            out.append(f"DELETED: {_label(name, a[0])}\n\n")
        else:
            out.append(f"MODIFIED: {_label(name, a[0])}\n")
            if a[0] != b[0]:
                out.append(f"  Signature changed:\n    - {a[0]}\n    + {b[0]}\n")
            if a[1] != b[1]:
                out.append("  Body:\n" + "".join(f"    {x}\n" for x in text_diff(a[1], b[1], "", fmt).split("\n") if x.strip()))
            out.append("\n")
    return "".join(out)


def structural_diffs(fmt: str = "markdown", scoped: bool = False):
    """``structural_text`` as an Arrow function of old text, new text, path and language."""

    @F.arrow_udf("string")
    def run(old: pa.Array, new: pa.Array, path: pa.Array, lang: pa.Array) -> pa.Array:
        rows = zip(old.to_pylist(), new.to_pylist(), path.to_pylist(), lang.to_pylist(), strict=True)
        return pa.array([structural_text(a or "", b or "", p, x or "", fmt, scoped) for a, b, p, x in rows], pa.string())

    return run
