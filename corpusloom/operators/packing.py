"""Next-fit packing of ordered sections into parts within a token limit.

Packing is a fold: a section that no longer fits opens the next part, so where a part starts depends on all before. Yet it
needn't run in one task. Rows are dealt out by ranges of group and order. In its piece of a group, a task knows not what
its first part already holds; but that only decides which section opens the first new part, and from each candidate for that
(at most as many as fit a part) the rest follows. Tasks report, for each candidate, parts opened and tokens left open;
these short reports are folded along the group, and the pieces are then numbered at once. Only
``(group, order, tokens)`` go through this; contents are joined back by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.shared import parts as n_parts
from corpusloom.shared import stored

#: Rows of group, order and tokens that are numbered in one step.
FEW = 1 << 17


def _openings(tokens: np.ndarray, alone: np.ndarray, limit: int) -> np.ndarray:
    """For each place the next that opens a part, if one opens here; the number of places where none does."""
    n = len(tokens)
    sums = np.concatenate(([0], np.cumsum(tokens)))
    fits = np.searchsorted(sums, sums[:-1] + limit, side="right") - 1
    lone = np.append(np.flatnonzero(alone), n)
    blocked = lone[np.searchsorted(lone, np.arange(n))]
    following = np.minimum(np.maximum(fits, np.arange(n) + 1), np.maximum(blocked, np.arange(n)))
    return np.where(alone, np.arange(n) + 1, np.maximum(following, np.arange(n) + 1))


def _first_opening(tokens: np.ndarray, alone: np.ndarray, held: int, limit: int) -> int:
    """The first place that doesn't fit a part that holds ``held`` tokens; nothing fits an empty state (-1)."""
    if not len(tokens) or held < 0:
        return 0
    sums = np.cumsum(tokens)
    over = int(np.searchsorted(sums, limit - held, side="right"))
    lone = np.flatnonzero(alone)
    return min(over, int(lone[0]) if len(lone) else len(tokens))


def summary(tokens: np.ndarray, alone: np.ndarray, limit: int) -> list[tuple[int, int, int, int]]:
    """For each place that may open the first new part: the tokens before it, parts opened from it on, and what the last holds (-1: closed)."""
    n = len(tokens)
    following = _openings(tokens, alone, limit)
    sums = np.concatenate(([0], np.cumsum(tokens)))
    #: the last opening that each place leads to, and how many come before it, by doubled steps
    ends = np.where(following < n, following, np.arange(n))
    opened = (following < n).astype(np.int64)
    while (further := ends[ends] != ends).any():
        opened[further] += opened[ends[further]]
        ends = ends[ends]
    opened = np.append(opened + 1, 0)
    last = np.append(np.where(alone[ends], -1, sums[n] - sums[ends]), -2) if n else np.array([-2])
    most = _first_opening(tokens, alone, 0, limit)
    return [(i, int(sums[i]), int(opened[i]), int(last[i])) for i in range(most + 1)]


def numbered(tokens: np.ndarray, alone: np.ndarray, held: int, limit: int, part: int) -> np.ndarray:
    """The part of each place, ``part`` being the one that is open on entry."""
    n = len(tokens)
    following = _openings(tokens, alone, limit)
    opens = np.zeros(n, np.int64)
    i = _first_opening(tokens, alone, held, limit)
    while i < n:
        opens[i] = 1
        i = int(following[i])
    return part + np.cumsum(opens)


def _whole(max_tokens: int):
    """Numbers rows that come sorted, all of a group together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := list(batches)) else None  # at most ``FEW`` rows in all
        if table is None or not table.num_rows:
            return
        group = table["g"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        tokens, alone = table["tokens"].to_numpy(), table["alone"].to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        part = np.concatenate([numbered(tokens[i:j], alone[i:j], -1, max_tokens, 0) for i, j in zip(edges[:-1], edges[1:], strict=True)])
        yield from table.drop(["alone"]).append_column("part", pa.array(part, pa.int64())).to_batches(1 << 14)

    return run


def part_map(rows: DataFrame, max_tokens: int, group: str, order: list[str], alone: str | None = None, few: int = FEW) -> DataFrame:
    """``(group, *order, tokens, part)``: parts count from 1 in each group; ``alone`` marks rows that are a part each.

    Up to ``few`` rows, groups are numbered whole, in one step instead of several; the numbers are the same.
    """
    if max_tokens == -1:
        return rows.select(group, *order, "tokens", F.lit(1).cast("bigint").alias("part"))
    spark = rows.sparkSession
    keyed = rows.select(F.col(group).alias("g"), F.struct(*order).alias("o"), F.col("tokens").cast("bigint").alias("tokens"), (F.col(alone) if alone else F.lit(False)).alias("alone"))
    kind = keyed.schema["g"].dataType.simpleString()
    columns = [F.col("g").alias(group), *[F.col(f"o.{c}").alias(c) for c in order], "tokens", "part"]
    if keyed.select(F.lit(1)).limit(few + 1).count() <= few:
        sorted_ = keyed.repartition(n_parts(spark), "g").sortWithinPartitions("g", "o")
        return stored(sorted_.mapInArrow(_whole(max_tokens), f"g {kind}, o {keyed.schema['o'].dataType.simpleString()}, tokens bigint, part bigint"), "packed").select(*columns)
    #: a row's id grows with its place in its piece and so stands for its order, whatever the type of that
    dealt = keyed.repartitionByRange(n_parts(spark), "g", "o").sortWithinPartitions("g", "o").withColumns({"piece": F.spark_partition_id(), "k": F.monotonically_increasing_id()})
    dealt = stored(dealt, "pack")

    def report(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("k")
        found = summary(df.tokens.to_numpy(), df.alone.to_numpy(), max_tokens)
        return pd.DataFrame(found, columns=["at", "before", "opened", "last"]).assign(g=df.g.iloc[0], piece=df.piece.iloc[0])

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        out, held, part = [], -1, 0
        for piece, own in df.sort_values(["piece", "at"]).groupby("piece", sort=True):
            out.append((piece, held, part))
            fits = own["at"][own.before <= max_tokens - held].max() if held >= 0 else 0
            state = own[own["at"] == fits].iloc[0]
            held = held + int(state.before) if state["last"] == -2 else int(state["last"])
            part += int(state.opened)
        return pd.DataFrame(out, columns=["piece2", "held", "entered"]).assign(g2=df.g.iloc[0])

    def number(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("k")
        return df[["k"]].assign(part=numbered(df.tokens.to_numpy(), df.alone.to_numpy(), int(df.held.iloc[0]), max_tokens, int(df.entered.iloc[0])))

    narrow = dealt.select("g", "piece", "k", "tokens", "alone")
    reports = narrow.groupBy("g", "piece").applyInPandas(report, f"g {kind}, piece int, at bigint, before bigint, opened bigint, last bigint")
    entries = reports.groupBy("g").applyInPandas(fold, f"g2 {kind}, piece2 int, held bigint, entered bigint")
    known = narrow.join(entries, F.col("g").eqNullSafe(F.col("g2")) & (F.col("piece") == F.col("piece2")))
    got = known.groupBy("g", "piece").applyInPandas(number, "k bigint, part bigint")
    final = stored(dealt.join(got, "k"), "packed")
    return final.select(*columns)


def assembled(rows: DataFrame, group: str, order: list[str], content: str = "content", separator: str = "\n\n") -> DataFrame:
    """``(group, part, content, tokens, n_sections)``: the contents of each part, which the limit bounds, joined in order."""
    item = F.struct(*order, F.col(content).alias("__content"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__content"]), separator)
    return rows.groupBy(group, "part").agg(strip(joined).alias(content), F.sum("tokens").alias("tokens"), F.count("*").alias("n_sections"))


def continuation(content, chunk, count, part):
    """A chunk with marks of the parts before and after it."""
    before = F.when(chunk > 0, F.concat(F.lit("> **[CONTINUED from part "), (part - 1).cast("string"), F.lit("]**\n\n"))).otherwise("")
    after = F.when(chunk < count - 1, F.concat(F.lit("\n\n> **[CONTINUES in part "), (part + 1).cast("string"), F.lit("]**"))).otherwise("")
    return F.when(count > 1, strip(F.concat(before, content, after))).otherwise(content)
