"""Connected components of an edge table by alternating large-star and small-star steps; up to ``FEW`` edges are joined in one step.

Nothing is gathered on the driver but one checksum a step. Each step is joins and aggregations on the edge table,
written to the shared folder, so a lost executor costs at most one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import stored

#: Edges that are joined in one step, some 16 MB; the steps over a table cost dozens of jobs, however small it is.
FEW = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same groups from fewer edges: each node but the least of its group, with that least one."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], low)
        np.minimum.at(now, label[b], low)
        while (up := now[now] != now).any():
            now[up] = now[now[up]]
        if (now == label).all():
            break
        label = now
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``FEW`` edges as each node with the least it reaches."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        found = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in found], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: each node's greater neighbours move to its least neighbour; small: its lesser ones do."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``edges`` has long columns u and v; root is the least node."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _sum(edges)
    if last[0] <= few:
        edges = stored(edges.coalesce(1).mapInArrow(_joined, "u long, v long"), "edges")
        last = (0,)
    while last[0]:
        edges = stored(_star(_star(edges, large=True), large=False), "edges")
        now = _sum(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
