"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A 64-bit fingerprint holds, for each bit, whether over half of the document's shingle hashes have it set. Two
fingerprints at distance 3 or less must meet: hide one of three blocks of bits, and for at least one choice (a block
that holds a differing bit) the visible rest differs in two bits at most, so it lies in the middle between them at one
flip from either. Every distinct fingerprint therefore emits, for each of the three choices, its visible bits and all
of their single-bit variants - the ball of half the remaining radius, 131 rows in all. Rows are shuffled on the variant; fingerprints that
meet are verified by their full distance. No pair within the radius can be missed and false meetings are dropped.

Balls are made of distinct fingerprints only, so copies cost nothing and no variant key is hot because of them. A task
gives only as many edges as hold its linked fingerprints together, never all pairs.

Defined results: a null or empty text has the fingerprint zero, linked like any other; a null doc_id stays and never
becomes a component id unless a whole component has no other; repeated rows give repeated rows; an empty table gives an
empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components, stars
from corpusloom.llm.shared import numbered, parts, stored

#: The seed of the shingle hash, the words in a shingle and the largest distance of a link.
SEED, SHINGLE, RADIUS = 42, 3, 3
#: Blocks of bits, of which one is hidden at a time.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Distinct fingerprints in a meeting place that are compared directly.
LARGE = 4096
#: Rows that are compared in one go.
GATHERED = 1 << 17


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of ASCII-lower-cased words; of the whole sequence where there are fewer words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, fp long)`` for every row; row is ``row_col``, or its place in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(np.array(shingle_hashes(t.as_py(), width, seed), np.uint64)) for t in batch.column(1)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fp], ["doc_id", "row", "fp"])

    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), row.alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(distinct: DataFrame) -> DataFrame:
    """``(variant, fp)``: all variants of each fingerprint within half the radius, for each hidden block."""
    balls = []
    for number, (low, high) in enumerate(BLOCKS):
        hidden = ((1 << high) - 1) & ~((1 << low) - 1)
        shown = ((1 << 64) - 1) & ~hidden
        #: the block's number stands in two of its own hidden bits, so that keys of different choices seldom meet
        flips = [_signed((number + 1) << low)] + [_signed((1 << b) ^ ((number + 1) << low)) for b in range(64) if shown >> b & 1]
        seen = F.col("fp").bitwiseAND(F.lit(_signed(shown)))
        balls.append(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x, seen=seen: x.bitwiseXOR(seen)))
    return distinct.select(F.explode(F.concat(*balls)).alias("variant"), "fp")


def _near(key: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of equal key within the radius; rows are sorted by key. Each row meets those after it in its run."""
    end = np.searchsorted(key, key, side="right")
    at, step = np.arange(len(key)), 1
    while len(at := at[at + step < end[at]]):
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= radius
        yield fp[at[near]], fp[at[near] + step]
        step += 1


def bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS, large: int = LARGE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the meeting places; rows are sorted by key.

    A place of more than ``large`` fingerprints is parted once more: two within the radius agree in one of
    ``radius + 1`` blocks of bits at least, so only those that agree in a block are compared.
    """
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(heads, len(key)))
    size = np.repeat(sizes, sizes)
    some = (size > 1) & (size <= large)
    yield from _near(key[some], fp[some], radius)
    for i, n in zip(heads[sizes > large].tolist(), sizes[sizes > large].tolist(), strict=True):
        own, width = np.unique(fp[i : i + n]), 64 // (radius + 1)
        for block in range(radius + 1):
            part = own >> np.uint64(block * width) & np.uint64((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            yield from _near(part[order], own[order], radius)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints of some batches at a time."""
    keys, fps, n = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        fps.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        n += batch.num_rows
        if n >= GATHERED:
            yield np.concatenate(keys), np.concatenate(fps)
            keys, fps, n = [], [], 0
    if n:
        yield np.concatenate(keys), np.concatenate(fps)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows sorted by variant; a run of one variant may go over several batches."""
    held_key, held = np.empty(0, np.int64), np.empty(0, np.uint64)
    us, vs, waiting = [], [], 0

    def collect(key: np.ndarray, fp: np.ndarray) -> None:
        nonlocal us, vs, waiting
        for u, v in bucket_edges(key, fp):
            us.append(u)
            vs.append(v)
            waiting += len(u)
            if waiting > 1 << 20:
                u, v = stars(np.concatenate(us), np.concatenate(vs))
                us, vs, waiting = [u], [v], 0

    for key, fp in _gathered(batches):
        key, fp = np.concatenate((held_key, key)), np.concatenate((held, fp))
        cut = int(np.searchsorted(key, key[-1]))
        collect(key[:cut], fp[:cut])
        held = np.unique(fp[cut:])
        held_key = np.full(len(held), key[-1])
    collect(held_key, held)
    if us:
        found = stars(np.concatenate(us), np.concatenate(vs))
        for i in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)].view(np.int64), pa.int64()) for x in found], ["u", "v"])


def linked(distinct: DataFrame) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint that has a link; root is one of its group's."""
    met = variants(distinct).repartition(parts(distinct.sparkSession), "variant").sortWithinPartitions("variant")
    return components(met.mapInArrow(_meet, "u long, v long")).select(F.col("node").alias("fp"), "root")


def _rooted(docs: DataFrame, id_col: str, text_col: str, width: int, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, row, fp)`` of every row, and ``(fp, root, component_id)`` of every distinct fingerprint."""
    prints = stored(fingerprints(docs, id_col, text_col, width, row_col=row_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(linked(nodes.select("fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, rooted.join(of_root, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: its fingerprint and the least doc_id that links reach."""
    prints, of_print = _rooted(docs, id_col, text_col, width)
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def candidates(rows: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(u, v)``: each row whose fingerprint is linked to others, or is another's too, with the first row of its group; rows by their number ``row_col``."""
    prints = stored(fingerprints(rows, id_col, text_col, width, row_col=row_col).select("row", "fp"), "fingerprints")
    rooted = prints.join(linked(prints.select("fp").distinct()), "fp", "left").select("row", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("row").alias("u"))
    return rooted.join(first, "root").where("u <> row").select("u", F.col("row").alias("v"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group stays: the one with the least id.

    Where rows repeat that id, the first read of them stays. A row without id stays only if no row of its group has
    an id.
    """
    rows, row = numbered(docs)
    prints, of_print = _rooted(rows, id_col, text_col, width, row)
    grouped = prints.join(of_print, "fp").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("first"))
    kept = stored(grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "survivors")
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
