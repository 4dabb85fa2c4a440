"""Removal of long passages that repeat anywhere in a corpus, by a run-length suffix index.

A byte goes if a string of ``width`` bytes over it starts at another place too, in any document. Strings are judged on
the input; none goes over the end of a document.

How the work is dealt out. In every string of ``width`` bytes one ``gram``-byte gram is chosen by content alone (the one of
least hash, the leftmost of equals), so equal strings choose the same gram at the same offset: it is their anchor. Each document
gives its anchors, about two for each ``width - gram`` bytes, each with a 128-bit hash (XXH3) of its context (all bytes that strings
anchored there can cover). Contexts whose hash is found twice or more are repeats whole; equality rests on those 128 bits, for
which texts of the corpus don't collide by chance. Anchors only deal out: two grams of one anchor hash cost time, not results. What is left are anchors in
several different contexts: these contexts, cut to what agrees with a neighbour on either side, are dealt out by anchor and indexed, a
few hundred KB at a time, as a run-compressed Burrows-Wheeler transform with sampled run ends
(``suffix_runs``); its matching statistics, streamed backwards over the runs, mark the long matches.

No anchor is one task's if it is frequent: contexts are made distinct by partial aggregation, and the one join with hot keys is a merge of two plain exchanges,
which Spark can split; an anchor with over ``hot_kinds`` different contexts goes another exact way, its strings being counted by their hashes in one more aggregation.

Defined results: a null or empty text has no bytes; a text shorter than ``width`` loses nothing; repeated rows repeat each other
and so lose all that lies in their long strings; null ids do no harm; an empty table gives an empty table; further
columns are left out. Rows are numbered and written once, and read from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import discard, free_name, numbered, parts, passing, slices, stored, stored_at
from corpusloom.llm.suffix_runs import repeated_spans

#: Length of a repeat, of an anchor's gram; contexts of an anchor beyond which it is hot; bytes indexed at a time.
WIDTH, GRAM, HOT_KINDS, INDEX_BYTES = 200, 64, 4096, 1 << 19
#: Bytes of documents whose grams are hashed together; a document is cut at the larger figure. Bytes of documents that are Python objects at once.
BLOCK, CHUNK, TOGETHER = 1 << 18, 1 << 22, 1 << 22
_AT_BITS = np.uint64(24)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _POWERS[name] = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram: a polynomial over the ring of 64-bit numbers, mixed."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: 0 if len(raw) < gram else len(raw) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(raw: bytes, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings in ``raw`` that don't cross one of ``ends``, and their grams' hashes."""
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    span = width - gram + 1
    if len(h) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    keys = h >> _AT_BITS << _AT_BITS | np.arange(len(h), dtype=np.uint64)
    blocks = np.full(-(-len(h) // span) * span, np.uint64(2**64 - 1))
    blocks[: len(h)] = keys
    blocks = blocks.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: len(h) - span + 1], left[span - 1 : len(h)])
    whole = np.ones(len(least), bool)
    for end in ends[:-1].tolist():
        whole[max(0, end - width + 1) : end] = False
    least = least[whole]
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = (least[np.concatenate(([True], least[1:] != least[:-1]))] & ((np.uint64(1) << _AT_BITS) - np.uint64(1))).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, h[at]


def _blocks(raws: list[bytes], width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Long documents in overlapping chunks, short ones together: bytes, ends of the pieces, their documents, their offsets there."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def together() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        return b"".join(p[2] for p in pieces), np.cumsum([len(p[2]) for p in pieces]), np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])

    for k, raw in enumerate(raws):
        if len(raw) < width:
            continue
        for start in range(0, len(raw), CHUNK):
            piece = raw[start : start + CHUNK + width - 1]
            if len(piece) >= width:
                pieces.append((k, start, piece))
                held += len(piece)
            if held >= BLOCK:
                yield together()
                pieces, held = [], 0
    if pieces:
        yield together()


def _places(raws: list[bytes], width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, places there and gram hashes of all anchors, each once: a piece may begin with the anchor that its document's piece before ended with."""
    last = (-1, -1)
    for raw, ends, doc, offset in _blocks(raws, width):
        at, h = anchors(raw, ends, width, gram)
        piece = np.searchsorted(ends, at, side="right")
        own, place = doc[piece], at - np.concatenate(([0], ends[:-1]))[piece] + offset[piece]
        new = (own != np.concatenate(([last[0]], own[:-1]))) | (place != np.concatenate(([last[1]], place[:-1])))
        last = (own[-1], place[-1])
        yield own[new], place[new], h[new]


def _anchor_table(docs: DataFrame, width: int, gram: int) -> DataFrame:
    reach = width - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                raws = [x or b"" for x in part.column(1).to_pylist()]
                rows = part.column(0).to_numpy()
                for own, place, h in _places(raws, width, gram):
                    context = b"".join([digest(raws[d][max(0, p - reach) : p + width], min(p, reach)) for d, p in zip(own.tolist(), place.tolist(), strict=True)])
                    halves = np.frombuffer(context, np.int64).reshape(-1, 2)
                    columns = rows[own], place, h.view(np.int64), np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "at", "anchor", "c1", "c2"])

    return docs.select("row", "raw").mapInArrow(run, "row long, at long, anchor long, c1 long, c2 long")


def _fetched(docs: DataFrame, wanted: DataFrame, width: int, gram: int) -> DataFrame:
    """The contexts that ``(row, anchor, at, hot)`` asks for."""
    reach = width - gram
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "at", "hot")).alias("asked"))  # a document's own anchors
    joined = by_row.join(docs.select("row", "raw"), "row").select("row", "asked", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, TOGETHER):
                lists = part.column(1)
                asked = lists.flatten()
                counts = np.diff(lists.offsets.to_numpy())
                rows, raws = np.repeat(part.column(0).to_numpy(), counts), part.column(2).to_pylist()
                anchor, at, hot = (asked.field(k) for k in range(3))
                places = at.to_pylist()
                contexts = [raws[d][max(0, p - reach) : p + width] for d, p in zip(np.repeat(np.arange(len(raws)), counts).tolist(), places, strict=True)]
                for j in range(0, len(contexts), 1 << 14):
                    cut = slice(j, j + (1 << 14))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[cut]), anchor[cut], at[cut], hot[cut], pa.array(contexts[cut], pa.binary())], ["row", "anchor", "at", "hot", "bytes"])

    return joined.mapInArrow(run, "row long, anchor long, at long, hot boolean, bytes binary")


def _agreeing(group: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each row of a byte matrix the longest common start with another row of its group; a row of its own has none."""
    words = np.ascontiguousarray(sides).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    apart = sides[order][1:] != sides[order][:-1]
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), sides.shape[1])
    common[group[order][1:] != group[order][:-1]] = -1
    best = np.full(len(group), -1)
    best[order[1:]] = common
    best[order[:-1]] = np.maximum(best[order[:-1]], common)
    return best


def trimmed(group: np.ndarray, lefts: list[int], contexts: list[bytes], width: int, gram: int) -> list[tuple[int, int]]:
    """The part of each context outside of which no string equals one of another context of its group; (0, 0) if there is none."""
    reach = width - gram
    side = -(-reach // 8) * 8
    before, after = np.full((len(contexts), side), 0xFF, np.uint8), np.full((len(contexts), side), 0xFF, np.uint8)
    for k, (left, c) in enumerate(zip(lefts, contexts, strict=True)):
        raw = np.frombuffer(c, np.uint8)
        before[k, :left] = raw[:left][::-1]
        rest = raw[left + gram :][:reach]
        after[k, : len(rest)] = rest
    left_most = np.minimum(_agreeing(group, before), lefts)
    right_most = np.minimum(_agreeing(group, after), [len(c) - left - gram for left, c in zip(lefts, contexts, strict=True)])
    return [(left - a, left + gram + b) if a >= 0 and b >= 0 and a + gram + b >= width else (0, 0) for left, a, b in zip(lefts, left_most.tolist(), right_most.tolist(), strict=True)]


def index_marks(rows: list[int], at: list[int], group: np.ndarray, contexts: list[bytes], width: int, gram: int) -> list[tuple[int, int, int]]:
    """``(row, begin, end)`` of what repeats among the contexts of some anchors."""
    lefts = [min(p, width - gram) for p in at]
    pieces = []
    for row, p, left, c, (i, j) in zip(rows, at, lefts, contexts, trimmed(group, lefts, contexts, width, gram), strict=True):
        if j:
            pieces.append((row, p - left + i, c[i:j]))
    pieces.sort(key=lambda x: (x[0], x[1]))
    segments: list[list] = []
    for row, start, c in pieces:  # a place stands in the index once
        last = segments[-1] if segments else None
        if last and last[0] == row and start <= last[1] + len(last[2]):
            last[2] += c[max(0, last[1] + len(last[2]) - start) :]
        else:
            segments.append([row, start, c])
    spans = repeated_spans([s[2] for s in segments], width)
    return [(row, start + i, start + j) for (row, start, _), own in zip(segments, spans, strict=True) for i, j in own]


def _indexed(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """Marks of contexts that come sorted by anchor, by an index for every few whole anchors."""

    def marks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        found = index_marks(table["row"].to_pylist(), table["at"].to_pylist(), table["anchor"].to_numpy(), table["bytes"].to_pylist(), width, gram)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["row", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                anchor = batch.column(1).to_numpy()
                if held and size >= INDEX_BYTES:  # cut where the held anchor ends
                    last = held[-1].column(1)[-1].as_py()
                    same = int(np.searchsorted(anchor, last, side="right"))
                    held.append(batch.slice(0, same))
                    if same < batch.num_rows:
                        yield marks(held)
                        held, size, batch = [], 0, batch.slice(same)
                    else:
                        continue
                held.append(batch)
                size += batch.nbytes
        if held:
            yield marks(held)

    dealt = contexts.select("row", "anchor", "at", "bytes").repartition(parts(contexts.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "row long, begin long, end long")


def _counted(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """Marks of hot anchors' contexts: their strings by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                rows, begins, firsts, seconds = [], [], [], []
                for row, at, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    start = at - min(at, width - gram)
                    for k in range(len(c) - width + 1):
                        both = xxhash.xxh3_128_intdigest(c[k : k + width])
                        rows.append(row)
                        begins.append(start + k)
                        firsts.append(both >> 64)
                        seconds.append(both & (1 << 64) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(begins, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (firsts, seconds))], ["row", "begin", "h1", "h2"])

    strings = stored(contexts.select("row", "at", "bytes").mapInArrow(run, "row long, begin long, h1 long, h2 long"), "hot-strings")
    place = F.struct("row", "begin")
    several = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2")
    several = stored(several, "hot-several")
    return strings.join(several, ["h1", "h2"]).select("row", "begin", (F.col("begin") + width).alias("end"))


def repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """``(row, begin, end)``: overlapping marks over all that repeats; ``docs`` has row and raw, the text's bytes."""
    context = ["c1", "c2"]  # equal contexts have one anchor
    found, path = stored_at(_anchor_table(docs, width, gram), "anchors")
    kinds = found.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("one"), F.min("anchor").alias("anchor"))
    #: of contexts found once, which are nearly all, the hash has done its work
    kinds = stored(kinds.select("anchor", "one", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in context]), "contexts")
    twice = kinds.where("c1 is not null").select(*context)
    copies = found.select("row", "at", *context).join(twice.hint("merge"), context)
    copies = stored(copies.select("row", F.greatest(F.lit(0), F.col("at") - (width - gram)).alias("begin"), (F.col("at") + width).alias("end")), "copies")
    discard(docs.sparkSession, path)
    mixed = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", (F.col("kinds") > hot_kinds).alias("hot")), "mixed")
    wanted = kinds.join(mixed.hint("merge"), "anchor").select("anchor", F.col("one.row").alias("row"), F.col("one.at").alias("at"), "hot")
    contexts = stored(_fetched(docs, wanted, width, gram), "context-bytes")
    return copies.union(_indexed(contexts.where("not hot"), width, gram)).union(_counted(contexts.where("hot"), width, gram))


def _keyed(docs: DataFrame, row_col: str, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{row_col}`").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast("binary").alias("raw"))


def _merged(begins: list[int], ends: list[int], size: int) -> list[list[int]]:
    """Disjoint spans of sorted, overlapping marks."""
    own: list[list[int]] = []
    for b, e in zip(begins, ends, strict=True):
        e = min(e, size)
        if own and b <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([b, e])
    return own


def _without(raw: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))


def _by_row(marks: DataFrame) -> DataFrame:
    return marks.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("marks"))  # a document's own marks


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """All rows and columns of ``docs``, repeats cut out of the text; a character that is only partly in a repeat stays.

    A column ``n_chars``, if there is one, is set to the length of what is left.
    """
    rows, row = numbered(docs)
    with passing(docs.sparkSession) as keep:
        of_row = _by_row(keep(repeated(_keyed(rows, row, id_col, text_col), width, gram, hot_kinds), "marks"))

    @F.arrow_udf("string")
    def cut(text: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for k, raw in enumerate(text.cast(pa.binary()).to_pylist()):
            if raw is None or not marks[k].is_valid:
                out.append(None if raw is None else raw.decode())
                continue
            inner, v = [], marks[k].values
            for b, e in _merged(v.field(0).to_pylist(), v.field(1).to_pylist(), len(raw)):
                while b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b += 1
                while e < len(raw) and e > b and raw[e] & 0xC0 == 0x80:
                    e -= 1
                inner.append([b, max(b, e)])
            out.append(_without(raw, inner).decode())
        return pa.array(out, pa.string())

    marks = free_name(rows, "marks")
    made = rows.join(of_row.select(F.col("row").alias(row), F.col("marks").alias(marks)), row, "left").withColumn(text_col, cut(F.col(f"`{text_col}`").cast("string"), F.col(marks)))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length(F.col(f"`{text_col}`")).cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """``(doc_id, row, n_bytes, removed array<struct<begin, end>>, kept binary)`` of every row."""
    rows, row = numbered(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    keyed = _keyed(rows, row, "doc_id", "text")
    with passing(docs.sparkSession) as keep:
        marks = keep(repeated(keyed, width, gram, hot_kinds), "marks")
    spans = "array<struct<begin:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                removed, kept = [], []
                lists = batch.column(3)
                for k, raw in enumerate(batch.column(2).to_pylist()):
                    v = lists[k].values if lists[k].is_valid else None
                    own = [] if v is None else _merged(v.field(0).to_pylist(), v.field(1).to_pylist(), len(raw))
                    removed.append([{"begin": b, "end": e} for b, e in own])
                    kept.append(_without(raw, own))
                sizes = pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), sizes, pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "row", "n_bytes", "removed", "kept"])

    return keyed.join(_by_row(marks), "row", "left").select("row", "doc_id", "raw", "marks").mapInArrow(run, f"doc_id long, row long, n_bytes long, removed {spans}, kept binary")


def digests(deduped: DataFrame) -> DataFrame:
    lengths = F.transform("removed", lambda s: s["end"] - s["begin"])
    return deduped.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
