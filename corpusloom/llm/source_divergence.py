"""Audit of how the sources of each language differ in their words.

Texts are counted where they lie: a task adds up occurrences and documents of each term by language and source and hands its sums on,
so what is shuffled are sums, not words. Terms that enough documents of a language hold are kept, sorted in the order of their UTF-8 bytes, and cut into chunks of bounded
length; a chunk's array of terms is its integer dictionary. The sums of a chunk's terms meet in one task: ids by binary search in the array, a dense vector of counts for each
source by bincount, and from these the shares, the distances of all pairs of sources over the chunk, and the best terms of each source. Ids stand in the order of the terms,
so ties need no strings. Distances are then added up over chunks and terms ranked among the few that each chunk gives.

All arithmetic is of whole numbers: a share is worked out in three steps of a thousand, exact up to 9 x 10^15 words of a source.

Defined results: a null text, language or source is an empty one; a source without terms is a group like any other; a language without kept
terms gives pairs of distance 0; repeated rows count each for itself; equal values rank by their items' bytes; an empty table gives an
empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import slices, stored

#: Documents of a language that a kept term is in at least; what is added to each count; terms reported of a source; what shares are counted in.
LEAST, ADDED, BEST, SCALE = 30, 5, 50, 1_000_000_000
#: Sums that a task holds before it hands them on; terms of a chunk at most; counts of a chunk at most, over all sources.
HELD, CHUNK_TERMS, CHUNK_CELLS = 1 << 18, 1024, 1 << 20
#: ASCII letters in lower case and all bytes beyond ASCII as they are; anything else parts terms.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SUMS = "lang string, source string, term string, n bigint, docs bigint"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def _handed_on(held: dict) -> pa.RecordBatch:
    rows = [(lang, source, term.decode(), n, docs) for (lang, source), (counts, within) in held.items() for term, n in counts.items() for docs in (within[term],)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])


def term_sums(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held_most: int = HELD) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for part in slices(batch, 0):
                for text, lang, source in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    counts, within = held[lang, source]
                    own = Counter(terms(text))
                    before = len(counts)
                    counts.update(own)
                    within.update(own.keys())
                    size += len(counts) - before
                    if size >= held_most:
                        yield _handed_on(held)
                        held.clear()
                        size = 0
        yield _handed_on(held)

    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    partial = docs.select(name(text_col).alias("text"), name(lang_col).alias("lang"), name(source_col).alias("source")).mapInArrow(run, _SUMS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chunks(kept: DataFrame, most: int) -> DataFrame:
    """``(lang, chunk, term)``: the terms of each language in their order, in chunks of ``most`` terms. Ranges of terms lie in partitions, whose ends end a chunk too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, seen = None, -1, 0
        for batch in batches:
            langs, numbers = batch.column(0).to_pylist(), []
            for lang in langs:
                if lang != last or seen == most:
                    last, at, seen = lang, at + 1, 0
                seen += 1
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64())], ["lang", "term", "at"])

    ranged = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    cut = ranged.mapInArrow(run, "lang string, term string, at bigint")
    return cut.select("lang", F.concat_ws("-", F.spark_partition_id(), "at").alias("chunk"), "term")


def shares(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED n_terms)) for a row of counts each total: three digits at a time, since the product may be beyond 64 bits."""
    rest, of = counts + ADDED, (totals + ADDED * n_terms)[:, None]
    found = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // of
        rest %= of
    return found + 1


def _chunk_results(sums: pa.Table, head: pa.Table) -> pa.Table:
    """Of one chunk: ``(source, part, item, value)``, pairs each once, and the terms that a source has more of than its language."""
    names = head.column("sources")[0].as_py()
    totals = np.array(head.column("totals")[0].as_py(), np.int64)
    lang, n_terms = head.column("lang")[0].as_py(), head.column("n_terms")[0].as_py()
    words = np.empty(len(head.column("terms")[0]), object)
    words[:] = sorted(x.encode() for x in head.column("terms")[0].as_py())
    ids = np.searchsorted(words, np.array([*(x.encode() for x in sums.column("term").to_pylist()), None], object)[:-1])
    place = {name: i for i, name in enumerate(names)}
    group = np.array([place[x] for x in sums.column("source").to_pylist()], np.int64)
    own = np.bincount(group * len(words) + ids, weights=sums.column("n").to_numpy(), minlength=len(names) * len(words)).astype(np.int64).reshape(len(names), len(words))
    p = shares(own, totals, n_terms)
    q = shares(own.sum(0, keepdims=True), totals.sum(keepdims=True), n_terms)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def put(source: str, part: str, items: list, values: list) -> None:
        for key, x in zip(out, ([source] * len(items), [part] * len(items), items, values), strict=True):
            out[key].extend(x)

    for i, name in enumerate(names):
        put(name, "pair", names[i + 1 :], np.abs(p[i + 1 :] - p[i]).sum(1).tolist())
        more = np.flatnonzero((own[i] > 0) & (p[i] > q[0]))
        values = p[i][more] - q[0][more]
        best = np.lexsort((more, -values))[:BEST]  # ids break ties, as the terms would
        put(name, "term", [words[k].decode() for k in more[best]], values[best].tolist())
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), **{k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in out.items()}})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of each source to all others of its language, and the terms that it has most of beyond its language's share."""
    key = ["lang", "source"]
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = stored(docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct(), "groups")
    sums = stored(term_sums(docs, text_col, lang_col, source_col), "sums")
    kept = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    most_sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    placed = stored(chunks(kept, max(1, min(chunk_terms, CHUNK_CELLS // most_sources))), "chunks")
    counted = stored(sums.join(placed, ["lang", "term"]).select("lang", "source", "chunk", "term", "n"), "counted")
    totals = groups.join(counted.groupBy(*key).agg(F.sum("n").alias("total")), key, "left").select(*key, F.coalesce("total", F.lit(0)).alias("total"))
    by_lang = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"))
    by_lang = by_lang.join(placed.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang")
    heads = placed.groupBy("lang", "chunk").agg(F.collect_list("term").alias("terms")).join(by_lang, "lang")
    heads = heads.select("lang", "chunk", "terms", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), "n_terms")
    found = counted.groupBy("lang", "chunk").cogroup(heads.groupBy("lang", "chunk")).applyInArrow(_chunk_results, "lang string, source string, part string, item string, value bigint")
    found = stored(found, "found")
    apart = found.where("part = 'pair'").groupBy(*key, "item").agg(F.sum("value").alias("value"))
    apart = apart.unionByName(apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    #: the result holds every pair of sources of a language, of distance 0 where nothing is kept
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").join(apart, [*key, "item"], "left")
    rows = pairs.select(*key, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    pair_rows = rows.withColumn("rank", F.row_number().over(order))
    term_rows = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return pair_rows.unionByName(term_rows)
