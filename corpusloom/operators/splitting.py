"""Splitting texts into sections, and sections that are over the limit into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from corpusloom.functions.text import CHARS_PER_TOKEN, count_tokens, single, strip

MODES = ("by_file", "by_paragraph", "by_marker", "single")
FILE_MARKER, PARAGRAPH = "\n\n### ", "\n\n"


def sections(text: Column, marker: str) -> Column:
    """The pieces between markers, each behind its marker; the first trimmed, unless the text begins with the marker.

    Of a text that begins with the marker, later blank pieces are dropped; of another, a blank first piece is.
    """
    m = F.lit(marker)
    quoted = r"\Q" + marker.replace(r"\E", r"\E\\E\Q") + r"\E"
    pieces = F.split(text, quoted)
    behind = lambda x: F.concat(m, x)
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))
    blank = lambda x: strip(x) == ""
    led = F.concat(F.array(behind(F.get(rest, F.lit(0)))), F.transform(F.filter(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(1))), lambda x: ~blank(x)), behind))
    first = F.filter(F.array(strip(F.get(pieces, F.lit(0)))), lambda x: x != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.startswith(text, m), led).otherwise(F.concat(first, F.transform(rest, behind)))


def split_text(text: Column, max_tokens: int, mode: str = "by_file", marker: str = PARAGRAPH) -> Column:
    """The sections of a text by mode; in mode ``single``, or without a limit, one. An unknown mode is ``by_file``."""
    if max_tokens == -1:
        return F.filter(F.array(strip(text)), lambda x: x != "")
    if mode == "single":
        return F.array(single(text, max_tokens))
    return sections(text, {"by_paragraph": PARAGRAPH, "by_marker": marker}.get(mode, FILE_MARKER))


def _packed(items: list[str], separator: str, limit: int, tokens: Callable[[str], int], joint: bool = False) -> list[str]:
    """Neighbours joined as long as they are within the limit; one that is over it stands alone.

    They are within it by the sum of their own tokens, or, if ``joint``, by the tokens of what they make together.
    """
    chunks: list[str] = []
    open_, used = "", 0
    for item in items:
        n = tokens(item)
        if open_ and (n > limit or (tokens(open_ + separator + item) if joint else used + n) > limit):
            chunks.append(open_)
            open_, used = "", 0
        if n > limit:
            chunks.append(item)
        else:
            open_, used = open_ + separator + item if open_ else item, used + n
    return [*chunks, open_] if open_ else chunks


def _longest_prefix(text: str, at: int, limit: int, tokens: Callable[[str], int]) -> int:
    """Characters from ``at`` on that are within the limit, one at least; only a few times as many are looked at."""
    low, high = 0, 2 * limit
    while high < len(text) - at and tokens(text[at : at + high]) <= limit:
        low, high = high, 2 * high
    high = min(high, len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tokens(text[at : at + mid]) <= limit else (low, mid - 1)
    return max(low, 1)


def chunks_of(text: str, limit: int, tokens: Callable[[str], int], strict: bool = False, joint: bool = False) -> list[str]:
    """An oversized section by paragraphs, else by lines, else by characters.

    The first way that gives several chunks holds; a chunk may still be over the limit, unless ``strict``, which goes on.
    Tokens are rounded, so the pieces of an oversized section may sum up to the limit and not part; with ``joint`` they do.
    """
    for separator in ("\n\n", "\n"):
        if separator in text and len(found := _packed(text.split(separator), separator, limit, tokens, joint)) > 1:
            return [c for x in found for c in (chunks_of(x, limit, tokens, True, joint) if tokens(x) > limit else [x])] if strict else found
    if isinstance(tokens, DefaultTokens):
        return [text[i : i + tokens.longest(limit)] for i in range(0, len(text), tokens.longest(limit))]
    found, at = [], 0
    while at < len(text):
        cut = _longest_prefix(text, at, limit, tokens)
        found.append(text[at : at + cut])
        at += cut
    return found


class DefaultTokens:
    """Code points over ``per``, rounded down, one at least."""

    def __init__(self, per: int = CHARS_PER_TOKEN):
        self.per = per

    def __call__(self, text: str) -> int:
        return max(1, len(text) // self.per)

    def longest(self, limit: int) -> int:
        """Characters of the longest text within the limit."""
        return max(1, limit * self.per + self.per - 1)


def default_tokens(chars_per_token: int = CHARS_PER_TOKEN) -> Callable[[str], int]:
    return DefaultTokens(chars_per_token)


def oversized_chunks(max_tokens: int, tokens: Callable[[str], int] | None = None, strict: bool = False):
    """``chunks_of`` as an Arrow function of a text."""
    count = tokens or default_tokens()

    @F.arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else chunks_of(t, max_tokens, count, strict) for t in text.to_pylist()], pa.list_(pa.string()))

    return run


def _chunked(others: list[str], max_tokens: int, tokens: Callable[[str], int] | None, strict: bool, joint: bool):
    """A row for each chunk of the last column; a few texts at a time."""
    count = tokens or default_tokens()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                few = whole.slice(i, 64)
                found = [chunks_of(t, max_tokens, count, strict, joint) for t in few.column(len(others)).to_pylist()]
                rows = pa.array([k for k, own in enumerate(found) for _ in own], pa.int64())
                sizes, numbers, texts = zip(*[(len(own), n, x) for own in found for n, x in enumerate(own)], strict=True) if len(rows) else ((), (), ())
                taken = few.take(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(k) for k in range(len(others))), pa.array(sizes, pa.int32()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], [*others, "n_chunks", "chunk_no", few.schema.names[-1]]
                )

    return run


def char_chunks(text: Column, max_tokens: int, chars_per_token: int = CHARS_PER_TOKEN) -> Column:
    """The chunks by characters alone in closed form: each the longest that default tokens allow."""
    width = max_tokens * chars_per_token + chars_per_token - 1
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(width))))


def exploded(rows: DataFrame, max_tokens: int, content: str = "content", tokens: Callable[[Column], Column] = count_tokens, plain: Callable[[str], int] | None = None, strict: bool = False, joint: bool = False) -> DataFrame:
    """Trimmed, non-blank rows as chunks: adds ``chunk_no``, ``n_chunks`` and ``tokens``; only oversized ones leave the JVM."""
    rows = rows.withColumn(content, strip(F.col(content))).where(F.col(content) != "").withColumn("tokens", tokens(F.col(content)))
    if max_tokens == -1:
        return rows.withColumns({"chunk_no": F.lit(0), "n_chunks": F.lit(1)})
    large = F.col("tokens") > max_tokens
    whole = rows.where(~large).withColumns({"chunk_no": F.lit(0), "n_chunks": F.lit(1)})
    others = [c for c in rows.columns if c not in (content, "tokens")]
    kinds = rows.select(*others).schema.add("n_chunks", IntegerType()).add("chunk_no", IntegerType()).add(content, StringType())
    pieces = rows.where(large).select(*others, content).mapInArrow(_chunked(others, max_tokens, plain, strict, joint), kinds)
    pieces = pieces.withColumn("tokens", tokens(F.col(content))).withColumn("oversized", F.lit(True))
    return whole.withColumn("oversized", F.lit(False)).unionByName(pieces)
