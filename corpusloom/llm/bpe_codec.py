"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` gives each document's token ids, ``decode`` gives the raw bytes of ids. Long texts are cut at safe
boundaries before they reach the library: no match of the split pattern goes on from a character that isn't white space to one that is,
so each such place starts a match of its own and the cut changes nothing. The library's split fails on runs of a million white
characters; such a run stands at the start of a piece, is one match by the pattern's own rule but for its last character, and goes to the merges directly.

Defined results: a null or empty text has no ids (an empty list) and decodes to no bytes; a null list of ids decodes
to null; repeated rows are coded each for itself; an empty table gives an empty table. Text is coded whole. All other
columns of the input are left out, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import texts

#: Characters after which a long text is cut at the next safe boundary; white space beyond which a run is not left to the library's split.
CHUNK_CHARS, LONG_RUN = 1 << 16, 1 << 14
# The characters that the pattern's class of white space holds.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_RUN = re.compile(f"[{_SPACE}]*")
_CODECS: dict[tuple[str, str], object] = {}


def codec(rank_file: str, pattern: str):
    """The library's encoding for a rank file; made once in each Python worker."""
    key = (rank_file, pattern)
    if key not in _CODECS:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODECS[key]


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that the pattern splits as it splits the whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + max(1, size))
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _encode_piece(encoding, text: str, long_run: int) -> list[int]:
    """The ids of a piece. Of white space at its start all but the last character is one match if text follows, else all of it is."""
    run = _RUN.match(text).end()
    if run <= max(1, long_run):
        return encoding.encode_ordinary(text)
    cut = run if run == len(text) else run - 1
    return encoding._encode_single_piece(text[:cut]) + encoding.encode_ordinary(text[cut:])


def encode_text(text: str | None, rank_file: str, pattern: str, chunk_chars: int = CHUNK_CHARS, long_run: int = LONG_RUN) -> list[int]:
    if not text:
        return []
    encoding = codec(rank_file, pattern)
    if len(text) <= min(chunk_chars, long_run):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    edges = [0, *(m.start() for m in re.finditer(f"[{_SPACE}]{{{long_run + 1},}}", text) if m.start()), len(text)]
    for begin, end in zip(edges, edges[1:], strict=False):  # a long run begins a part
        for piece in safe_chunks(text[begin:end], chunk_chars):
            ids += _encode_piece(encoding, piece, long_run)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [encode_text(t, rank_file, pattern, chunk_chars) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded binary)``: the raw bytes that the ids stand for, without any repair of broken UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(rank_file, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                raw = [None if ids is None else encoding.decode_bytes(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *more: Column) -> DataFrame:
    """Counts and checksums of what ``decode`` gives, and further columns of it."""
    return decoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
