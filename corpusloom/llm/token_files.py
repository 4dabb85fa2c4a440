"""Token ids as Arrow files of equal-length sequences.

Layout. Documents are dealt out by ranges of doc_id, so that shard ``k`` holds smaller ids than shard ``k + 1``; in a
shard they stand in ascending order, each followed by the end id. The shard's stream of ids is cut into sequences of
``length`` ids. ``shard-k.arrow`` is an Arrow IPC file whose batches have the columns ``input_ids``
(fixed-size list of unsigned 16-bit ids, or 32-bit where the vocabulary needs them) and ``mask`` (fixed-size list of
booleans; false where the last sequence is padded). All batches but the last have ``batch_rows`` rows, so sequence
``i`` is row ``i % batch_rows`` of batch ``i // batch_rows``: from a memory map it is reached without a copy.
``index-k.arrow`` has doc_id, start (in the shard's stream) and n_tokens (with the end id) of each document.

Files are written under a name of the attempt and then renamed, so a repeated or lost task leaves no half file. They
go through ``pyarrow.fs`` to whatever store the folder's address names.

Encoding. The tokenizers library encodes the text between safe boundaries (white space with a non-space on either side,
where its byte-level split always starts afresh); what it gives for such a piece is remembered in each worker. Words go to its
merges directly, other pieces through its split as well. A text that holds an added token of the vocabulary goes to the library whole and
gets that token's id, as the library does by default.

Defined results: a null or empty text gives the end id alone; null doc_ids come first; repeated rows are written each
for itself, those of one doc_id in order of a hash of their texts; an empty table gives no shard and an empty result; further columns are
left out. Texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import parts, scratch_path, stored, texts

#: Ids in a sequence, sequences in a batch, and pieces that a worker remembers.
LENGTH, BATCH_ROWS, REMEMBERED = 2048, 128, 800_000
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_MARKS = string.punctuation
# The characters by which byte-level merges show bytes that aren't printable.
_SHOWN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_ENCODERS: dict[str, Encoder] = {}


def _pieces(text: str) -> list[str]:
    """A text cut at safe boundaries, without the blanks there."""
    return [x[1:] if i else x for i, x in enumerate(_SAFE.split(text))]


class Encoder:
    """The library's tokenizer and the pieces seen so far; one in each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        #: texts that hold one of these are the library's alone
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: ids, as bytes, of a piece: of a blank and the piece, or of the piece itself where it begins with a line break
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.line_break = self._encoded(["\n"])[0]

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [self._bytes(x.ids) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: str, before: str) -> bytes:
        """Letters, and a blank before them if any, which the split leaves whole: straight to the library's merges."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return self._bytes([t.id for t in self.model.tokenize(before + shown)])

    def _parted(self, piece: str) -> bytes | None:
        """The ids of letters with marks behind them, which the split parts; none where the piece is anything else."""
        known, before = (self.bare, "") if piece[0] == "\n" else (self.known, "\u0120")
        own = piece[1:] if piece[0] == "\n" else piece
        word = own.rstrip(_MARKS)
        if not word.isalpha():
            return None
        ids = known.get(word)
        if ids is None:
            ids = known[word] = self._word(word, before)
        if len(word) < len(own):
            tail = own[len(word) :]
            if tail not in self.bare:
                self.bare[tail] = self._encoded([tail])[0]
            ids += self.bare[tail]
        return ids if before else self.line_break + ids

    def _learn(self, new: set[str]) -> None:
        others = []
        for p in new:
            ids = self._parted(p)
            if ids is None:
                others.append(p)
            else:
                self.known[p] = ids
        self.known.update(zip(others, self._encoded([p if p[0] == "\n" else " " + p for p in others]), strict=True))

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``self.dtype``.

        Pieces between single blanks and before line breaks are looked up. One that is empty, a line break alone, or has white space at
        an end is never known; its text is cut at safe boundaries instead.
        """
        if len(self.known) + len(self.bare) > REMEMBERED:
            self.known.clear()
            self.bare.clear()
        known = self.known
        split, found, new = [], [], set()
        whole = [any(t in text for t in self.added) for text in batch]
        for text, alone in zip(batch, whole, strict=True):
            if alone:
                split.append([text])
                found.append([])
                continue
            pieces = text.replace("\n", " \n").split(" ")
            if " \n" in text or (len(pieces) > 1 and (not pieces[0] or pieces[0][-1].isspace())):
                pieces = _pieces(text)
            ids = list(map(known.get, pieces[1:]))
            if None in ids:
                missing = {p for p, x in zip(pieces[1:], ids, strict=True) if x is None}
                if any(not p or (p[0].isspace() and (p[0] != "\n" or len(p) == 1 or p[1].isspace())) or p[-1].isspace() for p in missing):
                    pieces = _pieces(text)
                    ids = list(map(known.get, pieces[1:]))
                    missing = {p for p, x in zip(pieces[1:], ids, strict=True) if x is None}
                new |= missing
            split.append(pieces)
            found.append(ids)
        self._learn(new)
        firsts = self._encoded([p[0] for p in split])
        return [first + b"".join([known[p] if x is None else x for p, x in zip(pieces[1:], ids, strict=True)]) for first, pieces, ids in zip(firsts, split, found, strict=True)]


class _Shard:
    """A shard as it is written."""

    def __init__(self, folder: str, shard: int, attempt: int, dtype: np.dtype, length: int, batch_rows: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.fs.create_dir(root, recursive=True)
        self.names = [(f"{root}/.{kind}-{shard}-{attempt}", f"{root}/{kind}-{shard}.arrow") for kind in ("shard", "index")]
        self.dtype, self.length, self.rows = dtype, length, batch_rows
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"batch_rows": str(batch_rows)})
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(temporary) for temporary, _ in self.names]
        self.data = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.docs = self.tokens = 0

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        counts = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
        starts = self.tokens + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.docs += len(ids)
        self.tokens += int(counts.sum())
        self.waiting += ids
        self.waiting_bytes += sum(map(len, ids))
        self._flush(self.rows * self.length * self.dtype.itemsize)

    def _flush(self, unit: int) -> None:
        if self.waiting_bytes >= unit:
            joined = b"".join(self.waiting)
            cut = len(joined) // unit * unit
            for i in range(0, cut, unit):
                self._batch(joined[i : i + unit])
            self.waiting, self.waiting_bytes = [joined[cut:]], len(joined) - cut

    def _batch(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, self.dtype)
        padded = -(-len(ids) // self.length) * self.length
        mask = np.arange(padded) < len(ids)
        values = pa.array(np.concatenate((ids, np.zeros(padded - len(ids), self.dtype))))
        self.data.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(values, self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if rest := b"".join(self.waiting):
            self._batch(rest)
        for writer in (self.data, self.index, *self.sinks):
            writer.close()
        for temporary, name in self.names:
            self.fs.move(temporary, name)


def write(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None, length: int = LENGTH, batch_rows: int = BATCH_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; gives the manifest ``(shard, folder, n_docs, n_tokens, base)``, base the ids of all shards before."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, context = Encoder.of(tokenizer_file), None, TaskContext.get()
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                if shard is None:
                    shard = _Shard(folder, context.partitionId(), context.taskAttemptId(), encoder.dtype, length, batch_rows)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                shard.add(part.column(0).to_pylist(), [x + end for x in ids])
        if shard is not None:
            shard.close()
            row = [context.partitionId(), folder, shard.docs, shard.tokens]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "folder", "n_docs", "n_tokens"])

    dealt = texts(docs, id_col, text_col).repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    shards = stored(dealt.mapInArrow(run, "shard long, folder string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Reader:
    """Random access to one shard; from a local store through a memory map."""

    def __init__(self, folder: str, shard: int):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        opened = [pa.memory_map(p) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(p) for p in (f"{root}/shard-{shard}.arrow", f"{root}/index-{shard}.arrow")]
        self.data, self.index = (pa.ipc.open_file(x) for x in opened)
        self.batch_rows = int(self.data.schema.metadata[b"batch_rows"])
        self.length = self.data.schema.field("input_ids").type.list_size
        self._last: tuple[int, np.ndarray] | None = None

    def _batch(self, k: int) -> np.ndarray:
        if self._last is None or self._last[0] != k:
            self._last = k, self.data.get_batch(k).column(0).flatten().to_numpy()
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the ``i``-th sequence."""
        batch, row = self.data.get_batch(i // self.batch_rows), i % self.batch_rows
        return batch.column(0).flatten().to_numpy()[row * self.length : (row + 1) * self.length], batch.column(1)[row].values

    def span(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in pieces that are views of the file."""
        unit = self.batch_rows * self.length
        while count > 0:
            piece = self._batch(start // unit)[start % unit :][:count]
            yield piece
            start += len(piece)
            count -= len(piece)


def read_back(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["folder"], row["shard"])
                for k in range(reader.index.num_record_batches):
                    index = reader.index.get_batch(k)
                    sums = []
                    for start, count in zip(index.column(1).to_pylist(), index.column(2).to_pylist(), strict=True):
                        crc = 0
                        for piece in reader.span(start, count):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([index.column(0), pa.array(index.column(1).to_numpy() + row["base"]), index.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = manifest.select("shard", "folder", "base").repartition(parts(manifest.sparkSession), "shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
