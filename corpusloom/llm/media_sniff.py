"""Media columns: what stored bytes really are, whatever they were declared as, and what other media they hold.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob, window by window. Each hit is a guess that the format's
validator confirms or drops: it follows the headers, chunks, segments or pages that the format lays out and gives the length by them, so a part ends where its
format says and not where the next magic stands. Confirmed parts nest: a part within another has a greater depth, a part that would end beyond
its surroundings is none. A blob whose outermost first part begins it and ends it is of that part's type, whatever was declared; one that only holds parts
is a carrier, from which they are carved.

``store`` keeps texts as media: UTF-8 and bytes of 255 up to a whole number of rows, as 8-bit samples of an uncompressed picture or sound. Which
format, whether the declared type is right, wrong or absent, and whether the media stands in a carrier is told by the payload's SHA-256. ``features`` finds the media in the blob by
its bytes alone and reads the payload back from it.

A place from which a walk failed is remembered, so that many false hits don't walk the same bytes again and again.

Defined results: a null or empty text is a payload of one block of padding; a null blob has no parts, no type and no features; a blob without
media keeps its declared type; null ids and repeated rows are rows like any other; equal texts give equal bytes; an empty table gives an empty table; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import slices, texts

#: Bytes of a block of payload, which is what padding fills up; samples of a row of a picture; samples a second of a sound.
BLOCK, WIDTH, RATE = 576, 24, 8000
#: Bytes that are searched at once.
WINDOW = 1 << 16
CARRIER = "application/octet-stream"


class Part(NamedTuple):
    kind: str
    at: int
    length: int
    depth: int


# Walks


def _walk(step: Callable[[bytes, int], tuple[int, bool] | None], data: bytes, at: int, dead: set[int]) -> int | None:
    """The end that steps from ``at`` lead to. Where one step leads depends on its place only, so a place that failed once fails always."""
    seen = []
    while at not in dead:
        seen.append(at)
        found = step(data, at)
        if found is None:
            break
        at, over = found
        if over:
            return at
    dead.update(seen)
    return None


def _u(data: bytes, at: int, kind: str) -> int | None:
    size = struct.calcsize(kind)
    return struct.unpack_from(kind, data, at)[0] if 0 <= at <= len(data) - size else None


def _within(data: bytes, end: int | None) -> int | None:
    return end if end is not None and end <= len(data) else None


def _png_chunk(data: bytes, at: int):
    length, name = _u(data, at, ">I"), data[at + 4 : at + 8]
    if length is None or not name.isalpha() or at + 12 + length > len(data):
        return None
    return at + 12 + length, name == b"IEND"


def _png(data: bytes, at: int, dead: set[int]) -> int | None:
    head = data[at + 8 : at + 33]
    if head[:8] != b"\0\0\0\rIHDR" or len(head) < 25 or zlib.crc32(head[4:21]) != struct.unpack(">I", head[21:])[0]:
        return None
    return _walk(_png_chunk, data, at + 8, dead)


_JPEG_MARKER = re.compile(rb"\xff+([^\x00\xff\xd0-\xd7])")


def _jpeg_segment(data: bytes, at: int):
    if data[at : at + 1] != b"\xff":
        return None
    marker = data[at + 1 : at + 2]
    if marker == b"\xd9":
        return at + 2, True
    length = _u(data, at + 2, ">H")
    if length is None or length < 2 or marker < b"\xc0" or at + 2 + length > len(data):
        return None
    end = at + 2 + length
    if marker == b"\xda":  # coded data goes on up to the next marker
        found = _JPEG_MARKER.search(data, end)
        return None if found is None else (found.end() - 2, False)
    return end, False


def _jpeg(data: bytes, at: int, dead: set[int]) -> int | None:
    return _walk(_jpeg_segment, data, at + 2, dead)


def _gif_blocks(data: bytes, at: int) -> int | None:
    """The end of a chain of counted blocks."""
    while (n := _u(data, at, "B")) is not None:
        at += 1 + n
        if n == 0:
            return _within(data, at)
    return None


def _gif_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _gif_step(data: bytes, at: int):
    kind = data[at : at + 1]
    if kind == b";":
        return at + 1, True
    if kind == b"!":
        end = _gif_blocks(data, at + 2)
    elif kind == b"," and (flags := _u(data, at + 9, "B")) is not None:
        end = _gif_blocks(data, at + 11 + _gif_table(flags))
    else:
        end = None
    return None if end is None else (end, False)


def _gif(data: bytes, at: int, dead: set[int]) -> int | None:
    flags = _u(data, at + 10, "B")
    return None if flags is None else _walk(_gif_step, data, at + 13 + _gif_table(flags), dead)


def _ogg_page(data: bytes, at: int):
    if data[at : at + 5] != b"OggS\0" or (n := _u(data, at + 26, "B")) is None or at + 27 + n > len(data):
        return None
    end = _within(data, at + 27 + n + sum(data[at + 27 : at + 27 + n]))
    return None if end is None else (end, bool(data[at + 5] & 4))


def _ogg(data: bytes, at: int, dead: set[int]) -> int | None:
    return _walk(_ogg_page, data, at, dead) if (_u(data, at + 5, "B") or 0) & 2 else None


def _mp4_box(data: bytes, at: int):
    """A step is over where no box follows."""
    size, name = _u(data, at, ">I"), data[at + 4 : at + 8]
    if size is None or size < 8 or at + size > len(data) or not name.isalnum():
        return at, True
    return at + size, False


def _mp4(data: bytes, at: int, dead: set[int]) -> int | None:
    """``at`` is the place of the first box's name, four behind its size."""
    size = _u(data, at, ">I")
    if size is None or not 16 <= size <= 256 or size % 4 or not data[at + 8 : at + 12].strip().isalnum():
        return None
    end = _walk(_mp4_box, data, at, dead)
    return end if end is not None and end > at + size else None


def _bmp(data: bytes, at: int, dead: set[int]) -> int | None:
    if at + 54 > len(data):
        return None
    size, zero, start, head, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not 14 + head <= start <= size or (packed == 0 and size < start + rows):
        return None
    return _within(data, at + size)


_PNM = re.compile(rb"P([56])\s(\d{1,9})\s(\d{1,9})\s(\d{1,5})\s")


def _pnm_head(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Where samples begin, width and height."""
    found = _PNM.match(data, at, at + 40)
    if found is None or not 0 < int(found[4]) < 256:
        return None
    return found.end(), int(found[2]) * (3 if found[1] == b"6" else 1), int(found[3])


def _pnm(data: bytes, at: int, dead: set[int]) -> int | None:
    head = _pnm_head(data, at)
    return None if head is None or not head[1] * head[2] else _within(data, head[0] + head[1] * head[2])


_AU_BYTES = {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 8, 27: 1}


def _au(data: bytes, at: int, dead: set[int]) -> int | None:
    if at + 24 > len(data):
        return None
    start, size, coding, rate, channels = struct.unpack_from(">IIIII", data, at + 4)
    if start < 24 or coding not in _AU_BYTES or not 0 < rate <= 1 << 20 or not 0 < channels <= 64 or size % (_AU_BYTES[coding] * channels):
        return None
    return _within(data, at + start + size)


def _riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = _u(data, at + 4, "<I")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
_RIFF_FIRST = {b"WAVE": {b"fmt ", b"JUNK", b"bext"}, b"WEBP": {b"VP8 ", b"VP8L", b"VP8X"}, b"AVI ": {b"LIST", b"JUNK"}}


def _riff(data: bytes, at: int, dead: set[int]) -> int | None:
    size, form = _u(data, at + 4, "<I"), data[at + 8 : at + 12]
    first, length = data[at + 12 : at + 16], _u(data, at + 16, "<I")
    if size is None or form not in _RIFF or first not in _RIFF_FIRST[form] or length is None or length + 12 > size:
        return None
    return _within(data, at + 8 + size)


#: Magic bytes, how far they stand behind the start of the media, type, validator.
MAGIC: tuple[tuple[bytes, int, str, Callable], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"P5", 0, "image/x-portable-anymap", _pnm),
    (b"P6", 0, "image/x-portable-anymap", _pnm),
    (b"RIFF", 0, "riff", _riff),
    (b".snd", 0, "audio/basic", _au),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
)
_LONGEST = max(len(m[0]) for m in MAGIC)


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, _, _, _) in enumerate(MAGIC):
        found.add_word(magic.decode("latin-1"), i)
    found.make_automaton()
    return found


def hits(data: bytes, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """``(start of the media, number of the magic)`` wherever magic bytes stand, in order of the magic's end."""
    for begin in range(0, len(data), window):
        lead = max(0, begin - _LONGEST + 1)
        for last, i in _automaton().iter(data[lead : begin + window].decode("latin-1")):
            if lead + last >= begin and (at := lead + last + 1 - len(MAGIC[i][0]) - MAGIC[i][1]) >= 0:
                yield at, i


def parts(data: bytes | None, window: int = WINDOW) -> list[Part]:
    """All media in a blob, outer ones before what they hold."""
    found, around, dead = [], [], [set() for _ in MAGIC]
    for at, i in sorted(hits(data or b"", window)):
        _, _, kind, validate = MAGIC[i]
        end = validate(data, at, dead[i])
        if end is None:
            continue
        while around and around[-1] <= at:
            around.pop()
        if around and end > around[-1]:
            continue
        found.append(Part(_RIFF[data[at + 8 : at + 12]] if kind == "riff" else kind, at, end - at, len(around)))
        around.append(end)
    return found


def corrected(declared: str | None, data: bytes | None, found: list[Part]) -> str | None:
    """The type of a blob by its bytes: that of the part that fills it, or a carrier's if it holds parts, or else what was declared."""
    if found and found[0].at == 0 and found[0].length == len(data):
        return found[0].kind
    return CARRIER if found else declared


# Texts as media


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (BLOCK - len(raw) if not raw else -len(raw) % BLOCK)


def _as_wav(samples: bytes) -> bytes:
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def _as_bmp(samples: bytes) -> bytes:
    n, start = len(samples), 54 + 1024
    head = struct.pack("<2sIIIIiiHHIIIIII", b"BM", start + n, 0, start, 40, WIDTH, -(n // WIDTH), 1, 8, 0, n, 0, 0, 256, 0)
    return head + b"".join(bytes((i, i, i, 0)) for i in range(256)) + samples


def _as_pnm(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def _as_au(samples: bytes) -> bytes:
    return struct.pack(">4sIIIII", b".snd", 24, len(samples), 2, RATE, 1) + samples


FORMATS: dict[str, Callable[[bytes], bytes]] = {"audio/wav": _as_wav, "image/bmp": _as_bmp, "image/x-portable-anymap": _as_pnm, "audio/basic": _as_au}


def samples(data: bytes, part: Part) -> tuple[bytes, int, int] | None:
    """8-bit samples of a part, their width or channels, and rows or frames; None for what isn't kept as such samples."""
    at, end = part.at, part.at + part.length
    if part.kind == "audio/wav":
        chunks = {name: (begin, size) for name, begin, size in _riff_chunks(data, at + 12, end)}
        if b"fmt " not in chunks or b"data" not in chunks or struct.unpack_from("<HHIIHH", data, chunks[b"fmt "][0])[::5] != (1, 8):
            return None
        channels, (begin, size) = _u(data, chunks[b"fmt "][0] + 2, "<H"), chunks[b"data"]
        return data[begin : begin + size], channels, size // max(1, channels)
    if part.kind == "image/bmp":
        start, width, height, bits, packed = (_u(data, at + i, kind) for i, kind in ((10, "<I"), (18, "<i"), (22, "<i"), (28, "<H"), (30, "<I")))
        if bits != 8 or packed or width % 4:
            return None
        rows = [data[at + start + i * width : at + start + (i + 1) * width] for i in range(abs(height))] if height > 0 else [data[at + start : at + start + width * -height]]
        return b"".join(reversed(rows)), width, abs(height)
    if part.kind == "image/x-portable-anymap":
        start, width, height = _pnm_head(data, at)
        return data[start:end], width, height
    if part.kind == "audio/basic" and _u(data, at + 12, ">I") == 2:
        channels = _u(data, at + 20, ">I")
        return data[at + _u(data, at + 4, ">I") : end], channels, (part.length - _u(data, at + 4, ">I")) // channels
    return None


def kept(text: str | None) -> tuple[str | None, bytes]:
    """Declared type and blob of a text."""
    block = payload(text)
    told = hashlib.sha256(block).digest()
    kinds = list(FORMATS)
    which, how = told[0] % len(kinds), told[1] % 4
    media = FORMATS[kinds[which]](block)
    if how == 3:
        return CARRIER, b"DUMP %d\r\n\r\n" % len(media) + media + b"\r\nEND\r\n"
    return (kinds[which], kinds[(which + 1) % len(kinds)], None)[how], media


def feature(declared: str | None, data: bytes | None) -> tuple[bytes, str] | None:
    """The samples of the outermost first part that has some, and what was found: types declared and corrected, the part's type and place, its shape and the sum of its samples."""
    found = parts(data)
    for part in found:
        if part.depth == 0 and (read := samples(data, part)) is not None:
            body, width, rows = read
            return body, f"{declared or '-'} > {corrected(declared, data, found)}: {part.kind} {part.at}+{part.length} {width}x{rows} {_sum(body)}"
    return None


def _sum(body: bytes) -> int:
    import numpy as np

    return int(np.frombuffer(body, np.uint8).sum(dtype=np.int64))


# Columns

_STORED = "doc_id long, n_bytes long, declared string, media binary"
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_PARTS = "doc_id long, declared string, corrected string, parts array<struct<kind:string,at:bigint,length:bigint,depth:int>>"
_CARVED = "doc_id long, part int, kind string, depth int, media binary"


def _rows(kind: str, f: Callable[..., Iterator[tuple] | list[tuple]], column: int):
    """An Arrow function from rows to rows, of which a few MB are Python objects at once."""
    schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}.get(t) or pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("depth", pa.int32())]))) for name, t in (x.split(" ") for x in kind.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, column):
                made = [x for row in zip(*(c.to_pylist() for c in few.columns), strict=True) for x in f(*row)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], field.type) for i, field in enumerate(schema)], schema=schema)

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, declared, media)``: every text as a blob; the media isn't told but by its bytes."""

    def one(doc_id: int | None, text: str | None) -> list[tuple]:
        return [(doc_id, len((text or "").encode()), *kept(text))]

    return texts(docs, id_col, text_col).mapInArrow(_rows(_STORED, one, 1), _STORED)


def features(stored: DataFrame) -> DataFrame:
    """Of every blob of ``store``: what its bytes say, and checksums of the payload read back from it and of the blob."""

    def one(doc_id: int | None, n_bytes: int | None, declared: str | None, media: bytes | None) -> list[tuple]:
        read = feature(declared, media)
        body, told = read or (None, None)
        whole = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
        return [(doc_id, n_bytes, *((None, None, None) if body is None else (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))), *whole, told)]

    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(_rows(_FEATURES, one, 3), _FEATURES)


def _media(table: DataFrame, id_col: str, declared_col: str, media_col: str) -> DataFrame:
    return table.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{declared_col}`").cast("string").alias("declared"), F.col(f"`{media_col}`").cast("binary").alias("media"))


def sniff(table: DataFrame, id_col: str = "doc_id", declared_col: str = "declared", media_col: str = "media") -> DataFrame:
    """``(doc_id, declared, corrected, parts)`` of any table of blobs; parts have type, place, length and depth."""

    def one(doc_id: int | None, declared: str | None, media: bytes | None) -> list[tuple]:
        found = parts(media)
        return [(doc_id, declared, corrected(declared, media, found), [p._asdict() for p in found])]

    return _media(table, id_col, declared_col, media_col).mapInArrow(_rows(_PARTS, one, 2), _PARTS)


def carve(table: DataFrame, id_col: str = "doc_id", declared_col: str = "declared", media_col: str = "media") -> DataFrame:
    """``(doc_id, part, kind, depth, media)``: a row for each media that stands in a blob and isn't all of it, with its own bytes."""

    def one(doc_id: int | None, declared: str | None, media: bytes | None) -> Iterator[tuple]:
        for i, p in enumerate(parts(media)):
            if p.length < len(media):
                yield doc_id, i, p.kind, p.depth, media[p.at : p.at + p.length]

    return _media(table, id_col, declared_col, media_col).mapInArrow(_rows(_CARVED, one, 2), _CARVED)
