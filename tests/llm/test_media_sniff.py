"""Media: round trips, true types of odd blobs, carved parts, and walks that stay linear."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib

import pytest

from corpusloom.llm import media_sniff as M


def png(width=4, height=3, body=None):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = zlib.compress(body or b"".join(b"\0" + bytes(width) for _ in range(height)), 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", raw) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + bytes(9) + b"\xff\xdb\x00\x03\x01\xff\xda\x00\x04\x01\x02scan\xff\x00data\xff\xd0more\xff\xd9"
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"!\xf9\x04\x01\x00\x00\x00\x00," + bytes(8) + b"\x00\x02\x02D\x01\x00;"
OGG = b"OggS\0\x02" + bytes(20) + b"\x01\x03abcOggS\0\x04" + bytes(20) + b"\x02\x02\x01xyz"
MP4 = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 12) + b"moov" + bytes(4) + struct.pack(">I", 9) + b"mdat1"
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 2) + b"WEBPVP8 " + struct.pack("<I", 2) + b"ab"
SAMPLES = {"image/png": png(), "image/jpeg": JPEG, "image/gif": GIF, "audio/ogg": OGG, "video/mp4": MP4, "image/webp": WEBP} | {k: f(M.payload("some text")) for k, f in M.FORMATS.items()}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_each_format(kind):
    blob = SAMPLES[kind]
    assert M.parts(blob) == [M.Part(kind, 0, len(blob), 0)]
    assert M.corrected("text/plain", blob, M.parts(blob)) == kind
    lead, tail = b"GIF8 BMP RIFF P5 .snd OggS ftyp \xff\xd8", b"tail"
    assert M.parts(lead + blob + tail) == [M.Part(kind, len(lead), len(blob), 0)]
    assert M.corrected(None, lead + blob + tail, M.parts(lead + blob + tail)) == M.CARRIER
    cut = blob[:-1]
    assert all(p.length < len(cut) for p in M.parts(cut))


def test_parts_within_parts():
    inner = png()
    outer = M._as_wav(inner + GIF + b"\0" * (-len(inner + GIF) % 2))
    assert [(p.kind, p.depth) for p in M.parts(outer + JPEG)] == [("audio/wav", 0), ("image/png", 1), ("image/gif", 1), ("image/jpeg", 0)]
    claims_more = M._as_bmp(b"\0" * 576 + b"RIFF" + struct.pack("<I", 10**6) + b"WAVEfmt " + struct.pack("<I", 16))
    assert len(M.parts(claims_more)) == 1


@pytest.mark.parametrize("window", [1, 5, 64])
def test_windows_find_the_same(window):
    rng = random.Random(window)
    blob = b"".join(rng.choice([*SAMPLES.values(), b"BM", b"P5 2 2 255 ", b"RIFF", bytes(rng.randrange(9))]) for _ in range(40))
    assert M.parts(blob, window) == M.parts(blob) and len(M.parts(blob)) > 10


def test_bottom_up_rows_are_turned():
    body = bytes(range(96))
    blob = bytearray(M._as_bmp(body))
    blob[22:26] = struct.pack("<i", 4)
    read = M.samples(bytes(blob), M.parts(bytes(blob))[0])
    assert read == (body[72:] + body[48:72] + body[24:48] + body[:24], 24, 4)


def model(doc_id, text):
    raw = (text or "").encode()
    body = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
    return doc_id, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])


def test_payloads_come_back(spark, docs, rows):
    texts = ["x" * n for n in (575, 576, 577, 1152)] + [M._as_pnm(b"a" * 576).decode("latin-1"), "BM" * 3000, "P5 24 24 255 " * 300, "É" + "PNG\r\n\x1a\n" * 50]
    more = [(9000 + i, t) for i, t in enumerate(texts)]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    stored = M.store(all_docs)
    found = M.features(stored).collect()
    assert sorted(str(tuple(r)[:5]) for r in found) == sorted(str(model(*r[:2])) for r in [*rows, *more])
    assert {r.feature.partition(" > ")[0] for r in found} == {*M.FORMATS, "-", M.CARRIER}
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.payload_sha256, tuple(r)[1:]) == tuple(r)[1:]
    sniffed = M.sniff(stored).collect()
    assert all(r.corrected in (*M.FORMATS, M.CARRIER) and r.parts for r in sniffed)
    carved = M.carve(stored).where("depth = 0").collect()
    assert len(carved) == sum(r.corrected == M.CARRIER for r in sniffed) > 0
    assert all(M.parts(r.media)[0] == M.Part(r.kind, 0, len(r.media), 0) for r in carved)


def test_a_very_long_text(spark):
    text = "BM P6 RIFF .snd ÿØ " * 400_000
    r = M.features(M.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert tuple(r)[:5] == model(1, text)


def test_false_hits_stay_linear():
    began = time.time()
    for blob in (b"OggS\0\2" + bytes(20) + b"\0", b"\xff\xd8\xff\xe0\0\2", b"GIF89a" + bytes(7) + b"!\0\0", struct.pack(">I", 16) + b"ftypisom" + bytes(4)):
        assert M.parts(blob * 40_000 + b"!") is not None
    assert time.time() - began < 20


def test_null_blobs_and_nothing(spark, empty):
    blobs = spark.createDataFrame([(1, "image/png", None), (None, None, b""), (2, "image/png", b"nothing here")], "doc_id long, declared string, media binary")
    assert [(r.corrected, r.parts) for r in M.sniff(blobs).orderBy("doc_id").collect()] == [(None, []), ("image/png", []), ("image/png", [])]
    assert M.carve(blobs).count() == 0
    assert [r.feature for r in M.features(blobs.selectExpr("doc_id", "0L AS n_bytes", "declared", "media")).collect()] == [None] * 3
    assert M.features(M.store(empty)).count() == 0 and M.sniff(M.store(empty)).count() == 0
