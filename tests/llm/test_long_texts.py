"""Texts that are cut into several pieces."""

from __future__ import annotations

import random

import pytest

from corpusloom.llm import suffix_dedup


def found(texts):
    return [(int(d), int(p), int(h)) for own, place, hashes in suffix_dedup._places(texts, 200, 64) for d, p, h in zip(own, place, hashes, strict=True)]


@pytest.mark.parametrize(("chunk", "block"), [(700, 300), (300, 5000), (201, 1), (1000, 1000)])
def test_anchors_come_once(monkeypatch, chunk, block):
    long = bytes(random.Random(2).choices(b"abcd ", k=3000))
    texts = [long, long[500:1500], b"x" * 100, b"y" * 700, long[::-1]]
    once = found(texts)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    assert found(texts) == once and len(set(once)) == len(once)


def test_long_texts_lose_repeats_only(spark, tmp_path):
    """A passage comes twice, once over a cut; all else is there once."""
    rng = random.Random(7)
    chunk, letters = suffix_dedup.CHUNK, b"abcdefghijklmnop"
    passage = bytes(rng.choices(letters, k=500))
    text = bytearray(rng.choices(letters, k=2 * chunk + 5000))
    places = (1000, 2 * chunk - 250)
    for p in places:
        text[p - 1 : p + 501] = (b"Q" if p == 1000 else b"R") + passage + (b"S" if p == 1000 else b"T")
    path = str(tmp_path / "long")
    spark.createDataFrame([(1, text.decode()), (2, bytes(rng.choices(letters, k=chunk + 3000)).decode())], "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: [(s.begin, s.end) for s in r.removed] for r in suffix_dedup.dedup(spark.read.parquet(path)).select("doc_id", "removed").collect()}
    assert got == {1: [(p, p + 500) for p in places], 2: []}
