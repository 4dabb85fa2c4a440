"""Token ids: round trips, and the libraries on whole texts as the model."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe_codec, token_files

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_codec(docs, rows, model):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs, RANKS, P.PATTERN, chunk_chars=100), RANKS, P.PATTERN)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = model.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == sorted(want)


def test_codec_of_nothing(empty):
    assert bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN)).count() == 0


def test_null_ids_decode_to_null(spark):
    assert bpe_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS, P.PATTERN).first().decoded is None


_TEXT = st.text(st.sampled_from("ab 's\n\t é1漢😀."), max_size=60)


@settings(max_examples=300, deadline=None)
@given(text=_TEXT, size=st.integers(1, 12), run=st.integers(0, 5))
def test_safe_boundaries(model, text, size, run):
    assert bpe_codec.encode_text(text, RANKS, P.PATTERN, size, run) == model.encode_ordinary(text)


_PIECES = st.lists(st.sampled_from([*"ab 's\n\t é1漢😀.#!", "<|endoftext|>", "\u00a0", "\x1c", "ab.", "\nAb,", " the", "***", "don't"]), max_size=25).map("".join)


@settings(max_examples=600, deadline=None)
@given(texts=st.lists(_TEXT | _PIECES, max_size=5))
def test_pieces_encode_as_the_whole(library, texts):
    encoder = token_files.Encoder.of(JSON)
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_files(spark, docs, rows, library, tmp_path):
    manifest = token_files.write(docs, JSON, end_id=2, folder=str(tmp_path / "f"), length=32, batch_rows=4)
    got = [tuple(r) for r in token_files.read_back(manifest).collect()]
    coded = [(doc_id, [*library.encode(text or "", add_special_tokens=False).ids, 2]) for doc_id, text, *_ in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(d), len(ids), crc(ids)) for d, ids in coded)
    got.sort(key=lambda g: g[1])
    assert [g[1] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    order = [(-1 if g[0] is None else g[0]) for g in got]
    assert order == sorted(order)
    for row in manifest.collect():
        reader = token_files.Reader(row.folder, row.shard)
        whole = np.concatenate(list(reader.span(0, row.n_tokens)))
        i = row.n_tokens // 32 - 1 if row.n_tokens % 32 == 0 else row.n_tokens // 32
        ids, mask = reader.sequence(i)
        kept = np.array(mask.to_pylist())
        assert len(ids) == 32 and (ids[kept] == whole[i * 32 :]).all() and not ids[~kept].any()
        if row.n_tokens > 64:
            assert (reader.sequence(1)[0] == whole[32:64]).all()


def test_files_of_nothing(empty, tmp_path):
    assert token_files.read_back(token_files.write(empty, JSON, 2, str(tmp_path))).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x \t" * 300_000 + " " * 1_500_000, "漢字" * 400_000, "Qx9z" * 200_000, "word. " * 300_000, "a\u2003" * 100_000 + "\u2003" * 700_000 + "é"])
def test_very_long_texts(model, library, text):
    encoder = token_files.Encoder.of(JSON)
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    ids = bpe_codec.encode_text(text, RANKS, P.PATTERN)
    assert model.decode_bytes(ids) == text.encode()
    assert ids == library.encode(text, add_special_tokens=False).ids  # the same vocabulary and split


def test_rows_of_one_id_stand_in_one_order(spark, tmp_path):
    rows = [(1, t) for t in ("one", "two words", "three more words", None, "")] * 3 + [(2, "<|endoftext|>")]
    starts = []
    for n in (1, 3, 5):
        manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), JSON, 2, str(tmp_path / str(n)))
        starts.append(sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_back(manifest).collect()))
    assert starts[0] == starts[1] == starts[2]
    assert [r[3] for r in starts[0] if r[0] == 2] == [zlib.crc32(np.array([50256, 2], "<u4").tobytes())]
