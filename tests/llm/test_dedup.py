"""SimHash groups and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import simhash_ball, suffix_dedup, suffix_runs
from corpusloom.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, ids, radius=3):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    out = []
    for i in range(len(prints)):
        own = [ids[j] for j in range(len(prints)) if root(j) == root(i) and ids[j] is not None]
        out.append(min(own) if own else None)
    return out


def test_groups(docs, rows):
    prints, ids = [fingerprint(r[1]) for r in rows], [r[0] for r in rows]
    want = sorted((str(i), p, str(c)) for i, p, c in zip(ids, prints, grouped(prints, ids), strict=True))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in simhash_ball.near_groups(docs).collect())
    assert got == want


def test_survivors(docs, rows):
    ids, prints = [r[0] for r in rows], [fingerprint(r[1]) for r in rows]
    kept = simhash_ball.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, set(grouped(prints, ids))))


def test_groups_of_nothing(empty):
    assert simhash_ball.near_groups(empty).count() == 0 and simhash_ball.survivors(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.sampled_from([2, 4096]))
def test_no_pair_is_missed(seed, n, large):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = np.unique(np.array([rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(n)], np.uint64))
    keys, values = [], []
    for number, (low, high) in enumerate(simhash_ball.BLOCKS):
        shown = ((1 << 64) - 1) & ~(((1 << high) - 1) & ~((1 << low) - 1))
        for flip in [0, *(1 << b for b in range(64) if shown >> b & 1)]:
            keys.append((fps & np.uint64(shown)) ^ np.uint64(flip ^ (number + 1) << low))
            values.append(fps)
    key, fp = np.concatenate(keys).view(np.int64), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    found = {tuple(sorted(p)) for u, v in simhash_ball.bucket_edges(key[order], fp[order], 3, large) for p in zip(u.tolist(), v.tolist(), strict=True) if p[0] != p[1]}
    assert found == {tuple(sorted((int(a), int(b)))) for a in fps for b in fps if a < b and bin(int(a ^ b)).count("1") <= 3}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(25)] + [(-5, -9), (-9, -7)]
    label = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and all(k in got for k in label if label[k] != k)


def removed(texts, width):
    counts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
        out.append(spans)
    return out


@pytest.mark.parametrize("hot_kinds", [4096, 1])
def test_passages(docs, rows, hot_kinds):
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for row, t, spans in zip(rows, texts, removed(texts, 200), strict=True):
        edges = [0, *(x for s in spans for x in s), len(t)]
        kept = b"".join(t[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
        want.append((str(row[0]), len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.dedup(docs, hot_kinds=hot_kinds)).collect())
    assert got == sorted(want)


def anchor_places(texts):
    found = set()
    for raw, ends, own, offsets in suffix_dedup._blocks(texts, 200):
        starts = np.concatenate(([0], ends[:-1]))
        for p in suffix_dedup.anchors(raw, ends, 200, 64)[0]:
            k = int(np.searchsorted(ends, p, side="right"))
            found.add((int(own[k]), int(p - starts[k] + offsets[k])))
    return found


def test_blocks_and_chunks_choose_the_same_anchors(monkeypatch):
    long = bytes(random.Random(2).choices(b"abcd ", k=3000))
    texts = [long, long[500:1500], b"x" * 100, b"y" * 700]
    once = anchor_places(texts)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    assert anchor_places(texts) == once and {k for k, _ in once} == {0, 1, 3}


def test_cleaned(docs, rows):
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for row, t, spans in zip(rows, texts, removed(texts, 200), strict=True):
        kept = "" if row[1] is not None else None
        at = 0
        for ch in row[1] or "":
            size = len(ch.encode())
            if not any(b <= at and at + size <= e for b, e in spans):
                kept += ch
            at += size
        want.append((str(row[0]), str(kept), None if kept is None else len(kept)))
    assert sorted((str(r.doc_id), str(r.text), r.n_chars) for r in out.collect()) == sorted(want, key=lambda x: (x[0], x[1]))


def test_passages_of_nothing(empty):
    assert suffix_dedup.dedup(empty).count() == 0 and suffix_dedup.cleaned(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_run_index(seed):
    rng = random.Random(seed)
    pool = [bytes(rng.choices(b"ab", k=rng.choice([30, 400, 900]))) for _ in range(3)] + [b"a" * 500]
    segments = [b"".join(rng.choice(pool)[rng.randint(0, 20) : rng.randint(25, 900)] for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 6))]
    assert [[list(s) for s in x] for x in suffix_runs.repeated_spans(segments, 200)] == [[list(s) for s in x] for x in removed(segments, 200)]
    index = suffix_runs.build(segments)
    body = b"".join(s + b"\xff" for s in segments)
    assert all(index.text(k) == body[p - n : p] for k, (p, n) in enumerate(zip(index.places.tolist(), index.counts.tolist(), strict=True)))
    if len(body) < 700:
        want = [max([0, *(next(k for k in range(len(body)) if body[i + k] != body[j + k] or body[i + k] == 255) for j in range(len(body)) if j != i)]) for i in range(len(body))]
        assert index.matching_statistics().tolist() == want


def test_few_runs_drive_the_marks():
    own = bytes(random.Random(1).choices(b"acgt", k=1000))
    index = suffix_runs.build([own] * 50)
    assert len(index.run_bytes) < index.size / 20
    statistics = index.matching_statistics()
    assert statistics[:1000].tolist() == list(range(1000, 0, -1))
    broken = index._replace(run_bytes=index.run_bytes, run_targets=index.run_targets[::-1].copy())
    assert broken.matching_statistics().tolist() != statistics.tolist()
