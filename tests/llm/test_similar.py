"""Near-duplicates by shingle similarity against brute force."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corpusloom.llm import components, shingle_links, simhash_ball


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_ids(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for (i, _), g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append(i)
    return sorted(str(min((i for i in ids if i is not None), default=None)) for ids in groups.values())


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def planted():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for length in (30, 100, 150, 400, 1000):
        for share in (0.01, 0.02, 0.03, 0.04, 0.05):
            base = [rng.choice(words) for _ in range(length)]
            rows += [" ".join(base), *(edited(rng, base, share) for _ in range(2))]
    crowd = [rng.choice(words) for _ in range(200)]
    rows += [edited(rng, crowd, rng.choice([0.005, 0.01, 0.03])) for _ in range(60)]
    rows += ["same few words here always " * 3 + " ".join(rng.choices(words, k=20)) for _ in range(40)]
    return list(enumerate(rows))


@pytest.mark.parametrize("large", [2, 16])
def test_planted_copies(spark, tmp_path, large):
    rows = planted()
    path = str(tmp_path / "planted")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs, want = spark.read.parquet(path), kept_ids(rows)
    assert sorted(str(r.doc_id) for r in shingle_links.survivors(docs, large=large).collect()) == want
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_stage(spark, docs, rows):
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == kept_ids([r[:2] for r in rows])


def test_nothing(empty):
    assert shingle_links.survivors(empty).count() == 0


def test_fingerprints_link_first(spark, tmp_path, monkeypatch):
    """The stage gets links from SimHash balls over five-word shingles, of which the verified ones hold, and no false one."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(1500)]
    rows = [(i, edited(rng, base, 0.001) if i else " ".join(base)) for i in range(12)] + [(100 + i, " ".join(rng.choices(words, k=300))) for i in range(6)]
    path = str(tmp_path / "linked")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    found = simhash_ball.candidates(docs, "doc_id", width=5).collect()
    assert {r.v for r in found} == set(range(1, 12)) and {r.u for r in found} == {0}
    asked = []
    monkeypatch.setattr(shingle_links, "candidates", lambda rows, row, **how: asked.append(how) or simhash_ball.candidates(rows, row, **how))
    monkeypatch.setattr(shingle_links, "_met", lambda large: lambda batches: (b.schema.empty_table().to_batches()[0] for b in ()))  # shingles find nothing
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, *range(100, 106)]
    assert asked == [{"width": 5}]


def test_components_in_one_step_and_in_several(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    table = spark.createDataFrame(edges, "u long, v long").repartition(3)
    once, steps = (sorted(map(tuple, components.components(table, few).collect())) for few in (1 << 20, 0))
    assert once == steps and (1040, 1000) in once
    assert components.components(table.where("u > 5000")).count() == 0
