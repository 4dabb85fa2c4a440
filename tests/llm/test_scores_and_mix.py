"""The quality model, the mix, the search and the archive audit."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.queries import OP7_SQL
from corpusloom.llm import bm25_wand, quality_qda, source_mix, warc_fixity


def test_held_out_accuracy(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet").cache() for n in ("documents", "labels"))
    scored = quality_qda.quality_scores(docs, labels).join(labels, "doc_id").withColumn("held", quality_qda.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in scored if r.held} == {r.doc_id for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    right = [(r.score >= quality_qda.KEEP_AT) == bool(r.quality) for r in scored if r.held]
    assert sum(right) / len(right) > 0.9 and all(0 <= r.score <= 1 for r in scored)


def test_density_is_the_textbook_one():
    rng = np.random.default_rng(0)
    p = len(quality_qda.FEATURES)
    x = {c: rng.normal(c, 1 + c, (200, p)) for c in (0, 1)}
    sums = {c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in x.items()}
    model = quality_qda.fit(sums, 0.0, 1e-9)
    probe = rng.normal(0.5, 1, (20, p))
    logs = []
    for c in (0, 1):
        cov, d = np.cov(x[c].T, bias=True), probe - x[c].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-4)


def test_quality_of_odd_tables(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_qda.quality_scores(docs, none).collect()] == [0.5] * len(rows)
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_qda.quality_scores(docs, odd).where("score between 0 and 1").count() == len(rows)
    assert quality_qda.quality_scores(empty, odd).count() == 0
    kept = quality_qda.keep_good(docs, odd, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def level(sizes, budget, weights=(5, 2, 1), most=2):
    """Cut off what is over, share it out again, until nothing is."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    full, total = set(), budget * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        target = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_} | {n: most * sizes[n] for n in full}
        over = {n for n in open_ if target[n] > most * sizes[n] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix(docs, rows):
    sizes, words = defaultdict(int), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, text, _, source, _ in rows:
        sizes[source] += words(text)
    target = level(sizes, 1.5)
    found = source_mix.mix(docs, keep=["source"]).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(r[0]), words(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in found:
        source = r.kept.source
        assert r.source_size == sizes[source] and math.isclose(r.target, target[source], rel_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[source] += r.taken
    largest = {s: max(words(r[1]) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    assert sorted(map(str, source_mix.mix(docs, keep=["source"]).collect())) == sorted(map(str, found))
    out = source_mix.emitted(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in found)


def test_mix_comes_near(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n), f"s{i % 5 if i % 3 else 0}") for i, n in enumerate(rng.integers(1, 300, 3000))]
    out = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["source"])
    for r in out.groupBy("kept.source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) / r.target < 0.01


@pytest.mark.parametrize("sizes", [[100] * 6, [100] * 3, [7, 7, 7, 30, 30, 30, 7], [50, 20, 10, 50, 20, 10], [0, 0, 5, 5]])
def test_equal_sources_share_the_whole_budget(spark, sizes):
    rows = [(i, "w " * n, f"s{i}") for i, n in enumerate(sizes)]
    found = {r.source: r.target for r in source_mix.targets(spark.createDataFrame([(r[2], n) for r, n in zip(rows, sizes, strict=True)], "source string, source_size long")).collect()}
    want = level({r[2]: n for r, n in zip(rows, sizes, strict=True)}, 1.5)
    assert all(math.isclose(found[s], want[s], abs_tol=1e-9) for s in want) and math.isclose(sum(found.values()), 1.5 * sum(sizes), abs_tol=1e-6)
    got, by_sql = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")), duckdb.connect()
    by_sql.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{s}')" for i, t, s in rows) + ") AS t(doc_id, text, source)")
    assert sorted((r.doc_id, round(r.target, 6), r.copies) for r in got.collect()) == sorted((r[0], round(r[3], 6), r[5]) for r in by_sql.sql(OP7_SQL).fetchall())


def test_mix_of_nothing(spark, empty):
    assert source_mix.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.copies) for r in source_mix.mix(blank).collect()] == [(0.0, 0)] * 2


def bm25(rows, query, k):
    bags = [Counter(re.findall(r"[^\W_]+", (r[1] or "").lower())) for r in rows]
    n, mean = len(rows), max(1.0, sum(sum(b.values()) for b in bags) / len(rows))
    df = Counter(t for b in bags for t in b)
    scored = []
    for row, bag in zip(rows, bags, strict=True):
        s = 0.0
        for t, q in sorted(Counter(re.findall(r"[^\W_]+", (query or "").lower())).items()):
            if t in bag:
                s += q * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
        if s > 0:
            scored.append((-round(s, 6), row[0] is None, row[0] or 0))
    return sorted(scored)[:k]


@pytest.mark.parametrize(("shard_docs", "query_block"), [(7, 3), (16384, 512)])
def test_search(docs, rows, shard_docs, query_block, monkeypatch):
    monkeypatch.setattr(bm25_wand, "BLOCK", 4)
    asked = [r for r in {r[0]: r for r in rows if r[0] is not None and r[0] % 5 == 0}.values()]
    queries = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text").dropDuplicates(["query_id"])
    got = defaultdict(list)
    for r in bm25_wand.search(docs, queries, 6, shard_docs=shard_docs, query_block=query_block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 6), r.doc_id is None, r.doc_id or 0))
    for row in asked:
        want = bm25(rows, row[1], 6)
        assert [x[0] for x in got[row[0]]] == pytest.approx([x[0] for x in want], abs=2e-6)
        edge = want[-1][0] if want else 0
        assert {x[1:] for x in got[row[0]] if x[0] < edge - 1e-5} == {x[1:] for x in want if x[0] < edge - 1e-5}


def shard_of(rows, mean, **how):
    writer = bm25_wand.ShardWriter()
    for i in range(0, len(rows), 7):
        writer.add([r[0] for r in rows[i : i + 7]], [r[1] for r in rows[i : i + 7]])
    return bm25_wand.Shard(*writer.tables(), mean, **how)


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    texts = [" ".join([f"{'ab'[i % 2]}{j}" for j in rng.integers(0, 12, 20)] + [f"w{i}"]) for i in range(4000)]
    mean = 21.0
    shard = shard_of(list(enumerate(texts)), mean, block=32)
    names = shard.names.to_pylist()
    asked = [Counter(t.split()) for t in texts[:64:2]]
    best = shard.best([(np.array([names.index(t) for t in sorted(q)]), np.array([float(q[t]) for t in sorted(q)])) for q in asked], 5)
    for q, found in zip(asked, best, strict=True):
        scores = [sum(n * Counter(t.split())[x] * 2.2 / (Counter(t.split())[x] + 1.2 * (0.25 + 0.75 * 21 / mean)) for x, n in sorted(q.items())) for t in texts]
        want = sorted((-round(x, 9), i) for i, x in enumerate(scores))[:5]
        assert [i for _, i, _ in found] == [i for _, i in want] and np.allclose([-x for x, _, _ in found], [x for x, _ in want])
    assert shard.read < 0.6 * shard.asked  # the other half's documents share no long list


def test_copies_and_ties_are_ranked_by_id():
    rows = [(9, "red fox"), (3, "red fox"), (None, "red fox"), (5, "blue fox"), (4, "fox red"), (3, "red fox")]
    shard = shard_of(rows, 2.0)
    names = shard.names.to_pylist()
    query = np.array([names.index("fox"), -1, names.index("red")]), np.array([1.0, 7.0, 2.0])
    assert [(i, at) for _, i, at in shard.best([query], 5)[0]] == [(3, 1), (3, 5), (4, 4), (9, 0), (None, 2)]
    assert [(i, at) for _, i, at in shard.best([query], 2)[0]] == [(3, 1), (3, 5)]


def test_search_of_nothing(spark, docs, empty):
    no_queries = docs.limit(0).select(F.col("doc_id").alias("query_id"), "text")
    assert bm25_wand.search(docs, no_queries).count() == 0
    assert bm25_wand.search(empty, docs.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


PAGES = "page_id long, url string, html string"


def test_audit(spark):
    pages = [(i, f"u{i}", "h" * (i % 50)) for i in range(5000)] + [(None, "n", "x"), (None, None, None), (3, "u3", "h" * 3)]
    bad = {0, 17, 1023, 1024, 4999}
    replica = [(i, u, h + "!" if i in bad else h) for i, u, h in pages if i != 2500]
    mixed = spark.createDataFrame(pages, PAGES).withColumn("digest", F.lit("d")).withColumn("file", F.lit("f"))
    found = warc_fixity.audit(mixed, spark.createDataFrame(replica, PAGES), 256).collect()
    assert len(found) == len(pages)
    wrong = {r.page_id for r in found if not r.intact}
    assert wrong == bad | {2500}  # those behind the lost one have moved and are whole
    at = defaultdict(int)
    for r in sorted(found, key=lambda r: (r.file, r.deal, r.at)):
        assert r.offset == at[r.file, r.deal]
        at[r.file, r.deal] += r.length


def test_sound_replica_and_none(spark):
    pages = spark.createDataFrame([(i, "u", "h") for i in range(40)], PAGES)
    assert warc_fixity.audit(pages, pages).where("not intact").count() == 0
    assert warc_fixity.audit(pages, pages.limit(0)).where("intact").count() == 0
    assert warc_fixity.audit(pages.limit(0), pages).count() == 0


def test_only_differing_branches_are_opened(spark):
    pages = spark.createDataFrame([(i, "u", "h") for i in range(600)], PAGES)
    rotten = pages.withColumn("html", F.when(F.col("page_id") == 300, "x").otherwise("h"))
    a, b = warc_fixity.leaves(pages, 1024), warc_fixity.leaves(rotten, 1024)
    top = warc_fixity.Tree(a, 3, 0, "t"), warc_fixity.Tree(b, 3, 0, "u")
    bad = warc_fixity._differing(top[0].records[2], top[1].records[2], ["file", "deal", "at"])
    assert [r.at for r in bad.collect()] == [300 // 256]
    assert warc_fixity._below(top[0].records[1], bad, ["file", "deal"], "at").count() == 16
