"""The pipeline's stages on each other's tables."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from corpusloom.llm import queries


def test_stages(spark, docs, rows, tmp_path, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near-dedup by shingle similarity", "suffix-array dedup", "source mix", "byte-level bpe"]
    current, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        current = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(current.count())
    assert counts[0] <= len(rows) and counts[1] <= counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    mixed = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    for r in current.collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256((mixed[r.doc_id] or "").encode()).hexdigest()


def test_run(spark, data):
    found = corpus_pipeline.run(spark, data)
    assert found.count() > 0 and found.where("n_tokens is null").count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def compared(spark, folder, name):
    import duckdb
    from pathlib import Path

    connection = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    want = connection.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, folder).select(want.columns)
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    got, want = compared(spark, data, name)
    assert got == want


@pytest.mark.parametrize("name", ["op7_source_mix", "op8_quality_cascade", "op11_fill_middle", "op12_media_sniff", "op13_source_divergence"])
def test_against_sql_on_odd_rows(spark, docs, tmp_path, name):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got, want = compared(spark, str(tmp_path), name)
    assert got == want


def test_stages_of_nothing(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    current = empty
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        current = stage(spark, current, str(tmp_path))
        assert current.count() == 0 and (i == 4 or current.columns == empty.columns)
