"""Every registered query of the engine against its SQL in DuckDB, or at least with rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from corpusloom import queries as Q


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, data, name):
    found = Q.QUERIES[name](spark, data)
    got = sorted_rows(found.columns, found.collect())
    if name in Q.ORACLES:
        want = duck.sql(Q.ORACLES[name])
        assert got == sorted_rows(want.columns, want.fetchall())
    else:
        assert got[1]


def test_flagship_parts_sections_that_rounding_would_join(spark, tmp_path):
    """Lengths at which the tokens of heading and body sum up to the limit, and those of the whole section don't."""
    rows = [(i, ("word and line\n" * 700)[: 7959 + i] + "x", "en", f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found, want = Q.flagship(spark, str(tmp_path)), connection.sql(Q.ORACLES["collect_flagship"])
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(want.columns, want.fetchall())
