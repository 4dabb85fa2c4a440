"""Parts written by the executors: all or none."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import part_files, writers

ROW = "part bigint, header string, entries array<struct<path:string,n:bigint>>, content string"


def rows(spark, n):
    return spark.range(1, n + 1, numPartitions=3).select(
        F.col("id").alias("part"), F.lit(None).cast("string").alias("header"), F.expr("array(named_struct('path', concat('a/f', id), 'n', 1L), named_struct('path', 'b/long', 'n', 2L))").alias("entries"), F.concat(F.lit("body "), F.col("id")).alias("content")
    )


def test_names_contents_and_merge(spark, tmp_path):
    assert part_files.write(rows(spark, 11), 11, tmp_path, "chat", "# {project_name} {part}/{total}\n", "P") == [f"chat_{i}.md" for i in range(1, 12)]
    assert (tmp_path / "chat_11.md").read_text() == "# P 11/11\n\nPart 11 of 11. Files in this part:\n\n  f11\n  long [split across 2 parts]\n\nbody 11"
    assert writers.load_manifest(tmp_path) == [f"chat_{i}.md" for i in range(1, 12)]
    assert part_files.write(rows(spark, 2), 2, tmp_path, "chat", "", "P", merge=True) == ["chat_12.md", "chat_13.md"]
    assert "Part 13 of 13" in (tmp_path / "chat_13.md").read_text() and (tmp_path / "chat_1.md").is_file()
    assert part_files.write(rows(spark, 1), 1, tmp_path, "chat", "", "P") == ["chat_1.md"]
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([writers.MANIFEST, writers.LOCK, "chat_1.md"])
    assert part_files.write(rows(spark, 0), 0, tmp_path, "chat", "", "P") == [] and not list(tmp_path.glob("*.md"))


def test_a_failing_task_leaves_all_as_it_was(spark, tmp_path):
    part_files.write(rows(spark, 3), 3, tmp_path, "chat", "", "P")
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    bad = rows(spark, 40).withColumn("content", F.when(F.col("part") == 33, F.expr("raise_error('no')")).otherwise(F.concat("content", F.lit(" new"))))
    with pytest.raises(Exception, match="no"):
        part_files.write(bad, 40, tmp_path, "chat", "", "P")
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before


def test_tasks_that_ran_twice_count_once(tmp_path):
    options = {"path": str(tmp_path), "job": "j1", "template": "chat", "title": "", "project": "P", "start": "1", "count": "1", "merge": "false"}
    from pyspark.sql import Row

    row = [Row(part=1, header="H\n", entries=[], content="x")]
    writer = part_files.PartsWriter(options)
    first, second = writer.write(iter(row)), writer.write(iter(row))
    assert first != second and len(list(tmp_path.glob(".chat_1*"))) == 2
    writer.commit([second, None])
    assert (tmp_path / "chat_1.md").read_text() == "H\nx" and json.loads((tmp_path / writers.MANIFEST).read_text()) == ["chat_1.md"] and not list(tmp_path.glob(".chat_1*"))

    def broken():
        yield row[0]
        raise ValueError

    with pytest.raises(ValueError):
        writer.write(broken())
    writer.abort([None])
    assert not list(tmp_path.glob(".chat_1*"))
