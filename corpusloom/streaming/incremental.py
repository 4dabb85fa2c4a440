"""Incremental collection over a stream of files: each micro-batch is compared with the cache and the cache follows."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.incremental import CACHE_SCHEMA, changes, file_hash, updated
from corpusloom.sources.writers import write_text

#: Versions that are read together before they are written as one.
MANY = 16


def _written(folder: str | Path) -> list[str]:
    """What the cache consists of, oldest first: a whole state, then what was seen after it."""
    pointer = Path(folder, "CURRENT")
    return json.loads(pointer.read_text()) if pointer.is_file() else []


def load_cache(spark, folder: str | Path) -> DataFrame:
    """The newest state of the cache; an empty one at first."""
    names = _written(folder)
    if not names:
        return spark.createDataFrame([], CACHE_SCHEMA)
    read = [spark.read.schema(CACHE_SCHEMA).parquet(str(Path(folder, n))) for n in names]
    if len(read) == 1:
        return read[0]
    aged = reduce(DataFrame.unionByName, [df.withColumn("age", F.lit(i)) for i, df in enumerate(read)])
    newest = F.max_by(F.struct("mtime_ns", "size", "sha256"), "age").alias("f")
    return aged.groupBy("path").agg(newest).select("path", "f.mtime_ns", "f.size", "f.sha256")


def _write(rows: DataFrame, folder: str | Path, version: int, before: list[str]) -> None:
    """Written as a version of its own, then pointed to behind others; what nothing points to goes."""
    name = f"v{version}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(str(Path(folder, name)))
    write_text(Path(folder, "CURRENT"), json.dumps([*before, name]))
    for old in Path(folder).glob("v*-*"):
        if old.name not in (*before, name):
            shutil.rmtree(old, ignore_errors=True)


def save_cache(cache: DataFrame, folder: str | Path, version: int) -> None:
    """A whole state, in place of all before it."""
    _write(cache, folder, version, [])


def append_cache(seen: DataFrame, folder: str | Path, version: int) -> None:
    """What was seen since, each path once; every ``MANY`` times all is written together, so that a batch costs what it holds."""
    names = _written(folder)
    if len(names) < MANY:
        _write(seen, folder, version, names)
    else:
        _write(updated(seen, load_cache(seen.sparkSession, folder)), folder, version, [])


def follow(stream: DataFrame, folder: str | Path, checkpoint: str | Path, on_changes: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """``stream`` has path, size, mtime_ns and content; ``on_changes`` gets ``(path, state)`` of new and changed files of each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        newest = F.max_by(F.struct("size", "mtime_ns", "content"), "mtime_ns")
        seen = rows.groupBy("path").agg(newest.alias("f")).select("path", "f.size", "f.mtime_ns", file_hash(F.col("f.content"), F.col("f.size")).alias("sha256"))
        cache = load_cache(rows.sparkSession, folder)
        on_changes(changes(seen, cache).where("state in ('new', 'changed')"), number)
        append_cache(seen.select("path", "mtime_ns", "size", "sha256"), folder, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(checkpoint)).trigger(**trigger).start()
