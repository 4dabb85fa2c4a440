"""Source trees as tables: names and sizes first, contents for what is wanted of them; Spark's own sources leave out dot files, underscore files and empty ones.

``listing`` gives names without opening a file. A small tree is listed where the plan is made; of a larger one the folders that are left are a table, which executors
open level by level, each task up to a number of names, until no folder is left: the driver never holds more than that number of names. ``contents`` reads the files of any table of
paths on the executors. ``scan`` is both. The data source ``corpus`` gives the same rows to ``spark.read``, with filters on path, size and time met before a file is opened.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from corpusloom.shared import parts, stored
from corpusloom.sources.walk import Folder, Found, Walk, inside

__all__ = ["MAX_FILE_BYTES", "contents", "in_order", "inside", "listing", "scan"]

LISTED = "path string, size bigint, mtime_ns bigint, dir_no int, pattern_no int, error string"
SCHEMA = "path string, size bigint, mtime_ns bigint, content binary, dir_no int, pattern_no int, error string"
#: Largest file that is read; names that the driver sees at most, and a task in one round; names and bytes of files that are rows at once; folders of a level from which on they are dealt out as partitions.
MAX_FILE_BYTES, DRIVER_NAMES, TASK_NAMES, ROWS, BATCH_BYTES, WIDE = 100 * 1024 * 1024, 20_000, 100_000, 8192, 1 << 23, 256
_KINDS = {"path": pa.string(), "size": pa.int64(), "mtime_ns": pa.int64(), "content": pa.binary(), "dir_no": pa.int32(), "pattern_no": pa.int32(), "error": pa.string()}


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[n]) for i, n in enumerate(names)], list(names))


def listing(spark: SparkSession, root: str | Path, directories: list[str] = (".",), patterns: list[str] = ("*",), files: list[str] = (), exclude: list[str] = (), keep_all: bool = False, max_file_bytes: int = MAX_FILE_BYTES, driver_names: int = DRIVER_NAMES, task_names: int = TASK_NAMES) -> DataFrame:
    """``(path, size, mtime_ns, dir_no, pattern_no, error)`` of the files of a tree, each once, in their first place of order. No file is opened, and no folder below which all is excluded."""
    walk = Walk(str(root), tuple(directories), tuple(patterns), tuple(files), tuple(exclude), keep_all, max_file_bytes)
    found, left = walk.some(walk.start(), driver_names)
    out = spark.createDataFrame(pa.Table.from_batches([_batch([*walk.named(), *found], Found._fields)]))
    while left:
        if not isinstance(left, DataFrame):
            left = spark.createDataFrame(left, "dir_no int, path string")
        level = stored(left.repartition(parts(spark)).mapInArrow(_opening(walk, task_names), f"{LISTED}, folder boolean"), "listing")
        out = out.unionByName(level.where("not folder").drop("folder"))
        left = level.where("folder").select("dir_no", "path")
        if left.isEmpty():
            break
    return out


def _opening(walk: Walk, budget: int):
    names = Found._fields

    def told(rows: list[Found | Folder]) -> pa.RecordBatch:
        as_file = [x if isinstance(x, Found) else Found(x.path, None, None, x.dir_no, 0, None) for x in rows]
        return _batch(as_file, names).append_column("folder", pa.array([isinstance(x, Folder) for x in rows], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = walk.below(map(Folder, batch.column("dir_no").to_pylist(), batch.column("path").to_pylist()), budget)
            while rows := list(itertools.islice(below, ROWS)):
                yield told(rows)

    return run


def contents(rows: DataFrame, root: str | Path, balanced: bool = True) -> DataFrame:
    """``rows`` of paths with the bytes of their files as ``content``, null where ``error`` tells why. ``balanced`` deals the paths out evenly before."""
    top, columns = Path(root), [c for c in rows.columns if c not in ("content", "error")]

    def read(path: str, error: str | None) -> tuple[bytes | None, str | None]:
        if error is not None:
            return None, error
        try:
            full = top / path
            if full.is_symlink() or not inside(full, top):
                raise PermissionError("outside of the root")
            return full.read_bytes(), None
        except OSError as e:
            return None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, errors = batch.column("path").to_pylist(), batch.column("error").to_pylist()
            begin, held, size = 0, [], 0
            for i, (path, error) in enumerate(zip(paths, errors, strict=True), 1):
                held.append(read(path, error))
                size += len(held[-1][0] or b"")
                if size >= BATCH_BYTES or i == len(paths):
                    part = batch.slice(begin, i - begin)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array([x for x, _ in held], pa.binary()), pa.array([e for _, e in held], pa.string())], [*columns, "content", "error"])
                    begin, held, size = i, [], 0

    kinds = dict(rows.dtypes)
    wanted = rows.withColumn("error", F.col("error") if "error" in rows.columns else F.lit(None).cast("string")).select(*columns, "error")
    dealt = wanted.repartition(parts(rows.sparkSession)) if balanced else wanted
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "content binary", "error string"]))


def scan(spark: SparkSession, root: str | Path, directories: list[str] = (".",), patterns: list[str] = ("*",), files: list[str] = (), content: bool = True, keep_all: bool = False, max_file_bytes: int = MAX_FILE_BYTES, exclude: list[str] = (), **how) -> DataFrame:
    """The files of a tree, each once, in their first place of order; ``keep_all`` keeps one row for each pattern that matches."""
    found = listing(spark, root, directories, patterns, files, exclude, keep_all, max_file_bytes, **how)
    rows = contents(found, root) if content else found.withColumn("content", F.lit(None).cast("binary"))
    return rows.select(*_KINDS)


def in_order() -> list:
    """What to order files by: directory, pattern, then path by its components."""
    return [F.col("dir_no"), F.col("pattern_no"), F.split("path", "/")]


# The data source


class Folders(InputPartition):
    """Folders with all below them, folders by themselves, or the files that are named one by one."""

    def __init__(self, deep: list[Folder] = (), alone: list[Folder] = (), named: bool = False):
        self.deep, self.alone, self.named = list(deep), list(alone), named


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        listed = lambda name, default: tuple(json.loads(options.get(name, default)))
        self.walk = Walk(
            options["path"], listed("directories", '["."]'), listed("patterns", '["*"]'), listed("files", "[]"), listed("exclude", "[]"),
            options.get("keepAll", "false").lower() == "true", int(options.get("maxFileBytes", MAX_FILE_BYTES)),
        )
        self.with_content = options.get("includeContent", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []
        self.prefix = ""

    def partitions(self) -> list[InputPartition]:
        """Levels are opened until one is wide enough; its folders are walked by the executors."""
        level, above = self.walk.start(), []
        while 0 < len(level) < WIDE and len(above) < WIDE:
            above += level
            level = [x for f in level for x in self.walk.opened(f) if isinstance(x, Folder)]
        several = [Folders(level[i::WIDE]) for i in range(min(WIDE, len(level)))] + [Folders(alone=above[i::WIDE]) for i in range(min(WIDE, len(above)))]
        return [Folders(named=True), *several]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for f in self._found(partition):
            if not self.passes(f):
                continue
            content, error = None, f.error
            if self.with_content and error is None:
                try:
                    content = Path(self.walk.root, f.path).read_bytes()
                except OSError as e:
                    error = type(e).__name__
            yield f.path, f.size, f.mtime_ns, content, f.dir_no, f.pattern_no, error

    def _found(self, partition: Folders) -> Iterator[Found]:
        if partition.named:
            yield from self.walk.named()
        for folder in partition.alone:
            yield from (x for x in self.walk.opened(folder) if isinstance(x, Found))
        due = list(partition.deep)
        while due:
            for x in self.walk.opened(due.pop()):
                if isinstance(x, Found):
                    yield x
                elif x.path.startswith(self.prefix) or self.prefix.startswith(f"{x.path}/"):
                    due.append(x)

    def passes(self, f: Found) -> bool:
        return all((x := getattr(f, column)) is not None and _TESTS[test](x, value) for column, test, value in self.tests)


_TESTS = {
    "EqualTo": lambda x, v: x == v, "In": lambda x, v: x in v, "GreaterThan": lambda x, v: x > v, "GreaterThanOrEqual": lambda x, v: x >= v,
    "LessThan": lambda x, v: x < v, "LessThanOrEqual": lambda x, v: x <= v, "StringStartsWith": lambda x, v: x.startswith(v),
}
_NUMBERS, _STRINGS = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual), (EqualTo, In, StringStartsWith)


class FilteringReader(CorpusReader):
    """Takes over filters on path, size, time and places: a file that they drop is not opened, a folder that no wanted path can lie in neither."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, _STRINGS if column == "path" else _NUMBERS if column in ("size", "mtime_ns", "dir_no", "pattern_no") else ()):
                value = f.value
                self.tests.append((column, type(f).__name__, value))
                if isinstance(f, StringStartsWith) or column == "path" and isinstance(f, EqualTo):
                    self.prefix = max(self.prefix, value, key=len)
            else:
                yield f


class CorpusSource(DataSource):
    """Options: path; directories, patterns, files and exclude (JSON lists); includeContent; maxFileBytes; keepAll."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)


class FilteredCorpusSource(CorpusSource):
    def reader(self, schema) -> CorpusReader:
        return FilteringReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("corpus")`` known; filters are taken over where the session lets Python sources do that."""
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    spark.dataSource.register(FilteredCorpusSource if pushed else CorpusSource)


def load(spark: SparkSession, root: str | Path, **options) -> DataFrame:
    """The data source with options; lists become JSON."""
    register(spark)
    return spark.read.format("corpus").options(**{k: json.dumps(list(v)) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items()}).load(os.fspath(root))
