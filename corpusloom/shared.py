"""The shared folder and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


_KNOWN: set[str] = set()
#: Paths of the tables that go when what is being made of them is done, innermost last.
_PASSING: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (tests, notebooks in local mode) a temporary folder stands in for it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get().rpartition("/")[0]
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. Results that read them have to be written before."""
    jvm, path = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    jvm.org.apache.hadoop.fs.FileSystem.get(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the cluster may be gone by then
        clean_up(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is there goes when the application ends, or by ``clean_up``."""
    app = spark.sparkContext.applicationId
    if app not in _KNOWN:
        _KNOWN.add(app)
        atexit.register(_clean_at_exit, spark)
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _PASSING:
        _PASSING[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more: what was made of it is written."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileSystem.get(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is stored within goes at the end, but for what is stored by the function that this gives."""
    _PASSING.append([])

    def kept(df: DataFrame, name: str) -> DataFrame:
        own = _PASSING.pop()
        try:
            return stored(df, name)
        finally:
            _PASSING.append(own)

    try:
        yield kept
    finally:
        for path in _PASSING.pop():
            discard(spark, path)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session is set."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
