"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.shared import discard, parts, passing, scratch_path, shared_dir, stored

__all__ = ["SPACE_CLASS", "discard", "free_name", "numbered", "parts", "passing", "scratch_path", "shared_dir", "slices", "stored", "stored_at", "texts"]

#: Code points that part words in the contracts that speak of white space.
SPACE_CLASS = r"\x20\x09-\x0D"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)`` of any table; all other columns, whatever their names, stay out."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for a table that goes before the end."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, wanted: str) -> str:
    """A name like ``wanted`` that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once, so that every later read sees the same numbers; and the number's name.

    The table is bucketed by the number: texts are dealt out here once, and what is later asked for by number is brought to them, not they to it.
    """
    spark, row = docs.sparkSession, free_name(docs, "row")
    path, name = scratch_path(spark, "numbered"), f"corpusloom_numbered_{uuid.uuid4().hex}"
    n = parts(spark)
    dealt = docs.withColumn(row, F.monotonically_increasing_id()).repartition(n, row)
    dealt.write.option("compression", "zstd").option("path", path).bucketBy(n, row).sortBy(row).saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name), row


def _forget(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the cluster may be gone by then
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes of a column of strings or bytes, or of one row if that is longer, for what is made Python objects at once."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
