"""Changes of a file tree against a cache of path, size, time and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_NS = 1_000_000
MAX_HASHED = 10 * 1024 * 1024
CACHE_SCHEMA = "path string, mtime_ns bigint, size bigint, sha256 string"


def file_hash(content: Column, size: Column, limit: int = MAX_HASHED) -> Column:
    return F.when(size <= limit, F.sha2(content, 256))


def same_stat(size: Column, mtime_ns: Column, cached_size: Column, cached_mtime_ns: Column) -> Column:
    return F.coalesce((size == cached_size) & (F.abs(mtime_ns - cached_mtime_ns) < TOLERANCE_NS), F.lit(False))


def stat_changes(current: DataFrame, cache: DataFrame) -> DataFrame:
    """``(path, state)`` by size and time alone: new, deleted, same, or unsure (to be settled by hash). No content is read."""
    a, b = current.select("path", "size", "mtime_ns"), cache.select("path", F.col("size").alias("c_size"), F.col("mtime_ns").alias("c_mtime"), F.lit(True).alias("cached"))
    joined = a.withColumn("there", F.lit(True)).join(b, "path", "full_outer")
    state = F.when(F.col("cached").isNull(), "new").when(F.col("there").isNull(), "deleted").when(same_stat(F.col("size"), F.col("mtime_ns"), F.col("c_size"), F.col("c_mtime")), "same").otherwise("unsure")
    return joined.select("path", state.alias("state"))


def changes(current: DataFrame, cache: DataFrame) -> DataFrame:
    """``(path, state)``: new, changed, unchanged or deleted. ``current`` has sha256, null where a file is too large to be hashed."""
    hashes = current.select("path", "sha256").join(cache.select("path", F.col("sha256").alias("c_sha")), "path", "left")
    settled = hashes.select("path", F.coalesce(F.col("sha256") == F.col("c_sha"), F.lit(False)).alias("equal"))
    found = stat_changes(current, cache).join(settled, "path", "left")
    unsure = F.when(F.col("equal"), "unchanged").otherwise("changed")
    return found.select("path", F.when(F.col("state") == "same", "unchanged").when(F.col("state") == "unsure", unsure).otherwise(F.col("state")).alias("state"))


def updated(current: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache with the rows of ``current`` in place of its own; entries of files not seen stay."""
    fields = ["path", "mtime_ns", "size", "sha256"]
    return cache.select(fields).join(current.select("path"), "path", "left_anti").unionByName(current.select(fields))
