"""Fixity audit of web archives by Merkle trees.

Pages become WARC records; records in order of their id, some to a file, have byte ranges in it. A replica's tree has the
SHA-256 of each record for leaves; a node hashes its up to ``FAN`` children with the offset ranges that they stand for,
first over the records of a file, then over files, up to one root. To audit, the replicas' roots are compared, and only the
children of nodes that differ are looked at, level by level, down to the records that differ.

Each level is one aggregation over groups of at most ``FAN`` rows and has a ``FAN``-th of the rows of the level below;
levels are written to the shared folder as they are made. Only the heights of the trees reach the driver.

Defined results: a null url or html counts as empty; pages with a null id get files of their own, dealt out by content;
repeated rows are records each for itself, in order of content; an empty table has no records; further columns are left
out. A record that the replica lacks is damaged; those behind it, moved but whole, are not: what the trees find is matched by id and digest within its file.
If one replica is empty, all records of the other are damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import parts, stored

#: Ids that share a file; children of a node.
IDS_PER_FILE, FAN = 1024, 16
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC resource record."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {_DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    ]
    return F.concat(*head)


def leaves(pages: DataFrame, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """``(page_id, file, deal, at, offset, length, digest)``: one row for each record; ``at`` counts a file's records from 0."""
    n = parts(pages.sparkSession)
    text = record(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("length"), F.xxhash64("url", "html").alias("__content"))
    in_file = made.select(
        "page_id",
        F.coalesce(F.floor(F.col("page_id") / ids_per_file), F.lit(-1)).cast("long").alias("file"),
        F.when(F.col("page_id").isNull(), F.pmod("__content", F.lit(n))).otherwise(0).cast("long").alias("deal"),
        "digest",
        "length",
    )
    order = Window.partitionBy("file", "deal").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return in_file.select("page_id", "file", "deal", (F.row_number().over(order) - 1).cast("long").alias("at"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def _parents(nodes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The level above nodes ``(keys, at, low, high, digest)``."""
    child = F.struct(at, "low", "high", "digest")
    hashed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["low"], c["high"], c["digest"])), "\n").cast("binary"), 256)
    return nodes.groupBy(*keys, F.floor(F.col(at) / FAN).cast("long").alias(at)).agg(F.min("low").alias("low"), F.max("high").alias("high"), hashed.alias("digest"))


class Tree:
    """A replica's levels: ``records`` from the leaves to one root a file, ``files`` from those to the root."""

    def __init__(self, leaf_rows: DataFrame, records_high: int, files_high: int, name: str):
        level = leaf_rows.select("file", "deal", "at", F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"), "digest")
        self.records, self.files = [level], []
        for _ in range(records_high):
            level = stored(_parents(level, ["file", "deal"], "at"), f"{name}-records")
            self.records.append(level)
        level = level.select("deal", F.col("file").alias("at"), F.lit(0).cast("long").alias("low"), "high", "digest")
        self.files.append(level)
        for _ in range(files_high):
            level = stored(_parents(level, ["deal"], "at"), f"{name}-files")
            self.files.append(level)


def _height(most: int | None) -> int:
    """Levels until one node is left of the places 0 to ``most``."""
    levels, n = 0, (most or 0) + 1
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, F.col("digest").alias("one")).join(b.select(*keys, F.col("digest").alias("other")), keys, "full_outer").where(~F.col("one").eqNullSafe(F.col("other"))).select(*keys)


def _below(nodes: DataFrame, bad: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The children of differing nodes."""
    return nodes.withColumn("__up", F.floor(F.col(at) / FAN).cast("long")).join(bad.withColumnRenamed(at, "__up"), [*keys, "__up"], "left_semi").drop("__up")


def damaged(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(file, deal, at)`` of the records that differ between the leaves of two replicas."""
    tops = a.select("at", "file").union(b.select("at", "file")).agg(F.max("at").alias("at"), F.max("file").alias("file")).first()
    records_high, files_high = _height(tops.at), _height(tops.file)
    one, other = Tree(a, records_high, files_high, "one"), Tree(b, records_high, files_high, "other")
    bad = _differing(one.files[-1], other.files[-1], ["deal", "at"])
    for level in range(files_high - 1, -1, -1):
        bad = stored(_differing(_below(one.files[level], bad, ["deal"], "at"), _below(other.files[level], bad, ["deal"], "at"), ["deal", "at"]), "bad-files")
    bad = bad.withColumnRenamed("at", "file").withColumn("at", F.lit(0).cast("long"))
    keys = ["file", "deal"]
    for level in range(records_high - 1, -1, -1):
        bad = stored(_differing(_below(one.records[level], bad, keys, "at"), _below(other.records[level], bad, keys, "at"), [*keys, "at"]), "bad-records")
    return bad.select("file", "deal", "at")


def audit(pages: DataFrame, replica: DataFrame, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """``(page_id, file, deal, at, offset, length, digest, intact)`` of every record of ``pages``; intact where the replica has it whole in its file."""
    a, b = stored(leaves(pages, ids_per_file), "leaves"), stored(leaves(replica, ids_per_file), "replica-leaves")
    place = ["file", "deal", "at"]
    bad = stored(damaged(a, b), "differing")
    nth = F.row_number().over(Window.partitionBy("file", "deal", "digest").orderBy("at")).alias("nth")  # a digest tells the id
    one, other = (side.join(bad, place, "left_semi").select(*place, "digest", nth) for side in (a, b))
    lost = one.join(other.select("file", "deal", "digest", "nth"), ["file", "deal", "digest", "nth"], "left_anti").select(*place, F.lit(True).alias("lost"))
    return a.join(lost, place, "left").select("page_id", "file", "deal", "at", "offset", "length", "digest", F.col("lost").isNull().alias("intact"))
