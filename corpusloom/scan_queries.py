"""Registered queries over listings of trees: what is opened and what isn't."""

from __future__ import annotations

import dataclasses
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import collect as C
from corpusloom.plans.api import Engine
from corpusloom.plans.profiles import Profile
from corpusloom.registry import PATH, docs, query_of
from corpusloom.sources import files
from corpusloom.tree_queries import PROFILE, TAKEN, tree

_WALKED = f"SELECT {PATH} AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE source NOT IN ('src3', 'src4') AND lang IN ('en', 'de')"


@query_of("listing_pruned", f"SELECT path, size, 0 AS dir_no, CASE WHEN ends_with(path, '.en') THEN 0 ELSE 1 END AS pattern_no FROM ({_WALKED})")
def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders below which all is excluded are not opened; listed by the executors, a few names at a time."""
    found = files.listing(spark, tree(spark, sf_dir), ["."], ["*.en", "*.de"], exclude=["src3/*", "*rc4/*"], driver_names=5, task_names=20)
    return found.select("path", "size", "dir_no", "pattern_no")


@query_of("source_filtered", f"SELECT path, sha256(text) AS sha256 FROM (SELECT {PATH} AS path, text FROM documents WHERE source IN ('src1', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19') AND octet_length(encode(text)) > 2000)")
def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters reach the source where the session lets them; else Spark applies them."""
    rows = files.load(spark, tree(spark, sf_dir), patterns=["*.en", "*.de", "*.fr", "*.es"])
    return rows.where(F.col("path").startswith("src1") & (F.col("size") > 2000)).select("path", F.sha2("content", 256).alias("sha256"))


@query_of("incremental_tree", f"SELECT path, 'changed' AS state FROM ({TAKEN}) WHERE doc_id % 100 = 8 UNION ALL SELECT 'src9/new_' || doc_id || '.en', 'new' FROM documents WHERE doc_id % 100 = 9")
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second collection: one file in a hundred has changed, others are new, some are as they were but with a new time; only these are opened."""
    from corpusloom.operators.incremental import changes
    from corpusloom.streaming.incremental import load_cache

    engine = Engine(spark, tree(spark, sf_dir))
    engine.collect(PROFILE, incremental=True)
    cache = load_cache(spark, engine.root / ".corpusloom" / "cache")
    tree(spark, sf_dir, "concat(text, ' more')", where="doc_id % 100 = 8", root=engine.root)
    tree(spark, sf_dir, where="doc_id % 100 = 10", root=engine.root)
    tree(spark, sf_dir, "concat('fresh ', text)", "concat('src9/new_', doc_id, '.en')", "doc_id % 100 = 9", engine.root)
    return changes(engine.due(PROFILE, cache), cache).where("state in ('new', 'changed')")


_ODD = "CASE doc_id % 6 WHEN 0 THEN concat(source, '/doc_', doc_id, '.en') WHEN 1 THEN concat(source, '/large_', doc_id, '.en') WHEN 2 THEN concat(source, '/nul_', doc_id, '.xyz') WHEN 3 THEN concat(source, '/bad_', doc_id, '.en') WHEN 4 THEN concat(source, '/out_', doc_id, '.tmp') ELSE concat(source, '/big_', doc_id, '.xyz') END"


@query_of(
    "files_left_out",
    f"SELECT path, CASE k WHEN 1 THEN 'too large' WHEN 2 THEN 'binary' WHEN 3 THEN 'no text' ELSE 'binary too large' END AS reason FROM (SELECT {_ODD} AS path, doc_id % 6 AS k FROM documents) WHERE k IN (1, 2, 3, 5)",
)
def _left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reason for which a file isn't collected: over the profile's size, a NUL, bytes that are no text, a binary over its own size; excluded files aren't told."""
    root = tree(spark, sf_dir, "CASE doc_id % 6 WHEN 1 THEN repeat('x', 50000) WHEN 2 THEN concat('a', chr(0)) WHEN 5 THEN repeat('y', 25000) ELSE 'some text' END", _ODD)

    def spoil(rows) -> None:
        for r in rows:
            with open(os.path.join(root, r.path), "ab") as f:
                f.write(b"\xff\xfe")

    docs(spark, sf_dir).where("doc_id % 6 = 3").select(F.expr(_ODD).alias("path")).foreachPartition(spoil)
    profile = Profile(directories=(".",), patterns=("*.en", "*.xyz", "*.tmp"), exclude_patterns=("*.tmp",), use_gitignore=False, max_file_mb=0.04, binary_max_mb=0.02)
    return C.left_out(C.scanned(spark, Path(root), profile), profile)


query_of("collect_explicit", f"SELECT {PATH} AS path, greatest(1, length(concat('### ', {PATH}, chr(10), chr(10), '```', chr(10), text, chr(10), '```')) // 4) AS tokens FROM documents WHERE lang = 'en' AND source = 'src2' OR {PATH} IN ('src5/doc_5.en', 'src6/doc_6.en', 'src5/doc_5.de', 'src6/doc_6.de')")(
    lambda s, d: Engine(s, tree(s, d)).collect(dataclasses.replace(PROFILE, directories=("src2",), patterns=("*.en",), exclude_patterns=(), use_gitignore=False, files=("src5/doc_5.en", "src6/doc_6.en", "src5/doc_5.de", "src6/doc_6.de", "gone.en"))).sections.select("path", "tokens")
)
