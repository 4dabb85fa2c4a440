"""Registered queries over trees of code samples and over the ways to collect, compare and keep: modes, profiles together, numbered parts, snapshots that change."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.code_queries import SAMPLES, _sql
from corpusloom.plans import collect as C
from corpusloom.plans.api import Engine
from corpusloom.plans.profiles import CONFIG, Profile
from corpusloom.registry import PATH, query_of
from corpusloom.shared import scratch_path
from corpusloom.sources import files, writers
from corpusloom.tree_queries import _STATES, LIMIT, PARTS, PROFILE, SECTION, TAKEN, _collected, history, tree

_ENDS = {"python": "py", "javascript": "js", "cpp": "cpp", "go": "go", "ruby": "rb", "elixir": "ex", "text": "txt"}
_NAME = f"concat('src/doc_', doc_id, '.', {_sql([_ENDS[x.lang] for x in SAMPLES])})"
_LANG = _sql([x.lang for x in SAMPLES])
CODE = Profile(directories=("src",), patterns=tuple(f"*.{x}" for x in _ENDS.values()), use_gitignore=False)


def _code_tree(spark: SparkSession, sf_dir: str, what: str = "text", root: Path | None = None) -> Path:
    """A file for each document, of its sample, or of what that becomes later."""
    return tree(spark, sf_dir, _spark([getattr(x, what) for x in SAMPLES]), _spark_name(), root=root)


def _spark(values: list[str]) -> str:
    """A document's sample in Spark's SQL."""
    quoted = [json.dumps(v, ensure_ascii=False).replace("'", "\\'") for v in values]
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN replace({v}, 'NNN', CAST(doc_id AS STRING))" for i, v in enumerate(quoted)) + " END"


def _spark_name() -> str:
    return f"concat('src/doc_', doc_id, '.', {_spark([_ENDS[x.lang] for x in SAMPLES])})"


def _shown(body: str) -> str:
    return f"concat('### ', path, chr(10), chr(10), '```', lang, chr(10), {body}, chr(10), '```')"


_FILES = f"(SELECT doc_id, {_NAME} AS path, {_LANG} AS lang, {_sql([x.text for x in SAMPLES])} AS text, {_sql([x.signatures for x in SAMPLES])} AS signatures, {_sql([x.header for x in SAMPLES])} AS header, {_sql([x.changes for x in SAMPLES])} AS changes FROM documents)"


def _sections(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, _code_tree(spark, sf_dir)).collect(CODE, mode=mode).sections.select("path", F.sha2("content", 256).alias("digest"))

    return run


query_of("collect_repo_map", f"SELECT path, sha256({_shown('signatures')}) AS digest FROM {_FILES}")(_sections("repo-map"))
query_of("collect_headers", f"SELECT path, sha256(concat(CASE WHEN header = '' THEN '' ELSE concat('### ', path, chr(10), header) END, {_shown('text')})) AS digest FROM {_FILES}")(_sections("headers"))


def _compared(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, _code_tree(spark, sf_dir))
        engine.create_snapshot(CODE, "one")
        _code_tree(spark, sf_dir, "later", engine.root)
        return engine.diff(CODE, "one", mode=mode, flat=True)[1].select("type", "path", "content")

    return run


query_of("diff_structural_mode", f"SELECT 'modified' AS type, path, concat('### ', path, chr(10), changes) AS content FROM {_FILES}")(_compared("structural"))

# Ways to collect

_NUMBERED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: lpad(CAST(i AS VARCHAR), CAST(greatest(5, length(CAST(len(string_split(text, chr(10))) AS VARCHAR))) AS INTEGER), ' ') || '| ' || x), chr(10))"
query_of("collect_numbered", f"SELECT path, sha256(concat('### ', path, chr(10), chr(10), '```', chr(10), {_NUMBERED}, chr(10), '```')) AS digest FROM ({TAKEN}) WHERE text <> ''")(
    lambda s, d: Engine(s, tree(s, d)).collect(dataclasses.replace(PROFILE, line_numbers=True, max_tokens=-1)).sections.select("path", F.sha2("content", 256).alias("digest"))
)
_MANY = {
    "taken": PROFILE,
    "small": Profile(directories=("src2", "src1"), patterns=("*.de", "doc_1*"), exclude_patterns=("src1/*7.*",), max_tokens=2000, use_gitignore=False),
    "other": Profile(directories=("missing", "src2"), patterns=("*.es",), max_tokens=2000, use_gitignore=False, files=("src5/doc_5.en", "src5/doc_5.de", "src5/doc_5.fr", "src5/doc_5.es")),
}


@query_of(
    "collect_all_profiles",
    f"""WITH d AS (SELECT *, {PATH} AS path, 'doc_' || doc_id || '.' || lang AS name FROM documents),
 w AS (SELECT 'taken' AS profile, path, text FROM ({TAKEN})
 UNION ALL SELECT 'small', path, text FROM d WHERE source IN ('src1', 'src2') AND (lang = 'de' OR starts_with(name, 'doc_1')) AND NOT (source = 'src1' AND path GLOB 'src1/*7.*')
 UNION ALL SELECT 'other', path, text FROM d WHERE source = 'src2' AND lang = 'es' OR path IN ('src5/doc_5.en', 'src5/doc_5.de', 'src5/doc_5.fr', 'src5/doc_5.es'))
 SELECT profile, path, sha256({SECTION}) AS digest FROM w""",
)
def _together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of different folders, patterns, exclusions and limits in one scan; sections are put together from their chunks."""
    sections = C.collect_all(spark, tree(spark, sf_dir), {name: dataclasses.replace(p, max_tokens=-1) for name, p in _MANY.items()}).sections
    return sections.select("profile", "path", F.sha2("content", 256).alias("digest"))


@query_of("collect_merged", f"{PARTS}, most AS (SELECT max(part) AS m FROM f) SELECT 'chat_' || i || '.md' AS name, CAST(i AS BIGINT) AS number FROM (SELECT unnest(range(1, 2 * m + 1)) AS i FROM most)")
def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second collection numbers on behind the first; nothing of the first goes."""
    folder, found = Path(scratch_path(spark, "merged").removeprefix("file://")), _collected(spark, sf_dir)
    C.write(found, folder, PROFILE)
    C.write(found, folder, PROFILE, merge=True)
    assert len(writers.load_manifest(folder)) == len(set(writers.load_manifest(folder)))
    return files.listing(spark, folder, ["."], ["chat_*.md"]).select(F.col("path").alias("name"), F.regexp_extract("path", r"_(\d+)\.md$", 1).cast("bigint").alias("number"))


@query_of("profile_extends", f"SELECT path, sha256(concat('<file path=\"', path, '\">', chr(10), '<![CDATA[', chr(10), text, chr(10), ']]>', chr(10), '</file>')) AS digest FROM (SELECT {PATH} AS path, text FROM documents WHERE source = 'src1' AND lang IN ('en', 'de') AND doc_id % 10 <> 7)")
def _extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile on top of another: it adds to the patterns and exclusions that its parent has set and takes over the rest."""
    root = tree(spark, sf_dir)
    base = {"directories": ["src1"], "patterns": ["*.en"], "section_format": "xml", "max_tokens": -1, "use_gitignore": False, "exclude_patterns": ["*.tmp"]}
    (root / CONFIG).write_text(json.dumps({"profiles": {"base": base, "kid": {"extends": "base", "patterns": ["*.de"], "exclude_patterns": ["*7.*"]}}}))
    engine = Engine(spark, root)
    return engine.collect(engine.profile("kid")).sections.select("path", F.sha2("content", 256).alias("digest"))


# Snapshots that change


@query_of("snapshot_updated", f"WITH {_STATES} SELECT id, path, sha256(text) AS sha256 FROM two, (VALUES ('one'), ('three')) AS i(id)")
def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot is made anew from the tree, the second has another name."""
    engine = history(spark, sf_dir)
    engine.update_snapshot("one")
    engine.store.rename("two", "three")
    of = lambda name: engine.store.files(name).select(F.lit(name).alias("id"), "path", "sha256")
    return of("one").unionByName(of(engine.resolve("three")))


@query_of("snapshot_info", f"WITH {_STATES} SELECT 'two' AS id, (SELECT count(*) FROM two) AS files, CAST(0 AS BIGINT) AS outputs, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM two) AS bytes")
def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's files and bytes, worked out by Spark, as one row."""
    found = history(spark, sf_dir).snapshot_info("two")
    return spark.createDataFrame([(found["id"], found["files"], found["outputs"], found["bytes"])], "id string, files bigint, outputs bigint, bytes bigint")
