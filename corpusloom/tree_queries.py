"""Registered queries over trees of files, snapshots and the store: the documents are written as files, then go through the public interface."""

from __future__ import annotations

import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import percent
from corpusloom.operators import diff as D
from corpusloom.operators import packing, query, textdiff
from corpusloom.plans import collect as C
from corpusloom.plans import presets
from corpusloom.plans.api import Engine
from corpusloom.plans.profiles import Profile
from corpusloom.registry import PATH, corpus, docs, fold, query_of
from corpusloom.shared import scratch_path
from corpusloom.sources import commands, files, writers
from corpusloom.sources.store import SnapshotStore

LIMIT = 30_000
PROFILE = Profile(directories=("src1", "."), patterns=("*.en", "*.fr"), exclude_patterns=("src3/*", "*_1?.fr"), max_tokens=LIMIT, name_template="chat", title_template="# {project_name} {part}/{total}\n")
#: Of the documents, those that the profile takes, by the order in which it does; the tree's ignore file leaves out doc_3*.
TAKEN = f"SELECT doc_id, {PATH} AS path, text, CASE WHEN source = 'src1' THEN 0 ELSE 1 END AS d, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS p, source, 'doc_' || doc_id || '.' || lang AS name FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src3' AND NOT ({PATH} GLOB '*_1?.fr') AND NOT starts_with('doc_' || doc_id, 'doc_3')"
SECTION = "concat('### ', path, chr(10), chr(10), '```', chr(10), text, chr(10), '```')"
_ORDER = "d, p, source, name"
_SECTIONS = f"(SELECT 1 AS one, *, {SECTION} AS section FROM ({TAKEN}))"
PARTS = fold("one", f"{_ORDER}, path, section", _SECTIONS, "greatest(1, length(section) // 4)", LIMIT)


def tree(spark: SparkSession, sf_dir: str, content: str = "text", path: str = PATH, where: str = "true", root: Path | None = None) -> Path:
    """Documents as files of a tree in the shared folder, written by the executors; the driver adds an ignore file."""
    root = root or Path(scratch_path(spark, "tree").removeprefix("file://"))

    def write(rows) -> None:
        for r in rows:
            full = root / r.path
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_bytes(r.content.encode())

    docs(spark, sf_dir).where(where).select(F.expr(path).alias("path"), F.expr(content).alias("content")).foreachPartition(write)
    root.mkdir(parents=True, exist_ok=True)
    (root / ".gitignore").write_text("# left out\n\n/doc_3*\n")
    return root


def _collected(spark: SparkSession, sf_dir: str, **how) -> C.Collected:
    return Engine(spark, tree(spark, sf_dir)).collect(PROFILE, **how)


query_of(
    "scan_tree",
    f"SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, d AS dir_no, p AS pattern_no, sha256(text) AS sha256 FROM (SELECT {PATH} AS path, text, CASE WHEN source = 'src1' THEN 0 ELSE 1 END AS d, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS p FROM documents WHERE lang IN ('en', 'fr'))",
)(lambda s, d: files.scan(s, tree(s, d), ["src1", "."], ["*.en", "*.fr"]).select("path", "size", "dir_no", "pattern_no", F.sha2("content", 256).alias("sha256")))
query_of("collect_parts", f"{PARTS} SELECT part, count(*) AS n_sections, CAST(sum(tokens) AS BIGINT) AS tokens, sha256(string_agg(section, chr(10) || chr(10) ORDER BY rn)) AS digest FROM f GROUP BY part")(
    lambda s, d: _collected(s, d).parts.select("part", "n_sections", "tokens", F.sha2("content", 256).alias("digest"))
)
query_of("collect_sections", f"{PARTS} SELECT part, path, tokens FROM f")(lambda s, d: _collected(s, d).sections.select("part", "path", "tokens"))
query_of("collect_query", f"SELECT path, greatest(1, length({SECTION}) // 4) AS tokens FROM ({TAKEN}) WHERE contains(lower({SECTION}), 'sting') OR contains(lower(name), 'sting')")(
    lambda s, d: _collected(s, d, text_query="STING").sections.select("path", "tokens")
)
query_of("toc_entries", f"{PARTS} SELECT part, string_agg(path, chr(10) ORDER BY rn) AS toc FROM f GROUP BY part")(
    lambda s, d: C.toc_entries(_collected(s, d)).select("part", F.array_join(F.transform("entries", lambda e: e["path"]), "\n").alias("toc"))
)
query_of("pipeline_metrics", f"SELECT count(*) AS files_read, CAST(sum(greatest(1, length({SECTION} || chr(10)) // 4)) AS BIGINT) AS tokens_raw, CAST(sum(greatest(1, length({SECTION}) // 4)) AS BIGINT) AS tokens_compressed FROM ({TAKEN})")(
    lambda s, d: s.createDataFrame([{k: v for k, v in C.metrics(_collected(s, d)).items() if k in ("files_read", "tokens_raw", "tokens_compressed")}], "files_read long, tokens_raw long, tokens_compressed long")
)
query_of(
    "dry_run",
    f"{PARTS}, l AS (SELECT part, tokens, path AS name FROM f UNION ALL SELECT part, CAST(sum(tokens) AS BIGINT), '→ part ' || part FROM f GROUP BY part) SELECT printf('  %5d tokens | %5s | %s', tokens, CASE WHEN tokens / {LIMIT} * 100 < 0.05 THEN '<0.1%' ELSE printf('%.1f%%', tokens / {LIMIT} * 100) END, name) AS line FROM l",
)(lambda s, d: C.dry_run(_collected(s, d), LIMIT).select("line"))
query_of("format_pct", "SELECT doc_id, CASE WHEN length(text) / 20000 * 100 < 0.05 THEN '<0.1%' ELSE printf('%.1f%%', length(text) / 20000 * 100) END AS pct FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", percent(F.length("text"), F.lit(20000)).alias("pct"))
)


@query_of(
    "written_parts",
    f"""{PARTS}, t AS (SELECT max(part) AS total FROM f) SELECT 'chat_' || part || '.md' AS name, sha256(concat('# Project ', part, '/', any_value(total), chr(10), chr(10), 'Part ', part, ' of ', any_value(total), '. Files in this part:', chr(10),
 string_agg(chr(10) || '  ' || name, '' ORDER BY rn), chr(10), chr(10), string_agg(section, chr(10) || chr(10) ORDER BY rn))) AS digest FROM f, t GROUP BY part""",
)
def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Path(scratch_path(spark, "out").removeprefix("file://"))
    names = C.write(_collected(spark, sf_dir), folder, PROFILE)
    assert writers.load_manifest(folder) == names
    return files.scan(spark, folder, ["."], ["chat_*.md"]).select(F.col("path").alias("name"), F.sha2("content", 256).alias("digest"))


# Snapshots. In the second state some files have a suffix, some are new; none is gone.

_LATER = "CASE WHEN doc_id % 11 = 0 THEN concat(text, ' suffix') ELSE text END"
_STATES = f"""one AS (SELECT path, text FROM ({TAKEN})), new AS (SELECT 'src9/new_' || doc_id || '.en' AS path, concat('fresh ', text) AS text FROM documents WHERE doc_id % 10 = 1),
 two AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN concat(text, ' suffix') ELSE text END AS text FROM ({TAKEN}) UNION ALL SELECT path, text FROM new)"""
_LINES = "len(string_split(one.text, chr(10)))"
_LAST = "string_split(one.text, chr(10))[-1]"
_SECTIONS_OF = f"""WITH {_STATES} SELECT 'modified' AS type, path, concat('### ', path, chr(10), chr(10), 'REMOVED lines ', {_LINES}, ':', chr(10), '    ', {_LAST}, chr(10), chr(10), 'ADDED lines ', {_LINES}, ':', chr(10), '    ', {_LAST}, ' suffix', chr(10)) AS content FROM one JOIN two USING (path) WHERE one.text <> two.text
 UNION ALL SELECT 'added', path, concat('### ', path, chr(10), chr(10), 'ADDED (new file):', chr(10), chr(10), '```', chr(10), text, chr(10), '```', chr(10)) FROM new"""


def history(spark: SparkSession, sf_dir: str) -> Engine:
    """A tree with snapshots ``one`` and ``two`` of its two states; it is in the second."""
    ticks = iter(range(1, 100))
    engine = Engine(spark, tree(spark, sf_dir))
    engine.store.clock = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=next(ticks))
    engine.create_snapshot(PROFILE, "one")
    tree(spark, sf_dir, _LATER, where="doc_id % 11 = 0", root=engine.root)
    tree(spark, sf_dir, "concat('fresh ', text)", "concat('src9/new_', doc_id, '.en')", "doc_id % 10 = 1", engine.root)
    engine.create_snapshot(PROFILE, "two")
    return engine


query_of("snapshot_files", f"WITH {_STATES} SELECT path, sha256(text) AS sha256, octet_length(encode(text)) AS stored_bytes FROM two")(
    lambda s, d: (lambda e: e.store.files("two").join(e.store.objects().select("sha256", "stored_bytes"), "sha256").select("path", "sha256", "stored_bytes"))(history(s, d))
)


@query_of("snapshot_list", f"WITH {_STATES} SELECT 1 AS at, 'two' AS id, '2024-01-03T00:00:00.000000' AS created, (SELECT count(*) FROM two) AS files UNION ALL SELECT 2, 'one', '2024-01-02T00:00:00.000000', (SELECT count(*) FROM one)")
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = history(spark, sf_dir)
    rows = [(i, m["id"], m["created"], engine.store.files(m["id"]).count()) for i, m in enumerate(engine.snapshots(), 1)]
    return spark.createDataFrame(rows, "at int, id string, created string, files long")


query_of("snapshot_diff", f"{_SECTIONS_OF}")(lambda s, d: history(s, d).diff(PROFILE, "one", "two", flat=True)[1].select("type", "path", "content"))
query_of("snapshot_diff_live", f"{_SECTIONS_OF}")(lambda s, d: history(s, d).diff(PROFILE, "one", flat=True)[1].select("type", "path", "content"))
query_of("snapshot_diff_narrow", f"WITH x AS ({_SECTIONS_OF}) SELECT type, path FROM x WHERE starts_with(path, 'src1/') AND ends_with(path, '.en')")(
    lambda s, d: history(s, d).diff(Profile(directories=("src1",), patterns=("*.en",), exclude_patterns=PROFILE.exclude_patterns, use_gitignore=True), "one", flat=True)[1].select("type", "path")
)
_COUNTS = f"WITH x AS ({_SECTIONS_OF}) SELECT count(*) FILTER (type = 'renamed') AS renamed, count(*) FILTER (type = 'moved') AS moved, count(*) FILTER (type = 'modified') AS modified, count(*) FILTER (type = 'added') AS added, count(*) FILTER (type = 'deleted') AS deleted, CAST(sum(greatest(1, length(content) // 4)) AS BIGINT) AS total_tokens FROM x"
query_of("diff_section_stats", _COUNTS)(lambda s, d: s.createDataFrame([history(s, d).diff(PROFILE, "one", "two")[0]], "renamed long, moved long, modified long, added long, deleted long, total_tokens long"))
query_of(
    "diff_grouped",
    f"WITH x AS ({_SECTIONS_OF}) SELECT 0 AS rank, '' AS path, concat('## Changes from one to two (', count(*) FILTER (type = 'modified'), ' modified, ', count(*) FILTER (type = 'added'), ' added)', chr(10), chr(10)) AS content FROM x UNION ALL SELECT 5, '', '### Modified' || chr(10) UNION ALL SELECT 7, '', '### Added' || chr(10) UNION ALL SELECT CASE type WHEN 'modified' THEN 6 ELSE 8 END, path, content FROM x",
)(lambda s, d: history(s, d).diff(PROFILE, "one", "two")[1].select("rank", "path", "content"))


@query_of("part_stats", f"WITH x AS ({_SECTIONS_OF}), n AS (SELECT *, row_number() OVER (ORDER BY path) AS rn FROM x) SELECT (rn - 1) // 20 + 1 AS part, 0 AS renamed, 0 AS moved, count(*) FILTER (type = 'modified') AS modified, count(*) FILTER (type = 'added') AS added, 0 AS deleted, CAST(sum(greatest(1, length(content) // 4)) AS BIGINT) AS total_tokens FROM n GROUP BY 1")
def _part_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = history(spark, sf_dir).diff(PROFILE, "one", "two", flat=True)[1]
    parts = packing.part_map(sections.select("path", F.lit(1).alias("tokens"), F.lit("diff").alias("g")), 20, "g", ["path"])
    return D.stats(sections.join(parts.select("path", "part"), "path"), ["part"])


# The store

_CONTENTS = "SELECT sha256(text) AS sha256, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS n, count(*) AS uses FROM {0} GROUP BY 1"
query_of("store_objects", f"WITH {_STATES}, b AS (SELECT text FROM one UNION ALL SELECT text FROM two) SELECT sha256, n AS stored_bytes, substr(sha256, 1, 2) AS shard FROM ({_CONTENTS.format('b')})")(
    lambda s, d: history(s, d).store.objects().select("sha256", "stored_bytes", "shard")
)
query_of(
    "store_stats",
    f"WITH {_STATES}, b AS (SELECT text FROM one UNION ALL SELECT text FROM two), s AS (SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS total_bytes, CAST(sum(n * uses) AS BIGINT) AS logical FROM ({_CONTENTS.format('b')})) SELECT objects, total_bytes, total_bytes AS unique_bytes, 0.0::DOUBLE AS dedup_pct, round_even((1 - total_bytes / logical) * 100, 1) AS logical_dedup_pct, 2 AS snapshots FROM s",
)(lambda s, d: s.createDataFrame([history(s, d).store.stats()], "objects long, total_bytes long, unique_bytes long, dedup_pct double, logical_dedup_pct double, snapshots int"))


@query_of("store_collected", f"WITH {_STATES} SELECT sha256, n AS stored_bytes FROM ({_CONTENTS.format('two')})")
def _gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = history(spark, sf_dir).store
    store.delete("one")
    store.gc()
    return store.objects().select("sha256", "stored_bytes")


@query_of("cas_dedup", f"SELECT sha256, n AS stored_bytes, uses FROM ({_CONTENTS.format('documents')})")
def _put(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = SnapshotStore(spark, Path(scratch_path(spark, "store").removeprefix("file://")))
    rows = docs(spark, sf_dir).select(F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("data"))
    for _ in range(2):  # what is there already isn't put again
        store.put(rows)
    return store.objects().select("sha256", "stored_bytes").join(rows.groupBy("sha256").agg(F.count("*").alias("uses")), "sha256")


@query_of("store_integrity", "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE substr(sha256(text), 1, 1) = '7'")
def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = SnapshotStore(spark, Path(scratch_path(spark, "store").removeprefix("file://")))
    sha = F.sha2("text", 256)
    store.put(docs(spark, sf_dir).select(sha.alias("sha256"), F.when(F.startswith(sha, F.lit("7")), F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("data")))
    return store.damaged()


# Differences and outputs of commands

_OLD, _NEW = "concat('a', doc_id, chr(10), 'same', chr(10), 'x', doc_id % 3)", "concat('a', doc_id, chr(10), 'same', chr(10), 'x', doc_id % 4)"
query_of(
    "command_diff_lines",
    f"SELECT doc_id, concat('### pre: tree .', chr(10), '- x', doc_id % 3, chr(10), '+ x', doc_id % 4, chr(10)) AS content FROM documents WHERE doc_id % 3 <> doc_id % 4",
)(lambda s, d: docs(s, d).select("doc_id", textdiff.command_diffs()(F.expr(_OLD), F.expr(_NEW), F.lit("pre: tree .")).alias("content")).where("content <> ''"))
_LOG = "concat('head ', doc_id, chr(10), '=== COMMIT: a', chr(10), 'one', chr(10), '=== COMMIT: b', chr(10), {0})"
_LOG_OLD, _LOG_NEW = _LOG.format("text"), _LOG.format("CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE text END") + ", CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), '=== COMMIT: c', chr(10), doc_id) ELSE '' END"
query_of(
    "command_diff_log",
    """WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, text FROM documents WHERE NOT contains(text, '=== COMMIT:') AND text <> 'other'),
 s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('### pre: git log section 3', chr(10), chr(10), 'REMOVED lines 3', CASE WHEN n > 1 THEN concat('-', n + 2) ELSE '' END, ':', chr(10), '    ', replace(rtrim(text, chr(10)), chr(10), chr(10) || '    '), chr(10), chr(10), 'ADDED lines 3:', chr(10), '    other', chr(10)) END AS changed,
 CASE WHEN doc_id % 2 = 0 THEN concat('### pre: git log section 4', chr(10), chr(10), 'ADDED (new file):', chr(10), chr(10), '```', chr(10), chr(10), '=== COMMIT: c', chr(10), doc_id, chr(10), '```', chr(10)) ELSE concat('### pre: git log section 4', chr(10), chr(10), '[DELETED]', chr(10)) END AS last FROM d)
 SELECT doc_id, concat_ws(chr(10), changed, last) AS content FROM s""",
)(
    lambda s, d: docs(s, d)
    .where("NOT contains(text, '=== COMMIT:') AND text <> 'other'")
    .select("doc_id", textdiff.command_diffs()(F.expr(f"concat({_LOG_OLD}, CASE WHEN doc_id % 2 = 1 THEN concat(chr(10), '=== COMMIT: lost', chr(10)) ELSE '' END)"), F.expr(f"concat({_LOG_NEW})"), F.lit("pre: git log")).alias("content"))
)
query_of("command_labels", "SELECT doc_id, 'pre: ' || CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 47) || '...' END AS label FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", commands.label_of(F.col("text")).alias("label"))
)
query_of(
    "diff_xml",
    "SELECT doc_id, concat('<file path=\"', doc_id, '.txt\">', chr(10), '  <removed>', chr(10), '        x', doc_id % 3, chr(10), '  </removed>', chr(10), '  <added>', chr(10), '        x', doc_id % 4, chr(10), '  </added>', chr(10), '</file>', chr(10)) AS content FROM documents WHERE doc_id % 3 <> doc_id % 4",
)(lambda s, d: docs(s, d).select("doc_id", textdiff.text_diffs("xml")(F.expr(_OLD), F.expr(_NEW), F.expr("concat(doc_id, '.txt')")).alias("content")).where("content <> ''"))
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
query_of("diff_xml_added", f"SELECT doc_id, concat('<file path=\"n\">', chr(10), '  <added>', chr(10), '    ', {_ESCAPED}, chr(10), '  </added>', chr(10), '</file>', chr(10)) AS content FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", textdiff.text_diffs("xml")(F.lit(""), F.col("text"), F.lit("n")).alias("content"))
)
query_of("diff_deleted", "SELECT doc_id, concat('### ', doc_id, chr(10), chr(10), '[DELETED]', chr(10)) AS content FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", textdiff.text_diffs()(F.col("text"), F.lit(""), F.col("doc_id").cast("string")).alias("content"))
)
_KEPT = 4 * 100 + 3 - len(textdiff.CUT_MARK)
query_of(
    "diff_truncated",
    f"SELECT doc_id, concat('### n', chr(10), chr(10), 'ADDED (new file):', chr(10), chr(10), '```', chr(10), CASE WHEN length(text) // 4 <= 100 THEN text ELSE substr(text, 1, {_KEPT}) || chr(10) || '# ... truncated (exceeds token limit) ...' || chr(10) END, chr(10), '```', chr(10)) AS content FROM documents",
)(lambda s, d: docs(s, d).select("doc_id", textdiff.text_diffs("markdown", 100)(F.lit(""), F.col("text"), F.lit("n")).alias("content")))
query_of(
    "command_sections",
    "SELECT CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'deleted' ELSE 'modified' END AS type, 'pre: cat ' || doc_id AS path FROM documents WHERE doc_id % 5 < 3",
)(
    lambda s, d: D.command_sections(
        docs(s, d).where("doc_id % 5 <> 0").select(F.expr("concat('pre: cat ', doc_id)").alias("label"), F.expr("concat('out ', doc_id, CASE WHEN doc_id % 5 = 2 THEN ' old' ELSE '' END)").alias("content")),
        docs(s, d).where("doc_id % 5 <> 1").select(F.expr("concat('pre: cat ', doc_id)").alias("label"), F.expr("concat('out ', doc_id)").alias("content")),
    ).select("type", "path")
)
query_of(
    "continuation_marks",
    "SELECT doc_id, concat(CASE WHEN doc_id % 3 > 0 THEN '> **[CONTINUED from part ' || doc_id || ']**' || chr(10) || chr(10) ELSE '' END, text, CASE WHEN doc_id % 3 < 2 THEN chr(10) || chr(10) || '> **[CONTINUES in part ' || (doc_id + 2) || ']**' ELSE '' END) AS content FROM documents",
)(lambda s, d: docs(s, d).select("doc_id", packing.continuation(F.col("text"), F.col("doc_id") % 3, F.lit(3), F.col("doc_id") + 1).alias("content")))
query_of(
    "query_score_declared",
    "SELECT doc_id, CAST((CASE WHEN contains('f' || doc_id, 'f1') THEN 10 ELSE 0 END) + 3 * (CAST(contains(c, 'f1') AS INTEGER) + CAST(contains(c, 'mod_2') AS INTEGER)) + (CASE WHEN contains('run_' || (doc_id % 30), 'mod_2') OR contains('run_' || (doc_id % 30), 'f1') THEN 8 ELSE 0 END) + 5 * (CAST(contains('mod_' || (doc_id % 40), 'mod_2') AS INTEGER) + CAST(contains('lib_f1' || (doc_id % 7), 'f1') AS INTEGER)) AS INTEGER) AS score FROM (SELECT doc_id, concat('### f', doc_id, chr(10), 'deps: mod_', doc_id % 40, ', lib_f1', doc_id % 7, chr(10), 'exports: run_', doc_id % 30, chr(10), 'body') AS c FROM documents)",
)(
    lambda s, d: docs(s, d)
    .select("doc_id", F.expr("concat('f', doc_id)").alias("path"), F.expr("concat('### f', doc_id, chr(10), 'deps: mod_', doc_id % 40, ', lib_f1', doc_id % 7, chr(10), 'exports: run_', doc_id % 30, chr(10), 'body')").alias("content"))
    .select("doc_id", query.score(F.col("path"), F.col("content"), query.dependency_list(query.declared(F.col("content"), "deps")), "F1 mod_2").alias("score"))
)


@query_of("preset_detect", "SELECT DISTINCT source, 'docs' AS preset FROM documents WHERE doc_id % 40 = 7 UNION SELECT DISTINCT source, 'go' FROM documents WHERE doc_id % 40 = 9 UNION SELECT DISTINCT source, 'csharp' FROM documents WHERE doc_id % 40 = 11")
def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a project, known by the names of its files."""
    names = "CASE doc_id % 40 WHEN 7 THEN 'README.md' WHEN 9 THEN 'go.mod' WHEN 11 THEN 'app.csproj' ELSE 'other.bin' END"
    root = tree(spark, sf_dir, "lang", f"concat(source, '/', {names})")
    listed = files.listing(spark, root).where("contains(path, '/')")
    return presets.detected(listed.select(F.substring_index("path", "/", 1).alias("project"), F.expr("substring(path, locate('/', path) + 1)").alias("path"))).withColumnRenamed("project", "source")
