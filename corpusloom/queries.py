"""The registered queries over the operators of the engine, and the same in DuckDB's SQL.

``documents`` stands for a corpus: its path is ``source/doc_<id>.<lang>``. Snapshot A lacks every tenth document, snapshot B the
next of every ten; in B some paths are moved and some contents have a suffix. Where the documents have nothing of the kind
(code, blank lines), texts are made by one and the same expression in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import formatting, languages, parsers, predicates, text
from corpusloom.operators import diff as D
from corpusloom.operators import incremental, packing, query, splitting, structural, textdiff
from corpusloom.registry import ORACLES, PATH, QUERIES, query_of
from corpusloom.registry import corpus as _corpus
from corpusloom.registry import docs as _docs
from corpusloom.registry import fold as _fold
from corpusloom.shared import stored
from corpusloom.sources import store

LIMIT = 10_000
WORDS = "the doc_1 entre"

# Expressions that both engines read alike
BLANKS = "concat('a  ', chr(10), chr(10), chr(10), text, chr(9), chr(10), chr(10), chr(10), chr(10), 'b', doc_id % 5, ' ', chr(10), ' ', chr(10), 'end')"
JS = (
    "concat('import { a', doc_id % 7, ', b } from ', chr(34), './mod_', doc_id % 50, chr(34), chr(10), 'const x = require(', chr(34), 'lib_', doc_id % 13, chr(34), ')', chr(10),"
    " 'export function f_', doc_id % 17, '(x, y', doc_id % 3, ') {', chr(10), '  return ', doc_id % 4, chr(10), '}', chr(10), 'class C_', doc_id % 11, ' {', chr(10), '}', chr(10))"
)
JS_LATER = (
    "concat('export function f_', (doc_id + doc_id % 2) % 17, '(x, y', (doc_id + doc_id % 5) % 3, ') {', chr(10), '  return ', doc_id % 3, chr(10), '}', chr(10), 'class C_', doc_id % 11, ' {', chr(10), '}', chr(10))"
)
RUBY = "concat('require ', chr(34), 'gem_', doc_id % 9, chr(34), chr(10), 'def self.go_', doc_id % 21, '?(a)', chr(10), '  a', chr(10), 'end', chr(10), 'function plain_', doc_id % 5, '(b)', chr(10))"
SHEBANG = "concat(CASE doc_id % 4 WHEN 0 THEN '#!/usr/bin/env python3' WHEN 1 THEN '#!/bin/bash -e' WHEN 2 THEN '#! /usr/local/bin/node' ELSE 'no shebang' END, chr(10), text)"
EXT = "CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'RS' WHEN 2 THEN 'tar.gz' WHEN 3 THEN 'ts' WHEN 4 THEN 'yml' ELSE 'none' END"


def _project(content: str = "text", **made) -> Callable[[SparkSession, str], DataFrame]:
    """A projection of the corpus: doc_id and the columns made."""
    return lambda spark, sf_dir: _corpus(spark, sf_dir, content).select("doc_id", *[x().alias(n) for n, x in made.items()])


def _c(name: str = "content") -> Column:
    return F.col(name)


# Tokens, compression, numbering

query_of("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")(_project(tokens=lambda: text.count_tokens(_c())))
query_of("html_corpus_tokens", "SELECT page_id, greatest(1, length(html) // 4) AS tokens FROM pages")(lambda s, d: _docs(s, d, "pages").select("page_id", text.count_tokens(_c("html")).alias("tokens")))
for key in ("lang", "source"):
    query_of(f"tokens_by_{key}", f"SELECT {key}, count(*) AS files, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY {key}")(
        lambda s, d, key=key: _corpus(s, d).groupBy(key).agg(F.count("*").alias("files"), F.sum(text.count_tokens(_c())).alias("tokens"))
    )
_COMPRESSED = "regexp_replace(regexp_replace({0}, '\\n{{2,}}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g')"
query_of("compress_text", f"SELECT doc_id, {_COMPRESSED.format(BLANKS)} AS compressed FROM documents")(_project(BLANKS, compressed=lambda: text.compress(_c())))
query_of(
    "compress_savings",
    f"WITH c AS (SELECT doc_id, {BLANKS} AS a, {_COMPRESSED.format(BLANKS)} AS b FROM documents), t AS (SELECT doc_id, greatest(1, length(a) // 4) AS tokens_before, greatest(1, length(b) // 4) AS tokens_after FROM c) SELECT *, (1 - tokens_after / tokens_before) * 100 AS saved_pct FROM t",
)(lambda s, d: _corpus(s, d, BLANKS).select("doc_id", *[c.alias(n) for c, n in zip(text.savings(_c(), text.compress(_c())), ("tokens_before", "tokens_after", "saved_pct"), strict=True)]))
query_of(
    "line_numbers",
    "WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents), w AS (SELECT *, greatest(5, length(CAST(len(x) AS VARCHAR))) AS w FROM l)"
    " SELECT doc_id, CASE WHEN text = '' THEN text ELSE array_to_string(list_transform(x, lambda v, i: lpad(CAST(i AS VARCHAR), CAST(w AS INTEGER), ' ') || '| ' || v), chr(10)) END AS numbered FROM w",
)(_project(numbered=lambda: text.line_numbers(_c())))
query_of("split_single", "SELECT doc_id, CASE WHEN greatest(1, length(text) // 4) <= 200 THEN trim(text) ELSE substr(text, 1, 800) || chr(10) || chr(10) || '# ... truncated ...' END AS part FROM documents")(
    _project(part=lambda: text.single(_c(), 200))
)

# Formats and languages

query_of("format_markdown", f"SELECT doc_id, concat('### ', {PATH}, chr(10), chr(10), '```', lang, chr(10), text, chr(10), '```', chr(10)) AS section FROM documents")(_project(section=lambda: formatting.section(_c("path"), _c("lang"), _c())))
query_of("format_xml", f"SELECT doc_id, concat('<file path=\"', {PATH}, '\" language=\"', lang, '\">', chr(10), '<![CDATA[', chr(10), text, chr(10), ']]>', chr(10), '</file>', chr(10)) AS section FROM documents")(
    _project(section=lambda: formatting.section(_c("path"), _c("lang"), _c(), "xml"))
)
query_of("format_json", f"SELECT doc_id, concat('{{\"path\": ', to_json({PATH}), ', \"content\": ', to_json(text), ', \"language\": ', to_json(lang), '}}', chr(10)) AS section FROM documents")(
    _project(section=lambda: formatting.section(_c("path"), _c("lang"), _c(), "json"))
)
query_of("format_binary", f"SELECT doc_id, concat('### ', {PATH}, chr(10), chr(10), '```base64', chr(10), base64(encode(text)), chr(10), '```', chr(10)) AS section FROM documents")(
    _project(section=lambda: formatting.binary_section(_c("path"), _c().cast("binary")))
)
query_of(
    "lang_for_path",
    f"SELECT doc_id, CASE {EXT} WHEN 'py' THEN 'python' WHEN 'RS' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'yml' THEN 'yaml' ELSE '' END AS language FROM documents",
)(lambda s, d: _docs(s, d).select("doc_id", languages.lang_for_path(F.expr(f"concat(source, '/a.b/f', doc_id, '.', {EXT})")).alias("language")))
query_of("shebang_lang", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' WHEN 2 THEN 'javascript' ELSE '' END AS language FROM documents")(_project(SHEBANG, language=lambda: languages.lang_from_shebang(_c())))

# Predicates

_EXCLUDE = ["*_1?.en", "src3/*", "doc_7*", "*.zz"]
query_of(
    "exclude_filter",
    f"SELECT doc_id FROM (SELECT doc_id, {PATH} AS path FROM documents) WHERE NOT (path GLOB '*_1?.en' OR regexp_matches(path, '(^|/)src3/') OR regexp_matches(path, '(^|/)doc_7[^/]*$'))",
)(lambda s, d: _corpus(s, d).where(~predicates.excluded(_c("path"), _EXCLUDE)).select("doc_id"))
query_of("filename_query", f"SELECT doc_id FROM documents WHERE contains(lower('doc_' || doc_id || '.' || lang), 'doc_1') OR contains(lower('doc_' || doc_id || '.' || lang), '.fr')")(
    lambda s, d: _corpus(s, d).where(predicates.name_matches(_c("path"), "DOC_1 .fr")).select("doc_id")
)
query_of("binary_skip", "SELECT doc_id, doc_id % 6 NOT IN (0, 3, 1, 4) AND (octet_length(encode(text)) > 2097 OR doc_id % 3 = 2) AS skipped FROM documents")(
    lambda s, d: _docs(s, d).select(
        "doc_id",
        predicates.skip_binary(F.expr(f"concat('f', doc_id, '.', {EXT})"), F.octet_length("text"), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("\0"), F.col("text"))).otherwise(F.col("text")).cast("binary"), max_mb=2097 / (1024 * 1024)).alias("skipped"),
    )
)

# Queries

_HIT = "+".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 3 ELSE 0 END)" for w in WORDS.split())
_NAMED = " OR ".join(f"contains('doc_' || doc_id || '.' || lang, '{w}')" for w in WORDS.split())
_SCORE = f"CAST((CASE WHEN {_NAMED} THEN 10 ELSE 0 END) + {_HIT} AS INTEGER)"
query_of("query_score", f"SELECT doc_id, {_SCORE} AS score FROM documents")(lambda s, d: _corpus(s, d).select("doc_id", query.score(_c("path"), _c(), F.array().cast("array<string>"), WORDS).alias("score")))
query_of("query_filter", f"SELECT doc_id FROM documents WHERE {_SCORE} > 0")(
    lambda s, d: query.filtered(_corpus(s, d).withColumn("deps", F.array().cast("array<string>")), WORDS).select("doc_id")
)
_DEPS = f"unnest(list_concat(list_concat(regexp_extract_all(c, '(?m)^\\s*import\\s+\\{{([^}}]*)\\}}\\s*from\\s*[\\x27\"]([^\\x27\"]+)[\\x27\"]', 1), regexp_extract_all(c, '(?m)^\\s*import\\s+\\{{([^}}]*)\\}}\\s*from\\s*[\\x27\"]([^\\x27\"]+)[\\x27\"]', 2)), regexp_extract_all(c, 'require\\(\"([^\"]+)\"', 1)))"
_EDGES = f"e AS (SELECT path, trim(dep) AS dep FROM (SELECT {PATH} AS path, {_DEPS} AS dep FROM (SELECT *, {JS} AS c FROM documents)))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps, _ = parsers.header_parts(_c(), F.lit("javascript"), python=False)
    return query.import_edges(_corpus(spark, sf_dir, JS), deps=deps).select("path", F.trim("dep").alias("dep"))


query_of("import_edges", f"WITH {_EDGES} SELECT path, dep FROM e")(_edges)
query_of(
    "reverse_import_degree",
    f"WITH {_EDGES}, r AS (SELECT DISTINCT path, dep FROM e UNION SELECT path, string_split(string_split(dep, '/')[-1], '.')[1] FROM e) SELECT dep, count(DISTINCT path) AS importers FROM r GROUP BY dep",
)(lambda s, d: query.reverse_edges(_edges(s, d)).groupBy("dep").agg(F.count_distinct("path").alias("importers")))

# A graph in which document i imports documents i // 2 and i // 3
_GRAPH = "SELECT DISTINCT 'm/n' || doc_id || '.js' AS path, unnest(['x/n' || (doc_id // 2), 'n' || (doc_id // 3) || '.js']) AS dep FROM documents"
query_of(
    "import_chain_depth2",
    f"WITH RECURSIVE g AS ({_GRAPH}), r AS (SELECT path, string_split(string_split(dep, '/')[-1], '.')[1] AS name FROM g), c(path, depth) AS (SELECT 'm/n' || doc_id || '.js', 0 FROM documents WHERE contains('n' || doc_id || '.js', 'n13') OR contains('n' || doc_id || '.js', 'n21.') UNION SELECT r.path, depth + 1 FROM c JOIN r ON r.name = string_split(string_split(c.path, '/')[-1], '.')[1] WHERE depth < 2) SELECT DISTINCT path FROM c",
)(
    lambda s, d: query.expand(
        _docs(s, d).select(F.expr("concat('m/n', doc_id, '.js')").alias("path")).where(predicates.name_matches(_c("path"), "N13 n21.")),
        _docs(s, d).select(F.expr("concat('m/n', doc_id, '.js')").alias("path"), F.explode(F.expr("array(concat('x/n', doc_id div 2), concat('n', doc_id div 3, '.js'))")).alias("dep")),
    )
)

# Headers, signatures, blocks

_SORTED = "array_to_string(list_sort(list_distinct({0})), ', ')"
query_of(
    "header_deps_exports",
    f"WITH t AS (SELECT doc_id, {PATH} AS path, list_concat(list_concat(regexp_extract_all(c, 'import \\{{([^}}]*)\\}}', 1), regexp_extract_all(c, 'from \"([^\"]+)\"', 1)), regexp_extract_all(c, 'require\\(\"([^\"]+)\"', 1)) AS deps, list_concat(regexp_extract_all(c, 'function (\\w+)', 1), regexp_extract_all(c, 'class (\\w+)', 1)) AS exports FROM (SELECT *, {JS} AS c FROM documents))"
    f" SELECT doc_id, concat('### ', path, chr(10), 'deps: ', {_SORTED.format('deps')}, chr(10), 'exports: ', {_SORTED.format('exports')}, chr(10)) AS header FROM t",
)(_project(JS, header=lambda: parsers.header(_c("path"), *parsers.header_parts(_c(), F.lit("javascript"), python=False))))
query_of("c_like_signatures", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({JS}, '(?m)^((?:export )?(?:function|class)\\s+[^{{]*)', 1), lambda x: trim(x)), chr(10)) AS signatures FROM documents")(
    _project(JS, signatures=lambda: parsers.signatures(_c(), F.lit("javascript"), python=False))
)
query_of("script_signatures", f"SELECT doc_id, array_to_string(list_concat(regexp_extract_all({RUBY}, '(?m)^(def .*)', 1), regexp_extract_all({RUBY}, '(?m)^(function .*)', 1)), chr(10)) AS signatures FROM documents")(
    _project(RUBY, signatures=lambda: parsers.signatures(_c(), F.lit("ruby"), python=False))
)
_PY = "concat('import os, m_', doc_id % 50, chr(10), '@deco', chr(10), 'def f_', doc_id % 17, '(x):', chr(10), '    return ', doc_id % 3, chr(10), 'class K:', chr(10), '    pass', chr(10))"
query_of("python_signatures", f"SELECT doc_id, concat('import os, m_', doc_id % 50, chr(10), '@deco', chr(10), 'def f_', doc_id % 17, '(x):', chr(10), '    ...', chr(10), 'class K:', chr(10), '    ...') AS signatures FROM documents")(
    _project(_PY, signatures=lambda: parsers.signatures(_c(), F.lit("python")))
)
query_of(
    "python_blocks",
    "SELECT doc_id, 'f_' || (doc_id % 17) AS name, '@deco' || chr(10) || 'def f_' || (doc_id % 17) || '(x):' AS signature, '    return ' || (doc_id % 3) AS body FROM documents UNION ALL SELECT doc_id, 'K', 'class K:', '    pass' FROM documents",
)(lambda s, d: _corpus(s, d, _PY).select("doc_id", F.explode(parsers.blocks(_c(), F.lit("python"))).alias("b")).select("doc_id", "b.*"))

_A_BLOCKS = "SELECT doc_id, 'f_' || (doc_id % 17) AS name, 'export function f_' || (doc_id % 17) || '(x, y' || (doc_id % 3) || ')' AS sig, CAST(doc_id % 4 AS VARCHAR) AS body FROM documents UNION ALL SELECT doc_id, 'C_' || (doc_id % 11), 'class C_' || (doc_id % 11), '' FROM documents"
_B_BLOCKS = "SELECT doc_id, 'f_' || ((doc_id + doc_id % 2) % 17) AS name, 'export function f_' || ((doc_id + doc_id % 2) % 17) || '(x, y' || ((doc_id + doc_id % 5) % 3) || ')' AS sig, CAST(doc_id % 3 AS VARCHAR) AS body FROM documents UNION ALL SELECT doc_id, 'C_' || (doc_id % 11), 'class C_' || (doc_id % 11), '' FROM documents"
_BLOCKS = f"""WITH a AS ({_A_BLOCKS}), b AS ({_B_BLOCKS}), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.name, b.name) AS name, a.sig AS old_signature, b.sig AS new_signature,
 CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.sig <> b.sig OR a.body <> b.body THEN 'modified' ELSE 'same' END AS state
 FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.name = b.name)"""


def _block_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda content: structural.exploded_blocks(_corpus(spark, sf_dir, content).select(F.col("doc_id").cast("string").alias("path"), F.lit("javascript").alias("lang"), "content"))
    return structural.block_changes(side(JS), side(JS_LATER))


query_of("block_diff", f"{_BLOCKS} SELECT doc_id, name, state, old_signature, new_signature FROM j")(
    lambda s, d: _block_changes(s, d).select(F.col("path").cast("long").alias("doc_id"), "name", "state", "old_signature", "new_signature")
)
query_of(
    "repo_map_diff",
    f"{_BLOCKS} SELECT doc_id, concat('### ', doc_id, chr(10), string_agg(CASE WHEN state = 'added' THEN '+ ' || new_signature || chr(10) WHEN state = 'deleted' THEN '- ' || old_signature || chr(10) WHEN old_signature <> new_signature THEN '~ ' || old_signature || chr(10) || '  -> ' || new_signature || chr(10) ELSE '  ' || old_signature || '  (body changed)' || chr(10) END, '' ORDER BY name)) AS content FROM j WHERE state <> 'same' GROUP BY doc_id",
)(lambda s, d: structural.signature_lines(_block_changes(s, d)).select(F.col("path").cast("long").alias("doc_id"), "content"))
# Splitting and packing

_PARAS = "concat('intro ', doc_id, chr(10), chr(10), text, chr(10), chr(10), 'tail')"
query_of(
    "split_paragraph",
    f"WITH p AS (SELECT doc_id, string_split({_PARAS}, chr(10) || chr(10)) AS x FROM documents), n AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, x FROM p) SELECT doc_id, i - 1 AS at, CASE WHEN i = 1 THEN trim(x[i]) ELSE chr(10) || chr(10) || x[i] END AS section FROM n",
)(lambda s, d: _corpus(s, d, _PARAS).select("doc_id", F.posexplode(splitting.sections(_c(), splitting.PARAGRAPH)).alias("at", "section")).withColumn("at", F.col("at").cast("long")))
_MARKED = "concat('=== ', doc_id, chr(10), '=== second', chr(10), '=== ')"
query_of("split_marker", "SELECT doc_id, CAST(0 AS BIGINT) AS at, '=== ' || doc_id || chr(10) AS section FROM documents UNION ALL SELECT doc_id, 1, '=== second' || chr(10) FROM documents")(
    lambda s, d: _corpus(s, d, _MARKED).select("doc_id", F.posexplode(splitting.sections(_c(), "=== ")).alias("at", "section")).withColumn("at", F.col("at").cast("long"))
)
query_of(
    "oversized_char_split",
    "WITH n AS (SELECT doc_id, text, unnest(range(0, length(text), 803)) AS i FROM documents) SELECT doc_id, i // 803 AS chunk_no, substr(text, i + 1, 803) AS chunk FROM n",
)(lambda s, d: _docs(s, d).select("doc_id", F.posexplode(splitting.char_chunks(_c("text"), 200)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long")))
#: lines of each document joined within the limit, each that is over it alone; a single line goes by characters
_LINES = "SELECT doc_id, i, line, greatest(1, length(line) // 4) AS n FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE length(text) // 4 > 200))"
query_of(
    "oversized_chunks",
    f"""WITH RECURSIVE l AS ({_LINES}), f AS (SELECT doc_id, i, line, n, CAST(n AS BIGINT) AS held, CAST(0 AS BIGINT) AS chunk FROM l WHERE i = 1 UNION ALL
 SELECT l.doc_id, l.i, l.line, l.n, CAST(CASE WHEN l.n > 200 OR f.n > 200 OR f.held + l.n > 200 THEN l.n ELSE f.held + l.n END AS BIGINT), CASE WHEN l.n > 200 OR f.n > 200 OR f.held + l.n > 200 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
 c AS (SELECT doc_id, chunk AS chunk_no, string_agg(line, chr(10) ORDER BY i) AS content, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM f GROUP BY doc_id, chunk),
 p AS (SELECT doc_id, content, unnest(range(0, length(content), 803)) AS pos FROM c WHERE n_chunks = 1)
 SELECT doc_id, chunk_no, n_chunks, greatest(1, length(content) // 4) AS tokens, content FROM c WHERE n_chunks > 1
 UNION ALL SELECT doc_id, pos // 803, count(*) OVER (PARTITION BY doc_id), greatest(1, length(substr(content, pos + 1, 803)) // 4), substr(content, pos + 1, 803) FROM p
 UNION ALL SELECT doc_id, 0, 1, greatest(1, length(text) // 4), text FROM documents WHERE length(text) // 4 <= 200""",
)(lambda s, d: splitting.exploded(_corpus(s, d).select("doc_id", "content"), 200).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n_chunks").cast("long").alias("n_chunks"), "tokens", "content"))


_PACK = _fold("source", "doc_id", "documents", "greatest(1, length(text) // 4)", LIMIT)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("source", "doc_id", text.count_tokens(_c("text")).alias("tokens"))
    return packing.part_map(rows, LIMIT, "source", ["doc_id"])


query_of("pack_parts", f"{_PACK} SELECT g AS source, doc_id, tokens, part FROM f")(_packed)
query_of("pack_part_tokens", f"{_PACK} SELECT g AS source, part, count(*) AS sections, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY g, part")(
    lambda s, d: _packed(s, d).groupBy("source", "part").agg(F.count("*").alias("sections"), F.sum("tokens").alias("tokens"))
)
query_of(
    "pack_conversations",
    f"{_fold('conv_id', 'turn', 'conversations', 'greatest(1, length(text) // 4)', 8000)} SELECT g AS conv_id, turn, tokens, part FROM f",
)(lambda s, d: packing.part_map(_docs(s, d, "conversations").select("conv_id", "turn", text.count_tokens(_c("text")).alias("tokens")), 8000, "conv_id", ["turn"]))
query_of(
    "pack_lineitem",
    f"{_fold('l_returnflag', 'l_orderkey, l_linenumber, l_partkey, l_quantity', 'lineitem', 'l_quantity', 500)} SELECT g AS l_returnflag, part, count(*) AS sections, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY g, part",
)(
    lambda s, d: packing.part_map(_docs(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_quantity").cast("bigint").alias("tokens")), 500, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    .groupBy("l_returnflag", "part")
    .agg(F.count("*").alias("sections"), F.sum("tokens").alias("tokens"))
)
query_of(
    "part_assembly",
    f"{_PACK} SELECT g AS source, part, sha256(string_agg(d.text, chr(10) || chr(10) ORDER BY d.doc_id)) AS digest FROM f JOIN documents d ON d.doc_id = f.doc_id GROUP BY g, part",
)(
    lambda s, d: packing.assembled(_packed(s, d).join(_docs(s, d).select("source", "doc_id", F.col("text").alias("content")), ["source", "doc_id"]), "source", ["doc_id"]).select("source", "part", F.sha2("content", 256).alias("digest"))
)
# Snapshots and the store

_SIDES = f"""a AS (SELECT {PATH} AS path, sha256(text) AS sha, text FROM documents WHERE doc_id % 10 <> 0),
 b AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE '' END || {PATH} AS path, sha256(t) AS sha, t AS text FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN text || ' suffix' ELSE text END AS t FROM documents) WHERE doc_id % 10 <> 1),
 c AS (SELECT coalesce(a.path, b.path) AS path, a.sha AS old_sha, b.sha AS new_sha, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.sha <> b.sha THEN 'modified' ELSE 'same' END AS state FROM a FULL JOIN b ON a.path = b.path)"""
_GROUPS = f"""WITH {_SIDES}, g AS (SELECT coalesce(old_sha, new_sha) AS sha256, count(*) FILTER (state = 'deleted') AS n_deleted, count(*) FILTER (state = 'added') AS n_added,
 min(path) FILTER (state = 'deleted') AS old_path, min(path) FILTER (state = 'added') AS new_path FROM c WHERE state IN ('added', 'deleted') GROUP BY 1 HAVING n_deleted > 0 AND n_added > 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots A and B: path, sha256, content."""
    corpus = _corpus(spark, sf_dir)
    later = corpus.where("doc_id % 10 <> 1").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.col("content"), F.lit(" suffix"))).otherwise(F.col("content")).alias("content"))
    hashed = lambda df: df.select("path", F.sha2("content", 256).alias("sha256"), "content")
    return hashed(corpus.where("doc_id % 10 <> 0").select("path", "content")), hashed(later)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return D.classified(a, b)


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.union(b).select("sha256", "content").dropDuplicates(["sha256"])


query_of("diff_classify", f"WITH {_SIDES} SELECT path, old_sha, new_sha, state FROM c")(_classified)
query_of("diff_stats", f"WITH {_SIDES} SELECT state, count(*) AS files FROM c GROUP BY state")(lambda s, d: _classified(s, d).groupBy("state").agg(F.count("*").alias("files")))
_KIND = "CASE WHEN od = nd AND ob <> nb THEN 'renamed' WHEN od <> nd AND ob = nb THEN 'moved' ELSE 'renamed' END"
_VERB = "CASE WHEN od = nd AND ob <> nb THEN 'RENAMED' WHEN od <> nd AND ob = nb THEN 'MOVED' ELSE 'MOVED AND RENAMED' END"
query_of(
    "rename_exact",
    f"{_GROUPS}, p AS (SELECT *, regexp_replace(old_path, '/[^/]*$', '') AS od, regexp_replace(new_path, '/[^/]*$', '') AS nd, string_split(old_path, '/')[-1] AS ob, string_split(new_path, '/')[-1] AS nb FROM g WHERE n_deleted = 1 AND n_added = 1) SELECT {_KIND} AS type, new_path AS path, old_path, CAST(1 AS DOUBLE) AS similarity, {_VERB} || ': ' || old_path || ' -> ' || new_path || chr(10) AS content FROM p",
)(lambda s, d: D.exact_renames(D.hash_groups(_classified(s, d))))
query_of("rename_ambiguous", f"{_GROUPS} SELECT sha256, n_deleted, n_added FROM g WHERE n_deleted > 1 OR n_added > 1")(
    lambda s, d: D.hash_groups(_classified(s, d)).where("n_deleted > 1 or n_added > 1").select("sha256", "n_deleted", "n_added")
)


def _rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _classified(spark, sf_dir)
    return D.unmatched(changes, D.hash_groups(changes))


#: Files whose texts begin alike and end in a character of their own: the shorter beginning is what two have in common.
_BEGUN = "".join(chr(0x4E00 + i) for i in range(200))
_OWN = "20 + (doc_id * 37) % 170"
_PLANTED = f"""p AS (SELECT doc_id % 2 AS new, concat('f/', doc_id, '.x', (doc_id // 2) % 40) AS path, (doc_id // 2) % 40 AS ext, {_OWN} AS m, md5(concat(substr('{_BEGUN}', 1, {_OWN}), chr(CAST(24576 + doc_id % 12000 AS INTEGER)))) AS k FROM documents),
 u AS (SELECT * FROM p WHERE k NOT IN (SELECT k FROM p GROUP BY k HAVING count(DISTINCT new) > 1)),
 e AS (SELECT o.ext, o.path AS old_path, n.path AS new_path, 2 * least(o.m, n.m) / CAST(o.m + n.m + 2 AS DOUBLE) AS ratio FROM u AS o JOIN u AS n ON o.ext = n.ext AND o.new = 0 AND n.new = 1 WHERE 2 * least(o.m, n.m) > 0.7 * (o.m + n.m + 2)),
 c AS (SELECT ext, old_path, list(new_path ORDER BY new_path) AS near, row_number() OVER (PARTITION BY ext ORDER BY old_path) AS rn FROM e GROUP BY ext, old_path)"""


@query_of(
    "rename_greedy",
    f"""WITH RECURSIVE {_PLANTED}, f AS (SELECT ext, rn, old_path, near[1] AS new_path, [near[1]] AS taken FROM c WHERE rn = 1 UNION ALL
 SELECT ext, rn, old_path, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM (SELECT c.ext, c.rn, c.old_path, f.taken, list_filter(c.near, lambda x: NOT list_contains(f.taken, x))[1] AS pick FROM f JOIN c ON c.ext = f.ext AND c.rn = f.rn + 1))
 SELECT f.old_path, f.new_path, round(ratio, 9) AS ratio FROM f JOIN e ON e.old_path = f.old_path AND e.new_path = f.new_path""",
)
def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowds of files of an extension that resemble each other, matched in order."""
    own = F.concat(F.expr(f"substring('{_BEGUN}', 1, CAST({_OWN} AS INT))"), F.expr("decode(unhex(hex(24576 + doc_id % 12000)), 'UTF-16BE')"))
    rows = _docs(spark, sf_dir).select(F.expr("concat('f/', doc_id, '.x', doc_id div 2 % 40)").alias("path"), own.alias("content"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("side")).withColumn("sha256", F.sha2("content", 256))
    of = lambda side: rows.where(F.col("side") == side).select("path", "sha256")
    changes = stored(D.classified(of("old"), of("new")), "classified")
    rest = D.unmatched(changes, D.hash_groups(changes))
    return D.matches(rest, rows.select("sha256", "content").dropDuplicates(["sha256"])).select("old_path", "new_path", F.round("ratio", 9).alias("ratio"))


query_of("rename_similar")(lambda s, d: D.similar_renames(_rest(s, d), _contents(s, d)))
#: only the last line of a modified document differs
_LAST = "(len(string_split(o.text, chr(10))))"
query_of(
    "text_diff_modified",
    f"WITH {_SIDES} SELECT c.path, concat('### ', c.path, chr(10), chr(10), 'REMOVED lines ', {_LAST}, ':', chr(10), '    ', string_split(o.text, chr(10))[-1], chr(10), chr(10), 'ADDED lines ', {_LAST}, ':', chr(10), '    ', string_split(o.text, chr(10))[-1], ' suffix', chr(10)) AS content FROM c JOIN a o ON o.path = c.path WHERE state = 'modified'",
)(
    lambda s, d: _classified(s, d)
    .where("state = 'modified'")
    .join(_contents(s, d).select(F.col("sha256").alias("old_sha"), F.col("content").alias("old")), "old_sha")
    .join(_contents(s, d).select(F.col("sha256").alias("new_sha"), F.col("content").alias("new")), "new_sha")
    .select("path", textdiff.text_diffs()("old", "new", "path").alias("content"))
)


@query_of("diff_grouped")
def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    sections = D.file_sections(a, b, _contents(spark, sf_dir))
    counts = D.stats(sections).first().asDict()
    return D.grouped(sections, D.summary(counts, "a", "b"))


query_of("diff_section_stats")(lambda s, d: D.stats(D.file_sections(*_sides(s, d), _contents(s, d))))
_STORE = f"WITH {_SIDES}, o AS (SELECT sha, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS n FROM (SELECT sha, text FROM a UNION ALL SELECT sha, text FROM b) GROUP BY sha), u AS (SELECT sha, count(*) AS uses FROM b GROUP BY sha)"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select("sha256", F.octet_length("content").cast("bigint").alias("stored_bytes"))


query_of(
    "store_shares",
    f"{_STORE}, s AS (SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS total_bytes, CAST(sum(n) FILTER (uses > 0) AS BIGINT) AS unique_bytes, CAST(sum(n * uses) AS BIGINT) AS logical_bytes FROM o LEFT JOIN u USING (sha)) SELECT objects, total_bytes, unique_bytes, round_even((1 - unique_bytes / total_bytes) * 100, 1) AS dedup_pct, round_even((1 - unique_bytes / logical_bytes) * 100, 1) AS logical_dedup_pct FROM s",
)(lambda s, d: store.store_stats(_objects(s, d), _sides(s, d)[1].select("sha256")))
query_of("store_gc", f"{_STORE} SELECT o.sha AS sha256, o.n AS stored_bytes FROM o WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.sha = o.sha)")(lambda s, d: store.orphans(_objects(s, d), _sides(s, d)[1].select("sha256").distinct()))
# Incremental collection: the cache is of the earlier state; some times moved by a little or by much, some contents changed


def _stat(rows: DataFrame, later: bool) -> DataFrame:
    i = F.col("doc_id")
    content = F.when(i % 17 == 0, F.concat(F.col("content"), F.lit("!"))).otherwise(F.col("content")) if later else F.col("content")
    moved = F.when(i % 5 == 0, 2_000_000).when(i % 5 == 1, 500_000).otherwise(0) if later else F.lit(0)
    return rows.select("path", F.octet_length(content).cast("bigint").alias("size"), (i * 1_000_000_000 + moved).cast("bigint").alias("mtime_ns"), F.sha2(content, 256).alias("sha256"))


query_of(
    "incremental_changes",
    f"SELECT {PATH} AS path, CASE WHEN doc_id % 9 = 0 THEN 'new' WHEN doc_id % 8 = 0 THEN 'deleted' WHEN doc_id % 17 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents WHERE NOT (doc_id % 9 = 0 AND doc_id % 8 = 0)",
)(lambda s, d: incremental.changes(_stat(_corpus(s, d).where("doc_id % 8 <> 0"), True), _stat(_corpus(s, d).where("doc_id % 9 <> 0"), False)))
query_of("cache_update", f"SELECT {PATH} AS path, doc_id % 8 <> 0 AS fresh FROM documents WHERE NOT (doc_id % 9 = 0 AND doc_id % 8 = 0)")(
    lambda s, d: incremental.updated(_stat(_corpus(s, d).where("doc_id % 8 <> 0"), True).withColumn("sha256", F.lit("fresh")), _stat(_corpus(s, d).where("doc_id % 9 <> 0"), False)).select("path", (F.col("sha256") == "fresh").alias("fresh"))
)

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: formatted, compressed, packed by source; sections and tokens of each part.

    The heading and the body of an oversized section are parts of their own also where their rounded tokens sum up to the limit.
    """
    content = text.compress(formatting.section(_c("path"), languages.resolve_lang(_c("path"), _c()), _c()))
    chunks = splitting.exploded(_corpus(spark, sf_dir).select("source", "doc_id", content.alias("content")), 2000, joint=True)
    chunks = stored(chunks.select("source", "doc_id", "chunk_no", "tokens", "oversized"), "chunks")
    mapped = packing.part_map(chunks, 2000, "source", ["doc_id", "chunk_no"], "oversized")
    return mapped.groupBy("source", "part").agg(F.count("*").alias("sections"), F.sum("tokens").alias("tokens"))


#: an oversized section has two paragraphs, its heading and its body, which are parts of their own
_FLAG = f"SELECT source, doc_id, greatest(1, length(trim(t, ' ' || chr(10))) // 4) AS n, {PATH} AS path FROM (SELECT *, concat('### ', {PATH}, chr(10), chr(10), '```', chr(10), text, chr(10), '```', chr(10)) AS t FROM documents)"
_CHUNKS = f"SELECT source, doc_id, 0 AS chunk_no, CASE WHEN n > 2000 THEN greatest(1, length('### ' || path) // 4) ELSE n END AS n, n > 2000 AS alone FROM ({_FLAG}) UNION ALL SELECT source, doc_id, 1, greatest(1, (length(text) + 8) // 4), true FROM documents JOIN (SELECT doc_id, n FROM ({_FLAG})) USING (doc_id) WHERE n > 2000"
query_of(
    "collect_flagship",
    f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_no) AS rn FROM ({_CHUNKS})),
 f AS (SELECT source, n, alone, rn, CAST(n AS BIGINT) AS held, CAST(1 AS BIGINT) AS part FROM c WHERE rn = 1 UNION ALL
 SELECT c.source, c.n, c.alone, c.rn, CAST(CASE WHEN c.alone OR f.alone OR f.held + c.n > 2000 THEN c.n ELSE f.held + c.n END AS BIGINT), CASE WHEN c.alone OR f.alone OR f.held + c.n > 2000 THEN f.part + 1 ELSE f.part END FROM f JOIN c ON c.source = f.source AND c.rn = f.rn + 1)
 SELECT source, part, count(*) AS sections, CAST(sum(n) AS BIGINT) AS tokens FROM f GROUP BY source, part""",
)(flagship)

from corpusloom import code_queries, mode_queries, scan_queries, tree_queries  # noqa: E402, F401  they register theirs
