"""The registered query of each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bm25_wand, bpe_codec, fill_middle, license_scan, media_sniff, quality_cascade, quality_qda, simhash_ball, source_divergence, source_mix, suffix_dedup, token_files, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica of the archive has a damaged first byte in the pages of every 97th id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = (F.col("page_id") % 97 == 13) & (F.length("html") > 0)
    replica = pages.withColumn("html", F.when(rotten, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    return warc_fixity.audit(pages, replica).select("page_id", "file", "offset", "length", "digest", "intact")


_RECORD = """concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url,
 chr(13), chr(10), 'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10))"""

OP2_SQL = f"""
WITH records AS (SELECT page_id, page_id // 1024 AS file, {_RECORD} AS record, page_id % 97 = 13 AND length(html) > 0 AS rotten FROM pages)
SELECT page_id, file, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
 CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest, NOT rotten AS intact
FROM records
"""


def op3_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bm25_wand.search(docs, docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text"))


OP3_SQL = r"""
WITH t AS (SELECT r, doc_id, term, count(*) AS n FROM (SELECT r, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)) GROUP BY ALL),
 l AS (SELECT r, sum(n) AS len FROM t GROUP BY r),
 c AS (SELECT count(*) AS docs, greatest(1, (SELECT sum(len) FROM l) / greatest(1, count(*))) AS mean FROM documents),
 f AS (SELECT term, ln(1 + (docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, c GROUP BY term, docs),
 s AS (SELECT q.r AS asked, q.doc_id AS query_id, t.r AS place, t.doc_id, round(sum(q.n * idf * (t.n * 2.2::DOUBLE / (t.n + 1.2::DOUBLE * (0.25 + 0.75 * len / mean))) ORDER BY term), 9) AS score FROM t AS q JOIN f USING (term) JOIN t USING (term) JOIN l ON l.r = t.r, c WHERE q.doc_id % 20 = 0 GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id, place) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM n WHERE rank <= 10
"""


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_back(written)


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_qda.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= quality_qda.KEEP_AT, 1).otherwise(0)
    return scored.select("doc_id", quality_qda.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(_table(spark, sf_dir, "documents")))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i FROM d)),
 p AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
 g AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p)),
 s AS (SELECT r, min(i) AS b, max(i) + 200 AS e FROM g GROUP BY r, span),
 a AS (SELECT r, count(*) AS n_spans, CAST(sum(e - b) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS head, max(e) AS last FROM (SELECT s.*, h, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS before FROM s JOIN d USING (r)) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('a' || source, 'z') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'none'), ':', coalesce(text, ''), ':17')) AS mark FROM documents),
 s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
 r AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
 f AS (SELECT *, cap / w AS full_at, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r),
 l AS (SELECT coalesce(arg_min(rest / open, {'full_at': full_at, 'src': src}) FILTER (full_at >= rest / open), 'inf'::DOUBLE) AS level FROM f),
 t AS (SELECT src, source_size, least(cap, level * w) AS target, CAST('0x' || substr(md5(src || ':17'), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE AS shift FROM f, l),
 n AS (SELECT d.*, row_number() OVER (PARTITION BY src ORDER BY floor(16 * ln(size + 1.0::DOUBLE) / 0.6931471805599453::DOUBLE + 1e-9::DOUBLE) DESC, substr(mark, 1, 2), size DESC, mark) AS pos FROM d),
 c AS (SELECT n.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(shift + target / source_size * pos) - floor(shift + target / source_size * (pos - 1)) AS BIGINT) ELSE 0 END AS copies FROM n JOIN t USING (src))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.cascade(_table(spark, sf_dir, "documents"))


_BLANK = r"\x20\x09-\x0D"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w FROM documents),
 l AS (SELECT *, len(w) AS n, greatest(len(w), 1) AS of_n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS lines, list_filter(string_split_regex(text, '\n[\x20\t]*\n'), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS paras FROM d),
 g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 twice AS (SELECT row, gram FROM g GROUP BY ALL HAVING count(*) > 1),
 covered AS (SELECT row, count(DISTINCT i + k) AS n FROM g JOIN twice USING (row, gram), (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
 b AS (SELECT l.*, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(paras) - len(list_distinct(paras)) AS n_dup_paras, coalesce(covered.n, 0) AS n_repeat_words FROM l LEFT JOIN covered USING (row)),
 v AS (SELECT *, n < 50 OR 100 * n_repeat_words > 50 * n AS base_failed,
 n_symbols / of_n > 0.1 OR word_chars / of_n < 2 OR word_chars / of_n > 20 OR (n_dup_lines > 2 AND n_dup_lines / greatest(n_lines, 1) > 0.3) OR (n_dup_paras > 2 AND n_dup_paras / greatest(len(paras), 1) > 0.3)
 OR len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z]{{2,}}[^a-z]*$'))) / of_n > 0.3 OR (length(text) - length(replace(text, '!', ''))) / of_n > 0.15 OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / of_n < 0.7
 OR len(regexp_extract_all(text, '(?m)(?:\.\.\.|…)[ \t]*$')) / greatest(n_lines, 1) > 0.3 OR len(regexp_extract_all(text, '(?m)^[ \t]*[-*•]')) / greatest(n_lines, 1) > 0.9 OR len(list_distinct(w)) / of_n < 0.05
 OR (n >= 100 AND NOT regexp_matches(lower(array_to_string(w, ' ')), '(?:^| )(?:{"|".join(quality_cascade.FUNCTION_WORDS)})(?: |$)')) OR len(list_filter(w, lambda x: length(x) > 1000)) > 0 AS rejected FROM b)
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v
"""


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe_codec.encode(_table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe_codec.digests(bpe_codec.decode(encoded, ranks, pattern))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(_table(spark, sf_dir, "documents")))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+') AS units, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
 h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, [CAST('0x' || substr(mark, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d),
 r AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS first, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS second,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, coalesce(array_to_string(units[1:first], ''), '') AS prefix, coalesce(array_to_string(units[first + 1:second], ''), '') AS middle, coalesce(array_to_string(units[second + 1:], ''), '') AS suffix FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op12_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sniff.features(media_sniff.store(_table(spark, sf_dir, "documents")))


def _little(x: str, size: int = 4) -> str:
    """Hexadecimal digits of a number, lowest byte first."""
    return "concat(" + ", ".join(f"printf('%02X', (({x}) >> {8 * i}) & 255)" for i in range(size)) + ")"


def _big(x: str) -> str:
    return f"printf('%08X', {x})"


def _hex(x: str) -> str:
    return f"hex(encode({x}))"


_WAV = f"concat({_hex(repr('RIFF'))}, {_little('36 + n')}, {_hex(repr('WAVEfmt '))}, '10000000', '01000100', {_little('8000')}, {_little('8000')}, '01000800', {_hex(repr('data'))}, {_little('n')}, body)"
_BMP = f"concat('424D', {_little('1078 + n')}, '00000000', {_little('1078')}, '28000000', '18000000', {_little('(4294967296 - n // 24)')}, '0100', '0800', '00000000', {_little('n')}, '0000000000000000', '00010000', '00000000', array_to_string([printf('%02X%02X%02X00', i, i, i) FOR i IN range(256)], ''), body)"
_PNM = "concat(hex(encode(concat('P5', chr(10), '24 ', n // 24, chr(10), '255', chr(10)))), body)"
_AU = f"concat({_hex(repr('.snd'))}, '00000018', {_big('n')}, '00000002', '00001F40', '00000001', body)"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents),
 p AS (SELECT row, doc_id, length(raw) // 2 AS n_bytes, raw || repeat('FF', CASE WHEN raw = '' THEN 576 ELSE (576 - length(raw) // 2 % 576) % 576 END) AS body FROM d),
 s AS (SELECT *, length(body) // 2 AS n, sha256(unhex(body)) AS sha FROM p),
 k AS (SELECT *, ['audio/wav', 'image/bmp', 'image/x-portable-anymap', 'audio/basic'] AS kinds, CAST('0x' || substr(sha, 1, 2) AS INTEGER) % 4 + 1 AS which, CAST('0x' || substr(sha, 3, 2) AS INTEGER) % 4 AS how FROM s),
 m AS (SELECT *, CASE which WHEN 1 THEN {_WAV} WHEN 2 THEN {_BMP} WHEN 3 THEN {_PNM} ELSE {_AU} END AS media FROM k),
 b AS (SELECT *, length(media) // 2 AS size, CASE WHEN how = 3 THEN hex(encode(concat('DUMP ', length(media) // 2, chr(13), chr(10), chr(13), chr(10)))) ELSE '' END AS lead FROM m),
 f AS (SELECT *, CASE WHEN how = 3 THEN lead || media || hex(encode(concat(chr(13), chr(10), 'END', chr(13), chr(10)))) ELSE media END AS blob,
 [CAST('0x' || x AS UBIGINT) FOR x IN regexp_extract_all(body, '..')] AS bytes FROM b),
 t AS (SELECT [list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) FOR i IN range(256)] AS crc)
SELECT doc_id, n_bytes, n AS payload_bytes, sha AS payload_sha256, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes[n - 31:]), lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS tail_crc32,
 length(blob) // 2 AS media_bytes, sha256(unhex(blob)) AS media_sha256,
 concat(CASE how WHEN 0 THEN kinds[which] WHEN 1 THEN kinds[which % 4 + 1] WHEN 2 THEN '-' ELSE 'application/octet-stream' END, ' > ', CASE how WHEN 3 THEN 'application/octet-stream' ELSE kinds[which] END, ': ', kinds[which], ' ', length(lead) // 2, '+', size, ' ',
 CASE WHEN which IN (2, 3) THEN concat('24x', n // 24) ELSE concat('1x', n) END, ' ', list_sum(bytes)::BIGINT) AS feature
FROM f, t
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
 k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
 s AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
 p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM s JOIN v USING (lang)),
 q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 5) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v))::HUGEINT AS q FROM s JOIN v USING (lang) GROUP BY lang, term),
 a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
 r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_bm25_search": op3_bm25_search,
    "op4_token_files": op4_token_files,
    "op5_quality_qda": op5_quality_qda,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_fill_middle": op11_fill_middle,
    "op12_media_sniff": op12_media_sniff,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op2_warc_fixity": OP2_SQL, "op3_bm25_search": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op7_source_mix": OP7_SQL, "op8_quality_cascade": OP8_SQL,
    "op11_fill_middle": OP11_SQL, "op12_media_sniff": OP12_SQL, "op13_source_divergence": OP13_SQL,
}
