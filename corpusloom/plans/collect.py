"""Collection: scan, format, query, compress, pack; as plans over tables, and as files on the driver."""

from __future__ import annotations

import dataclasses
import time
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import predicates
from corpusloom.functions.formatting import binary_section, section
from corpusloom.functions.languages import resolve_lang
from corpusloom.functions.parsers import header, header_parts, signatures
from corpusloom.functions.text import compress, count_tokens, decoded, line_numbers, percent
from corpusloom.functions.tokenizers import load
from corpusloom.operators import incremental, packing, query, splitting
from corpusloom.plans.profiles import Profile
from corpusloom.shared import stored
from corpusloom.sources import commands, files, gitignore, part_files
from corpusloom.sources.walk import Walk

GROUP = "profile"


#: The folder below a tree's root for its store, its cache and the log of its commands.
STORE = ".corpusloom"


def excludes(profile: Profile, root: Path) -> list[str]:
    """What a profile and the tree's ignore files leave out, and what this library keeps beside the tree."""
    return [*profile.exclude_patterns, STORE, f"{STORE}/*", *(gitignore.load(root) if profile.use_gitignore else [])]


def formatted(corpus: DataFrame, profile: Profile, mode: str = "full", with_header: bool = False) -> DataFrame:
    """``(path, content, deps, raw_tokens)`` and the columns that order ``corpus`` (path, size, content), its files in the profile's form.

    Headers and signatures are read from the raw text, whatever the numbering.
    """
    p = profile
    path, size, raw = F.col("path"), F.col("size"), F.col("content")
    left = corpus.where(raw.isNotNull() & ~predicates.skip_binary(path, size, raw, p.include_binary, p.binary_extensions, p.binary_max_mb))
    rows = left.withColumn("text", decoded(raw))
    rows = rows.withColumn("lang", resolve_lang(path, F.col("text")))
    text, lang = F.col("text"), F.col("lang")
    deps, exports = header_parts(text, lang)
    rows = rows.withColumn("deps", F.coalesce(deps, F.array().cast("array<string>"))).withColumn("exports", F.coalesce(exports, F.array().cast("array<string>")))
    body = signatures(text, lang) if mode == "repo-map" else line_numbers(text) if p.line_numbers else text
    head = header(path, F.col("deps"), F.col("exports")) if with_header or mode == "headers" else F.lit("")
    whole = F.concat(head, section(path, lang, body, p.section_format))
    allowed = F.lit(p.include_binary) & predicates.binary_allowed(path, size, p.binary_extensions, p.binary_max_mb)
    content = F.when(text.isNotNull(), whole).when(allowed, binary_section(path, raw, p.section_format))
    return rows.withColumn("content", content).where("content is not null").drop("text", "lang", "exports")


@dataclasses.dataclass(frozen=True)
class Collected:
    """``sections`` (seq, path, content, tokens, part …) and ``parts`` (part, content, tokens, n_sections)."""

    sections: DataFrame
    parts: DataFrame


def _packed(sections: DataFrame, max_tokens: int, tokens, strict: bool) -> Collected:
    """Sections ``(GROUP, seq, path, content, raw_tokens)`` as parts that count from 1 in each group."""
    chunks = splitting.exploded(sections, max_tokens, "content", tokens, strict=strict)
    chunks = stored(chunks, "chunks") if max_tokens != -1 else chunks.withColumn("oversized", F.lit(False))
    mapped = packing.part_map(chunks, max_tokens, GROUP, ["seq", "chunk_no"], "oversized")
    placed = chunks.drop("tokens").join(mapped, [GROUP, "seq", "chunk_no"])
    marked = placed.withColumn("content", packing.continuation(F.col("content"), F.col("chunk_no"), F.col("n_chunks"), F.col("part")))
    return Collected(placed, packing.assembled(marked, GROUP, ["seq", "chunk_no"]))


def pack(sections: DataFrame, profile: Profile, tokens, strict: bool = False) -> Collected:
    """Sections ``(seq, path, content)`` as parts; ``raw_tokens``, if they have it, is carried along."""
    if "raw_tokens" not in sections.columns:
        sections = sections.withColumn("raw_tokens", count_tokens(F.col("content"), profile.chars_per_token))
    found = _packed(sections.withColumn(GROUP, F.lit(profile.name_template)), profile.max_tokens, tokens, strict)
    return Collected(found.sections, found.parts.drop(GROUP))


def corpus_sections(corpus: DataFrame, profile: Profile, order: list[Column], mode: str = "full", text_query: str | None = None, pre: list[tuple[str, str]] = (), include_pre: bool = False) -> DataFrame:
    """``(seq, path, content)``, seq to order by, outputs of commands first; filtered by the query."""
    asked = bool(query.query_words(text_query or ""))
    rows = corpus.where(~predicates.excluded(F.col("path"), list(profile.exclude_patterns)))
    made = formatted(rows, profile, mode, with_header=asked)
    if asked:  # hits, imports and what is kept are all read from what was formatted once
        made = query.filtered(stored(made, "formatted"), text_query)
    kind = "struct<kind:int,dir_no:int,pattern_no:int,components:array<string>>"
    made = made.select("path", "content", F.struct(F.lit(1), *order).cast(kind).alias("seq"))
    if pre and (include_pre or not asked):
        first = corpus.sparkSession.createDataFrame([(label, out, i) for i, (label, out) in enumerate(pre)], "path string, content string, i int")
        made = made.unionByName(first.select("path", "content", F.struct(F.lit(0), "i", F.lit(0), F.array(F.lit(""))).cast(kind).alias("seq")))
    made = made.withColumn("raw_tokens", count_tokens(F.col("content"), profile.chars_per_token))
    return made.withColumn("content", compress(F.col("content"))) if profile.compress else made


def listed(spark: SparkSession, root: str | Path, profile: Profile) -> DataFrame:
    """Names and sizes of a profile's files; folders that it excludes are never opened. ``exclude_patterns`` are taken as they are."""
    return files.listing(spark, root, list(profile.directories), list(profile.patterns), list(profile.files), list(profile.exclude_patterns), max_file_bytes=profile.max_file_bytes)


def read(rows: DataFrame, root: str | Path) -> DataFrame:
    """Listed files with their contents and hashes."""
    return files.contents(rows, root).withColumn("sha256", incremental.file_hash(F.col("content"), F.col("size")))


def scanned(spark: SparkSession, root: str | Path, profile: Profile) -> DataFrame:
    """The files of a profile, with their hashes."""
    return read(listed(spark, root, profile), root)


def left_out(corpus: DataFrame, profile: Profile) -> DataFrame:
    """``(path, reason)`` of the files of a corpus that a collection leaves out: too large, unreadable, binary, or no text."""
    p, path, size, raw = profile, F.col("path"), F.col("size"), F.col("content")
    binary = predicates.skip_binary(path, size, raw, p.include_binary, p.binary_extensions, p.binary_max_mb)
    shown = F.lit(p.include_binary) & predicates.binary_allowed(path, size, p.binary_extensions, p.binary_max_mb)
    reason = (
        F.when(F.col("error") == "too large", "too large").when(F.col("error").isNotNull() | raw.isNull(), F.concat(F.lit("unreadable: "), F.coalesce("error", F.lit("no content"))))
        .when(binary, predicates.skip_reason(path, size, p.include_binary, p.binary_extensions, p.binary_max_mb)).when(decoded(raw).isNull() & ~shown, "no text")
    )
    return corpus.where(~predicates.excluded(path, list(p.exclude_patterns))).select("path", reason.alias("reason")).where("reason is not null")


def collect(spark: SparkSession, root: str | Path, profile: Profile, mode: str = "full", text_query: str | None = None, cache: DataFrame | None = None, allow_commands: bool = False, include_pre: bool = False, strict: bool = False, corpus: DataFrame | None = None) -> Collected:
    """The parts of a tree, or of a ``corpus`` that was scanned before. With a ``cache``, of its new and changed files only; a command takes the place of files."""
    root = Path(root)
    tokens = load(profile.tokenizer, root, profile.chars_per_token, spark=spark)
    log = root / STORE / commands.AUDIT
    pre = commands.run_all(list(profile.pre_commands), root, allow_file_args=True, log=log) if allow_commands else []
    if profile.command is not None:
        out = commands.run(profile.command, root, allow_file_args=True, log=log) if allow_commands else ""
        one = spark.createDataFrame([(out,)], "text string")
        split = one.select(F.posexplode(splitting.split_text(F.col("text"), profile.max_tokens, profile.split_mode, profile.split_marker)).alias("seq", "content"))
        return pack(split.select(F.col("seq").cast("bigint").alias("seq"), F.lit(profile.command[:50]).alias("path"), "content"), profile, tokens, strict)
    profile = dataclasses.replace(profile, exclude_patterns=tuple(excludes(profile, root)))
    corpus = scanned(spark, root, profile) if corpus is None else corpus
    if cache is not None:
        due = incremental.changes(corpus, cache).where("state in ('new', 'changed')")
        corpus = corpus.join(due.select("path"), "path", "left_semi")
    return pack(corpus_sections(corpus, profile, files.in_order(), mode, text_query, pre, include_pre), profile, tokens, strict)


def _place(walk: Walk, profile: Profile) -> Column:
    """The directory and pattern for which a profile takes a path, as ``Walk`` finds them; null if it doesn't."""
    path = F.col("path")
    glob = lambda x, p: x.rlike(rf"(?s)\A(?:{predicates.glob_regex(p)})\z")
    at = lambda d, p: F.struct(F.lit(d).alias("dir_no"), F.lit(p).alias("pattern_no"))
    found = F.lit(None).cast("struct<dir_no:int,pattern_no:int>")
    places = []
    for d, top in sorted(walk.tops.items()):
        below = F.lit(True) if top == "." else path.startswith(f"{top}/")
        within = path if top == "." else F.substring(path, len(top) + 2, 1 << 30)
        places += [(below & (glob(within, p) | glob(predicates.basename(path), p)), at(d, i)) for i, p in enumerate(profile.patterns) if ".." not in p]
    places += [(path == f, at(len(profile.directories), i)) for i, f in enumerate(profile.files)]
    for test, place in reversed(places):
        found = F.when(test, place).otherwise(found)
    return F.when(~predicates.excluded(path, list(profile.exclude_patterns)), found)


def tagged(spark: SparkSession, root: str | Path, profiles: dict[str, Profile]) -> DataFrame:
    """The files that any of some profiles takes, each read once: ``(path, size, mtime_ns, content, error, taken)``; ``taken`` has, by a profile's name, the place of order that the file has in it."""
    several = lambda key: list(dict.fromkeys(x for p in profiles.values() for x in getattr(p, key)))
    common = set.intersection(*(set(p.exclude_patterns) for p in profiles.values()))
    largest = max(p.max_file_bytes for p in profiles.values())
    listed = files.listing(spark, root, several("directories"), several("patterns"), several("files"), sorted(common), max_file_bytes=largest)
    of = {name: _place(Walk(str(root), p.directories, p.patterns), p) for name, p in profiles.items()}
    entry = [F.when(place.isNotNull(), F.struct(F.lit(name).alias("key"), place.alias("value"))) for name, place in of.items()]
    taken = listed.select("path", "size", "mtime_ns", "error", F.map_from_entries(F.array_compact(F.array(*entry))).alias("taken")).where(F.size("taken") > 0)
    return stored(files.contents(taken, root), "tagged")


def collect_all(spark: SparkSession, root: str | Path, profiles: dict[str, Profile], mode: str = "full", text_query: str | None = None, allow_commands: bool = False, include_pre: bool = False, strict: bool = False) -> Collected:
    """All profiles' parts, told apart by the column ``profile``: one scan of the tree, and one packing for all profiles of the same limit and tokenizer.

    Each profile's parts are those that ``collect`` gives. Profiles whose source is a command aren't taken; ``collect`` runs them.
    """
    root = Path(root)
    own = {name: dataclasses.replace(p, exclude_patterns=tuple(excludes(p, root))) for name, p in profiles.items() if p.command is None}
    if not own:
        raise ValueError("no profile collects files")
    log, corpus, alike = root / STORE / commands.AUDIT, tagged(spark, root, own), defaultdict(list)
    for name, p in own.items():
        pre = commands.run_all(list(p.pre_commands), root, allow_file_args=True, log=log) if allow_commands else []
        rows = corpus.withColumn("place", F.col("taken")[name]).where("place is not null")
        rows = rows.select("path", "size", "mtime_ns", F.when(F.col("size") <= p.max_file_bytes, F.col("content")).alias("content"), "place.dir_no", "place.pattern_no")
        made = corpus_sections(rows, p, files.in_order(), mode, text_query, pre, include_pre)
        made = stored(made.select("seq", "path", "content", "raw_tokens"), "sections")  # Spark doesn't take Python functions out of the branches of a union
        alike[p.max_tokens, p.tokenizer, p.chars_per_token].append(made.withColumn(GROUP, F.lit(name)))
    found = [_packed(reduce(DataFrame.unionByName, rows), limit, load(tokenizer, root, per, spark=spark), strict) for (limit, tokenizer, per), rows in alike.items()]
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return Collected(union([f.sections for f in found]), union([f.parts for f in found]))


def of_profile(collected: Collected, name: str) -> Collected:
    """One profile's share of what ``collect_all`` gives."""
    return Collected(*(df.where(F.col(GROUP) == name).drop(GROUP) for df in (collected.sections, collected.parts)))


def toc_entries(collected: Collected) -> DataFrame:
    """``(part, entries)``: the names of each part's sections, each once, in order."""
    spread = collected.sections.groupBy("seq").agg(F.count_distinct("part").alias("n"))
    joined = collected.sections.select("seq", "path", "part").distinct().join(spread, "seq")
    return joined.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("seq", "path", "n"))).alias("entries"))


def write(collected: Collected, folder: str | Path, profile: Profile, project: str = "Project", merge: bool = False, headers: DataFrame | None = None) -> list[str]:
    """The parts as numbered files, each with its table of contents and, of ``headers`` (part, header), its header. Executors write them; all are there or none is."""
    count = collected.sections.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    rows = collected.parts.join(toc_entries(collected), "part", "left")
    rows = rows.withColumn("header", F.lit(None).cast("string")) if headers is None else rows.join(headers, "part", "left")
    return part_files.write(rows, count, folder, profile.name_template, profile.title_template, project, merge)


def summary(collected: Collected) -> DataFrame:
    """``(path, tokens)`` of the sections, in order of path."""
    return collected.sections.groupBy("path").agg(F.sum("tokens").alias("tokens")).orderBy("path")


def manifest_lines(collected: Collected) -> Iterator[str]:
    """A summary in Markdown, a line at a time."""
    yield "# Files\n\n"
    for r in summary(collected).toLocalIterator():
        yield f"- {r.path}: {r.tokens} tokens\n"


def benchmark(spark: SparkSession, root: str | Path, profile: Profile, text_query: str | None = None) -> dict[str, dict]:
    """Parts, tokens and seconds of each way to collect a tree, and the tokens in percent of the full way."""
    ways = {"full": {}, "compress": {"profile": dataclasses.replace(profile, compress=True)}, "repo-map": {"mode": "repo-map"}, "headers": {"mode": "headers"}} | ({"query": {"text_query": text_query}} if text_query else {})
    found = {}
    for name, how in ways.items():
        began = time.perf_counter()
        row = collect(spark, root, how.get("profile", profile), **{k: v for k, v in how.items() if k != "profile"}).parts.agg(F.count("*").alias("parts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
        found[name] = row.asDict() | {"seconds": round(time.perf_counter() - began, 3)}
    return {name: x | {"percent_of_full": round(100 * x["tokens"] / max(1, found["full"]["tokens"]), 1)} for name, x in found.items()}


def metrics(collected: Collected, started: float | None = None) -> dict:
    """Files, tokens of their sections before and after compression and splitting, and the ratio of these."""
    whole, shown = F.col("chunk_no") == 0, ~F.startswith("path", F.lit(query.PRE))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    row = collected.sections.agg(
        F.count_if(whole & shown).alias("files_read"), total(F.when(whole, F.col("raw_tokens"))).alias("raw"), total("tokens").alias("tokens")
    ).first()
    return {
        "extract_time_ms": None if started is None else round((time.time() - started) * 1000, 1), "files_read": row.files_read,
        "tokens_raw": row.raw, "tokens_compressed": row.tokens, "compression_ratio": round(row.tokens / row.raw, 4) if row.raw else 1.0,
    }


def dry_run(collected: Collected, limit: int) -> DataFrame:
    """``(part, at, line)``: a line for each section and, behind those, for each part; in order by part and at, nulls last."""
    rows = collected.sections.select("part", F.col("seq").alias("at"), "path", "tokens")
    whole = rows.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    rows = rows.unionByName(whole.select("part", F.lit(None).cast(rows.schema["at"].dataType).alias("at"), F.concat(F.lit("→ part "), F.col("part").cast("string")).alias("path"), "tokens"))
    return rows.select("part", "at", F.format_string("  %5d tokens | %5s | %s", "tokens", percent(F.col("tokens"), F.lit(limit)), "path").alias("line"))


def in_line(lines: DataFrame) -> Iterator[str]:
    return (r.line for r in lines.orderBy("part", F.col("at").asc_nulls_last()).toLocalIterator())


def benchmark_report(found: dict[str, dict]) -> list[str]:
    """A line for each way that ``benchmark`` took, against the full one, and what each saves."""
    full = found["full"]
    change = lambda x, of: "baseline" if x is full else f"{(x[of] - full[of]) / full[of] * 100:+.1f}%" if full[of] else "-"
    lines = [f"{name:<12}{x['parts']:>6} parts{x['tokens']:>10} tokens{x['seconds']:>9.3f} s{change(x, 'tokens'):>12}{change(x, 'seconds'):>12}" for name, x in found.items()]
    saved = [(name, 100 - x["percent_of_full"]) for name, x in found.items() if x is not full and x["percent_of_full"] < 100]
    return [*lines, *(f"{name} saves {share:.1f} % of the tokens" for name, share in saved)]
