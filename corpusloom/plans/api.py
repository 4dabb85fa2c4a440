"""The public interface: collect a tree, keep snapshots of it, compare them."""

from __future__ import annotations

import dataclasses
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.languages import lang_for_path
from corpusloom.functions.predicates import covered, excluded
from corpusloom.functions.text import decoded
from corpusloom.functions.tokenizers import load
from corpusloom.operators import diff as D
from corpusloom.operators import structural
from corpusloom.operators.incremental import stat_changes
from corpusloom.plans import collect as C
from corpusloom.plans import presets
from corpusloom.plans.profiles import Profile, get_profile, load_config
from corpusloom.shared import stored
from corpusloom.sources import commands, files
from corpusloom.streaming.incremental import append_cache, load_cache
from corpusloom.sources.store import SnapshotNotFound, SnapshotStore, StoreError

STORE = C.STORE


class Engine:
    """A tree of files with its configuration and snapshot store."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.config = load_config(self.root)
        self.store = SnapshotStore(spark, self.root / STORE)

    def profile(self, name: str = "full") -> Profile:
        return get_profile(name, self.config)

    def collect(self, profile: Profile, incremental: bool = False, **how) -> C.Collected:
        """The parts of the tree; ``incremental``: of files that are new or changed since the last such call."""
        if not incremental:
            return C.collect(self.spark, self.root, profile, **how)
        folder = self.root / STORE / "cache"
        cache = load_cache(self.spark, folder)
        due = stored(self.due(profile, cache), "due")
        found = C.collect(self.spark, self.root, profile, cache=cache, corpus=due, **how)
        if not due.isEmpty():
            append_cache(due.select("path", "mtime_ns", "size", "sha256"), folder, time.time_ns())
        return found

    def due(self, profile: Profile, cache: DataFrame) -> DataFrame:
        """The files that may have changed since the cache was written, with contents and hashes. Names, sizes and times of all are compared first; no other file is opened."""
        own = dataclasses.replace(profile, exclude_patterns=tuple(C.excludes(profile, self.root)))
        listed = C.listed(self.spark, self.root, own)
        unsettled = stat_changes(listed, cache).where("state in ('new', 'unsure')").select("path")
        return C.read(listed.join(unsettled, "path", "left_semi"), self.root)

    def write_diff(self, sections: DataFrame, folder: str | Path, profile: Profile) -> list[str]:
        """Sections of a comparison as numbered files, each headed by what it holds."""
        order = ["rank", "path"] if "rank" in sections.columns else ["type", "path"]
        rows = stored(sections.select("type", F.col("path").alias("name"), "content", F.struct(*order).alias("seq")), "diff-sections")
        packed = C.pack(rows.select("seq", F.col("name").alias("path"), "content"), profile, load(profile.tokenizer, self.root, profile.chars_per_token))
        placed = packed.sections.select("seq", "part").distinct().join(rows, "seq")
        counts = D.stats(placed, ["part"])
        header = D.part_header(*[F.col(t) for t in D.TYPES], F.col("part"), F.max("part").over(Window.partitionBy(F.lit(1))))
        return C.write(packed, folder, profile, self.config.project_name, headers=counts.select("part", header.alias("header")))

    def collect_remote(self, url: str, profile: Profile | None = None, **how) -> C.Collected:
        """A clone's parts; its commands are never run. Without a profile, the clone's own first one that allows it, or what its presets say."""
        from corpusloom.sources.remote import clone

        root = clone(url)
        return C.collect(self.spark, root, profile or self.remote_profile(root), allow_commands=False, **how)

    @staticmethod
    def remote_profile(root: Path) -> Profile:
        config = load_config(root)
        allowed = [n for n in sorted(config.profiles) if get_profile(n, config).remote]
        if allowed or "full" in config.profiles:
            return get_profile((["full"] if "full" in config.profiles else allowed)[0], config)
        found = [presets.to_profile(n, root) for n in presets.detect(root)]
        parts = [p for p in found if p.get("directories") or p.get("files")]
        several = lambda key: tuple(dict.fromkeys(x for p in parts for x in p.get(key, ())))
        return Profile(directories=several("directories"), files=several("files"), patterns=several("patterns") or Profile.patterns) if parts else Profile()

    def after(self, profile: Profile, allow_commands: bool = False) -> list[tuple[str, str]]:
        """Runs the commands that follow a collection, if commands are allowed; their outputs."""
        return commands.run_all(list(profile.post_commands), self.root, allow_file_args=True, log=self.root / STORE / commands.AUDIT) if allow_commands and profile.post_commands else []

    def snapshot_info(self, snapshot_id: str) -> dict:
        """A snapshot's manifest, with the numbers of its files and outputs and their bytes."""
        entries = self.store.entries(snapshot_id)
        kinds = {r.kind: r.n for r in entries.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        size = entries.join(self.store.objects().select("sha256", "stored_bytes"), "sha256").agg(F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("n")).first().n
        return self.store.manifest(snapshot_id) | {"files": kinds.pop("file", 0), "outputs": sum(kinds.values()), "bytes": size}

    def live(self, profile: Profile, allow_commands: bool = False) -> DataFrame:
        """``(kind, label, content)`` of the tree as it is: files as text, outputs of commands."""
        skip = C.excludes(profile, self.root)
        scanned = files.scan(self.spark, self.root, list(profile.directories), list(profile.patterns), list(profile.files), exclude=skip, max_file_bytes=profile.max_file_bytes)
        rows = scanned.where(~excluded(F.col("path"), skip)).select(F.lit("file").alias("kind"), F.col("path").alias("label"), decoded(F.col("content")).alias("content")).where("content is not null")
        if allow_commands:
            made = [("pre", label, out) for label, out in commands.run_all(list(profile.pre_commands), self.root, allow_file_args=True, log=self.root / STORE / commands.AUDIT)]
            if profile.command is not None:
                made.append(("command", "command", commands.run(profile.command, self.root, allow_file_args=True, log=self.root / STORE / commands.AUDIT)))
            if made:
                rows = rows.unionByName(self.spark.createDataFrame(made, "kind string, label string, content string"))
        return rows

    def create_snapshot(self, profile: Profile, name: str | None = None, allow_commands: bool = False) -> str:
        return self.store.create(self.live(profile, allow_commands), profile.to_dict(), name)

    def update_snapshot(self, snapshot_id: str, profile: Profile | None = None, allow_commands: bool = False) -> str:
        profile = profile or Profile.of(self.store.manifest(snapshot_id)["profile"])
        return self.store.update(snapshot_id, self.live(profile, allow_commands), profile.to_dict())

    def snapshots(self) -> list[dict]:
        return self.store.list()

    def resolve(self, snapshot_id: str | None) -> str:
        """The snapshot asked for, or the only one."""
        if snapshot_id is not None:
            return self.store.manifest(snapshot_id)["id"]
        found = self.store.list()
        if not found:
            raise SnapshotNotFound("there is no snapshot")
        if len(found) > 1:
            raise StoreError(f"which snapshot? there are {[m['id'] for m in found]}")
        return found[0]["id"]

    def diff(self, profile: Profile, snapshot_id: str | None = None, to: str | None = None, fmt: str = "markdown", mode: str = "full", flat: bool = False, line_numbers: bool = False, allow_commands: bool = False) -> tuple[dict, DataFrame]:
        """``(statistics, sections)`` from a snapshot to another, or to the tree as it is.

        Against the tree, what the snapshot has and the tree's profile neither gives nor covers is left out; two snapshots are compared whole.
        Statistics are of sections before grouping. Modes: ``full``; ``structural``, modified files by blocks; ``scopes``, the same with JavaScript, TypeScript and Go read by their scopes; ``repo-map``, by signatures.
        """
        old_id = self.resolve(snapshot_id)
        old = self.store.entries(old_id)
        if to is not None:
            new, contents = self.store.entries(to), self.store.contents()
        else:
            live = stored(self.live(profile, allow_commands).withColumn("sha256", F.sha2("content", 256)), "live")
            new = live.select("kind", "label", "sha256")
            contents = self.store.contents().unionByName(live.select("sha256", "content")).dropDuplicates(["sha256"])
        files_of = lambda df: df.where("kind = 'file'").select(F.col("label").alias("path"), "sha256")
        old_files, new_files = files_of(old), files_of(new)
        if to is None:
            there = old_files.join(new_files.select("path", F.lit(True).alias("there")), "path", "left")
            old_files = there.where(F.col("there") | covered(F.col("path"), list(profile.directories), list(profile.patterns), list(profile.files))).select("path", "sha256")
        sections = D.file_sections(old_files, new_files, contents, fmt, line_numbers)
        if mode != "full":
            sections = self._by_blocks(sections, old_files, new_files, contents, fmt, mode)
        outputs = lambda df: df.where("kind <> 'file'").join(contents, "sha256").select("label", "content")
        if to is not None or allow_commands:
            sections = sections.unionByName(D.command_sections(outputs(old), outputs(new), fmt, {commands.label(c): c for c in profile.pre_commands}))
        sections = stored(sections, "sections")
        counts = D.stats(sections).first().asDict()
        return counts, sections if flat else D.grouped(sections, D.summary(counts, old_id, to))

    def _by_blocks(self, sections: DataFrame, old: DataFrame, new: DataFrame, contents: DataFrame, fmt: str, mode: str) -> DataFrame:
        side = lambda df, name: df.join(contents, "sha256").select("path", F.col("content").alias(name))
        joined = sections.join(side(old, "old"), "path", "left").join(side(new, "new"), "path", "left").withColumn("lang", lang_for_path(F.col("path")))
        if mode in ("structural", "scopes"):
            told = F.when(F.col("type") == "modified", structural.structural_diffs(fmt, mode == "scopes")("old", "new", "path", "lang"))
        else:
            read = lambda name: structural.exploded_blocks(joined.where(F.col("type").isin("modified", "added", "deleted") & F.col(name).isNotNull()).select("path", "lang", F.col(name).alias("content")))
            lines = structural.signature_lines(structural.block_changes(read("old"), read("new"))).select("path", F.col("content").alias("lines"))
            joined = joined.join(lines, "path", "left")
            told = F.when(F.col("type").isin("modified", "added", "deleted"), F.col("lines"))
        return joined.withColumn("content", F.when(F.length(F.coalesce(told, F.lit(""))) > 0, told).otherwise(F.col("content"))).select(*sections.columns)
