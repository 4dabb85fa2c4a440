"""Comparison of two snapshots ``(path, sha256)``: classes of change, renames, statistics, grouping.

Contents are joined in by hash, for changed paths only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.languages import basename, dirname, suffix
from corpusloom.functions.text import count_tokens
from corpusloom.operators.textdiff import alike_pairs, command_diffs, first_alike, text_diffs
from corpusloom.shared import parts, passing, stored

#: Types in the order in which a grouped report has them.
TYPES = ("renamed", "moved", "modified", "added", "deleted")
SIMILAR, MAX_SIMILAR_BYTES = 0.7, 1_048_576
#: Files and bytes of a piece of old or new files that are compared in one task; rounds in which pairs are matched side by side.
TILE, TILE_BYTES, ROUNDS = 128, 1 << 23, 4
#: Pairs of an extension up to which all that are alike are listed; files of a side that are tried; alike pairs for each file from which on an extension is a crowd; files of its blocks.
FEW_PAIRS, TRIED, CROWD, BLOCK = 1 << 16, 64, 16, 512
SECTION = "type string, path string, old_path string, similarity double, content string"


def classified(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, old_sha, new_sha, state)``: added, deleted, modified or same."""
    joined = old.select("path", F.col("sha256").alias("old_sha")).join(new.select("path", F.col("sha256").alias("new_sha")), "path", "full_outer")
    state = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "modified").otherwise("same")
    return joined.select("path", "old_sha", "new_sha", state.alias("state"))


def hash_groups(changes: DataFrame) -> DataFrame:
    """``(sha256, n_deleted, n_added, old_path, new_path)`` of hashes on both sides of ``classified``; paths are the least ones."""
    old, new = F.col("state") == "deleted", F.col("state") == "added"
    sided = changes.where(old | new).select(F.coalesce("old_sha", "new_sha").alias("sha256"), "state", "path")
    grouped = sided.groupBy("sha256").agg(F.count_if(old).alias("n_deleted"), F.count_if(new).alias("n_added"), F.min(F.when(old, F.col("path"))).alias("old_path"), F.min(F.when(new, F.col("path"))).alias("new_path"))
    return grouped.where((F.col("n_deleted") > 0) & (F.col("n_added") > 0))


def rename_kind(old: Column, new: Column, similar: bool = False) -> tuple[Column, Column]:
    """Type and verb of a rename. A similar file in the same folder is renamed whatever its name."""
    same_folder, same_name = dirname(old) == dirname(new), basename(old) == basename(new)
    renamed = same_folder if similar else same_folder & ~same_name
    moved = ~same_folder & same_name
    return F.when(~renamed & moved, "moved").otherwise("renamed"), F.when(renamed, "RENAMED").when(moved, "MOVED").otherwise("MOVED AND RENAMED")


def exact_renames(groups: DataFrame) -> DataFrame:
    """Sections of hashes that one deleted and one added path share."""
    pairs = groups.where((F.col("n_deleted") == 1) & (F.col("n_added") == 1))
    kind, verb = rename_kind(F.col("old_path"), F.col("new_path"))
    text = F.concat(verb, F.lit(": "), F.col("old_path"), F.lit(" -> "), F.col("new_path"), F.lit("\n"))
    return pairs.select(kind.alias("type"), F.col("new_path").alias("path"), "old_path", F.lit(1.0).alias("similarity"), text.alias("content"))


def unmatched(changes: DataFrame, groups: DataFrame) -> DataFrame:
    """Added and deleted paths whose hash is on one side only; those of ambiguous groups are consumed."""
    sided = changes.where(F.col("state").isin("added", "deleted")).withColumn("sha256", F.coalesce("old_sha", "new_sha"))
    return sided.join(groups.select("sha256"), "sha256", "left_anti").select("path", "sha256", "state")


def _pieces(text: DataFrame) -> DataFrame:
    """``(ext, class, state, pieces)``: into how many pieces of ``TILE`` files, or of so many bytes, the files of a class fall."""
    sizes = text.groupBy("ext", "class", "state").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sizes.select("ext", "class", "state", F.greatest(F.ceil(F.col("files") / TILE), F.ceil(F.col("bytes") / TILE_BYTES), F.lit(1)).cast("int").alias("pieces"))


def similar_pairs(rest: DataFrame, contents: DataFrame, least: float = SIMILAR, max_bytes: int = MAX_SIMILAR_BYTES) -> DataFrame:
    """``(old_path, new_path, ratio)`` of unmatched files of one extension that are alike enough.

    The ratio of texts of lengths a and b is 2 min(a, b) / (a + b) at most, so only lengths within a factor of (2 - least) / least can pass, and those are in neighbouring
    classes of that factor. Each class is cut into pieces, and every piece of old files meets every piece of new ones in a task of its own: a text is sent once for
    each piece of the other side, not for each file, and no task holds more than two pieces. Within it lengths and counts of characters are compared before texts.
    """
    factor = (2 - least) / least
    found = rest.join(contents, "sha256").where((F.instr("content", "\0") == 0) & (F.octet_length("content") <= max_bytes))
    text = found.select("path", "state", "content", suffix(F.col("path")).alias("ext"), F.length("content").alias("n"), F.octet_length("content").alias("bytes"))
    text = stored(text.withColumn("class", F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(factor))).cast("int")), "unmatched-texts")
    pieces = _pieces(text)

    def side(state: str, other: str, own: str, theirs: str) -> DataFrame:
        """The files of one state, dealt into their pieces, for each piece of the neighbouring classes of the other state."""
        of_own = pieces.where(F.col("state") == state).select("ext", "class", F.col("pieces").alias("own_pieces"))
        of_other = pieces.where(F.col("state") == other).select("ext", F.col("class").alias("near"), F.col("pieces").alias("near_pieces"))
        rows = text.where(F.col("state") == state).join(of_own, ["ext", "class"])
        rows = rows.withColumn(f"{own}_piece", F.pmod(F.xxhash64("path"), F.col("own_pieces")).cast("int"))
        rows = rows.withColumn("near", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)]))).join(of_other, ["ext", "near"])
        rows = rows.withColumn(f"{theirs}_piece", F.explode(F.sequence(F.lit(0), F.col("near_pieces") - 1)))
        key = [F.col("ext").alias("kind"), F.col("class").alias(f"{own}_class"), F.col("near").alias(f"{theirs}_class"), f"{own}_piece", f"{theirs}_piece"]
        return rows.select(*key, F.col("path").alias(f"{own}_path"), F.col("content").alias(f"{own}_content"))

    tile = ["kind", "old_class", "new_class", "old_piece", "new_piece"]
    old, new = side("deleted", "added", "old", "new").groupBy(*tile), side("added", "deleted", "new", "old").groupBy(*tile)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return alike_pairs(a["old_path"].to_pylist(), a["old_content"].to_pylist(), b["new_path"].to_pylist(), b["new_content"].to_pylist(), least)

    return old.cogroup(new).applyInArrow(compare, "old_path string, new_path string, ratio double")


def _mutual(edges: DataFrame) -> DataFrame:
    """The pairs that are the first both of their old and of their new path."""
    first = lambda key, value: edges.groupBy(key).agg(F.min(value).alias(value))
    return edges.join(first("old_path", "new_path"), ["old_path", "new_path"], "left_semi").join(first("new_path", "old_path"), ["old_path", "new_path"], "left_semi")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that come in order: each is taken whose paths are both free."""
    done: set[str] = set()
    taken: set[str] = set()
    for batch in batches:
        kept = []
        for i, (old, new) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if old not in done and new not in taken:
                done.add(old)
                taken.add(new)
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def greedy(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One-to-one matches: old paths in order each take the first new path in order that is free.

    That is the matching which takes pairs in order and leaves out those with a path that is taken. A pair that is the first of both of its paths is in it whatever else is, so all such pairs are
    taken at once and all others of their paths dropped, round by round. What a few rounds leave over, crowds in which all resemble all, is taken in order by extension; a task holds the
    matched paths only.
    """
    left, matched = stored(pairs.select("old_path", "new_path", "ratio"), "pairs"), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        matched.append(stored(_mutual(left), "matched"))
        free = left.join(matched[-1].select("old_path"), "old_path", "left_anti").join(matched[-1].select("new_path"), "new_path", "left_anti")
        left = stored(free.select("old_path", "new_path", "ratio"), "pairs")
    by_extension = left.repartition(parts(left.sparkSession), suffix(F.col("old_path"))).sortWithinPartitions("old_path", "new_path")
    return reduce(DataFrame.unionByName, matched, by_extension.mapInArrow(_in_order, left.schema))


def _crowds(text: DataFrame, least: float) -> DataFrame:
    """Extensions of so many alike pairs, as some files tell, that these aren't to be listed. It decides how they are matched, not what."""
    old = F.col("state") == "deleted"
    sizes = text.groupBy("ext").agg(F.count_if(old).alias("n_old"), F.count_if(~old).alias("n_new")).where(F.col("n_old") * F.col("n_new") > FEW_PAIRS)
    share = F.ceil(F.when(old, F.col("n_old")).otherwise(F.col("n_new")) / TRIED)
    some = stored(text.join(sizes, "ext").where(F.pmod(F.xxhash64("path"), share) == 0), "tried")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        found = alike_pairs(a["path"].to_pylist(), a["content"].to_pylist(), b["path"].to_pylist(), b["content"].to_pylist(), least).num_rows
        kind = (a if a.num_rows else b)["ext"][0].as_py()
        return pa.table({"ext": pa.array([kind], pa.string()), "alike": pa.array([found], pa.int64()), "tried": pa.array([a.num_rows * b.num_rows], pa.int64())})

    told = some.where(old).groupBy("ext").cogroup(some.where(~old).groupBy("ext")).applyInArrow(count, "ext string, alike long, tried long")
    n, m = F.col("n_old").cast("double"), F.col("n_new").cast("double")
    return told.join(sizes, "ext").where(F.col("alike") * n * m > CROWD * (n + m) * F.col("tried")).select("ext")


def _waves(text: DataFrame, least: float) -> DataFrame:
    """The matches of ``greedy``, found block by block.

    Old and new files of an extension are cut into blocks in order of their paths. What a block of old files takes from a block of new ones depends on what it took from earlier ones and
    what earlier old files left of these, so all pairs of blocks whose numbers have one sum are matched side by side, sum by sum. A task holds two blocks, and a file that is
    matched meets no other.
    """
    spark = text.sparkSession
    size = text.agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes")).first()
    pieces = max(1, -(-size.files // BLOCK), -(-(size.bytes or 0) // TILE_BYTES))
    with passing(spark) as keep:
        dealt = stored(text.select("ext", "state", "path", "content").repartitionByRange(pieces, "ext", "state", "path").withColumn("piece", F.spark_partition_id()), "dealt")
        held = dealt.select("ext", "state", "piece").distinct()
        blocks = stored(held.withColumn("block", F.row_number().over(Window.partitionBy("ext", "state").orderBy("piece"))), "blocks")
        last = blocks.groupBy("ext").agg(F.sum(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        free, matched = stored(dealt.join(blocks, ["ext", "state", "piece"]).drop("piece"), "free"), []

        def side(state: str, own: str, other: str, wave: int):
            rows = free.where((F.col("state") == state) & (F.col("block") < wave))
            return rows.select("ext", F.col("block").alias(own), (F.lit(wave) - F.col("block")).alias(other), "path", "content").groupBy("ext", "old_block", "new_block")

        def match(a: pa.Table, b: pa.Table) -> pa.Table:
            return first_alike(a["path"].to_pylist(), a["content"].to_pylist(), b["path"].to_pylist(), b["content"].to_pylist(), least)

        for wave in range(2, last + 1):
            pairs = side("deleted", "old_block", "new_block", wave).cogroup(side("added", "new_block", "old_block", wave))
            matched.append(stored(pairs.applyInArrow(match, "old_path string, new_path string, ratio double"), "wave"))
            free = stored(free.join(matched[-1].select(F.explode(F.array("old_path", "new_path")).alias("path")), "path", "left_anti"), "free")
        return keep(reduce(DataFrame.unionByName, matched), "waves")


def matches(rest: DataFrame, contents: DataFrame, least: float = SIMILAR, max_bytes: int = MAX_SIMILAR_BYTES) -> DataFrame:
    """``greedy(similar_pairs())``; of extensions in which very many pairs are alike these aren't listed."""
    kinds = rest.withColumn("ext", suffix(F.col("path")))
    text = kinds.join(contents, "sha256").where((F.instr("content", "\0") == 0) & (F.octet_length("content") <= max_bytes)).select("ext", "state", "path", "content")
    crowds = stored(_crowds(text, least), "crowds")
    if crowds.isEmpty():
        return greedy(similar_pairs(rest, contents, least, max_bytes))
    calm = greedy(similar_pairs(kinds.join(crowds, "ext", "left_anti").drop("ext"), contents, least, max_bytes))
    return calm.unionByName(_waves(stored(text.join(crowds, "ext", "left_semi"), "crowd-texts"), least))


def similar_renames(rest: DataFrame, contents: DataFrame, fmt: str = "markdown", number: bool = False) -> DataFrame:
    """Sections of similar renames, with their text difference."""
    matched = stored(matches(rest, contents), "matches")
    by_path = rest.join(contents, "sha256").select("path", "state", "content")
    side = lambda state, path, name: by_path.where(F.col("state") == state).select(F.col("path").alias(path), F.col("content").alias(name))
    both = matched.join(side("deleted", "old_path", "old"), "old_path").join(side("added", "new_path", "new"), "new_path")
    kind, verb = rename_kind(F.col("old_path"), F.col("new_path"), similar=True)
    changed = text_diffs(fmt, None, number)(F.col("old"), F.col("new"), F.col("new_path"))
    action = F.concat(verb, F.lit(": "), F.col("old_path"), F.lit(" -> "), F.col("new_path"), F.format_string(" (%.0f%% similar)", F.bround(F.col("ratio") * 100)))
    made = both.select(kind.alias("type"), F.col("new_path").alias("path"), "old_path", F.col("ratio").alias("similarity"), action.alias("action"), changed.alias("changed"))
    return made.select("type", "path", "old_path", "similarity", F.concat(F.col("action"), F.when(F.col("changed") != "", F.concat(F.lit("\n\n"), F.col("changed"))).otherwise(F.lit("\n"))).alias("content"))


def file_sections(old: DataFrame, new: DataFrame, contents: DataFrame, fmt: str = "markdown", number: bool = False, limit: int | None = None) -> DataFrame:
    """All sections of two snapshots: renames, deleted, added, modified. ``contents`` is ``(sha256, content)``."""
    changes = stored(classified(old, new).where("state <> 'same'"), "changes")
    groups = hash_groups(changes)
    rest = stored(unmatched(changes, groups), "unmatched")
    similar = stored(similar_renames(rest, contents, fmt, number), "similar")
    left = rest.join(similar.select(F.col("old_path").alias("path")), "path", "left_anti").join(similar.select("path"), "path", "left_anti")
    diffs = text_diffs(fmt, limit, number)
    lone = left.join(contents, "sha256", "left").withColumn("content", F.coalesce("content", F.lit("")))
    gone = F.col("state") == "deleted"
    empty = F.lit("")
    lone = lone.select(F.col("state").alias("type"), "path", F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("double").alias("similarity"), diffs(F.when(gone, F.when(F.col("content") == "", " ").otherwise(F.col("content"))).otherwise(empty), F.when(gone, empty).otherwise(F.col("content")), F.col("path")).alias("content"))
    modified = changes.where("state = 'modified'").join(contents.select(F.col("sha256").alias("old_sha"), F.col("content").alias("old")), "old_sha").join(contents.select(F.col("sha256").alias("new_sha"), F.col("content").alias("new")), "new_sha")
    modified = modified.select(F.lit("modified").alias("type"), "path", F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("double").alias("similarity"), diffs(F.col("old"), F.col("new"), F.col("path")).alias("content"))
    return exact_renames(groups).unionByName(similar).unionByName(lone).unionByName(modified)


def stats(sections: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sections of each type, and the tokens of all."""
    return sections.groupBy(*by).agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES], F.coalesce(F.sum(count_tokens(F.col("content"))), F.lit(0)).alias("total_tokens"))


def summary(counts: dict[str, int], from_id: str, to_id: str | None = None) -> str:
    told = ", ".join(f"{counts[t]} {t}" for t in TYPES if counts[t])
    return f"## Changes from {from_id} to {to_id or 'current'} ({told})\n\n" if told else "## No changes\n\n"


def part_header(renamed: Column, moved: Column, modified: Column, added: Column, deleted: Column, part: Column, total: Column) -> Column:
    told = F.concat_ws(", ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {t}"))) for t, n in zip(TYPES, (renamed, moved, modified, added, deleted), strict=True)])
    return F.concat(F.lit("Part "), part.cast("string"), F.lit(" of "), total.cast("string"), F.lit(". Changes: "), F.when(told == "", "no changes").otherwise(told), F.lit("\n\n"))


def grouped(sections: DataFrame, header: str) -> DataFrame:
    """Adds a summary row and a heading row for each type that occurs, and ``rank`` to order by (then by path); other types count as modified."""
    known = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("modified")
    rank = F.array_position(F.array(*map(F.lit, TYPES)), known).cast("int") * 2
    rows = sections.withColumn("rank", rank)
    headings = rows.select("rank").distinct().select(F.lit("header").alias("type"), F.lit("").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("double").alias("similarity"), F.concat(F.lit("### "), F.initcap(F.element_at(F.array(*map(F.lit, TYPES)), (F.col("rank") / 2).cast("int"))), F.lit("\n")).alias("content"), (F.col("rank") - 1).alias("rank"))
    first = sections.sparkSession.createDataFrame([("header", "", None, None, header, 0)], f"{SECTION}, rank int")
    return first.unionByName(headings).unionByName(rows.select(*headings.columns))


def command_sections(old: DataFrame, new: DataFrame, fmt: str = "markdown", commands: dict[str, str] | None = None) -> DataFrame:
    """Sections of ``(label, content)`` of commands' outputs, joined on the label; ``commands`` as ``command_diffs`` takes them."""
    both = old.select("label", F.col("content").alias("old")).join(new.select("label", F.col("content").alias("new")), "label", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    told = command_diffs(fmt, commands)("old", "new", "label")
    made = both.where(~F.col("old").eqNullSafe(F.col("new"))).select(kind.alias("type"), F.col("label").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("double").alias("similarity"), told.alias("content"))
    return made.where("content <> ''")
