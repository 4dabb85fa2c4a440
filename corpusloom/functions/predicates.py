"""Predicates on paths, contents and names."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.languages import EXTENSIONS, basename, suffix

SNAPSHOT_ID = r"^\w[\w.-]*$"


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for a whole string; ``*`` goes over slashes."""
    body = fnmatch.translate(pattern)
    return re.sub(r"^\(\?s:(.*)\)(\\Z|\\z)$", r"\1", body, flags=re.DOTALL).replace("(?>", "(?:")


def excluded(path: Column, exclude: list[str]) -> Column:
    """Whether a path, its last component, or for patterns with a slash any of its ends, matches one of the patterns."""
    deep = [p for p in exclude if "/" in p]
    flat = [p for p in exclude if "/" not in p]
    tests = []
    if deep:
        tests.append(path.rlike(r"(?s)\A(?:.*/)?(?:%s)\z" % "|".join(map(glob_regex, deep))))
    if flat:
        either = r"(?s)\A(?:%s)\z" % "|".join(map(glob_regex, flat))
        tests += [path.rlike(either), basename(path).rlike(either)]
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def covered(path: Column, directories: list[str], patterns: list[str], files: list[str] = ()) -> Column:
    """Whether a path is one of the files, or lies in one of the directories with a last component that matches a pattern."""
    tidy = [d.strip("/").removeprefix("./") for d in directories]
    inside = F.lit(any(d in ("", ".") for d in tidy))
    for d in tidy:
        inside = inside | F.startswith(path, F.lit(f"{d}/"))
    named = basename(path).rlike(r"(?s)\A(?:%s)\z" % "|".join(map(glob_regex, patterns))) if patterns else F.lit(False)
    return path.isin(*[f.removeprefix("./") for f in files]) | (inside & named) if files else inside & named


def query_words(query: str) -> list[str]:
    return query.lower().split()


def name_matches(path: Column, query: str) -> Column:
    """Whether the last component holds one of the query's words; all do for an empty query."""
    words = query_words(query or "")
    if not words:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(basename(path)), w))


def has_nul(text: Column) -> Column:
    return F.instr(text, "\0") > 0


def is_text_extension(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*[f".{x}" for x in EXTENSIONS])


def _listed(path: Column, extensions: list[str] | None) -> Column:
    return F.lit(True) if extensions is None else F.lower(suffix(path)).isin(*extensions)


def skip_binary(path: Column, size: Column, content: Column, include: bool = False, extensions: list[str] | None = None, max_mb: float = 1.0) -> Column:
    """Whether a file is left out for its kind: never with a known extension, else by size, list or a NUL in the first KB."""
    too_large = size / (1024 * 1024) > max_mb
    if extensions is not None:
        other = ~_listed(path, extensions)
    else:
        other = F.lit(False) if include else F.locate("\0", F.substring(content, 1, 1024).cast("string")) > 0
    return F.when(is_text_extension(path), F.lit(False)).when(too_large, F.lit(True)).otherwise(other)


def binary_allowed(path: Column, size: Column, extensions: list[str] | None = None, max_mb: float = 1.0) -> Column:
    return _listed(path, extensions) & (size / (1024 * 1024) <= max_mb)


def skip_reason(path: Column, size: Column, include: bool = False, extensions: list[str] | None = None, max_mb: float = 1.0) -> Column:
    unlisted = F.lit(include) & ~_listed(path, extensions)
    return F.when(size / (1024 * 1024) > max_mb, "binary too large").when(unlisted, "binary not in allowlist").otherwise("binary")


def valid_snapshot_id(name: Column) -> Column:
    return name.rlike(f"(?U){SNAPSHOT_ID}")


def check_snapshot_id(name: str) -> None:
    if not re.match(SNAPSHOT_ID, name):
        raise ValueError(f"not a snapshot id: {name!r}")
