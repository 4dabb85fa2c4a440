"""Walks over a tree of files: what a profile takes of it, folder by folder, without what is left out anyway.

A walk knows folders, patterns and exclusions and nothing of Spark; the driver and the executors run the same one. A folder below which everything
is excluded is never opened. Each file is given once, at its first place of order, and a file's place depends on its path alone, so
walks of different folders need no word from each other.
"""

from __future__ import annotations

import dataclasses
import fnmatch
import os
import re
import stat
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cached_property
from pathlib import Path
from typing import NamedTuple

from corpusloom.functions.predicates import glob_regex


class Found(NamedTuple):
    path: str
    size: int | None
    mtime_ns: int | None
    dir_no: int
    pattern_no: int
    error: str | None


class Folder(NamedTuple):
    """A folder that is still to be opened, by its path from the root, in the walk of one of the directories."""

    dir_no: int
    path: str


def inside(path: Path, root: Path) -> bool:
    """Whether a path, links resolved, lies under the root."""
    try:
        return path.resolve().is_relative_to(root.resolve())
    except (OSError, ValueError):
        return False


def _joined(folder: str, name: str) -> str:
    return name if folder == "." else f"{folder}/{name}"


@dataclasses.dataclass(frozen=True)
class Walk:
    root: str
    directories: tuple[str, ...] = (".",)
    patterns: tuple[str, ...] = ("*",)
    files: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    keep_all: bool = False
    max_bytes: int | None = None

    @cached_property
    def _patterns(self) -> list[tuple[int, re.Pattern]]:
        return [(i, re.compile(fnmatch.translate(p))) for i, p in enumerate(self.patterns) if ".." not in p]

    @cached_property
    def _flat(self) -> re.Pattern | None:
        flat = [glob_regex(p) for p in self.exclude if "/" not in p]
        return re.compile(rf"(?s)(?:{'|'.join(flat)})\Z") if flat else None

    @cached_property
    def _deep(self) -> re.Pattern | None:
        deep = [glob_regex(p) for p in self.exclude if "/" in p]
        return re.compile(rf"(?s)(?:.*/)?(?:{'|'.join(deep)})\Z") if deep else None

    @cached_property
    def _below(self) -> re.Pattern | None:
        """Of a folder with a slash behind it: patterns that end in ``*`` match whatever stands behind that."""
        tests = [rf"(?:.*/)?(?:{glob_regex(p)})" if "/" in p else rf"(?:{glob_regex(p)})" for p in self.exclude if p.endswith("*")]
        return re.compile(rf"(?s)(?:{'|'.join(tests)})\Z") if tests else None

    def excluded(self, path: str) -> bool:
        return bool((self._deep and self._deep.match(path)) or (self._flat and (self._flat.match(path) or self._flat.match(path.rpartition("/")[2]))))

    def pruned(self, folder: str) -> bool:
        """Whether all that a folder holds is excluded."""
        return bool(folder != "." and self._below and self._below.match(f"{folder}/"))

    @cached_property
    def tops(self) -> dict[int, str]:
        """The directories that are there, by number, as plain paths from the root."""
        found = {}
        for d, directory in enumerate(self.directories):
            top = Path(self.root, directory)
            if top.is_dir() and not top.is_symlink() and inside(top, Path(self.root)):
                found[d] = Path(os.path.normpath(directory)).as_posix()
        return found

    def _holds(self, top: str, path: str) -> bool:
        """Whether a walk from ``top`` comes by a path: no link and no folder that is left out lies between."""
        if top != "." and not path.startswith(f"{top}/"):
            return False
        at = top
        for name in path[0 if top == "." else len(top) + 1 :].split("/")[:-1]:
            at = _joined(at, name)
            if os.path.islink(os.path.join(self.root, at)):
                return False
        return True

    @cached_property
    def _earlier(self) -> dict[int, list[str]]:
        """For each directory those before it whose walks come by files of it: directories within it, and directories around it without a link between."""
        under = lambda a, b: b == "." or a == b or a.startswith(f"{b}/")
        return {d: [t for e, t in self.tops.items() if e < d and (under(t, top) or under(top, t) and self._holds(t, f"{top}/x"))] for d, top in self.tops.items()}

    def _matching(self, top: str, path: str) -> list[int]:
        name = path.rpartition("/")[2]
        within = path if top == "." else path[len(top) + 1 :]
        return [i for i, p in self._patterns if p.match(within) or p.match(name)]

    def places(self, d: int, path: str) -> list[int]:
        """The numbers of the patterns for which the walk of directory ``d`` gives a file."""
        found = self._matching(self.tops[d], path)
        if self.keep_all or not found:
            return found
        if any((t == "." or path.startswith(f"{t}/")) and self._matching(t, path) for t in self._earlier[d]):
            return []
        return found[:1]

    def opened(self, folder: Folder) -> Iterator[Found | Folder]:
        """The files of one folder that are taken, and its folders that are to be opened."""
        try:
            entries = os.scandir(os.path.join(self.root, folder.path))
        except OSError:
            return
        with entries:
            for entry in entries:
                path = _joined(folder.path, entry.name)
                try:
                    if entry.is_symlink():
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        if not self.pruned(path):
                            yield Folder(folder.dir_no, path)
                    elif entry.is_file(follow_symlinks=False) and not self.excluded(path):
                        for p in self.places(folder.dir_no, path):
                            yield self.told(path, folder.dir_no, p, entry.stat(follow_symlinks=False))
                except OSError as e:
                    yield Found(path, None, None, folder.dir_no, 0, type(e).__name__)

    def told(self, path: str, d: int, p: int, about: os.stat_result) -> Found:
        return Found(path, about.st_size, about.st_mtime_ns, d, p, "too large" if self.max_bytes is not None and about.st_size > self.max_bytes else None)

    def named(self) -> Iterator[Found]:
        """The files that are named one by one; those that a walk gives are left to it."""
        seen = set()
        for i, name in enumerate(self.files):
            if not self.keep_all and name in seen or self.excluded(name):
                continue
            seen.add(name)
            full = Path(self.root, name)
            if not self.keep_all and os.path.normpath(name) == name and full.is_file() and not full.is_symlink() and any(self._holds(t, name) and self._matching(t, name) for t in self.tops.values()):
                continue
            try:
                if full.is_symlink() or not inside(full, Path(self.root)):
                    raise PermissionError("outside of the root")
                about = full.stat()
                if not stat.S_ISREG(about.st_mode):
                    raise IsADirectoryError(name)
                yield self.told(name, len(self.directories), i, about)
            except OSError as e:
                yield Found(name, None, None, len(self.directories), i, type(e).__name__)

    def start(self) -> list[Folder]:
        return [Folder(d, top) for d, top in self.tops.items() if not self.pruned(top)]

    def below(self, folders: Iterable[Folder], budget: int) -> Iterator[Found | Folder]:
        """What lies below some folders, breadth first, until ``budget`` names have been seen; then the folders that are left."""
        due, seen = deque(folders), 0
        while due and seen < budget:
            for x in self.opened(due.popleft()):
                seen += 1
                if isinstance(x, Folder):
                    due.append(x)
                else:
                    yield x
        yield from due

    def some(self, folders: Iterable[Folder], most: int) -> tuple[list[Found], list[Folder]]:
        """As ``below``, but ``most`` names are held at any time: a folder that holds more is left as it is."""
        due, found, left = deque(folders), [], []
        while due:
            if len(found) + len(due) >= most:
                return found, [*left, *due]
            folder, own = due.popleft(), []
            for x in self.opened(folder):
                own.append(x)
                if len(found) + len(due) + len(own) > most:
                    left.append(folder)
                    break
            else:
                due.extend(x for x in own if isinstance(x, Folder))
                found += [x for x in own if isinstance(x, Found)]
        return found, left
