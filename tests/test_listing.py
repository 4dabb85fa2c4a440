"""Listings of trees: what is opened, who lists, and that incremental runs read what may have changed only."""

from __future__ import annotations

import os
import random

import pytest

from corpusloom.operators.incremental import changes
from corpusloom.plans import collect as C
from corpusloom.plans.api import Engine
from corpusloom.plans.profiles import Profile
from corpusloom.sources import files
from corpusloom.sources.walk import Walk
from corpusloom.streaming.incremental import load_cache


@pytest.fixture
def tree(tmp_path):
    root, rng = tmp_path / "tree", random.Random(1)
    folders = ["", "a", "a/b", "a/b/c", "a/node_modules/x", "a/node_modules/x/y", ".git/objects", "b", "b/a", "b/.hidden", "z-a", "z/deep/er/and/er"]
    for folder in folders:
        (root / folder).mkdir(parents=True, exist_ok=True)
        for name in rng.sample(["one.py", "two.py", "n.md", "x.pyc", ".dot", "__pycache__", "a b.py", "[odd].py"], 5):
            (root / folder / name).write_text(folder + name)
    os.symlink(root / "a", root / "link")
    os.symlink(root / "a/b/c", root / "b/link")
    os.symlink(root / "n.md", root / "b/link.md")
    return root


def plain(root, directories, patterns, exclude=()):
    """Every file, then the first place, then exclusion."""
    import fnmatch

    first = {}
    for d, top in enumerate(directories):
        top = os.path.normpath(top)
        if not os.path.isdir(root / top) or os.path.islink(root / top):
            continue
        for folder, folders, names in os.walk(root / top):
            folders[:] = [f for f in folders if not os.path.islink(os.path.join(folder, f))]
            for name in names:
                full = os.path.join(folder, name)
                if os.path.islink(full):
                    continue
                path, within = os.path.relpath(full, root), os.path.relpath(full, root / top)
                for p, pattern in enumerate(patterns):
                    if fnmatch.fnmatchcase(within, pattern) or fnmatch.fnmatchcase(name, pattern):
                        first[path] = min(first.get(path, (d, p)), (d, p))
    ends = lambda path: ["/".join(path.split("/")[i:]) for i in range(path.count("/") + 1)]
    out = lambda path: any(any(fnmatch.fnmatchcase(e, x) for e in (ends(path) if "/" in x else [path, path.rpartition("/")[2]])) for x in exclude)
    return {(path, *place) for path, place in first.items() if not out(path)}


WAYS = [
    ((".",), ("*.py", "*"), ()), (("a", "."), ("*.md", "*.py"), ()), ((".", "a/b", "b"), ("*.py",), ("node_modules/*", "b/*")), (("b", "a", "a/b", "./a"), ("b/*", "*.py", "*.md"), ("*pyc*",)),
    (("link", "b/link", "missing"), ("*",), ()), (("link/b", "."), ("*.py",), ()), ((".", "z/deep"), ("*/er/*", "*"), (".git/*", ".git", "*node_modules*")),
]


@pytest.mark.parametrize("way", range(len(WAYS)))
def test_places(tree, way):
    directories, patterns, exclude = WAYS[way]
    walk = Walk(str(tree), directories, patterns, exclude=exclude)
    found, left = walk.some(walk.start(), 10**6)
    got = [(f.path, f.dir_no, f.pattern_no) for f in found]
    assert not left and sorted(got) == sorted(plain(tree, directories, patterns, exclude))


def test_excluded_folders_stay_shut(tree, monkeypatch):
    opened = []
    own = os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(os.path.relpath(path, tree)) or own(path))
    walk = Walk(str(tree), exclude=("node_modules/*", ".git/*", "z/*"))
    walk.some(walk.start(), 10**6)
    assert sorted(opened) == [".", "a", "a/b", "a/b/c", "b", "b/.hidden", "b/a", "z-a"]


def test_executors_list_the_same(spark, tree):
    names = lambda **how: sorted(tuple(r) for r in files.listing(spark, tree, [".", "a"], ["*.py", "*"], ["n.md", "a/one.py", "gone"], exclude=["*.pyc"], **how).select("path", "size", "dir_no", "pattern_no", "error").collect())
    assert names(driver_names=3, task_names=2) == names()
    assert names(driver_names=0, task_names=1) == names()
    assert ("gone", None, 2, 2, "FileNotFoundError") in names()


def test_source_takes_filters_over(spark, tree):
    rows = files.load(spark, tree, patterns=["*"], exclude=["*.pyc"])
    want = sorted(r.path for r in files.scan(spark, tree, exclude=["*.pyc"]).select("path").collect())
    assert sorted(r.path for r in rows.select("path").collect()) == want
    wanted = rows.where("path LIKE 'a/b%' AND size > 6 AND dir_no = 0")
    assert sorted(r.path for r in wanted.collect()) == sorted(p for p in want if p.startswith("a/b") and os.path.getsize(tree / p) > 6)
    reader = files.FilteringReader({"path": str(tree)})
    assert list(reader.pushFilters([files.StringStartsWith(("path",), "a/b"), files.GreaterThan(("size",), 6), files.EqualTo(("error",), "x")])) == [files.EqualTo(("error",), "x")]
    assert {f.path for p in reader.partitions() for f in reader._found(p) if reader.passes(f)} == {p for p in want if p.startswith("a/b") and os.path.getsize(tree / p) > 6} | {f.path for p in reader.partitions() for f in reader._found(p) if reader.passes(f) and f.path.endswith(".pyc")}


def test_an_incremental_run_opens_what_may_have_changed(spark, tree):
    engine, profile = Engine(spark, tree), Profile(patterns=("*.py",), use_gitignore=False)
    first = engine.collect(profile, incremental=True)
    assert first.sections.count() > 5
    cache = load_cache(spark, tree / ".corpusloom" / "cache")
    assert engine.due(profile, cache).count() == 0
    shown = sorted(p for p, *_ in plain(tree, (".",), ("*.py",), profile.exclude_patterns))
    silent, touched, changed = shown[:3]
    about = os.stat(tree / silent)
    (tree / silent).write_text("?" * about.st_size)  # nothing but its bytes tells that it isn't the same
    os.utime(tree / silent, ns=(about.st_atime_ns, about.st_mtime_ns))
    os.utime(tree / touched, ns=(1, 1))
    (tree / changed).write_text("longer than before")
    (tree / "new.py").write_text("new")
    due = engine.due(profile, cache)
    assert sorted(r.path for r in due.collect()) == sorted([touched, changed, "new.py"])
    assert sum(len(r.content) for r in due.collect()) == sum(os.path.getsize(tree / p) for p in (touched, changed, "new.py"))
    assert {r.path: r.state for r in changes(due, cache).where("state <> 'deleted'").collect()} == {touched: "unchanged", changed: "changed", "new.py": "new"}
    assert sorted(r.path for r in engine.collect(profile, incremental=True).sections.collect()) == sorted([changed, "new.py"])
    assert engine.collect(profile, incremental=True).sections.count() == 0


def test_files_left_out(spark, tree):
    (tree / "large.py").write_text("x" * 3000)
    (tree / "bad.py").write_bytes(b"\xff\xfe")
    (tree / "nul.xyz").write_bytes(b"a\0b")
    profile = Profile(patterns=("*.py", "*.xyz"), use_gitignore=False, max_file_mb=0.002, files=("gone.py",))
    found = {r.path: r.reason for r in C.left_out(C.scanned(spark, tree, profile), profile).collect()}
    assert found == {"large.py": "too large", "bad.py": "no text", "nul.xyz": "binary", "gone.py": "unreadable: FileNotFoundError"}


def test_all_profiles_in_one_plan(spark, tree):
    many = {
        "a": Profile(directories=("a", "."), patterns=("*.md", "*.py"), max_tokens=12, use_gitignore=False),
        "b": Profile(directories=("b", "link", "gone"), patterns=("*",), max_tokens=12, files=("n.md", "gone.py"), exclude_patterns=("*.pyc",), line_numbers=True, use_gitignore=False),
        "c": Profile(patterns=("*.py",), max_tokens=500, section_format="xml", compress=True, use_gitignore=False),
        "none": Profile(directories=("gone",), use_gitignore=False),
    }
    found = C.collect_all(spark, tree, many)
    for name, profile in many.items():
        one, own = C.collect(spark, tree, profile), C.of_profile(found, name)
        assert sorted(map(tuple, own.parts.select("part", "content", "tokens").collect())) == sorted(map(tuple, one.parts.select("part", "content", "tokens").collect())), name
        assert sorted(map(tuple, own.sections.select("seq", "path", "part", "tokens").collect())) == sorted(map(tuple, one.sections.select("seq", "path", "part", "tokens").collect()))
    with pytest.raises(ValueError):
        C.collect_all(spark, tree, {"x": Profile(command="ls")})


def test_presets_of_many_projects(spark, tmp_path):
    from corpusloom.plans import presets

    shown = {"one": ["go.mod", "x/y.txt"], "two": ["docs/a.md", "src/app.csproj"], "three": ["app.csproj", "Cargo.toml.bak"], "four": ["sub/package.json"], "five": ["package.json", "README.md", "pyproject.toml"]}
    for project, names in shown.items():
        for name in names:
            (tmp_path / project / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / project / name).write_text("x")
    rows = [(project, name) for project, names in shown.items() for name in names]
    got = {(r.project, r.preset) for r in presets.detected(spark.createDataFrame(rows, "project string, path string")).collect()}
    assert got == {(project, name) for project in shown for name in presets.detect(tmp_path / project)} and len(got) > 4
