"""Trees of files: sources, collection, snapshots, comparison."""

from __future__ import annotations

import dataclasses
import difflib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import textdiff
from corpusloom.operators import diff as D
from corpusloom.operators import incremental
from corpusloom.operators import query as query_op
from corpusloom.plans import collect as C
from corpusloom.plans import presets, profiles
from corpusloom.plans.api import Engine
from corpusloom.plans.profiles import Profile
from corpusloom.sources import commands, files, gitignore, remote, writers
from corpusloom.sources.store import SnapshotExists, SnapshotNotFound, StoreError


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, body in {
        "src/__init__.py": "", "src/auth.py": "import crypto\ndef login(user):\n    return user\n", "src/crypto.py": "def hash_it(x):\n    return x\n",
        "src/main.py": "import auth\nprint(1)\n", "src/_hidden/.dot.py": "x = 1\n", "src/a-b.py": "y = 2\n", "src/skip.pyc": "z", "docs/readme.md": "# Hi\n\n\n\nthere\n", "src/data.bin": "b\0in",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body.encode())
    (root / ".gitignore").write_text("# c\n\n*.tmp\n/build\n")
    os.symlink(root / "src/auth.py", root / "src/link.py")
    return root


PROFILE = Profile(directories=("src", "docs", "missing"), patterns=("*.py", "*.md", "*"), max_tokens=1000, use_gitignore=True, name_template="chat", title_template="# {project_name} {part}/{total}\n")


def test_scan(spark, tree):
    rows = files.scan(spark, tree, ["src", "docs"], ["*.py", "*"])
    names = {r.path for r in rows.select("path").collect()}
    assert "src/__init__.py" in names and "src/_hidden/.dot.py" in names and "src/link.py" not in names
    assert files.scan(spark, tree, ["src"], ["*.py", "*"], keep_all=True).count() > files.scan(spark, tree, ["src"], ["*.py", "*"]).count()
    assert files.scan(spark, tree, ["src"], ["../*"]).count() == 0
    assert files.scan(spark, tree, [], [], ["../tree/docs/readme.md", "gone"]).where("error is null").count() == 1
    in_order = [r.path for r in files.scan(spark, tree, ["src"], ["*.py"]).orderBy(*files.in_order()).collect()]
    assert in_order.index("src/_hidden/.dot.py") < in_order.index("src/a-b.py")


def test_gitignore(tree):
    (tree / "docs" / ".gitignore").write_text("*.log\n/out\n")
    (tree / "node_modules").mkdir()
    (tree / "node_modules" / ".gitignore").write_text("all\n")
    assert sorted(gitignore.load(tree)) == ["*.tmp", "build", "docs/*.log", "docs/out"]


def test_collect(spark, tree, tmp_path):
    found = C.collect(spark, tree, PROFILE)
    paths = [r.path for r in found.sections.orderBy("seq").collect()]
    assert paths[0].startswith("src/") and paths[-1] == "docs/readme.md" and "src/skip.pyc" not in paths and "src/data.bin" not in paths
    names = C.write(found, tmp_path / "out", PROFILE, "P")
    assert names == ["chat_1.md"]
    body = (tmp_path / "out" / "chat_1.md").read_text()
    assert body.startswith("# P 1/1\n\nPart 1 of 1. Files in this part:\n\n") and "def login" in body
    assert C.write(found, tmp_path / "out", PROFILE, "P", merge=True) == ["chat_2.md"]
    assert writers.clean(tmp_path / "out", "chat") == ["chat_1.md", "chat_2.md"]
    assert C.metrics(found)["files_read"] == len(paths)
    assert any("auth.py" in line for line in C.in_line(C.dry_run(found, 1000)))


def test_modes_and_queries(spark, tree):
    parts = lambda **how: "\n".join(r.content for r in C.collect(spark, tree, PROFILE, **how).parts.collect())
    assert "return user" not in parts(mode="repo-map") and "def login(user):" in parts(mode="repo-map")
    assert "deps: crypto\nexports: login\n" in parts(mode="headers")
    asked = parts(text_query="hash_it")
    assert "src/crypto.py" in asked and "src/auth.py" in asked and "src/main.py" in asked and "readme" not in asked
    small = dataclasses.replace(PROFILE, max_tokens=8, compress=True)
    assert C.collect(spark, tree, small).parts.count() > 3


def test_pre_commands(spark, tree):
    profile = dataclasses.replace(PROFILE, pre_commands=("echo hi",))
    first = C.collect(spark, tree, profile, allow_commands=True).sections.orderBy("seq").first()
    assert (first.path, first.content.strip()) == ("pre: echo hi", "hi")
    made = C.collect(spark, tree, dataclasses.replace(PROFILE, command="echo one"), allow_commands=True)
    assert [r.content for r in made.parts.collect()] == ["one"]


def test_import_chain_declared(spark):
    rows = [("m.js", "deps: b\nx"), ("b.js", "deps: c"), ("c.js", "needle"), ("d.js", "deps: m"), ("e.js", "deps: d")]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("deps", F.array().cast("array<string>"))
    assert {r.path for r in query_op.filtered(df, "needle").collect()} == {"c.js", "b.js", "m.js"}


def test_snapshots(spark, tree):
    engine = Engine(spark, tree)
    with pytest.raises(SnapshotNotFound):
        engine.resolve(None)
    first = engine.create_snapshot(PROFILE, "one")
    with pytest.raises(SnapshotExists):
        engine.create_snapshot(PROFILE, "one")
    assert engine.diff(PROFILE, first)[0]["total_tokens"] == 0
    (tree / "src/auth.py").rename(tree / "src/login.py")
    (tree / "src/crypto.py").write_text("def hash_it(x, y):\n    return y\n")
    (tree / "src/new.py").write_text("def fresh():\n    pass\n")
    (tree / "docs/readme.md").unlink()
    counts, sections = engine.diff(PROFILE, flat=True)
    assert {k: v for k, v in counts.items() if k != "total_tokens"} == {"renamed": 1, "moved": 0, "modified": 1, "added": 1, "deleted": 1}
    by_type = {r.type: r for r in sections.collect()}
    assert by_type["renamed"].content == "RENAMED: src/auth.py -> src/login.py\n"
    assert by_type["deleted"].content == "### docs/readme.md\n\n[DELETED]\n"
    grouped = engine.diff(PROFILE)[1].orderBy("rank", "path").collect()
    assert grouped[0].content == "## Changes from one to current (1 renamed, 1 modified, 1 added, 1 deleted)\n\n"
    assert [r.content for r in grouped if r.type == "header"][1:] == ["### Renamed\n", "### Modified\n", "### Added\n", "### Deleted\n"]
    assert "Signature changed" in engine.diff(PROFILE, mode="structural", flat=True)[1].where("type = 'modified'").first().content
    assert "~ def hash_it(x):\n  -> def hash_it(x, y):\n" in engine.diff(PROFILE, mode="repo-map", flat=True)[1].where("type = 'modified'").first().content
    engine.create_snapshot(PROFILE, "two")
    with pytest.raises(StoreError):
        engine.resolve(None)
    assert [m["id"] for m in engine.snapshots()] == ["two", "one"] and engine.store.head() == "two"
    assert engine.diff(PROFILE, "one", "two")[0]["renamed"] == 1
    before = engine.store.stats()
    engine.store.delete("one")
    gone = engine.store.gc()
    assert gone["removed"] > 0 and engine.store.stats()["objects"] == before["objects"] - gone["removed"] and engine.store.head() == "two"
    assert engine.store.damaged().count() == 0
    sha = engine.store.files("two").first().sha256
    assert engine.store.get(sha) is not None
    assert engine.store.rename("two", "three") == "three" and engine.store.head() == "three"
    assert engine.update_snapshot("three") == "three"
    manifest = tree / ".corpusloom/snapshots/three.json"
    manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"version": 99}))
    with pytest.raises(StoreError):
        engine.store.manifest("three")


def test_renames(spark):
    rename = lambda old, new: D.exact_renames(D.hash_groups(D.classified(spark.createDataFrame(old, "path string, sha256 string"), spark.createDataFrame(new, "path string, sha256 string")))).collect()
    assert rename([("a/x", "1")], [("b/x", "1")])[0].type == "moved"
    assert rename([("a/x", "1")], [("b/y", "1")])[0].content == "MOVED AND RENAMED: a/x -> b/y\n"
    assert rename([("a", "1"), ("b", "1")], [("c", "1")]) == []


def test_similar_renames_are_greedy_in_order(spark):
    import difflib

    texts = {f"d{i}.py": "line one\nline two\nline three\n" * 3 + f"tail {i}" * i for i in range(4)} | {f"n{i}.py": "line one\nline two\nline three\n" * 3 + f"tail {i}" * (i + 1) for i in range(3)} | {"n9.md": "line one\n", "d9.py": "other entirely"}
    rows = [(p, p, "deleted" if p[0] == "d" else "added") for p in texts]
    rest = spark.createDataFrame(rows, "path string, sha256 string, state string")
    contents = spark.createDataFrame(list(texts.items()), "sha256 string, content string")
    free, want = sorted(p for p in texts if p[0] == "n"), {}
    for old in sorted(p for p in texts if p[0] == "d"):
        for new in free:
            if old[-3:] == new[-3:] and difflib.SequenceMatcher(None, texts[old], texts[new]).ratio() > 0.7:
                want[old] = new
                free.remove(new)
                break
    got = {r.old_path: r.path for r in D.similar_renames(rest, contents).collect()}
    assert got == want and got


@pytest.mark.parametrize("rounds", [0, 1, 3, 9])
def test_greedy_in_rounds_is_greedy_in_order(spark, rounds):
    import random

    rng = random.Random(rounds)
    edges = {(f"o{rng.randrange(30):02}.a", f"n{rng.randrange(30):02}.a") for _ in range(120)} | {(f"p{i}.b", f"m{j}.b") for i in range(9) for j in range(7)} | {(f"q{i}.c", f"r{i + k}.c") for i in range(9) for k in (0, 1)}
    taken, want = set(), set()
    for old, new in sorted(edges):
        if old not in taken and new not in taken:
            taken |= {old, new}
            want.add((old, new))
    found = D.greedy(spark.createDataFrame([(*e, 0.8) for e in edges], "old_path string, new_path string, ratio double"), rounds)
    assert {(r.old_path, r.new_path) for r in found.collect()} == want
    assert D.greedy(found.limit(0), rounds).count() == 0


def test_pieces_find_every_similar_pair(spark, monkeypatch):
    import difflib
    import random

    monkeypatch.setattr(D, "TILE", 3)
    rng = random.Random(5)
    texts = {f"{'dn'[i % 2]}{i:03}{rng.choice(['.py', '.md', ''])}": "".join(rng.choice("aaaab\né漢") for _ in range(rng.choice([0, 1, 2, 3, 5, 30, 31, 34]))) for i in range(200)}
    rest = spark.createDataFrame([(p, p, "deleted" if p[0] == "d" else "added") for p in texts], "path string, sha256 string, state string")
    got = {(r.old_path, r.new_path): r.ratio for r in D.similar_pairs(rest, spark.createDataFrame(list(texts.items()), "sha256 string, content string")).collect()}
    want = {(a, b): r for a in texts for b in texts if a[0] == "d" and b[0] == "n" and a[4:] == b[4:] and (r := difflib.SequenceMatcher(None, texts[a], texts[b]).ratio()) > 0.7 and len(texts[a]) + len(texts[b])}
    both_empty = {(a, b) for a, b in got if not texts[a] and not texts[b]}
    assert {k: v for k, v in got.items() if k not in both_empty} == want and len(want) > 5


def test_incremental(spark):
    schema = "path string, mtime_ns bigint, size bigint, sha256 string"
    cache = spark.createDataFrame([("a", 10**9, 1, "x"), ("b", 10**9, 1, "x"), ("c", 10**9, 1, "x"), ("gone", 1, 1, "x"), ("big", 1, 9, None)], schema)
    now = spark.createDataFrame([("a", 10**9 + 999_999, 1, "y"), ("b", 10**9 + 10**6, 1, "x"), ("c", 10**9, 2, "y"), ("n", 1, 1, "z"), ("big", 10**8, 9, None)], schema)
    assert {r.path: r.state for r in incremental.changes(now, cache).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "n": "new", "gone": "deleted", "big": "changed"}
    assert {r.path: r.size for r in incremental.updated(now, cache).collect()} == {"a": 1, "b": 1, "c": 2, "n": 1, "gone": 1, "big": 9}


def test_stream(spark, tmp_path):
    from corpusloom.streaming import incremental as S

    source, seen = tmp_path / "in", []
    schema = "path string, size bigint, mtime_ns bigint, content binary"
    spark.createDataFrame([("a", 1, 1, b"x"), ("b", 1, 1, b"y")], schema).write.parquet(str(source))
    run = lambda: S.follow(spark.readStream.schema(schema).parquet(str(source)), tmp_path / "cache", tmp_path / "check", lambda df, n: seen.extend((r.path, r.state) for r in df.collect()), availableNow=True).awaitTermination()
    run()
    spark.createDataFrame([("a", 1, 1, b"x"), ("b", 2, 9 * 10**9, b"yy")], schema).write.mode("append").parquet(str(source))
    run()
    assert sorted(seen) == [("a", "new"), ("b", "changed"), ("b", "new")]


@pytest.mark.parametrize(
    ("command", "ok"),
    [("echo hi", True), ("cat x", False), ("echo hi | wc", False), ("echo $(id)", False), ("curl x", False), ("'unclosed", True), ("which concatenate", True), ("FIND .", False)],
)
def test_restricted_commands(command, ok):
    assert (commands.objection(command) is None) is ok


def test_allowed_commands(tmp_path):
    assert commands.objection("cat x | sort | uniq", True) is None
    assert list(commands.objections("cat x | python y", True)) == ["'python' is not on the list"]
    assert list(commands.objections("cat `x`; wget y", True)) == ["'wget' is never run", "a command inside of the command", "'wget' is not on the list"]
    assert commands.objection("dd if=x") == "'dd if=' is never run"
    assert commands.pipe_parts("a '|' b | c \"|\" \\| d || e") == ["a '|' b", 'c "|" | d || e']
    log = tmp_path / "log"
    assert commands.run("rm -rf / x", tmp_path, log=log) == "" and "refused" in log.read_text()
    assert "truncated" in commands.run("echo 12345", tmp_path, max_output=3)


def test_urls():
    remote.check_url("https://example.com/x")
    remote.check_url("http://127.0.0.1/x")
    for url in ("http://example.com", "ftp://x", "file:///x"):
        with pytest.raises(ValueError, match="address"):
            remote.check_url(url)


def test_profiles(tmp_path):
    (tmp_path / profiles.CONFIG).write_text(json.dumps({"project_name": "Z", "profiles": {"base": {"patterns": ["*.a"], "max_tokens": 5}, "kid": {"extends": "base", "patterns": ["*.b"]}, "loop": {"extends": "loop"}, "bad": {"split_mode": "x", "max_tokens": 0}}}))
    config = profiles.load_config(tmp_path / "deep") if (tmp_path / "deep").mkdir() is None else None
    kid = profiles.get_profile("kid", config)
    assert kid.patterns == ("*.a", "*.b") and kid.max_tokens == 5 and kid.name_template == "chat-kid" and kid.title_template.startswith("# Z — KID")
    with pytest.raises(ValueError):
        profiles.get_profile("loop", config)
    with pytest.raises(KeyError):
        profiles.get_profile("none", config)
    assert len(profiles.validate("bad", config.profiles["bad"])["errors"]) == 3
    assert {x["name"]: bool(x["errors"]) for x in profiles.doctor(config, tmp_path)}["loop"]
    assert Profile.of(kid.to_dict()).patterns == kid.patterns


def test_presets(tree):
    found = presets.detect(tree)
    assert "python" in found and "docs" in found and "go" not in found
    assert presets.to_profile("python", tree)["directories"] == ["src"]
    assert presets.to_profile("git", tree)["command"].startswith("git log") and presets.to_profile("none", tree) is None
    assert presets.detect(tree, only="config") == ["config"] and presets.detect(tree, only="go") == []
    (tree / "p.json").write_text(json.dumps({"mine": {"dirs": ["src"]}, "bad": {"x": 1}}))
    assert list(presets.from_file(tree / "p.json")) == ["mine"] and presets.merged(local={"go": {}})["go"] == {} and len(presets.builtin()) == 24


def test_command_line(spark, tree, capsys):
    from corpusloom.plans.cli import main

    assert main(["--root", str(tree), "collect", "--max-tokens", "1000", "--output-dir", "o"]) == 0
    assert "chat-default_1.md" in capsys.readouterr().out and (tree / "o" / "chat-default_1.md").is_file()
    assert main(["--root", str(tree), "snapshot", "create", "s1"]) == 0 and main(["--root", str(tree), "diff", "--stats"]) == 0
    assert '"added": ' in capsys.readouterr().out
    assert main(["--root", str(tree), "presets"]) == 0 and main(["--root", str(tree), "store", "stats"]) == 0


def test_incremental_collection(spark, tree):
    engine = Engine(spark, tree)
    profile = dataclasses.replace(PROFILE, exclude_patterns=(*PROFILE.exclude_patterns, ".corpusloom/*"))
    paths = lambda: {r.path for r in engine.collect(profile, incremental=True).sections.select("path").collect()}
    assert "src/auth.py" in paths()
    (tree / "src/auth.py").write_text("changed = True\n")
    (tree / "src/more.py").write_text("new = True\n")
    assert paths() == {"src/auth.py", "src/more.py"}
    assert paths() == set()


def test_written_diff(spark, tree, tmp_path):
    engine = Engine(spark, tree)
    engine.create_snapshot(PROFILE, "one")
    (tree / "src/more.py").write_text("new = True\n")
    names = engine.write_diff(engine.diff(PROFILE)[1], tmp_path / "out", PROFILE)
    body = (tmp_path / "out" / names[0]).read_text()
    assert "Part 1 of 1. Changes: 1 added\n\n" in body and "new = True" in body


def test_command_outputs(spark):
    from corpusloom.operators.textdiff import command_diff

    assert command_diff("a\nb", "a\nc", "pre: tree x", "tree x") == "### pre: tree x\n- b\n+ c\n"
    assert command_diff("a\n", "a", "pre: tree x", "/usr/bin/tree x") == "" and "REMOVED" in command_diff("a\nb", "a\nc", "pre: treeview", "treeview")
    history = "\n=== COMMIT: 1\nx\n=== COMMIT: 2\ny"
    told = command_diff(history, history.replace("y", "z"), "pre: git log", "git log")
    assert told.startswith("### pre: git log section 2\n\nREMOVED") and "section 1" not in told
    assert command_diff(history, "\n=== COMMIT: 1\nx", "pre: git log", "git log") == "### pre: git log section 2\n\n[DELETED]\n"
    assert command_diff("a\nb\n", "", "pre: x", "x") == "### pre: x\n\n[DELETED]\n\n- a\n- b\n"
    assert command_diff("", "new", "pre: x", "x").startswith("### pre: x\n\nADDED")
    schema = "label string, content string"
    rows = D.command_sections(spark.createDataFrame([("pre: a", "1"), ("pre: b", "x"), ("pre: s", "s")], schema), spark.createDataFrame([("pre: a", "2"), ("pre: c", "y"), ("pre: s", "s")], schema)).collect()
    assert {(r.path, r.type) for r in rows} == {("pre: a", "modified"), ("pre: b", "deleted"), ("pre: c", "added")}


def test_benchmark_and_manifest(spark, tree):
    found = C.benchmark(spark, tree, PROFILE, "login")
    assert set(found) == {"full", "compress", "repo-map", "headers", "query"} and found["query"]["tokens"] < found["full"]["tokens"]
    assert "- src/auth.py: " in "".join(C.manifest_lines(C.collect(spark, tree, PROFILE)))


def test_sql(spark):
    from corpusloom.plans import sql

    sql.register(spark)
    row = spark.sql("SELECT count_tokens('abcdefgh') a, compress_text('x  \\n\\n\\n\\ny') b, path_suffix('a/b.tar.gz') c, strip_text(' q ') d").first()
    assert tuple(row) == (2, "x\n\ny", ".gz", "q")
    assert [r.chunk for r in spark.sql("SELECT chunk FROM (SELECT 'aaaa bbbb' AS t), LATERAL split_chunks(t, 1) ORDER BY chunk_no").collect()] == ["aaaa bb", "bb"]


def test_bounds_leave_out_no_pair(monkeypatch):
    """Texts of many lengths and likenesses: what bounds leave is all that is alike, and of texts that aren't, hardly any is compared."""
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("eeeeeeetttttaaaaooooiiinnnsssrrhhll   dcumfpgwybvkxjqz,.") for _ in range(n))
    bases = [prose(n) for n in (60, 199, 200, 260, 900, 1500, 2200, 5000)]
    old, new = list(bases), []
    for base in bases:
        for cut in (0.05, 0.2, 0.3, 0.4, 0.6):
            k = int(len(base) * cut)
            new += [prose(k) + base[k:], base[:-k] + prose(k), base[k:], "".join(c if rng.random() > cut / 8 else "#" for c in base)]
    new += ["", "é" * 300, *(prose(1500) for _ in range(40))]
    old += ["", "é" * 290, *(prose(1500) for _ in range(40))]
    want = {(i, j): r for i, a in enumerate(old) for j, b in enumerate(new) if (r := difflib.SequenceMatcher(None, a, b).ratio()) > 0.7 and (a or b)}
    compared, real = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: compared.append(len(self.b)) or real(self))
    got = textdiff.alike_pairs([str(i) for i in range(len(old))], old, [str(j) for j in range(len(new))], new, 0.7).to_pylist()
    assert {(int(r["old_path"]), int(r["new_path"])): r["ratio"] for r in got if old[int(r["old_path"])] or new[int(r["new_path"])]} == want
    assert sum(n == 1500 for n in compared) < 60  # of over 1600 pairs of that length


def test_crowds_are_matched_block_by_block(spark, monkeypatch):
    """Extensions with and without many alike pairs, cut into small blocks, against the rule taken in order; no list of pairs is made of the crowd."""
    rng = random.Random(8)
    begun = "".join(chr(0x4E00 + i) for i in range(120))
    text = lambda: begun[: rng.randint(10, 110)] + rng.choice("abcdef")
    files = [(f"{side}{rng.random()}.{ext}", text() if ext == "x" else "".join(rng.choices(begun, k=40)), state) for ext, n in (("x", 40), ("y", 30)) for side, state in (("o", "deleted"), ("n", "added")) for _ in range(n)]
    want, taken = [], set()
    for path, a, _ in sorted(f for f in files if f[2] == "deleted"):
        for other, b, _ in sorted(f for f in files if f[2] == "added"):
            if other not in taken and other[-1] == path[-1] and (ratio := difflib.SequenceMatcher(None, a, b).ratio()) > 0.7:
                taken.add(other)
                want.append((path, other, ratio))
                break
    listed, real = [], D.similar_pairs
    monkeypatch.setattr(D, "similar_pairs", lambda rest, *more: listed.append({r.path[-1] for r in rest.collect()}) or real(rest, *more))
    for name, value in (("FEW_PAIRS", 100), ("CROWD", 1), ("BLOCK", 7)):
        monkeypatch.setattr(D, name, value)
    rest = spark.createDataFrame([(p, p, s) for p, _, s in files], "path string, sha256 string, state string")
    contents = spark.createDataFrame([(p, t) for p, t, _ in files], "sha256 string, content string")
    assert sorted(map(tuple, D.matches(rest, contents).select("old_path", "new_path", "ratio").collect())) == sorted(want)
    assert listed == [{"y"}] and want
