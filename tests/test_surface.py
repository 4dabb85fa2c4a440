"""What lies around collection: hooks, completion, plugins, questions, metrics, all profiles; diffs of profiles that differ from the snapshot's."""

from __future__ import annotations

import io
import json
import subprocess

import pytest

from corpusloom.operators.splitting import DefaultTokens, chunks_of
from corpusloom.plans import presets, profiles, setup
from corpusloom.plans.api import Engine
from corpusloom.plans.cli import main, parser
from corpusloom.plans.profiles import Profile
from corpusloom.sources import commands, writers


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, body in {"src/a.py": "import os\n", "src/b.txt": "text\n", "docs/b.md": "# B\n\n\n\nend\n", "docs/c.md": "c\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def test_hook(tree):
    with pytest.raises(FileNotFoundError):
        setup.install_hook(tree)
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    hook = setup.install_hook(tree, "echo done")
    assert subprocess.run([str(hook)], capture_output=True, text=True, check=True).stdout == "done\n"
    with pytest.raises(FileExistsError):
        setup.install_hook(tree)
    assert "collect --all" in setup.install_hook(tree, force=True).read_text()


@pytest.mark.parametrize("shell", setup.SHELLS)
def test_completion(shell):
    script = setup.completion(shell, parser())
    assert "collect" in script and "--incremental" in script
    if shell == "bash":
        asked = 'COMP_WORDS=(corpusloom collect --in); COMP_CWORD=2; _corpusloom; echo "${COMPREPLY[@]}"'
        assert subprocess.run(["bash", "-c", script + asked], capture_output=True, text=True, check=True).stdout.split() == ["--incremental"]


def test_plugins():
    assert setup.plugin_command("tokens") == [] and setup.plugin_command("tokens", remove=True)[-2:] == ["-y", "tiktoken"]
    assert setup.change_plugin("transformers").endswith("pip install transformers")
    with pytest.raises(KeyError):
        setup.plugin_command("none")


def test_questions(tree):
    answers = iter(["Mine", "", "docs"])
    path = setup.interactive(tree, lambda _: next(answers), lambda _: None)
    config = profiles.load_config(tree)
    assert path.is_file() and config.project_name == "Mine" and list(config.profiles) == ["docs"]


def test_presets_from_afar():
    answer = lambda text: lambda url, timeout: io.BytesIO(text.encode())
    assert presets.fetch("https://x.example/p.json", opened=answer('{"a": {"dirs": ["s"]}, "b": {"odd": 1}}')) == {"a": {"dirs": ["s"]}}
    assert presets.fetch("https://x.example/p.json", opened=answer("no json")) == {}
    with pytest.raises(ValueError, match="address"):
        presets.fetch("http://x.example/p.json")


def test_slow_commands_end(tmp_path):
    assert commands.run("tail -f /dev/null", tmp_path, allow_file_args=True, seconds=0.5) == ""


def test_all_profiles(spark, tree, capsys):
    config = {"profiles": {"one": {"directories": ["src"], "patterns": ["*.py"], "post_commands": ["echo after"]}, "two": {"directories": ["docs"], "patterns": ["*.md"], "compress": True}}, "output_dir": "out"}
    (tree / profiles.CONFIG).write_text(json.dumps(config))
    assert main(["--root", str(tree), "collect", "--all", "--allow-commands"]) == 0
    assert {p.name for p in (tree / "out").glob("*.md")} == {"chat-one_1.md", "chat-two_1.md", "chat-one-manifest.md", "chat-two-manifest.md"}
    found = json.loads((tree / "out" / writers.METRICS).read_text())
    assert found["files_read"] == 2 and found["tokens_raw"] >= found["tokens_compressed"] > 0 and 0 < found["compression_ratio"] <= 1
    assert "run: echo after" in (tree / ".corpusloom" / commands.AUDIT).read_text()
    capsys.readouterr()
    assert main(["--root", str(tree), "manifest", "--json"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert [x["file"] for x in told["parts"]] == ["chat-one_1.md", "chat-two_1.md"] and told["profiles"] == ["one", "two"]
    for argv, said in ((["manifest"], "2 file(s)"), (["collect", "--list"], "one: 1 folders"), (["collect", "--validate"], "[]"), (["benchmark", "--profile", "two"], "baseline"), (["plugins", "list"], "tokens: there")):
        assert main(["--root", str(tree), *argv]) == 0
        assert said in capsys.readouterr().out
    assert main(["--root", str(tree), "collect", "--clean"]) == 0 and not list((tree / "out").glob("chat-*_1.md"))


WIDE, NARROW = Profile(directories=(".",), patterns=("*",)), Profile(directories=("src",), patterns=("*.py",))


def test_diff_of_a_narrow_profile(spark, tree):
    engine = Engine(spark, tree)
    engine.create_snapshot(WIDE, "wide")
    assert engine.diff(NARROW, "wide", flat=True)[1].count() == 0
    assert engine.snapshot_info("wide")["files"] == 4
    (tree / "src/a.py").unlink()
    (tree / "docs/c.md").unlink()
    assert [(r.type, r.path) for r in engine.diff(NARROW, "wide", flat=True)[1].collect()] == [("deleted", "src/a.py")]
    engine.create_snapshot(WIDE, "later")
    excluding = Profile(directories=(".",), patterns=("*",), exclude_patterns=("docs/*",))
    changed = sorted((r.type, r.path) for r in engine.diff(excluding, "wide", "later", flat=True)[1].collect())
    assert changed == [("deleted", "docs/c.md"), ("deleted", "src/a.py")]  # two snapshots are compared whole


def test_collection_of_garbage_by_shards(spark, tree):
    engine = Engine(spark, tree)
    engine.create_snapshot(WIDE, "one")
    before = {p: p.stat().st_mtime_ns for p in (engine.store.root / "objects").rglob("*.parquet")}
    (tree / "src/a.py").write_text("changed\n")
    engine.update_snapshot("one", WIDE)
    assert engine.store.gc()["removed"] == 1
    assert engine.store.objects().count() == 4 and engine.store.damaged().count() == 0
    assert sum(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items()) >= 3
    assert engine.store.gc() == {"removed": 0, "freed_bytes": 0}


def test_characters_by_any_count():
    words = lambda text: len(text.split()) or 1
    text = "ab " * 5000
    assert "".join(chunks_of(text, 7, words)) == text and all(words(x) <= 7 for x in chunks_of(text, 7, words))
    assert chunks_of("x" * 1000, 10, DefaultTokens(4)) == ["x" * 43] * 23 + ["x" * 11]
    assert chunks_of("x" * 1000, 10, lambda t: max(1, len(t) // 4)) == chunks_of("x" * 1000, 10, DefaultTokens(4))
