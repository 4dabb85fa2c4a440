"""Presets: ready profiles for kinds of projects."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = {"dirs", "patterns", "files", "pre_commands", "max_tokens", "split_mode", "split_marker", "detect", "tokenizer", "remote"}

MAX_TOKENS = 16000

# Fixed values.
_BUILTIN = {
    "c_cpp": {"dirs": ["src", "include"], "patterns": ["*.c", "*.cpp", "*.h", "*.hpp"], "files": ["CMakeLists.txt", "Makefile"], "detect": ["CMakeLists.txt"], "pre_commands": ["tree src include 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "config": {"dirs": [], "patterns": [], "files": ["package.json", "tsconfig.json", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "requirements-dev.txt"], "detect": [], "pre_commands": [], "max_tokens": 16000, "split_mode": "by_file"},
    "csharp": {"dirs": ["."], "patterns": ["*.cs", "*.csproj", "*.sln"], "files": [], "detect": ["*.csproj", "*.sln"], "pre_commands": ["tree -I 'bin|obj|node_modules' 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "docker": {"dirs": [], "patterns": [], "files": ["Dockerfile", "docker-compose.yml", "docker-compose.yaml"], "detect": ["Dockerfile", "docker-compose.yml", "docker-compose.yaml"], "pre_commands": [], "max_tokens": 16000, "split_mode": "by_file"},
    "docs": {"dirs": ["docs", "documentation", "data/prompts", "config/messages"], "patterns": ["*.md", "*.txt", "*.json"], "files": ["README.md", "README_DEV.md", "TODO.md", "CHANGELOG.md", "Makefile"], "detect": ["docs", "documentation", "README.md", "TODO.md"], "pre_commands": [], "max_tokens": 16000, "split_mode": "by_file"},
    "elixir": {"dirs": ["lib"], "patterns": ["*.ex", "*.exs"], "files": ["mix.exs"], "detect": ["mix.exs"], "pre_commands": ["tree lib 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "git": {"dirs": [], "patterns": [], "files": [], "detect": [".git"], "pre_commands": ["git log --reverse --format='=== COMMIT: %h ===%nTITLE: %s%n%nMESSAGE:%n%b%n%nCHANGES:%n' --stat"], "max_tokens": 16000, "split_mode": "by_marker", "split_marker": "\n=== COMMIT:"},
    "gleam": {"dirs": ["src"], "patterns": ["*.gleam"], "files": ["gleam.toml", "manifest.toml"], "detect": ["gleam.toml"], "pre_commands": ["tree src 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "go": {"dirs": ["."], "patterns": ["*.go"], "files": ["go.mod", "go.sum", "main.go"], "detect": ["go.mod", "main.go"], "pre_commands": ["tree -I 'vendor|node_modules' 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "godot": {"dirs": ["."], "patterns": ["*.gd", "*.tscn", "*.tres", "*.gdshader"], "files": ["project.godot"], "detect": ["project.godot"], "pre_commands": ["tree -I '.godot|__pycache__' 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "haskell": {"dirs": ["src", "app"], "patterns": ["*.hs", "*.lhs"], "files": ["*.cabal", "stack.yaml", "cabal.project"], "detect": ["*.cabal", "stack.yaml"], "pre_commands": ["tree src app 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "javascript": {"dirs": ["src", "app", "lib", "scripts"], "patterns": ["*.js", "*.ts", "*.jsx", "*.tsx"], "files": ["package.json", "tsconfig.json"], "detect": ["package.json", "tsconfig.json"], "pre_commands": ["tree -I 'node_modules|__pycache__|venv' src app lib scripts 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "kotlin_java": {"dirs": ["src"], "patterns": ["*.kt", "*.java"], "files": ["build.gradle", "build.gradle.kts", "pom.xml"], "detect": ["build.gradle", "build.gradle.kts", "pom.xml"], "pre_commands": ["tree src 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "lua": {"dirs": ["src", "lib"], "patterns": ["*.lua"], "files": ["*.rockspec"], "detect": ["src", "lib"], "pre_commands": ["tree src lib 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "php": {"dirs": ["src", "app", "public"], "patterns": ["*.php"], "files": ["composer.json"], "detect": ["composer.json"], "pre_commands": ["tree src app public 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "python": {"dirs": ["src", "app", "lib", "pkg", "scripts"], "patterns": ["*.py"], "files": ["pyproject.toml", "requirements.txt", "requirements-dev.txt"], "detect": ["src", "app", "lib", "pkg"], "pre_commands": ["tree -I '__pycache__|*.pyc|*.egg-info|venv|node_modules' src app lib pkg scripts 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "ruby": {"dirs": ["lib", "app"], "patterns": ["*.rb"], "files": ["Gemfile", "Rakefile"], "detect": ["Gemfile", "Rakefile"], "pre_commands": ["tree lib app 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "rust": {"dirs": ["src"], "patterns": ["*.rs"], "files": ["Cargo.toml", "Cargo.lock"], "detect": ["Cargo.toml"], "pre_commands": ["tree src 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "swift": {"dirs": ["Sources", "Source", "src"], "patterns": ["*.swift"], "files": ["Package.swift"], "detect": ["Package.swift", "Sources", "Source"], "pre_commands": ["tree Sources Source src 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "terraform": {"dirs": ["."], "patterns": ["*.tf", "*.tfvars"], "files": [], "detect": ["*.tf"], "pre_commands": ["tree -I '.terraform|__pycache__' 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "tests": {"dirs": ["tests", "test"], "patterns": ["*.py", "*.js", "*.ts", "*.go", "*.rs"], "files": [], "detect": ["tests", "test"], "pre_commands": ["tree tests test 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "unity": {"dirs": ["Assets"], "patterns": ["*.cs", "*.unity", "*.prefab"], "files": [], "detect": ["Assets"], "pre_commands": ["tree Assets 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "unreal": {"dirs": ["Source", "Content"], "patterns": ["*.cpp", "*.h", "*.cs", "*.ini", "*.uproject", "*.uplugin"], "files": [], "detect": ["*.uproject"], "pre_commands": ["tree Source Content 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
    "zig": {"dirs": ["src"], "patterns": ["*.zig"], "files": ["build.zig", "build.zig.zon"], "detect": ["build.zig", "build.zig.zon"], "pre_commands": ["tree src 2>/dev/null || true"], "max_tokens": 16000, "split_mode": "by_file"},
}


def builtin() -> dict[str, dict]:
    return {name: dict(preset) for name, preset in _BUILTIN.items()}


def valid(preset: object) -> bool:
    if not isinstance(preset, dict) or set(preset) - KEYS:
        return False
    lists = all(isinstance(preset.get(k, []), list) and all(isinstance(x, str) for x in preset.get(k, [])) for k in ("dirs", "patterns", "files", "detect", "pre_commands"))
    tokens = preset.get("max_tokens", MAX_TOKENS)
    return lists and isinstance(tokens, int) and (tokens == -1 or tokens > 0) and preset.get("split_mode", "by_file") in ("by_file", "by_paragraph", "by_marker", "single")


def from_file(path: str | Path) -> dict[str, dict]:
    """The valid presets of a JSON file; none if it can't be read."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in found.items() if valid(v)} if isinstance(found, dict) else {}


def fetch(url: str, seconds: float = 10, opened=None) -> dict[str, dict]:
    """The valid presets at an allowed address; none if it can't be read."""
    from urllib.request import urlopen

    from corpusloom.sources.remote import check_url

    check_url(url)
    try:
        with (opened or urlopen)(url, timeout=seconds) as answer:
            found = json.loads(answer.read().decode("utf-8"))
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in found.items() if valid(v)} if isinstance(found, dict) else {}


def merged(remote: dict | None = None, local: dict | None = None) -> dict[str, dict]:
    """Built-in ones, over them remote ones, over them local ones."""
    return builtin() | (remote or {}) | (local or {})


def _there(path: str, root: Path) -> bool:
    if "*" in path or "?" in path:
        return any(True for _ in root.glob(path))
    full = root / path
    return any(True for _ in full.rglob("*.*")) or full.exists() if full.is_dir() else full.exists()


def detect(root: str | Path, presets: dict[str, dict] | None = None, only: str | None = None) -> list[str]:
    """The presets of which something is found under the root; one by name holds if it has nothing to detect."""
    root, presets = Path(root), presets if presets is not None else builtin()
    if only is not None:
        own = presets.get(only)
        return [only] if own is not None and (not own.get("detect") or any(_there(p, root) for p in own["detect"])) else []
    return [name for name, p in presets.items() if any(_there(x, root) for x in p.get("detect", []))]


def _shown(entry: str, path: Column) -> Column:
    """Whether a file's path shows that an entry to detect is there: the file itself, a folder around it, or a name that matches level by level."""
    if "*" in entry or "?" in entry:
        level = re.escape(entry).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return path.rlike(rf"\A{level}(?:/|\z)")
    return (path == entry) | path.startswith(f"{entry}/")


def detected(files: DataFrame, presets: dict[str, dict] | None = None) -> DataFrame:
    """``(project, preset)`` of many projects at once, from ``(project, path)`` of their files, paths from the project's root. A folder counts if it holds a file."""
    path = F.col("path")
    tests = {name: [_shown(x, path) for x in p["detect"]] for name, p in (presets if presets is not None else builtin()).items() if p.get("detect")}
    shown = [F.when(reduce(Column.__or__, any_of), F.lit(name)) for name, any_of in tests.items()]
    return files.select("project", F.explode(F.array_compact(F.array(*shown))).alias("preset")).distinct()


def to_profile(name: str, root: str | Path, presets: dict[str, dict] | None = None) -> dict | None:
    """A profile's settings: folders and files that exist; the history of git is a command of its own."""
    root, preset = Path(root), (presets if presets is not None else builtin()).get(name)
    if preset is None:
        return None
    found = {"split_mode": preset.get("split_mode", "by_file"), "max_tokens": preset.get("max_tokens", MAX_TOKENS)}
    if name == "git" and preset.get("pre_commands"):
        return found | {"command": preset["pre_commands"][0]} | ({"split_marker": preset["split_marker"]} if preset.get("split_marker") else {})
    if preset.get("dirs"):
        found["directories"] = [d for d in preset["dirs"] if (root / d).is_dir() and any(True for _ in (root / d).rglob("*.*"))]
    if preset.get("files"):
        found["files"] = [f for f in preset["files"] if (root / f).exists()]
    return found | {k: preset[k] for k in ("patterns", "split_marker", "pre_commands", "remote") if preset.get(k)}
