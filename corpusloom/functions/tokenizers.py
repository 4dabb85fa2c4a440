"""Pluggable token counters: ``default``, ``tiktoken[:encoding]``, ``transformers[:model]`` or ``module:function``."""

from __future__ import annotations

import ast
import importlib.util
import os
import sys
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import count_tokens

#: A token counter as a column function.
Counter = Callable[[Column], Column]

# Modules that a local tokenizer must not import.
SENSITIVE_MODULES = frozenset(
    "os subprocess sys shutil importlib builtins ctypes socket http urllib requests pickle base64 code codeop compileall crypt "
    "curses email ftplib glob hashlib imaplib io json logging marshal multiprocessing pathlib pdb platform poplib posix pprint "
    "pty random re runpy shelve shlex signal smtplib sqlite3 ssl struct tempfile textwrap threading time traceback uuid "
    "webbrowser xml zipfile zipimport".split()
)


def by_batch(function: Callable[[str], int]) -> Counter:
    """A function of one text as a column function, in Arrow batches."""

    @F.arrow_udf("bigint")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in text.to_pylist()], pa.int64())

    return lambda text: run(text)


def safe_source(path: Path) -> bool:
    """Whether a local module only defines functions and plain values and imports nothing sensitive."""
    try:
        tree = ast.parse(path.read_text(encoding="utf-8"))
    except (OSError, SyntaxError, ValueError):
        return False
    for node in tree.body:
        plain = isinstance(node, (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or (isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant))
        value = isinstance(node, (ast.Assign, ast.AnnAssign)) and not any(isinstance(x, ast.Call) for x in ast.walk(node))
        if not (plain or value):
            return False
    names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
    return not any(n.split(".")[0] in SENSITIVE_MODULES for n in names)


def _module_file(name: str, root: Path) -> Path | None:
    for folder in (root, *map(Path, sys.path)):
        if (found := folder / f"{name.replace('.', '/')}.py").is_file():
            return found
    return None


def load(spec: str, root: Path = Path("."), chars_per_token: int | None = None, allowed: list[str] | None = None, spark: SparkSession | None = None) -> Counter:
    """The counter that ``spec`` names; ValueError where there is none or it isn't allowed."""
    kind, _, rest = spec.partition(":")
    if kind == "default":
        return lambda text: count_tokens(text, chars_per_token)
    if kind == "tiktoken":
        try:
            import tiktoken

            encoding = tiktoken.get_encoding(rest or "cl100k_base")
        except Exception as e:
            raise ValueError(f"tiktoken encoding {rest or 'cl100k_base'!r} can't be loaded: {e}") from e
        return by_batch(lambda t: len(encoding.encode(t, disallowed_special=())))
    if kind == "transformers":
        if importlib.util.find_spec("transformers") is None:
            raise ValueError("transformers isn't installed")
        from transformers import AutoTokenizer

        model = AutoTokenizer.from_pretrained(rest or "gpt2")
        return by_batch(lambda t: len(model.encode(t)))
    if not rest:
        raise ValueError(f"unknown tokenizer {spec!r}")
    safe = allowed if allowed is not None else [x for x in os.environ.get("CORPUSLOOM_SAFE_TOKENIZERS", "").split(",") if x]
    path = _module_file(kind, Path(root))
    if path is None or not (kind in safe or safe_source(path)):
        raise ValueError(f"tokenizer {spec!r} isn't found or isn't safe")
    loaded = importlib.util.spec_from_file_location(kind, path)
    module = importlib.util.module_from_spec(loaded)
    loaded.loader.exec_module(module)
    if spark is not None:
        spark.sparkContext.addPyFile(str(path))
    function = getattr(module, rest, None)
    if not callable(function):
        raise ValueError(f"{kind} has no function {rest!r}")
    return by_batch(function)


def plugins() -> dict[str, bool]:
    """Optional packages and whether they are there."""
    return {name: importlib.util.find_spec(name) is not None for name in ("tiktoken", "transformers", "tree_sitter", "tree_sitter_javascript", "tree_sitter_typescript", "tree_sitter_go")}
