"""Dependencies, exports, signatures and blocks of source texts.

The families of C and of scripts are read with patterns, on the JVM. Python is read with its own grammar in Arrow batches.
Blocks need brace matching and go through Arrow batches for every language.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions.languages import C_LIKE_READ, SCRIPT
from corpusloom.functions.scopes import SCOPED, scoped_blocks
from corpusloom.functions.text import strip

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
BLOCK_TYPE = "array<struct<name:string,signature:string,body:string>>"


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(P.bounded(pattern), re.MULTILINE)


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


# Python


def python_header(text: str) -> tuple[list[str], list[str]]:
    """Modules imported and names defined at the top level; by lines, and without names, where the text has errors."""
    tree = _tree(text)
    if tree is None:
        return _python_imports_by_line(text), []
    deps: list[str] = []
    exports: list[str] = []
    for node in tree.body:
        match node:
            case ast.Import():
                deps += [alias.name for alias in node.names]
            case ast.ImportFrom(module=str(module)):
                deps.append(module)
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                exports.append(node.name)
    return deps, exports


def _listed(names: str) -> list[str]:
    return [x.strip() for x in names.split(",") if x.strip()]


def _python_imports_by_line(text: str) -> list[str]:
    found: list[str] = []
    for line in map(str.strip, text.split("\n")):
        if line.startswith("import "):
            found += _listed(line.removeprefix("import "))
        elif origin := _compiled(P.PYTHON_FROM).match(line):
            found.append(origin[1])
    for several in _compiled(P.PYTHON_IMPORT_LIST).finditer(text):
        found += _listed(several[1])
    return found


def python_signatures(text: str) -> str:
    """The text with the body of each top-level definition left out but for ``...`` in place of its first line."""
    tree = _tree(text)
    if tree is None:
        return text
    lines = text.split("\n")
    shown = dict(enumerate(lines))
    for node in tree.body:
        if isinstance(node, _DEFINITIONS):
            first, last = node.body[0].lineno - 1, node.end_lineno - 1
            for i in range(first, last + 1):
                shown.pop(i, None)
            kept = {node.lineno - 1, *(d.lineno - 1 for d in node.decorator_list)}
            if not isinstance(node, ast.ClassDef) and node.returns is not None:
                kept.add(last)
            lines[first] = "    ..."
            shown |= {i: lines[i] for i in {*kept, first}}
    return "\n".join(shown[i] for i in sorted(shown)).strip()


def python_blocks(text: str) -> dict[str, tuple[str, str]] | None:
    """Each top-level definition's head, decorators included, and body; of equal names the last. None where the text has errors."""
    tree = _tree(text)
    if tree is None:
        return None
    lines = text.split("\n")
    found = {}
    for node in tree.body:
        if isinstance(node, _DEFINITIONS):
            head = min([node.lineno, *(d.lineno for d in node.decorator_list[:1])]) - 1
            body = node.body[0].lineno - 1
            found[node.name] = ("\n".join(lines[head:body]), "\n".join(lines[body : node.end_lineno]))
    return found


# Braces and scripts

# What is quoted, in which a brace is none.
_QUOTED = r'"[^"]*"|\'[^\']*\'|`[^`]*`'
_BRACE, _IN_LINE = re.compile(r"[{}]"), re.compile(rf"{_QUOTED}|\n")
_IN_CODE, _IN_COMMENT = re.compile(rf"{_QUOTED}|//|/\*|[{{}}]"), re.compile(rf"{_QUOTED}|//|\*/(?!/)")


class Braces:
    """Which braces of a text belong together, once with and once without regard to strings and comments.

    Strings are found first, then line comments, then block comments in what is left of the text from a place on. Behind a brace that
    is in none of them all three begin anew, so the next such brace depends on the place only and is looked for once, whichever blocks it lies in.
    """

    def __init__(self, text: str):
        self.text, self._last_end = text, text.rfind("*/")
        self._ends: dict[int, int | None] = {}
        self._next: dict[int, int | None] = {}
        self._closing: dict[int, int | None] = {}
        self._plain: dict[int, int] = {}
        opened = []
        for m in _BRACE.finditer(text):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                self._plain[opened.pop()] = m.end()

    def _behind(self, quiet: re.Match) -> int:
        """Where to go on behind a string, or at the end of the line behind ``//``. Strings are found first, also in a comment: a newline in one doesn't end it."""
        if quiet[0] != "//":
            return quiet.end()
        at = quiet.end()
        while (m := _IN_LINE.search(self.text, at)) is not None and m[0] != "\n":
            at = m.end()
        return len(self.text) if m is None else m.start()

    def _comment_end(self, start: int) -> int | None:
        """The end of the block comment that opens at ``start``; None if nothing closes it, and it is none."""
        if start not in self._ends:
            at = start + 2 if start + 2 <= self._last_end else len(self.text)
            while (m := _IN_COMMENT.search(self.text, at)) is not None and m[0] != "*/":
                at = self._behind(m)
            self._ends[start] = None if m is None else m.end()
        return self._ends[start]

    def _following(self, start: int) -> int | None:
        """The next brace behind ``start`` that is in no string and no comment."""
        if start not in self._next:
            at = start + 1
            while (m := _IN_CODE.search(self.text, at)) is not None and m[0] not in "{}":
                at = (self._comment_end(m.start()) or m.end()) if m[0] == "/*" else self._behind(m)
            self._next[start] = None if m is None else m.start()
        return self._next[start]

    def _closed(self, start: int) -> bool:
        """Whether the brace at ``start`` closes, strings and comments aside. What is found for the braces within is kept."""
        waiting = [(start, self._following(start))]
        while waiting:
            opening, at = waiting.pop()
            while at is not None and self.text[at] == "{":
                if at not in self._closing:
                    break
                at = None if self._closing[at] is None else self._following(self._closing[at])
            if at is not None and self.text[at] == "{":
                waiting += [(opening, at), (at, self._following(at))]
            else:
                self._closing[opening] = at
        return self._closing[start] is not None

    def block(self, start: int) -> str:
        """The block that opens at ``start``; all the rest where, strings and comments aside, it never closes."""
        if not self.text.startswith("{", start):
            return ""
        return self.text[start : self._plain.get(start) if self._closed(start) else None]


def c_like_blocks(text: str) -> dict[str, tuple[str, str]]:
    """Head and braced body of each definition; of equal names the first, in order of the patterns."""
    found: dict[str, tuple[str, str]] = {}
    braces = Braces(text)
    for pattern in P.BLOCKS:
        for m in _compiled(pattern).finditer(text):
            if m[1] not in found:
                found[m[1]] = (m[0].strip(), braces.block(m.end()))
    return found


def script_blocks(text: str) -> dict[str, tuple[str, str]]:
    """Head of each definition and all that follows it; of equal names the last."""
    return {m[2]: (m[1].strip(), text[m.end() :].strip()) for pattern in P.SCRIPT_BLOCKS for m in _compiled(pattern).finditer(text)}


def blocks_of(text: str | None, lang: str | None, scoped: bool = False) -> dict[str, tuple[str, str]] | None:
    """The blocks of a text; None for a language that isn't read and for Python with errors. ``scoped`` reads the languages of ``scopes`` by their scopes and not by patterns."""
    if text is None:
        return None
    if scoped and lang in SCOPED:
        return scoped_blocks(text, lang)
    if lang == "python":
        return python_blocks(text)
    if lang in C_LIKE_READ:
        return c_like_blocks(text)
    return script_blocks(text) if lang in SCRIPT else None


# Columns


def _by_batch(kind: str, f: Callable):
    """An Arrow function of text and language."""

    @F.arrow_udf(kind)
    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t, x) for t, x in zip(text.to_pylist(), lang.to_pylist(), strict=True)], _ARROW[kind])

    return run


_ARROW = {
    "struct<deps:array<string>,exports:array<string>>": pa.struct([("deps", pa.list_(pa.string())), ("exports", pa.list_(pa.string()))]),
    "string": pa.string(),
    BLOCK_TYPE: pa.list_(pa.struct([("name", pa.string()), ("signature", pa.string()), ("body", pa.string())])),
}


def _header_row(text: str, lang: str) -> dict | None:
    return dict(zip(("deps", "exports"), python_header(text), strict=True)) if lang == "python" else None


def _signature_row(text: str, lang: str) -> str | None:
    return python_signatures(text) if lang == "python" else None


def _block_row(text: str, lang: str, scoped: bool = False) -> list[dict] | None:
    found = blocks_of(text, lang, scoped)
    return None if found is None else [{"name": n, "signature": s, "body": b} for n, (s, b) in found.items()]


def _all(text: Column, table: tuple[str, ...]) -> Column:
    """What all groups of all patterns capture."""
    return F.filter(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(P.java(p)), F.lit(g)) for p in table for g in range(1, P.groups(p) + 1)])), lambda x: x != "")


def header_parts(text: Column, lang: Column, python: bool = True) -> tuple[Column, Column]:
    """Dependencies and exports, unsorted, as arrays; empty for languages that aren't read. ``python=False`` stays on the JVM."""
    empty = F.array().cast("array<string>")
    deps = F.when(lang.isin(*C_LIKE_READ), _all(text, P.C_LIKE_IMPORTS)).when(lang.isin(*SCRIPT), _all(text, P.SCRIPT_IMPORTS))
    exports = F.when(lang.isin(*C_LIKE_READ), _all(text, (P.C_LIKE_EXPORT,))).when(lang.isin(*SCRIPT), _all(text, P.SCRIPT_EXPORTS))
    if python:
        read = _by_batch("struct<deps:array<string>,exports:array<string>>", _header_row)(text, lang)
        deps, exports = deps.when(lang == "python", read["deps"]), exports.when(lang == "python", read["exports"])
    return deps.otherwise(empty), exports.otherwise(empty)


def header(path: Column, deps: Column, exports: Column) -> Column:
    """Path, distinct dependencies and distinct exports, a line each; nothing where there are neither."""
    line = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(F.array_distinct(x)), ", "), F.lit("\n"))).otherwise("")
    return F.when((F.size(deps) == 0) & (F.size(exports) == 0), "").otherwise(F.concat(F.lit("### "), path, F.lit("\n"), line("deps", deps), line("exports", exports)))


def signatures(text: Column, lang: Column, python: bool = True) -> Column:
    """The signatures of a text, a line each; the text itself where there are none or the language isn't read."""
    read = lambda table: F.array_join(F.transform(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(P.java(p)), F.lit(1)) for p in table])), strip), "\n")
    c_like, script = read((P.C_LIKE_SIGNATURE,)), read(P.SCRIPT_SIGNATURES)
    found = F.when(lang.isin(*C_LIKE_READ), F.when(c_like != "", c_like)).when(lang.isin(*SCRIPT), F.when(script != "", script))
    if python:
        found = found.when(lang == "python", _by_batch("string", _signature_row)(text, lang))
    return F.coalesce(found, text)


def blocks(text: Column, lang: Column, scoped: bool = False) -> Column:
    """Name, signature and body of each block; null where ``blocks_of`` has none."""
    return _by_batch(BLOCK_TYPE, partial(_block_row, scoped=scoped))(text, lang)
