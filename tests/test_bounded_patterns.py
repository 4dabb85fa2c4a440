"""Patterns and brace matching take steps in proportion to the text, and find what the plain patterns find."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import parsers, text
from corpusloom.functions import patterns as P

PLAIN = [*P.C_LIKE_IMPORTS, P.C_LIKE_EXPORT, P.C_LIKE_SIGNATURE, *P.SCRIPT_IMPORTS, *P.SCRIPT_EXPORTS, *P.SCRIPT_SIGNATURES, *P.SCRIPT_BLOCKS, *P.BLOCKS, P.PYTHON_IMPORT_LIST]
WORDS = ["import", "type", "export", "async", "function", "class", "def", "defp", "defmodule", "public", "static", "use", "using", "const", "require", "from", "#include", "struct", "fn", "func", "self.", "a", "b_1", "é", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", " ", "{", "}", "(", ")", "'", '"', "<", ">", ";", "=", "*", "//", "/*", "*/", "`", "?", "."]


def random_text(rng, words=WORDS, most=60):
    return "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(most)))


def stripped(found):
    return [tuple(x.strip() for x in (m if isinstance(m, tuple) else (m,))) for m in found]


def test_bounded_patterns_match_the_same():
    rng = random.Random(1)
    for _ in range(3000):
        t = random_text(rng)
        for p in PLAIN:
            assert stripped(re.findall(p, t, re.M)) == stripped(re.findall(P.bounded(p), t, re.M)), (p, t)


def old_braced(t, start):
    """The block by replacing all strings and comments of the rest first."""
    rest = t[start:]
    if not rest.startswith("{"):
        return ""
    quiet = rest
    for p, flags in ((r'"[^"]*"|\'[^\']*\'|`[^`]*`', 0), (r"//[^\n]*", 0), (r"/\*.*?\*/", re.DOTALL)):
        quiet = re.sub(p, " ", quiet, flags=flags)

    def closing(x):
        depth = 0
        for m in re.finditer(r"[{}]", x):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return m.end()
        return None

    return rest if closing(quiet) is None else rest[: closing(rest)]


def test_braces_as_by_replacement():
    rng = random.Random(2)
    few = ["{", "{", "}", "}", '"', "'", "`", "//", "/*", "*/", "/", "*", "\n", "a", " "]
    for _ in range(20000):
        t = "".join(rng.choice(few) for _ in range(rng.randrange(40)))
        braces = parsers.Braces(t)
        starts = [i for i, c in enumerate(t) if c == "{"]
        rng.shuffle(starts)
        for i in starts:
            assert braces.block(i) == old_braced(t, i), (t, i)
    assert parsers.Braces("a{").block(0) == "" and parsers.Braces("a").block(1) == ""


HARD = {
    "blank lines": "\n" * 1_000_000 + "x",
    "blank columns": " " * 1_000_000 + "x",
    "a word, then blanks": "type" + "\n" * 200_000 + "{\n" + "export" + " " * 200_000 + ";",
    "lists without an end": "import {\nconst {\n#include <a\nuse x\n" * 4_000,
    "nested and closed": "function f() {\n" * 20_000 + "}\n" * 20_000,
    "many short blocks": "".join(f"function f{i}() {{ if (x) {{ return '}}' }} }}\n" for i in range(20_000)),
    "odd quotes": "function f() { don't }\n/* " * 3_000,
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_hard_texts_take_seconds(spark, name):
    began, t = time.time(), HARD[name]
    parsers.c_like_blocks(t)
    rows = spark.createDataFrame([(t, "javascript"), (t, "ruby"), (t, "python"), (t, "cpp")], "t string, lang string")
    deps, exports = parsers.header_parts(F.col("t"), F.col("lang"))
    rows.select(F.size(deps), F.size(exports), F.length(parsers.signatures(F.col("t"), F.col("lang")))).collect()
    rows.select(F.length(text.strip(F.col("t"))), F.length(text.compress(F.col("t")))).collect()
    assert time.time() - began < 60


def test_strip_and_compress_are_the_same(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice(["a", "b", " ", "\t", "\n", "\r", "\x0b", " ", " "]) for _ in range(rng.randrange(14))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(text.strip(F.col("t")).alias("s"), text.compress(F.col("t")).alias("c"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("s2"), F.regexp_replace(F.regexp_replace("t", "\n{2,}", "\n\n"), r"(?md)[ \t]+$", "").alias("c2"))
    assert got.where("s <> s2 OR c <> c2").count() == 0


def test_scopes():
    from corpusloom.functions.scopes import scoped_blocks

    assert scoped_blocks("", "go") == {} and scoped_blocks("}{ ) ]", "javascript") == {}
    nested = scoped_blocks("function a() { class B { c() { const d = () => { } } } }", "javascript")
    assert list(nested) == ["a", "a.B", "a.B.c", "a.B.c.d"] and nested["a.B.c"] == ("c()", "{ const d = () => { } }")
    assert scoped_blocks("/* a */ function f() { '", "javascript") == {"f": ("function f()", "{ '")}
    rng = random.Random(7)
    for _ in range(3000):  # whatever the text, a block is a piece of it that starts with a brace
        t = random_text(rng, [*WORDS, "=>", "`", "${", "class A", "=", "/"])
        for lang in ("javascript", "typescript", "go"):
            assert all(body.startswith("{") and head + body[:1] and body in t for head, body in scoped_blocks(t, lang).values())
    began = time.time()
    scoped_blocks("\n" * 1_000_000 + "x `${ " * 5_000 + "import {\n" * 20_000, "javascript")
    scoped_blocks("".join(f"function f{i}() {{ if (x) {{ return '}}' }} }}\n" for i in range(20_000)), "typescript")
    assert time.time() - began < 60
