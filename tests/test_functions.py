"""Row-wise functions on cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import formatting, languages, parsers, predicates, text, tokenizers
from corpusloom.operators import structural, textdiff


@pytest.fixture
def of(spark):
    def run(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
        return row.select(column.alias("x")).first().x

    return run


@pytest.mark.parametrize(("value", "tokens"), [("", 1), ("abc", 1), ("abcdefgh", 2), ("👨‍👩‍👧‍👦", 1), ("é" * 9, 2)])
def test_tokens(of, value, tokens):
    assert of(text.count_tokens(F.col("t")), t=value) == tokens


@pytest.mark.parametrize(("value", "want"), [("a\n\n\n\nb", "a\n\nb"), ("a  \nb\t", "a\nb"), ("a\n \n\nb", "a\n\n\nb"), ("", ""), ("a \r\nb", "a \r\nb")])
def test_compress(of, value, want):
    assert of(text.compress(F.col("t")), t=value) == want


def test_line_numbers(of):
    assert of(text.line_numbers(F.col("t")), t="a\nb") == "    1| a\n    2| b"
    assert of(text.line_numbers(F.col("t")), t="") == ""


def test_decoded(of):
    assert of(text.decoded(F.col("t")), t=b"a\r\nb\rc") == "a\nb\nc"
    assert of(text.decoded(F.col("t")), t=b"\xff") is None
    assert of(text.decoded(F.col("t")), t=b"a\0") is None


def test_strip(of):
    assert of(text.strip(F.col("t")), t="\u3000 a b\u00a0\n") == "a b"


@pytest.mark.parametrize(("path", "lang"), [("a/b.py", "python"), ("Dockerfile", "dockerfile"), ("x/.env", "bash"), ("a.tar.GZ", ""), (".py", ""), ("a.d/x", ""), ("m.TS", "typescript")])
def test_language(of, path, lang):
    assert of(languages.lang_for_path(F.col("p")), p=path) == lang


@pytest.mark.parametrize(("line", "lang"), [("#!/usr/bin/env python3", "python"), ("#!/bin/sh -e", "bash"), ("#!", ""), ("x", ""), ("#!/usr/bin/env", "")])
def test_shebang(of, line, lang):
    assert of(languages.lang_from_shebang(F.col("t")), t=f"{line}\nrest") == lang


@pytest.mark.parametrize(("path", "out"), [("a/node_modules/x.js", True), ("node_modules/x.js", True), ("a/b.pyc", True), ("a/b.py", False), ("x/venv", True), ("a\n.pyc", True)])
def test_excluded(of, path, out):
    assert of(predicates.excluded(F.col("p"), ["*.pyc", "node_modules/*", "venv", "[!x]zz"]), p=path) is out


def test_binary(of):
    skip = lambda path, content, **how: of(predicates.skip_binary(F.col("p"), F.octet_length("c"), F.col("c"), **how), p=path, c=content)
    assert skip("a.py", b"\0") is False
    assert skip("a.bin", b"x\0") is True
    assert skip("a.bin", b"x\0", include=True) is False
    assert skip("a.bin", b"x", extensions=[".png"]) is True
    assert skip("a.bin", b"x" * 300, max_mb=1e-4) is True


def test_snapshot_ids(of):
    assert of(predicates.valid_snapshot_id(F.col("t")), t="é1.a-b") and not of(predicates.valid_snapshot_id(F.col("t")), t="../x")
    with pytest.raises(ValueError, match="snapshot id"):
        predicates.check_snapshot_id("-x")


def test_formats(of):
    assert of(formatting.section(F.col("p"), F.lit("python"), F.col("t")), p="a.py", t="x") == "### a.py\n\n```python\nx\n```\n"
    assert of(formatting.section(F.col("p"), F.lit(""), F.col("t"), "xml"), p="a", t="x") == '<file path="a">\n<![CDATA[\nx\n]]>\n</file>\n'
    assert of(formatting.section(F.col("p"), F.lit("c"), F.col("t"), "json"), p="a", t='é"\n') == '{"path": "a", "content": "é\\"\\n", "language": "c"}\n'
    assert of(formatting.binary_section(F.col("p"), F.col("c"), "xml"), p="a.PNG", c=b"x" * 90).count("\n") == 3


def test_python_header():
    assert parsers.python_header("import a, b.c as d\nfrom e.f import g\nfrom . import h\ndef i(): pass\nclass J: pass") == (["a", "b.c", "e.f"], ["i", "J"])
    assert parsers.python_header("import a, b\nfrom c import d\ndef (") == (["a", "b", "c"], [])


def test_python_signatures():
    source = "import a\n@d\ndef f(x):\n    y = 1\n    return y\nclass C(B):\n    z = 1\nq = 2"
    assert parsers.python_signatures(source) == "import a\n@d\ndef f(x):\n    ...\nclass C(B):\n    ...\nq = 2"
    assert parsers.python_signatures("def (") == "def ("


def test_python_blocks():
    assert parsers.python_blocks("@d\ndef f(x):\n    return 1\nf = 2") == {"f": ("@d\ndef f(x):", "    return 1")}
    assert parsers.python_blocks("def (") is None


def test_c_like_blocks():
    source = 'function f(a) {\n  s = "}";\n  if (x) { y }\n}\nclass C {\n}\nfunction f(b) {}\nfunction open() {'
    found = parsers.c_like_blocks(source)
    assert list(found) == ["f", "open", "C"]
    assert found["f"][0] == "function f(a)"
    assert found["open"][1] == "{"


def test_script_blocks():
    assert parsers.script_blocks("def a?(x)\n  1\nend")["a?"] == ("def a?(x)", "1\nend")


def test_headers(of):
    source = "import { b, a } from './m'\nimport x from \"y\"\n#include <z.h>\nusing A.B;\nfn go() {}\n"
    deps, exports = parsers.header_parts(F.col("t"), F.lit("rust"))
    assert of(parsers.header(F.lit("p"), deps, exports), t=source) == "### p\ndeps:  b, a , ./m, A.B, y, z.h\nexports: go\n"
    assert of(parsers.header(F.lit("p"), *parsers.header_parts(F.col("t"), F.lit("python"))), t="import q\n") == "### p\ndeps: q\n"
    assert of(parsers.header(F.lit("p"), *parsers.header_parts(F.col("t"), F.lit("text"))), t="import q\n") == ""


def test_signatures_of_other_languages(of):
    assert of(parsers.signatures(F.col("t"), F.lit("text")), t="as it is") == "as it is"
    assert of(parsers.signatures(F.col("t"), F.lit("go")), t="func f(a int) int {\n}\ntype T struct {") == "func f(a int) int\ntype T struct"


def test_text_diff():
    assert textdiff.text_diff("a\nb\n", "a\nc\nd\n", "p") == "### p\n\nREMOVED lines 2:\n    b\n\nADDED lines 2-3:\n    c\n    d\n"
    assert textdiff.text_diff("x", "x", "p") == ""
    assert textdiff.text_diff("", "n", "p") == "### p\n\nADDED (new file):\n\n```\nn\n```\n"
    assert textdiff.text_diff("o", "", "p", "xml") == '<file path="p">\n  <removed>\n    [DELETED]\n  </removed>\n</file>\n'
    assert textdiff.text_diff("a", "<", "p", "xml") == '<file path="p">\n  <removed>\n        a\n  </removed>\n  <added>\n        &lt;\n  </added>\n</file>\n'
    assert textdiff.text_diff("", "x" * 100, "p", limit=12).count("truncated") == 1


def test_structural_text():
    out = structural.structural_text("def f(a):\n    return 1\ndef g():\n    pass", "def f(b):\n    return 2\nclass H:\n    pass", "p.py", "python")
    assert "MODIFIED: function f\n  Signature changed:\n    - def f(a):\n    + def f(b):\n" in out
    assert "DELETED: function g\n" in out and "ADDED: class H\n" in out
    assert structural.structural_text("x", "y", "p", "text").startswith("### p\n\nREMOVED")


def test_tokenizers(tmp_path, spark, of):
    (tmp_path / "mine.py").write_text("def count(t):\n    return len(t.split())\n")
    (tmp_path / "bad.py").write_text("import os\ndef count(t):\n    return 1\n")
    assert of(tokenizers.load("mine:count", tmp_path, spark=spark)(F.col("t")), t="a b c") == 3
    for spec in ("bad:count", "none:count", "unknown", "mine:other"):
        with pytest.raises(ValueError):
            tokenizers.load(spec, tmp_path)
    assert of(tokenizers.load("default", chars_per_token=2)(F.col("t")), t="abcd") == 2


def test_percent(of):
    assert of(text.percent(F.col("a"), F.col("b")), a=1, b=10000) == "<0.1%"
    assert of(text.percent(F.col("a"), F.col("b")), a=1, b=8) == "12.5%"
    assert of(text.percent(F.col("a"), F.col("b")), a=1, b=0) == "0.0%"


@pytest.mark.parametrize(("command", "items"), [("a; b", ["a", "b"]), ("a && b || c | d & e\nf", ["a", "b", "c", "d", "e", "f"]), ("a ';' \"&\" \\; b", ["a ';' \"&\" \\; b"]), ("a 2>&1 &> f", ["a 2>&1 &> f"])])
def test_list_items(command, items):
    from corpusloom.sources import commands

    assert commands.list_items(command) == items


def test_every_item_of_a_list_is_checked():
    from corpusloom.sources import commands

    for bad in ("cat x; touch y", "cat x && touch y", "cat x | touch y", "cat x\ntouch y", "cat x & touch y"):
        assert commands.objection(bad, allow_file_args=True) == "'touch' is not on the list"
    for good in ("cat x; wc y", "cat x > y", "cat x 2>&1 | sort"):
        assert commands.objection(good, allow_file_args=True) is None
    assert commands.label("a" * 50) == "pre: " + "a" * 50 and commands.label("a" * 51) == "pre: " + "a" * 47 + "..."
