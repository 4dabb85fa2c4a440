"""Sections of output: a file's path and text as Markdown, XML or JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.languages import suffix

FORMATS = ("markdown", "xml", "json")


def json_string(text: Column) -> Column:
    """A JSON string in its quotes, other than ASCII left as it is."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", "$1")


def section(path: Column, lang: Column, text: Column, fmt: str = "markdown") -> Column:
    if fmt == "xml":
        attribute = F.when(lang != "", F.concat(F.lit(' language="'), lang, F.lit('"'))).otherwise("")
        return F.concat(F.lit('<file path="'), path, F.lit('"'), attribute, F.lit(">\n<![CDATA[\n"), text, F.lit("\n]]>\n</file>\n"))
    if fmt == "json":
        language = F.when(lang != "", F.concat(F.lit(', "language": '), json_string(lang))).otherwise("")
        return F.concat(F.lit('{"path": '), json_string(path), F.lit(', "content": '), json_string(text), language, F.lit("}\n"))
    return F.concat(F.lit("### "), path, F.lit("\n\n```"), lang, F.lit("\n"), text, F.lit("\n```\n"))


def binary_section(path: Column, content: Column, fmt: str = "markdown") -> Column:
    """Bytes in base 64, on one line."""
    coded = F.regexp_replace(F.base64(content), r"[\r\n]", "")
    extension = F.lower(F.regexp_replace(suffix(path), r"^\.", ""))
    if fmt == "xml":
        return F.concat(F.lit('<file path="'), path, F.lit('" encoding="base64" extension="'), extension, F.lit('">\n'), coded, F.lit("\n</file>\n"))
    if fmt == "json":
        return F.concat(F.lit('{"path": '), json_string(path), F.lit(', "encoding": "base64", "content": '), json_string(coded), F.lit("}\n"))
    return F.concat(F.lit("### "), path, F.lit("\n\n```base64\n"), coded, F.lit("\n```\n"))
