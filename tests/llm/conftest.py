"""A small table of documents with all that can go wrong, and an empty one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LICENSES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-only", "cc by nc cc by nc 4.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.", "All rights reserved. BSD 3-Clause License",
    "see https://www.mozilla.org/MPL/2.0 and Mozilla Public License 2.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
]


def make_rows() -> list[tuple]:
    rng = random.Random(11)
    words = ["the", "of", "and", "in", *("".join(rng.choice("abcdeéüß漢") for _ in range(rng.randint(2, 9))) for _ in range(300))]
    prose = lambda n: " ".join(rng.choice(words) + (".\n" if rng.random() < 0.08 else "") for _ in range(n))
    passage = prose(70)
    base = prose(220)
    texts: list[str | None] = [None, "", " \n\t ", "x", "one two", "a" * 5000, "ab" * 900, base, base, base, prose(9000)]
    texts += [prose(rng.randint(30, 200)) for _ in range(25)]
    texts += [prose(40) + "\n" + passage + "\n" + prose(40) for _ in range(6)]
    for _ in range(6):
        own = base.split(" ")
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += [prose(60) + "\n" + x for x in LICENSES]
    texts += [" ".join(w.upper() + "!!" for w in prose(80).split()), " ".join(w + "***" for w in prose(90).split()), "same line here\n" * 60, "q w e " * 100]
    texts += ["tab nbsp em  <|endoftext|> 😀 é", "İK KELVIN ſ", "\u0000nul\u0001"]
    rows = [(i * 3 % 1009 if i % 17 else i, t, "en", f"s{i % 4}" if i % 9 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (None, base, "en", "s1", 1), (None, None, None, None, None), rows[7], rows[40]]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """Written, so that it reads the same each time; with further columns of names that the operators use inside."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("row", "raw", "fp", "words", "marks", "kept", "class", "bucket", "norm", "x", "base", "anchor", "term", "shard", "__row", "size"):
        df = df.withColumn(name, F.lit(name))
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
