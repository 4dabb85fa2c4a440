"""Packing in pieces is packing in order."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import packing, splitting


def in_order(tokens, alone, limit):
    part, held, out = 0, -1, []
    for t, a in zip(tokens, alone, strict=True):
        if a or held < 0 or held + t > limit:
            part, held = part + 1, -1 if a else t
        else:
            held += t
        out.append(part)
    return out


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_pieces(data):
    limit = data.draw(st.integers(1, 30))
    tokens = np.array(data.draw(st.lists(st.integers(1, limit), min_size=1, max_size=40)))
    alone = np.array(data.draw(st.lists(st.booleans(), min_size=len(tokens), max_size=len(tokens))))
    cuts = sorted(data.draw(st.sets(st.integers(1, len(tokens)), max_size=5)))
    held, part, got = -1, 0, []
    for i, j in zip([0, *cuts], [*cuts, len(tokens)], strict=True):
        if i == j:
            continue
        own, lone = tokens[i:j], alone[i:j]
        got += packing.numbered(own, lone, held, limit, part).tolist()
        at, before, opened, last = max(x for x in packing.summary(own, lone, limit) if (x[0] == 0 if held < 0 else x[1] <= limit - held))
        held, part = held + before if last == -2 else last, part + opened
    assert got == in_order(tokens, alone, limit)


def test_any_number_of_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[int(i > 20)] if i % 50 else None, i, int(t)) for i, t in enumerate(rng.integers(1, 9, 400))]
    df = spark.createDataFrame(rows, "g string, seq int, tokens int").withColumn("alone", F.col("seq") % 37 == 0)
    results = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        for few in (0, packing.FEW):
            results.append(sorted((str(r.g), r.seq, r.part) for r in packing.part_map(df, 12, "g", ["seq"], "alone", few).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = []
    for g in ("None", "a", "b"):
        own = [r for r in rows if str(r[0]) == g]
        want += [(g, r[1], p) for r, p in zip(own, in_order([r[2] for r in own], [r[1] % 37 == 0 for r in own], 12), strict=True)]
    assert all(r == sorted(want) for r in results)


def test_unlimited_and_empty(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 7)], "g string, seq int, tokens int")
    assert {r.part for r in packing.part_map(df, -1, "g", ["seq"]).collect()} == {1}
    assert packing.part_map(df.limit(0), 4, "g", ["seq"]).count() == 0


@given(st.text("ab \n", min_size=1, max_size=300), st.integers(1, 20))
def test_chunks_keep_the_text(text, limit):
    chunks = splitting.chunks_of(text, limit, splitting.default_tokens())
    assert "".join("".join(chunks).split()) == "".join(text.split())
    strict = splitting.chunks_of(text, limit, splitting.default_tokens(), strict=True)
    assert all(len(c) // 4 <= limit for c in strict)


def test_sections(spark):
    made = lambda text, marker: spark.createDataFrame([(text,)], "t string").select(splitting.sections(F.col("t"), marker)).first()[0]
    assert made("a\n\n### b\n\n### c", "\n\n### ") == ["a", "\n\n### b", "\n\n### c"]
    assert made("#x#  #y", "#") == ["#x", "#y"]
    assert made("", "#") == []
    assert made("  #y", "#") == ["#y"]


def test_continuation(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "c int, p int")
    got = [r[0] for r in df.orderBy("c").select(packing.continuation(F.lit("x"), F.col("c"), F.lit(3), F.col("p"))).collect()]
    assert got == ["x\n\n> **[CONTINUES in part 2]**", "> **[CONTINUED from part 1]**\n\nx\n\n> **[CONTINUES in part 3]**", "> **[CONTINUED from part 2]**\n\nx"]
