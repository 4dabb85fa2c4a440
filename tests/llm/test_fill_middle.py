"""Fill-in-the-middle against units split off one by one."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from corpusloom.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def model(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    mark = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(mark[8 * i : 8 * i + 8], 16) for i in range(4)]
    first, second = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:first], units[first:second], units[second:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    cut = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, len(units), form, *cut, *(hashlib.sha256(x.encode()).hexdigest() for x in (out, text)))


def got(df):
    return sorted(map(str, (tuple(r) for r in fill_middle.digests(fill_middle.transform(df)).collect())))


def test_odd_rows(docs, rows):
    assert got(docs) == sorted(str(model(r[0], r[1])) for r in rows)


def test_sentinels_and_edges(spark):
    texts = ["<P", "<P>", "a<M>", "<<S>", "a < b > <", "<S >", " nbsp is no blank ", " \t lead", "trail \n", "\r\n", "x", "a\x00b \x1f c", "😀 é 漢字  ", "<P <S <M", "ends with <", "P>S>M>"]
    rows = [(100 * i + k, t) for i, t in enumerate(texts) for k in range(12)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(str(model(*r)) for r in rows)


def test_forms_have_their_shares(spark):
    found = {r.form: r["count"] for r in fill_middle.transform(spark.createDataFrame([(i, "a b c d") for i in range(4000)], "doc_id long, text string")).groupBy("form").count().collect()}
    assert abs(found["plain"] - 2000) < 150 and abs(found["spm"] - 1600) < 150 and abs(found["psm"] - 400) < 100


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_blocks_are_one_text(block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", "😀", " ", "\n", "  ", "<", "P", ">", "<P>", "word"]) for _ in range(rng.randrange(60)))
        units, whole = fill_middle.Units(text, block), UNIT.findall(text)
        assert (units.n, units.marked) == (len(whole), any(s in text for s in fill_middle.SENTINELS)), text
        ranks = list(range(units.n + 1))
        rng.shuffle(ranks)
        assert [units.end(r) for r in ranks] == [len("".join(whole[:r])) for r in ranks], text


def test_a_very_long_text(spark):
    text = "word \n" * 700_000 + "漢" * 300_000 + " " * 300_000
    rows = [(i, text) for i in range(3)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(str(model(*r)) for r in rows)


def test_nothing(empty):
    assert fill_middle.digests(fill_middle.transform(empty)).count() == 0
