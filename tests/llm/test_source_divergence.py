"""The audit of sources against whole counts in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import source_divergence as S

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(rows, least):
    """``rows`` are ``(text, lang, source)``."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((x or "" for x in r) for r in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(_LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = lambda c: [1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept]  # noqa: B023, E731
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            parts = {"pair": [(o, sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True))) for o in sources - {s}], "term": [(t, a - b) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1) if part == "pair" or i <= 50]
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r) for r in S.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("least", "chunk"), [(3, 1024), (3, 5), (1, 17), (10**6, 1024)])
def test_odd_rows(docs, rows, least, chunk):
    own = [(r[1], r[2], r[3]) for r in rows]
    assert audited(docs, least=least, chunk_terms=chunk) == model(own, least)


def test_languages_ties_and_nulls(spark):
    rng = random.Random(4)
    words = ["a", "b", "ab", "ä", "漢", "😀", "é", "zz", "q", "￿", "\U00010000", "ABC", "i̇", "W" * 3000]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "-", "1", "\x00"]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S", None, "é"])) for _ in range(400)]
    rows += [(None, "en", "quiet"), ("", "xx", "alone"), (None, None, None), ("one two", "yy", "a"), ("", "yy", "b")]
    assert audited(spark.createDataFrame(rows, "text string, lang string, source string")) == model(rows, 30)


def test_sums_are_handed_on_early(spark, docs):
    few = sorted(map(tuple, S.term_sums(docs, held_most=40).collect()))
    assert few == sorted(map(tuple, S.term_sums(docs).collect())) and len(few) > 200


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([[0, 10**14 + 7, 9 * 10**14 - 1]], np.int64)
    total = int(counts.sum())
    assert S.shares(counts, np.array([total]), 3).tolist() == [[1 + 10**9 * (int(c) + 5) // (total + 15) for c in counts[0]]]


def test_nothing(empty):
    assert audited(empty) == []
