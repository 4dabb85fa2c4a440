"""Native scans and cascades against plain Python."""

from __future__ import annotations

import re
from collections import Counter

from corpusloom.llm import license_scan, quality_cascade
from corpusloom.llm.license_rules import Rule, rules

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def detected(norm, table):
    found = []
    for rule in table:
        if f" {rule.keyword}" in f" {norm}":
            found += [(m.start(), -m.end(), rule.priority, rule.label, rule.confidence) for m in re.finditer(f"(?<![^ ])(?:{rule.pattern})(?![^ ])", norm)]
    kept = []
    for x in sorted(found):
        if not kept or x[0] >= -kept[-1][1]:
            kept.append(x)
        elif -x[1] > -kept[-1][1] and x[2] < kept[-1][2]:
            kept[-1] = x
    return kept


def test_licenses(docs, rows):
    table = rules()
    want = []
    for doc_id, text, *_ in rows:
        words = words_of(text)
        places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(x[3] for x in detected(" ".join(words), table))})
        want.append((str(doc_id), len(words), len(places), str(min((i for i, _ in places), default=None)), str(max((i for i, _ in places), default=None)), ",".join(base), ",".join(labels)))
    found = license_scan.scan(docs).collect()
    got = [(str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels) for r in found]
    assert sorted(got) == sorted(want)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in found)
    assert {"mit", "apache-2", "gpl-3", "cc-by-nc", "gpl", "bsd-3-clause", "mpl-2"} <= {x for r in got for x in r[6].split(",")}


def test_rules():
    table = rules()
    assert len(table) > 300 and len({r.pattern for r in table}) > 300
    assert table == sorted(table) and all(0 < r.confidence <= 1 for r in table)


def test_overlaps(spark):
    table = [Rule(5, "short", "a", "a b", 0.5), Rule(9, "long", "a", "a b c", 0.5), Rule(1, "tail", "c", "c d e", 0.5), Rule(2, "same", "a", "a b c", 0.5), Rule(3, "never", "z", "q", 0.5)]
    for text in ("a b c d e", "a b c", "x a b c d", "a b a b c c d e a b", "q"):
        got = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), table=table).first()
        assert [tuple(s) for s in got.spans] == detected(text, table), text


def test_licenses_of_nothing(empty):
    assert license_scan.scan(empty).count() == 0


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_cascade(docs, rows):
    found = quality_cascade.cascade(docs).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    want = []
    for doc_id, text, *_ in rows:
        b = base_of(text)
        want.append((str(doc_id), *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(want)
    assert not any(r.kept and r.base_failed for r in found)
    by_text = {r.doc_id: r.kept for r in found}
    noisy = [r[0] for r in rows if r[1] and (r[1].count("!!") > 20 or r[1].count("***") > 20)]
    assert noisy and not any(by_text[i] for i in noisy) and sum(by_text.values()) > 20


def test_order_changes_no_verdict(docs):
    table = quality_cascade.rules()
    once = sorted(map(str, quality_cascade.cascade(docs, table=table).collect()))
    assert sorted(map(str, quality_cascade.cascade(docs, table=table[::-1], sample_rows=5).collect())) == once
    measured = quality_cascade.measure(docs, table)
    rates = [m.rejected / m.cost for m in measured]
    assert rates == sorted(rates, reverse=True) and len(measured) == len(table)


def test_cascade_of_nothing(empty):
    assert quality_cascade.cascade(empty).count() == 0
