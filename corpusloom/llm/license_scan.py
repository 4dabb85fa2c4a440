"""Licence scans: ordered signature rules behind a keyword prefilter, overlaps resolved by containment and priority.

All on the JVM, one projection over the documents, no shuffle. A text becomes its words in lower case, joined by single
blanks. A rule is tried only where a word of the text, or several, begin with its keyword and where the one pattern of all rules of that keyword hits; most texts are done there.
Each rule that is tried gives the character spans of its matches. Spans are sorted by start, longest first: a
span inside an earlier one is suppressed, of equal spans the rule of the smaller priority stays, and where two
spans overlap in part the smaller priority stays, or else the earlier.

Defined results: a null or empty text has no words and no labels; rows are scanned each for itself, so repeated rows,
ties and null ids do no harm; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import json
import string
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.license_rules import Rule, rules
from corpusloom.llm.shared import texts

#: Phrases that always give their label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_SPAN = "struct<start:int,back:int,priority:int,label:string,confidence:double>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(text: Column) -> Column:
    """Words of digits, letters of A to Z in lower case and anything beyond ASCII as it is, joined by single blanks."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _whole(pattern: str) -> str:
    """A pattern for whole words."""
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def _literal(groups: list[list[Rule]]) -> Column:
    """Groups of rules as one literal: thousands of expressions would take the planner longer than the scan takes."""
    rows = [[{"priority": r.priority, "label": r.label, "pattern": _whole(r.pattern), "confidence": r.confidence} for r in own] for own in groups]
    return F.from_json(F.lit(json.dumps(rows)), "array<array<struct<priority:int,label:string,pattern:string,confidence:double>>>")


def _spans(norm: Column, rule: Column) -> Column:
    """Spans of one rule's matches: what the matches part has known lengths."""

    def placed(found: Column) -> Column:
        step = F.zip_with(F.split(norm, rule["pattern"]), found, lambda before, match: F.struct(F.length(before).alias("gap"), F.length(match).alias("span")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def add(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            end = begin + x["span"]
            span = F.struct(begin.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence")).cast(_SPAN)
            return F.struct(F.coalesce(end, state["at"]).alias("at"), F.when(x["span"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"))

        return F.aggregate(step, start, add, lambda s: s["out"])

    return F.when(F.rlike(norm, rule["pattern"]), _let(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _resolved(spans: Column) -> Column:
    """What stays of sorted spans."""
    none = F.array().cast(f"array<{_SPAN}>")

    def add(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        free = last.isNull() | (x["start"] >= -last["back"])
        inside = -x["back"] <= -last["back"]
        wins = ~inside & (x["priority"] < last["priority"])
        return F.when(free, F.concat(kept, F.array(x))).when(wins, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)

    return F.aggregate(F.sort_array(spans), none, add)


def detections(norm: Column, table: list[Rule] | None = None) -> Column:
    """The resolved spans in a normalized text of all rules of which a word of the text begins with the keyword."""
    by_keyword: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules() if table is None else table:
        by_keyword[rule.keyword].append(rule)
    groups = sorted(by_keyword.items())
    families = _literal([own for _, own in groups])
    padded = F.concat(F.lit(" "), norm)

    def of_text(whole: Column) -> Column:
        # a group's one pattern is a literal, compiled once for all rows; rules are tried one by one only where it hits
        opened = [F.when(F.contains(whole, F.lit(f" {k}")) & F.rlike(whole, F.lit(_whole("|".join(f"(?:{r.pattern})" for r in own)))), F.lit(i)) for i, (k, own) in enumerate(groups)]
        near = F.array_compact(F.array(*opened))
        return F.flatten(F.transform(F.flatten(F.transform(near, lambda i: F.get(families, i))), lambda r: _spans(norm, r)))

    return _resolved(_let(padded, of_text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, n_words, spans, n_base, first_word, last_word, base_labels, labels, score)``.

    ``spans`` are character spans in the normalized text, ``back`` being the end with a minus.
    """
    rows = texts(docs, id_col, text_col).select("doc_id", normalized(F.col("text")).alias("norm"))
    norm, padded = F.col("norm"), F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    n_words = F.when(norm == "", 0).otherwise(_blanks(norm) + 1)
    places, firsts, lasts, own = [], [], [], []
    for phrase, label in BASE.items():
        has = F.contains(padded, F.lit(f" {phrase} "))
        places.append(F.when(has, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(has, _blanks(F.left(padded, F.locate(f" {phrase} ", padded))) - 1))
        lasts.append(F.when(has, n_words - len(phrase.split()) - _blanks(F.substring_index(padded, f" {phrase} ", -1))))
        own.append(F.when(has, F.lit(label)))
    base = rows.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        detections(norm, table).alias("spans"),
        sum(places[1:], places[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*own))).alias("base"),
    )
    labels = F.array_sort(F.array_union("base", F.transform("spans", lambda x: x["label"])))
    surest = F.coalesce(F.array_max(F.transform("spans", lambda x: x["confidence"])), F.lit(0.0))
    return base.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.greatest(surest, F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"), "spans")
