"""Quality rules as a short-circuit cascade, all on the JVM and without a shuffle.

Each rule rejects a document by an expression over its words, lines, paragraphs or characters. On a sample of the documents each
rule's cost (the steps that it takes for a document: characters that a pattern reads, words that are looked at) and selectivity (share that it
rejects) are estimated in one aggregation, and the rules are put in descending order of
rejection per cost; then one projection applies them to every document, and a document's later rules are not worked
out once one has rejected it. The verdict is that of all rules together and so doesn't depend on the order.

Defined results: a null or empty text has no words, so the base rule rejects it; rows are judged each for itself, so
repeated rows, ties and null ids do no harm; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import SPACE_CLASS

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Base limits: fewest words; most repeated words in a hundred.
MIN_WORDS, MAX_REPEATED = 50, 50


# The commonest function words of four languages.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "le", "la", "les", "des", "et", "en", "un", "une", "que", "pour",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "ein", "nicht", "el", "los", "las", "de", "del", "y", "es", "por", "con", "no",
)


class Rule(NamedTuple):
    """``rejects`` and ``steps``, what it costs to work that out, are expressions over the columns of ``base``."""

    name: str
    rejects: Column
    steps: Column


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def repeated_words(words_: Column) -> Column:
    """How many words lie in three-word windows that the text has twice or more.

    Windows are known by a 64-bit hash. Only where their distinct hashes are fewer than the windows are they sorted, so
    that equal ones stand side by side; places that they cover are then added up in order.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return _let(F.sort_array(F.transform(same, lambda x: x["at"])), covered)

        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(paired, places))

    return _let(words_, lambda w: _let(windows(w), count))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    made = rows.select("doc_id", "text", words(F.col("text")).alias("words"), _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"))
    return made.select(
        "doc_id",
        text.alias("text"),
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def _share(count: Column, of: Column) -> Column:
    return count / F.greatest(of, F.lit(1))


def rules() -> list[Rule]:
    """The rules that follow the base rule, in no order of weight."""
    text, n, w = F.col("text"), F.col("n_words"), F.col("words")
    characters, count = F.length(text), F.lit(1)
    like = lambda pattern: F.size(F.filter(w, lambda x: x.rlike(pattern)))
    paragraphs = F.filter(F.split(text, "\n[\\x20\t]*\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    repeated = _let(paragraphs, lambda p: (F.size(p) - F.size(F.array_distinct(p)) > 2) & (_share(F.size(p) - F.size(F.array_distinct(p)), F.size(p)) > 0.3))
    plain = F.lower(F.array_join(w, " "))
    return [
        Rule("symbols", _share(F.col("n_symbols"), n) > 0.1, count),
        Rule("word_length", (_share(F.col("word_chars"), n) < 2) | (_share(F.col("word_chars"), n) > 20), count),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 2) & (_share(F.col("n_dup_lines"), F.col("n_lines")) > 0.3), count),
        Rule("duplicate_paragraphs", repeated, 2 * characters),
        Rule("shouting", _share(like("^[^a-z]*[A-Z]{2,}[^a-z]*$"), n) > 0.3, characters),
        Rule("exclamations", _share(characters - F.length(F.replace(text, F.lit("!"))), n) > 0.15, characters / 4),
        Rule("few_letters", _share(like(r"\p{L}"), n) < 0.7, characters / 2),
        Rule("ellipses", _share(F.regexp_count(text, F.lit(r"(?md)(?:\.\.\.|…)[ \t]*$")), F.col("n_lines")) > 0.3, characters),
        Rule("bullets", _share(F.regexp_count(text, F.lit(r"(?md)^[ \t]*[-*•]")), F.col("n_lines")) > 0.9, characters / 2),
        Rule("few_kinds", _share(F.size(F.array_distinct(w)), n) < 0.05, 4 * n),
        Rule("no_function_words", (n >= 100) & ~F.rlike(plain, F.lit(rf"(?:^| )(?:{'|'.join(FUNCTION_WORDS)})(?: |$)")), characters / 8),
        Rule("endless_word", F.exists(w, lambda x: F.length(x) > 1000), n),
    ]


class Measured(NamedTuple):
    rule: Rule
    cost: float
    rejected: float


def measure(docs: DataFrame, table: list[Rule], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Measured]:
    """The rules by descending rejection per cost, as a sample of the documents shows it."""
    total = docs.select(F.lit(1)).count()
    sampled = docs.sample(min(1.0, sample_rows / total), seed=7) if total > sample_rows else docs
    seen = base(sampled, id_col, text_col).agg(F.count("*").alias("n"), *[F.avg(r.steps).alias(f"cost_{i}") for i, r in enumerate(table)], *[F.count_if(r.rejects).alias(f"hits_{i}") for i, r in enumerate(table)]).first()
    found = [Measured(r, max(1.0, seen[f"cost_{i}"] or 0), seen[f"hits_{i}"] / max(1, seen.n)) for i, r in enumerate(table)]
    return sorted(found, key=lambda m: (-m.rejected / m.cost, m.cost, m.rule.name))


def cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``."""
    rows = base(docs, id_col, text_col)
    table = rules() if table is None else table
    ordered = [m.rule for m in measure(docs, table, sample_rows, id_col, text_col)]
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    verdict = F.when(base_failed, F.lit(False))
    for rule in ordered:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"))
