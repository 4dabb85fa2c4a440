"""Quality scores of documents by a regularised quadratic discriminant.

Each document gives a short vector of transformed statistics of its text (logs of smoothed ratios: capitals, symbols,
punctuation, word lengths, repetition and so on). Labelled documents give, for each class, a mean and a covariance,
shrunk towards the covariance of all classes and a sphere. A document's score is the logistic of the difference of the two
classes' Gaussian log-densities, each by a Mahalanobis distance solved through the class's Cholesky factor, which is
made once and shipped with the scoring function.

The training moments are sums over all labelled rows, added up by Spark; only these sums (two classes times
``p * (p + 3) / 2 + 1`` numbers) reach the driver. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null or empty text has the statistics of an empty text and gets a score; rows with a null label or
a null doc_id train nothing; a doc_id with several labels trains once for each; repeated documents train and score each
for itself; where a class has no training row the score is the share of label 1 (0.5 with no labels at all); an empty
table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import stored

#: Shares of the pooled covariance and of the sphere in each class's covariance.
TO_POOLED, TO_SPHERE = 0.3, 0.02
#: Score from which a document is kept.
KEEP_AT = 0.7

_CLASSES = 7
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _PUNCT, _HIGH = range(_CLASSES)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _PUNCT, np.uint8)
    kind[0x80:] = _HIGH
    kind[ord("A") : ord("Z") + 1] = _UPPER
    kind[ord("a") : ord("z") + 1] = _LOWER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[[0x20, *range(9, 14)]] = _SPACE
    kind[list(b"#*$%&|<>")] = _SYMBOL
    return kind


_KIND = _byte_classes()
FEATURES = ("words", "capitals", "symbols", "exclaimed", "punctuation", "digits", "word_length", "high_bytes", "distinct_words", "repeated_lines", "line_length", "longest_word")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=_CLASSES)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w, s = len(raw), len(words), len(lines)
    letters = int(kinds[_UPPER] + kinds[_LOWER])
    log = np.log
    return [
        float(log(w + 1)),
        float(log((kinds[_UPPER] + 0.5) / (letters + 10))),
        float(log((kinds[_SYMBOL] + 0.5) / (w + 10))),
        float(log((raw.count(b"!") + 0.5) / (w + 10))),
        float(log((kinds[_PUNCT] + 0.5) / (w + 10))),
        float(log((kinds[_DIGIT] + 0.5) / (n + 50))),
        float(log((n - kinds[_SPACE] + 5) / (w + 1))),
        float(log((kinds[_HIGH] + 1) / (n + 50))),
        float(log((len(set(words)) + 1) / (w + 1))),
        float(log((s - len(set(lines)) + 0.2) / (s + 1))),
        float(log((n + 20) / (s + 1))),
        float(log(max(map(len, words), default=0) + 5)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, x array<double>)``; row is ``row_col``, or the row's place in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "row", "x"])

    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), row.alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, x array<double>")


@dataclass(frozen=True)
class Model:
    """For each class the mean, the inverse of the Cholesky factor and the constant of its log-density; or a constant score."""

    means: np.ndarray | None
    whiteners: np.ndarray | None
    constants: np.ndarray | None
    constant_score: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant_score is not None:
            return np.full(len(x), self.constant_score)
        density = [c - 0.5 * np.square((x - m) @ w.T).sum(axis=1) for m, w, c in zip(self.means, self.whiteners, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each label of ``(label, x)``: rows, sums and sums of products. Added up by Spark."""
    p = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for c in np.unique(label).tolist():
                own = x[label == c]
                sums[c] = sums.get(c, 0) + np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        for c, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v, pa.float64())], ["label", "k", "v"])

    found: dict[int, np.ndarray] = {}
    summed = labelled.select(F.col("label").cast("int"), "x").mapInArrow(run, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))
    for r in summed.collect():  # 2 x (1 + p + p * p) numbers
        found.setdefault(r.label, np.zeros(1 + p + p * p))[r.k] = r.v
    return {c: (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for c, v in found.items()}


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Model:
    total = sum(n for n, _, _ in sums.values())
    if {0, 1} - set(sums):
        return Model(None, None, None, sums[1][0] / total if 1 in sums else 0.0 if 0 in sums else 0.5)
    n = np.array([sums[c][0] for c in (0, 1)])
    means = np.array([sums[c][1] / sums[c][0] for c in (0, 1)])
    own = [sums[c][2] / sums[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / total
    p = len(FEATURES)
    sphere = np.eye(p) * max(np.trace(pooled) / p, 1e-3)
    whiteners, constants = [], []
    for c in (0, 1):
        covariance = (1 - to_pooled - to_sphere) * own[c] + to_pooled * pooled + to_sphere * sphere
        factor = np.linalg.cholesky(covariance)
        whiteners.append(np.linalg.inv(factor))
        constants.append(np.log(n[c] / total) - np.log(np.diag(factor)).sum())
    return Model(means, np.array(whiteners), np.array(constants))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, row, score)`` of what ``features`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x), pa.float64())], ["doc_id", "row", "score"])

    return rows.mapInArrow(run, "doc_id long, row long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels train nothing; a null doc_id isn't one of them, having no labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _known(labels: DataFrame, label_col: str) -> DataFrame:
    """``(doc_id, label)`` of what trains."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, score)`` of every row of ``docs``; the model learns from ``labels`` outside the held-out rows."""
    rows = stored(features(docs, id_col, text_col, row_col), "statistics")
    return score(rows, fit(moments(rows.join(_known(labels, label_col), "doc_id").select("label", "x"))))


def text_score(text: Column, model: Model) -> Column:
    """The score of a text, as a column beside it."""

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in text]).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    return run(text)


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``keep_at`` or more. Texts are read twice and moved never: once for the moments, once for the scores."""
    learnt = features(docs, id_col, text_col).join(_known(labels, label_col), "doc_id").select("label", "x")
    return docs.where(text_score(F.col(f"`{text_col}`").cast("string"), fit(moments(learnt))) >= keep_at)
