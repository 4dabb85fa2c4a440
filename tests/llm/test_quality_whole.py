"""The registered quality query against the textbook's formulas over whole tables."""

from __future__ import annotations

import zlib

import numpy as np

from corpusloom.llm import quality_qda as Q
from corpusloom.llm.queries import op5_quality_qda


def test_scores_of_the_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    x = {r.doc_id: np.array(Q.statistics(r.text)) for r in docs}
    train = {c: np.array([x[i] for i, label in labels if label == c and i in x and not held(i)]) for c in (0, 1)}
    n = {c: len(v) for c, v in train.items()}
    own = {c: np.cov(v.T, bias=True) for c, v in train.items()}
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    sphere = np.eye(len(pooled)) * max(np.trace(pooled) / len(pooled), 1e-3)
    mixed = {c: (1 - Q.TO_POOLED - Q.TO_SPHERE) * own[c] + Q.TO_POOLED * pooled + Q.TO_SPHERE * sphere for c in (0, 1)}

    def density(c, v):
        apart = v - train[c].mean(axis=0)
        return np.log(n[c] / (n[0] + n[1])) - 0.5 * (apart @ np.linalg.solve(mixed[c], apart) + np.linalg.slogdet(mixed[c])[1])

    found = op5_quality_qda(spark, data).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in docs)
    for r in found:
        want = 1 / (1 + np.exp(-np.clip(density(1, x[r.doc_id]) - density(0, x[r.doc_id]), -700, 700)))
        assert abs(r.score - want) < 1e-6 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7)
