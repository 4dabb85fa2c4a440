"""Registered queries put whole texts through their operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import queries as Q


def test_shebang_reads_the_whole_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.length("text").alias("n"))
    made = Q._corpus(spark, data, Q.SHEBANG).select("doc_id", F.length("content").alias("m"))
    assert docs.join(made, "doc_id").where("m <= n").count() == 0
