"""Where queries and their SQL are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The path of a document, in both engines' SQL.
PATH = "concat(source, '/doc_', doc_id, '.', lang)"


def query_of(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, content: str = "text") -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "source", "lang", F.expr(PATH).alias("path"), F.expr(content).alias("content"))


def fold(group: str, order: str, table: str, tokens: str, limit: int) -> str:
    """Next-fit as a recursion over the rows of each group."""
    return f"""WITH RECURSIVE n AS (SELECT {group} AS g, {order}, CAST({tokens} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {table}),
 f AS (SELECT g, {order}, tokens, rn, tokens AS held, CAST(1 AS BIGINT) AS part FROM n WHERE rn = 1 UNION ALL
 SELECT n.g, {', '.join('n.' + x.strip() for x in order.split(','))}, n.tokens, n.rn, CASE WHEN f.held + n.tokens > {limit} THEN n.tokens ELSE f.held + n.tokens END, CASE WHEN f.held + n.tokens > {limit} THEN f.part + 1 ELSE f.part END FROM f JOIN n ON n.g = f.g AND n.rn = f.rn + 1)"""
