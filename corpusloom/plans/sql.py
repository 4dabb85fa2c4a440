"""The row-wise functions for SQL: ``register(spark)``, then ``SELECT count_tokens(text) ...`` or ``LATERAL split_chunks(text, 200)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom.functions.text import CHARS_PER_TOKEN
from corpusloom.operators.splitting import chunks_of, default_tokens

#: Name, parameters, type and body of each.
FUNCTIONS = (
    ("count_tokens", "t STRING", "BIGINT", f"greatest(1, CAST(floor(length(t) / {CHARS_PER_TOKEN}) AS BIGINT))"),
    ("compress_text", "t STRING", "STRING", r"regexp_replace(regexp_replace(t, '\n{2,}', '\n\n'), r'(?md)(?<![ \t])[ \t]++$', '')"),
    ("strip_text", "t STRING", "STRING", r"regexp_replace(t, r'(?U)\A\s++|(?<!\s)\s++\z', '')"),
    ("path_name", "p STRING", "STRING", "substring_index(p, '/', -1)"),
    ("path_suffix", "p STRING", "STRING", r"regexp_extract(substring_index(p, '/', -1), r'^.+?(\.[^.]+)$', 1)"),
    ("content_hash", "t STRING", "STRING", "sha2(t, 256)"),
)


@udtf(returnType="chunk_no int, chunk string", useArrow=True)
class SplitChunks:
    """A text's chunks of at most so many default tokens."""

    def eval(self, text: str, max_tokens: int) -> Iterator[tuple[int, str]]:
        if text:
            yield from enumerate(chunks_of(text, max_tokens, default_tokens()))


def register(spark: SparkSession) -> None:
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("split_chunks", SplitChunks)
