"""Row-wise text functions as columns: tokens, compression, line numbers, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
TRUNCATED = "# ... truncated ..."


def count_tokens(text: Column, chars_per_token: int | None = None) -> Column:
    """Code points over ``chars_per_token``, rounded down, one at least."""
    per = chars_per_token if chars_per_token and chars_per_token > 0 else CHARS_PER_TOKEN
    return F.greatest(F.lit(1), F.floor(F.length(text) / per)).cast("bigint")


def compress(text: Column) -> Column:
    """Runs of newlines become two at most, then blanks and tabs at the ends of lines go."""
    return F.regexp_replace(F.regexp_replace(text, "\n{2,}", "\n\n"), r"(?md)(?<![ \t])[ \t]++$", "")


def savings(before: Column, after: Column, chars_per_token: int | None = None) -> tuple[Column, Column, Column]:
    """Tokens before, tokens after, and the saving in percent."""
    a, b = count_tokens(before, chars_per_token), count_tokens(after, chars_per_token)
    return a, b, (1 - b / a) * 100


def line_numbers(text: Column) -> Column:
    """Each line behind its number; numbers are as wide as the largest, five at least. An empty text stays."""
    lines = F.split(text, "\n")

    def numbered(of: Column) -> Column:
        width = F.greatest(F.lit(5), F.length(F.size(of).cast("string")))
        return F.array_join(F.transform(of, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit("| "), x)), "\n")

    return F.when(text == "", text).otherwise(F.element_at(F.transform(F.array(lines), numbered), 1))


def strip(text: Column) -> Column:
    """Without white space of any script at either end. A run within the text is passed once, not from each of its places."""
    return F.regexp_replace(text, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def decoded(content: Column) -> Column:
    """Bytes as text with plain newlines; null where they are no UTF-8 or hold a NUL."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(F.instr(text, "\0") == 0, universal_newlines(text))


def single(text: Column, max_tokens: int, chars_per_token: int | None = None) -> Column:
    """The whole text trimmed, or its first characters and a mark where it is over the limit."""
    if max_tokens == -1:
        return strip(text)
    per = chars_per_token if chars_per_token and chars_per_token > 0 else CHARS_PER_TOKEN
    within = count_tokens(text, per) <= max_tokens
    return F.when(within, strip(text)).otherwise(F.concat(F.substring(text, 1, max_tokens * per), F.lit(f"\n\n{TRUNCATED}")))


def percent(tokens: Column, limit: Column) -> Column:
    """A share in percent with one decimal; ``<0.1%`` where it would round to nothing, ``0.0%`` without a limit."""
    share = tokens / limit * 100
    return F.when(limit <= 0, "0.0%").when(share < 0.05, "<0.1%").otherwise(F.concat(F.replace(F.format_number(share, 1), F.lit(","), F.lit("")), F.lit("%")))
