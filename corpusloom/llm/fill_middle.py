"""Fill-in-the-middle: texts cut at unit boundaries into prefix, middle and suffix, and put together in another order.

A unit is a word with the white space before it, or the white space at a text's end. Units are not split off one by one.
An Aho-Corasick automaton finds the events of a text: its ASCII white space, the only characters at which the class of
characters changes, and the sentinels. Between two events that aren't neighbours lies one word, so the gaps of the events give the
count of units by arithmetic, and the place of the unit of a rank is that of an event. A text is scanned in blocks of which only the number
of units before is kept; the block that holds a rank is scanned once more, so memory doesn't grow with a text's length.

Only the scan runs in Python, which returns four numbers a text; hashes, cuts, outputs and restored texts are columns.

Defined results: a null or empty text has no units and is left plain; a null id is hashed as an empty one; a text that holds a sentinel is left
plain, so that an output can be taken apart; rows are cut each for itself, so repeated rows and ties do no harm; an empty table gives an
empty table; all other columns are left out, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import texts

# White space, and what marks prefix, suffix and middle.
WHITE, SENTINELS = "\t\n\x0b\x0c\r ", ("<P>", "<S>", "<M>")
#: Percent of the texts that are left plain; percent of the others that begin with the suffix; seed of the hashes.
PLAIN, SUFFIX_FIRST, SEED = 50, 80, 42
#: Characters that are scanned at once.
BLOCK = 1 << 16
_EVENT = np.dtype([("at", np.int64), ("sentinel", np.int8)])
_CUT = pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("prefix", pa.int64()), ("middle", pa.int64())])


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for character in WHITE:
        found.add_word(character, 0)
    for sentinel in SENTINELS:
        found.add_word(sentinel, 1)
    found.make_automaton()
    return found


class Units:
    """The units of a text: how many, whether a sentinel stands in it, and where the unit of a rank ends."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block, self.marked = text, block, False
        #: of each block: units that end before it, and the last white character before it
        self.before, self.white, self._last = [], [], (-1, None)
        ended, white = 0, -1
        for i in range(0, len(text), block):
            self.before.append(ended)
            self.white.append(white)
            places, marked = self._events(i)
            self.marked |= marked
            ends = places[np.diff(places, prepend=white) > 1]
            self._last = (len(self.before) - 1, ends)
            ended += len(ends)
            white = int(places[-1]) if len(places) else white
        #: what is left behind the last of these ends is a word or white space, one unit either way
        self.n = ended + (len(text) > 0)

    def _events(self, begin: int) -> tuple[np.ndarray, bool]:
        """White characters of a block, and whether a sentinel ends in it."""
        lead = max(0, begin - max(map(len, SENTINELS)) + 1)
        found = np.fromiter(_automaton().iter(self.text[lead : begin + self.block]), _EVENT)
        places = found["at"][found["sentinel"] == 0] + lead
        return places[places >= begin], bool((found["sentinel"] == 1).any())

    def end(self, rank: int) -> int:
        """Characters up to the end of the unit of a rank, from 1; 0 for rank 0."""
        if rank <= 0 or rank >= self.n:
            return len(self.text) if rank > 0 else 0
        k = bisect_left(self.before, rank) - 1
        if self._last[0] != k:
            places, _ = self._events(k * self.block)
            self._last = (k, places[np.diff(places, prepend=self.white[k]) > 1])
        return int(self._last[1][rank - self.before[k] - 1])


def _cut(text: str, one: int, two: int) -> dict:
    units = Units(text)
    first, second = sorted((one % (units.n + 1), two % (units.n + 1)))
    prefix = units.end(first)
    return {"n": units.n, "marked": units.marked, "prefix": prefix, "middle": units.end(second) - prefix}


def cuts(text: Column, one: Column, two: Column) -> Column:
    """Units, whether a sentinel is there, characters of the prefix and of the middle, from two numbers that choose the ranks. One text at a time is a Python object."""

    @F.arrow_udf("struct<n:bigint,marked:boolean,prefix:bigint,middle:bigint>")
    def run(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array([_cut(t.as_py(), a, b) for t, a, b in zip(text, one.to_pylist(), two.to_pylist(), strict=True)], _CUT)

    return run(text, one, two)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``(doc_id, text, n, form, prefix_chars, middle_chars, output)`` of every row; form is plain, psm or spm."""
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("mark", mark)
    h = [F.conv(F.substring("mark", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = rows.withColumn("cut", cuts(F.col("text"), h[0], h[1]))
    form = F.when((F.col("text") == "") | F.col("cut.marked") | (h[2] % 100 >= plain), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.prefix").cast("int").alias("p"), F.col("cut.middle").cast("int").alias("m"))
    text, p, m = F.col("text"), F.col("p"), F.col("m")
    part = {"<P>": F.substring(text, F.lit(1), p), "<M>": F.substring(text, p + 1, m), "<S>": F.substring(text, p + m + 1, F.length(text))}
    put = lambda *order: F.concat(*[x for s in order for x in (F.lit(s), part[s])])
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", put("<P>", "<S>", "<M>")).otherwise(put("<S>", "<P>", "<M>"))
    cut = lambda x: F.when(F.col("form") != "plain", x.cast("long"))
    return rows.select("doc_id", "text", "n", "form", cut(p).alias("prefix_chars"), cut(m).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def digests(rows: DataFrame) -> DataFrame:
    """What ``transform`` gives, with checksums in place of texts; the restored text is rebuilt from the output."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
