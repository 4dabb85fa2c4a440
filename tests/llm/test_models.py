"""Plain models of single steps: the statistics of a text, and balls of half the radius."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import quality_qda, simhash_ball


def plain_statistics(text):
    """Byte by byte, as the docstring of the features says."""
    raw = (text or "").encode()
    space = set(b" \t\n\v\f\r")
    words, word, lines, line = [], b"", [], b""
    for c in [*raw, 0x20]:
        if c in space:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([c])
    for c in [*raw, 0x0A]:
        if c == 0x0A:
            if any(x not in space for x in line):
                lines.append(line)
            line = b""
        else:
            line += bytes([c])
    n, w, s = len(raw), len(words), len(lines)
    upper, lower, digit = (sum(a <= c <= b for c in raw) for a, b in ((65, 90), (97, 122), (48, 57)))
    blank, symbol, high = sum(c in space for c in raw), sum(c in b"#*$%&|<>" for c in raw), sum(c >= 128 for c in raw)
    punctuation = n - upper - lower - digit - blank - symbol - high
    ratios = [
        w + 1, (upper + 0.5) / (upper + lower + 10), (symbol + 0.5) / (w + 10), (sum(c == 33 for c in raw) + 0.5) / (w + 10), (punctuation + 0.5) / (w + 10), (digit + 0.5) / (n + 50), (n - blank + 5) / (w + 1),
        (high + 1) / (n + 50), (len(set(words)) + 1) / (w + 1), (s - len(set(lines)) + 0.2) / (s + 1), (n + 20) / (s + 1), max([0, *map(len, words)]) + 5,
    ]
    return [math.log(x) for x in ratios]


@settings(max_examples=300, deadline=None)
@given(st.none() | st.text(st.sampled_from("aB é9!#*.\n\t\v漢 "), max_size=80))
def test_statistics(text):
    assert quality_qda.statistics(text) == pytest.approx(plain_statistics(text))


def ball(fp, radius):
    return {fp ^ sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)}


def keys(fp):
    """What the operator emits for a fingerprint: for each hidden block the visible bits and their single flips."""
    out = set()
    for number, (low, high) in enumerate(simhash_ball.BLOCKS):
        shown = ((1 << 64) - 1) & ~(((1 << high) - 1) & ~((1 << low) - 1))
        out |= {(number, (fp & shown) ^ flip) for flip in (0, *(1 << b for b in range(64) if shown >> b & 1))}
    return out


@pytest.mark.parametrize("distance", range(7))
def test_blocks_and_balls_meet_where_plain_balls_do(distance):
    rng = random.Random(distance)
    for _ in range(15):
        u = rng.getrandbits(64)
        v = u ^ sum(1 << b for b in rng.sample(range(64), distance))
        plain = bool(ball(u, 2) & ball(v, 1))  # half the radius of three, up on one side and down on the other
        assert plain == (distance <= 3)
        assert bool(keys(u) & keys(v)) >= plain  # none is missed; what else meets is verified by distance
    assert len(keys(u)) == 131


def test_variants_are_these_keys(spark):
    fps = [0, 1, -1, 123456789, -(1 << 63)]
    got = {}
    for r in simhash_ball.variants(spark.createDataFrame([(x,) for x in fps], "fp long")).collect():
        got.setdefault(r.fp, set()).add(r.variant)
    assert all(120 < len(v) <= 131 for v in got.values())
    met = {(a, b) for a in fps for b in fps if got[a] & got[b]}
    assert {(a, b) for a in fps for b in fps if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3} <= met
