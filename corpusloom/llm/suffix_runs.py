"""A run-length index of a text: its run-compressed Burrows-Wheeler transform with sampled run ends.

Segments stand behind one another, each ended by a separator that equals no other, so no match goes over a segment's end. The index keeps
the transform's runs (byte, first place, where the last-to-first mapping takes that place) and samples: at each run's
two ends the match length of the mapped suffix with its neighbour outside of the run; and, every ``STEP`` bytes of a segment, a suffix's place in
the order with its match lengths. The suffix array itself isn't kept.

Matching statistics are streamed backwards from the samples. Where the suffix at hand isn't at an end of its run, its neighbour in the order is
preceded by the same byte, so the suffixes one byte earlier are neighbours too and match one byte longer; at a run's end the
run's sample says how long they match. Repetitive text has few runs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Parts segments; no UTF-8 text has it.
SEPARATOR = 0xFF
#: Bytes that are streamed from one sample.
STEP = 256


class RunIndex(NamedTuple):
    """The runs in order, then the samples in order of their places in the text."""

    run_bytes: np.ndarray
    run_starts: np.ndarray
    run_targets: np.ndarray
    above: np.ndarray
    below: np.ndarray
    places: np.ndarray
    ranks: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray
    size: int

    def text(self, sample: int) -> bytes:
        """The bytes before a sample, up to the sample before it, read off the runs."""
        out, rank = [], int(self.ranks[sample])
        for _ in range(int(self.counts[sample])):
            run = int(np.searchsorted(self.run_starts, rank, side="right")) - 1
            out.append(int(self.run_bytes[run]))
            rank += int(self.run_targets[run] - self.run_starts[run])
        return bytes(out[::-1])

    def matching_statistics(self) -> np.ndarray:
        """For each place the longest match that starts there and anywhere else."""
        found = np.zeros(self.size, np.int64)
        found[self.places] = self.lengths.max(axis=1, initial=0)
        by_length = np.argsort(-self.counts, kind="stable")
        left = self.counts[by_length]
        place, rank = self.places[by_length], self.ranks[by_length]
        up, down = self.lengths[by_length].T.copy()
        last = np.append(self.run_starts[1:], self.size) - 1
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step))  # those with more than ``step`` bytes to go
            place, rank, up, down = place[:live] - 1, rank[:live], up[:live], down[:live]
            run = np.searchsorted(self.run_starts, rank, side="right") - 1
            up = np.where(rank > self.run_starts[run], up + 1, self.above[run])
            down = np.where(rank < last[run], down + 1, self.below[run])
            rank = rank + (self.run_targets[run] - self.run_starts[run])
            found[place] = np.maximum(up, down)
        return found


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each key's number among the distinct keys, the keys' order, and how many differ."""
    order = np.argsort(keys)
    ordered = keys[order]
    number = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    rank = np.empty(len(keys), np.uint32)
    rank[order] = number.astype(np.uint32)
    return rank, order, int(number[-1]) + 1


def _sorted_suffixes(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, and for each length tried the ranks of that many first bytes. ``ends`` are the separators' places."""
    size = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(size, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : size + i]
    which = np.searchsorted(ends, np.arange(size))
    room = ends[which] - np.arange(size)
    cut = room < 8  # what stands behind a separator doesn't count, the separator's number does
    key[cut] = key[cut] >> (56 - 8 * room[cut]).astype(np.uint64) << (56 - 8 * room[cut]).astype(np.uint64)
    rank, _, _ = _dense(key)
    rank, order, distinct = _dense(rank.astype(np.uint64) << np.uint64(32) | np.where(cut, which + 1, 0).astype(np.uint64))
    levels, h = [(8, rank)], 8
    while distinct < size:
        later = np.zeros_like(rank)
        later[:-h] = rank[h:]
        rank, order, distinct = _dense(rank.astype(np.uint64) << np.uint64(32) | later)
        h *= 2
        levels.append((h, rank))
    return order, levels


def _common(i: np.ndarray, j: np.ndarray, levels: list[tuple[int, np.ndarray]], text: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at ``i`` and ``j`` share."""
    size = len(text)
    i, j, shared = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for h, rank in reversed(levels):
        same = (i < size) & (j < size) & (rank[np.minimum(i, size - 1)] == rank[np.minimum(j, size - 1)])
        for x in (i, j, shared):
            x[same] += h
    going = np.ones(len(i), bool)
    for _ in range(8):  # fewer bytes than the least length of a rank; two separators never match
        a, b = text[np.minimum(i, size - 1)], text[np.minimum(j, size - 1)]
        going &= (i < size) & (j < size) & (a == b) & (a != SEPARATOR)
        for x in (i, j, shared):
            x[going] += 1
    return shared


def build(segments: list[bytes]) -> RunIndex:
    """The index of all segments together."""
    text = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in segments), np.uint8)
    size = len(text)
    ends = np.flatnonzero(text == SEPARATOR)
    suffixes, levels = _sorted_suffixes(text, ends)
    before = text[suffixes - 1]
    starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    lengths, run_bytes = np.diff(np.append(starts, size)), before[starts]
    by_byte = np.argsort(run_bytes, kind="stable")
    targets = np.empty(len(starts), np.int64)
    targets[by_byte] = np.cumsum(lengths[by_byte]) - lengths[by_byte]

    def with_neighbour(rank: np.ndarray, step: int) -> np.ndarray:
        other = rank + step
        there = (other >= 0) & (other < size)
        found = np.zeros(len(rank), np.int64)
        found[there] = _common(suffixes[rank[there]], suffixes[other[there]], levels, text)
        return found

    above, below = with_neighbour(targets, -1), with_neighbour(targets + lengths - 1, 1)
    #: from each segment's end, and from every ``STEP`` bytes before it, up to the next such place
    begins = np.concatenate(([0], ends[:-1] + 1))
    pieces = np.maximum(1, -(-(ends - begins) // STEP))
    of_piece = np.repeat(np.arange(len(ends)), pieces)
    nth = np.arange(len(of_piece)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    places = ends[of_piece] - nth * STEP
    counts = np.minimum(STEP, places - begins[of_piece])
    inverse = np.empty(size, np.int64)
    inverse[suffixes] = np.arange(size)
    ranks = inverse[places]
    return RunIndex(run_bytes, starts, targets, above, below, places, ranks, np.stack((with_neighbour(ranks, -1), with_neighbour(ranks, 1)), axis=1), counts, size)


def repeated_spans(segments: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each segment the maximal spans of bytes covered by strings of ``width`` bytes that start anywhere else as well."""
    if not segments:
        return []
    long = build(segments).matching_statistics() >= width
    found, start = [], 0
    for s in segments:
        own = np.flatnonzero(long[start : start + max(0, len(s) - width + 1)])
        start += len(s) + 1
        if len(own):
            cut = np.flatnonzero(np.diff(own) > width)
            begins, ends = own[np.concatenate(([0], cut + 1))], own[np.concatenate((cut, [len(own) - 1]))] + width
            found.append(list(zip(begins.tolist(), ends.tolist(), strict=True)))
        else:
            found.append([])
    return found
