"""A run-length index over a bounded text, and matching statistics streamed from it."""

from __future__ import annotations

import numpy as np

#: Characters that one sort key holds, nine bits each; doubled until ``DEPTH`` is reached.
_FIRST = 7
#: Depth to which suffixes are ordered: above the longest segment that is indexed.
DEPTH = 896


def suffix_ranks(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """Suffix array of ``text`` (numbers below 512), by prefix doubling, for each doubling (length,
    rank of every position by that many characters), and characters before the next 0.

    A 0 ends its segment: comparisons stop there, and suffixes equal up to it are ordered by place.
    With segments shorter than ``DEPTH`` that is a total order, in which two suffixes preceded by
    one character keep their order when it is put before them.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    left = np.diff(np.concatenate(([-1], zeros, [n])))
    left = np.repeat(np.cumsum(left) - 1, left)[:n] - np.arange(n)
    padded = np.concatenate((text.astype(np.int64), np.zeros(_FIRST, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(_FIRST):
        key = (key << 9) | np.where(left >= j, padded[j: j + n], 0)
    levels, length = [], _FIRST
    while True:
        order = np.argsort(key)
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append((length, rank))
        if length >= DEPTH:
            return np.sort(rank * n + np.arange(n)) % n, levels, left
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - length, 0)] = rank[length:]
        key = rank * (n + 1) + np.where(left >= length, ahead, 0)
        length *= 2


def _common(
    text: np.ndarray, levels: list[tuple[int, np.ndarray]], left: np.ndarray, a: np.ndarray, b: np.ndarray
) -> np.ndarray:
    """Length of the common prefix, within a segment, of the suffixes at ``a`` and ``b``."""
    n, most, a, b = len(text), left[a], a.copy(), b.copy()
    out = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        step = same * length
        a, b, out = a + step, b + step, out + step
    for _ in range(_FIRST):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = text[a[inside]] == text[b[inside]]
        a, b, out = a + same, b + same, out + same
    return np.minimum(out, most)


class RunLengthIndex:
    """The Burrows-Wheeler transform of a text as runs, with suffix positions kept at run ends.

    For the position of a run's first (last) row the match with the row before (after) it is
    computed; inside a run that match is the one of the position before, less one character. So the
    matching statistics of all positions follow, in text order, from two numbers a run. Positions in
    ``starts`` are sampled as well, as a chain must not leave its segment.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray) -> None:
        order, levels, left = suffix_ranks(text)
        before = np.where(order > 0, text[order - 1], 511)
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads = np.concatenate(([0], change))
        self.symbols = before[self.heads]
        tails = np.concatenate((change - 1, [len(order) - 1]))
        self.size = len(text)
        begin = np.flatnonzero(np.isin(order, starts) | (order == 0))
        self.up = self._sampled(text, levels, left, order, np.union1d(self.heads, begin), -1)
        self.down = self._sampled(text, levels, left, order, np.union1d(tails, begin), 1)

    @staticmethod
    def _sampled(text, levels, left, order, rows, step) -> tuple[np.ndarray, np.ndarray]:
        """Positions at the sampled rows, in text order, with the match to the neighbouring row."""
        there = (rows + step >= 0) & (rows + step < len(order))
        at, other = order[rows], order[np.clip(rows + step, 0, len(order) - 1)]
        match = np.where(there, _common(text, levels, left, at, other), 0)
        by = np.argsort(at)
        return at[by], match[by]

    def matching_statistics(self) -> np.ndarray:
        """For every position the length of its longest match, within a segment, with any other
        position."""
        positions = np.arange(self.size)
        best = np.zeros(self.size, np.int64)
        for at, match in (self.up, self.down):
            last = np.searchsorted(at, positions, side="right") - 1
            best = np.maximum(best, match[last] - (positions - at[last]))
        return best


def repeated_windows(segments: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each byte segment, which of its windows of ``width`` occur a second time among all
    positions of all segments. Segments hold at most ``DEPTH`` bytes less a few."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    text = np.zeros(int(ends[-1]), np.int64)  # 0 stands between segments
    for start, segment in zip(starts.tolist(), segments, strict=True):
        text[start: start + len(segment)] = segment.astype(np.int64) + 1
    match = RunLengthIndex(text, starts).matching_statistics()
    # a match is cut where the segment ends
    return [match[a: a + n - width + 1] >= width for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
