"""Periodic runs of words: stretches that repeat with some period and cannot be extended.

Two places of a text whose words agree for ``depth`` words, but neither before nor after, are a maximal
pair. If their distance is at most ``depth``, the stretch they cover together repeats with that distance,
and it already ends on both sides where the repetition does: such pairs are exactly the runs, nothing is
extended. The pairs come from the tree of LCP intervals over the sorted suffixes of a text, walked
bottom-up. An interval holds its places, each in the class of its left word; where two intervals meet, a
pair of places of different classes is maximal, with the interval's depth. A stretch found at several
distances has the smallest as its period, as the others are multiples of it.

For a run's period the two places are neighbours among all places of their interval: a place between them
would give their common words, and with them the stretch, a smaller period. So each place that enters a
larger list is compared with its two neighbours there, and the smaller list always enters the larger.

A run of ``min_words`` words needs a depth of half as many, so suffixes are sorted only where some window of
that many words comes twice (found by a hash, which may find too many but not too few), and intervals of
less depth are never opened. Time grows with n log(n)^2 for n words, memory with n log(n); texts are
worked off one by one, in Arrow batches of bounded bytes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places kept in one block of an ordered list.
BLOCK = 1024
#: Multipliers of the window hash.
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_FOUND = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class Places:
    """Word numbers in order, in blocks, so that one more costs a block's length at most."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, place: int):
        self.blocks, self.firsts, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def neighbours(self, place: int) -> tuple[int | None, int | None]:
        """The last one before ``place`` and the first one after it; ``place`` is not in the list."""
        b = max(bisect.bisect_right(self.firsts, place) - 1, 0)
        block = self.blocks[b]
        at = bisect.bisect_right(block, place)
        before = block[at - 1] if at else None
        if at < len(block):
            return before, block[at]
        return before, self.firsts[b + 1] if b + 1 < len(self.firsts) else None

    def add(self, place: int) -> None:
        b = max(bisect.bisect_right(self.firsts, place) - 1, 0)
        block = self.blocks[b]
        bisect.insort(block, place)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts.insert(b + 1, block[BLOCK])


def windows_repeat(codes: np.ndarray, width: int) -> bool:
    """Whether some ``width`` neighbouring words may come twice; false only if none do."""
    if len(codes) <= width:
        return False
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    n = len(codes) - width + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        hashes = hashes * STEP + mixed[k : k + n]
    hashes.sort()
    return bool((hashes[1:] == hashes[:-1]).any())


def suffix_order(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the words each has in common with the one before (0 at first).

    Ranks of windows of 1, 2, 4 ... words, each from the ranks of its halves. The ranks of all widths are
    kept for the common words, four bytes a place and width.
    """
    n = len(codes)
    ranks = [codes.astype(np.int32)]
    while True:
        last, width = ranks[-1], 1 << (len(ranks) - 1)
        if width > n:
            break
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = last[width:].astype(np.int64) + 1
        kinds, made = np.unique(last.astype(np.int64) * (n + 1) + second, return_inverse=True)
        ranks.append(made.astype(np.int32))
        if len(kinds) == n:
            break
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        there = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[there] = ranks[k][a[there]] == ranks[k][b[there]]
        step = same.astype(np.int64) << k
        common[1:] += step
        a += step
        b += step
    return order, np.where(common >= least, common, 0)


def maximal_stretches(codes: np.ndarray, min_words: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of all runs of ``min_words`` words or more."""
    least = (min_words + 1) // 2
    order, common = suffix_order(codes, least)
    left = [-1, *codes.tolist()]  # the class of place p is left[p]; the start has one of its own
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, depth: int) -> None:
        if j - i <= depth and depth + j - i >= min_words and left[i] != left[j]:
            key = (i, j + depth)
            found[key] = min(found.get(key, j - i), j - i)

    def joined(one: Places, other: Places, depth: int) -> Places:
        small, large = (one, other) if one.size < other.size else (other, one)
        own = list(small)
        for place in own:
            before, after = large.neighbours(place)
            if before is not None:
                pair(before, place, depth)
            if after is not None:
                pair(place, after, depth)
        for place in own:
            large.add(place)
        return large

    # Suffixes that share no window of ``least`` words with a neighbour are in no interval.
    shared = common > 0
    inside = shared.copy()
    inside[:-1] |= shared[1:]
    waiting: list[tuple[int, Places]] = []  # depths rise; each waits for the rest of its interval
    node = None
    for place, depth in zip(order[inside].tolist(), common[inside].tolist(), strict=True):
        while waiting and waiting[-1][0] >= max(depth, 1):
            deep, places = waiting.pop()
            node = joined(places, node, deep)
        if depth:
            waiting.append((depth, node))
        node = Places(place)
    while waiting:
        deep, places = waiting.pop()
        node = joined(places, node, deep)
    return found


def runs_of(words: list[bytes], min_words: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(words) < min_words or not windows_repeat(codes, (min_words + 1) // 2):
        return []
    return sorted((start, end - start, period) for (start, end), period in maximal_stretches(codes, min_words).items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that lie in some run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    start, length, period = np.array(runs).T
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change[:-1]) > 0
    return [w for w, d in zip(words, dropped.tolist(), strict=True) if not d]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period, by start and period), collapsed.

    Words are parted by ASCII white space and numbered from 0. A run is at least ``min_words`` (2 or more) and two
    periods long. ``collapsed`` joins with one space the words that no run contains after its first
    period. A null or empty text has no words, no runs and an empty ``collapsed``. Repeated rows and
    rows without an id give a row each; other columns are not read. No rows give no rows.
    """
    if min_words < 2:
        raise ValueError("a run has at least two words")

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = (text or "").encode().split()
                runs = runs_of(words, min_words)
                rows.append((len(words), runs, b" ".join(collapse(words, runs)).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), search(F.col(f"`{text_col}`")).alias("found"))
    return rows.select(F.col(f"`{id_col}`"), "found.*")
