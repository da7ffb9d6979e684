"""Recompression of word sequences: equal substrings get equal symbols inside.

A round replaces runs of one symbol by a new symbol, or pairs whose left symbol is on the left side
of a split of all symbols and whose right one is on the right side. Names and sides are functions
of the symbols alone (64-bit hashes), so they agree across documents and machines without a table,
and a substring is parsed alike wherever it stands, but for what may join with its surroundings.
"""

from __future__ import annotations

import numpy as np

from pagegauge.llm.wordgrams import Words, mix, powers

_RUN, _PAIR, _SIDE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_BASE = 0xD1342543DE82EF95
#: One round of runs on the words, then rounds of pairs.
MARGIN, CHOICE = 2, 2
STEPS = ("run", "pair", "pair", "pair", "pair", "pair", "pair")


class Ranges:
    """Hashes of any range of words in constant time."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * _RUN)


def windows_of(words: Words, size: int) -> np.ndarray:
    """First words of all windows that lie in one text."""
    count = np.diff(words.first)
    ends = np.repeat(words.first[1:], count)
    at = np.arange(len(words.hash))
    return at[ends - at >= size]


def _least(names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where in each range of symbols the one with the smallest name is, the first among equals."""
    best, where = names[lo], lo.copy()
    for j in range(1, int((hi - lo).max(initial=1))):
        at = np.minimum(lo + j, hi - 1)
        less = names[at] < best
        best = np.where(less, names[at], best)
        where = np.where(less, at, where)
    return where


def phrases(words: Words, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window a phrase inside it (first word, end), found from the window's words alone.

    Symbols at the window's edges that could join with what is outside are left out, step by step;
    the others stand in the parse of the window wherever its words occur. Of the last level at which
    ``CHOICE`` of them lie ``MARGIN`` words or more from both edges, the one with the smallest name is
    taken. Windows with too few runs are their own phrase.
    """
    total = len(words.hash)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    names, begin = words.hash, np.arange(total)
    first, end = starts.copy(), starts + size
    # Symbols that surely stand in the parse, and those of them that may be chosen.
    active, lo, hi = np.arange(len(starts)), starts.copy(), starts + size
    choose_lo, choose_hi = lo, hi

    def settle(which: np.ndarray) -> None:
        at = _least(names, choose_lo[which], choose_hi[which])
        ends = np.append(begin[1:], total)
        first[active[which]], end[active[which]] = begin[at], ends[at]

    for number, kind in enumerate(STEPS):
        if not len(active):
            break
        before = np.zeros(len(names), bool)  # a symbol joins with the one before it
        own = text[begin]
        if kind == "run":
            before[1:] = (names[1:] == names[:-1]) & (own[1:] == own[:-1])
            new = np.flatnonzero(~before)
            length = np.diff(np.append(new, len(names))).astype(np.uint64)
            named = np.where(length > 1, mix(names[new] * _RUN + length), names[new])
            to = np.cumsum(~before) - 1
            lo2, hi2 = to[lo] + 1, to[hi - 1]
        else:
            right = mix(names ^ mix(np.array([number], np.uint64) + _SIDE)) >> np.uint64(63) == 1
            before[1:] = ~right[:-1] & right[1:] & (own[1:] == own[:-1])
            new = np.flatnonzero(~before)
            last = np.append(new[1:], len(names)) - 1
            named = np.where(last > new, mix(names[new] * _PAIR + names[last]), names[new])
            to = np.cumsum(~before) - 1
            i, j = lo + right[lo], hi - ~right[hi - 1]
            some = i < j
            i, j = np.where(some, i, lo), np.where(some, j, lo + 1)
            lo2, hi2 = np.where(some, to[i], 1), np.where(some, to[j - 1] + 1, 0)
        begins = begin[new]
        at = starts[active] + MARGIN
        c_lo = np.maximum(lo2, np.searchsorted(begins, at))
        c_hi = np.minimum(hi2, np.searchsorted(np.append(begins[1:], total), at + size - 2 * MARGIN, "right"))
        gone = c_hi - c_lo < CHOICE
        if number and gone.any():
            settle(gone)
        stay = ~gone
        active, lo, hi, choose_lo, choose_hi = active[stay], lo2[stay], hi2[stay], c_lo[stay], c_hi[stay]
        names, begin = named, begins
    if len(active):
        settle(np.ones(len(active), bool))
    return first, end


def window_keys(words: Words, starts: np.ndarray, size: int, ranges: Ranges) -> np.ndarray:
    """A key for every window: its phrase with the ``MARGIN`` words on both sides of it. Equal windows
    have equal keys; neighbours often share one."""
    first, end = phrases(words, starts, size)
    return ranges.of(np.maximum(first - MARGIN, starts), np.minimum(end + MARGIN, starts + size))
