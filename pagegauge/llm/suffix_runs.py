"""Sorted runs of suffixes: front coding, and merging that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most  # equal up to low, not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_coded(suffixes: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """Of each string of a sorted run, the length it shares with the one before, and the rest."""
    last = b""
    for suffix in suffixes:
        n = common(last, suffix)
        yield n, suffix[n:]
        last = suffix


def decoded(run: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """The strings of a front-coded run, each with its shared length."""
    last = b""
    for n, rest in run:
        last = last[:n] + rest
        yield n, last


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merges sorted runs of (length shared with the string before in its run, string).

    Yields (length shared with the string before in the output, string, run). A loser tree whose
    players know how much they share with the last winner: of two players the one that shares more
    is the smaller, and only players that share equally much are compared, from there on.
    """
    count = len(runs)
    if not count:
        return
    size = 1
    while size < count:
        size *= 2
    # A player: (shared with the last winner, string, run); None is an ended run.
    losers: list[tuple[int, bytes, int] | None] = [None] * size

    def play(a, b):
        """Winner and loser, the loser's shared length being that with the winner."""
        if a is None or b is None:
            return (b, None) if a is None else (a, None)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        n = common(a[1], b[1], a[0])
        if a[1][n:] <= b[1][n:]:
            return a, (n, b[1], b[2])
        return b, (n, a[1], a[2])

    def entrant(i: int):
        if i >= count:
            return None
        item = next(runs[i], None)
        return None if item is None else (item[0], item[1], i)

    def build(node: int):
        if node >= size:
            return entrant(node - size)
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    best = build(1) if size > 1 else entrant(0)
    while best is not None:
        yield best
        i = best[2]
        best = entrant(i)
        node = (i + size) // 2
        while node >= 1 and size > 1:
            best, losers[node] = play(best, losers[node])
            node //= 2
