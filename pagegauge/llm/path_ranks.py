"""Cheapest repairs of slices of conversations, and the least of their audits, in numpy.

A node is a place between two rows and the state of the roles so far. Costs to go are found from the
right for all slices of a batch at once. An arc is optimal when its cost is the difference of its
nodes' costs to go. Optimal arcs are then ranked by the first 1, 2, 4, ... initials of the least audit
that begins with them: the rank over twice the length is that of the pair (rank, rank where the
pointer leads), and the pointer of the pointer leads twice as far. The arc of least rank out of the
entry begins the least path, and the stored pointers give its arcs by the bits of their places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Edits in the order of their initials, and what they cost (fixed values).
EDITS = b"DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COST = np.array([4, 3, 0, 3], dtype=np.int64)
TRUNCATED_COST = 3
#: Faults of a row.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing kept, after a system, a user, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant row that is inserted, or made by a changed role, leads.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
#: State after keeping a row, by state and initial; -1 where it cannot stay.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
NEVER = np.int64(1) << 40


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs to go from a place when up to two rows may be inserted there (more would be a loop)."""
    step = COST[INSERT]
    return np.minimum(np.minimum(cost, step + cost[..., NEXT]), 2 * step + cost[..., NEXT[NEXT]])


#: Costs to go after the last row of a conversation.
END = with_inserts(np.array([0, NEVER, NEVER, 0], dtype=np.int64))


@dataclass
class Slices:
    """Rows of all slices in a row: initials, faults, and the slices' lengths."""

    initials: np.ndarray
    faults: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first_node = self.starts + np.arange(len(self.sizes))
        self.node_count = int(self.sizes.sum()) + len(self.sizes)

    def _row_costs(self, rows: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs to go before ``rows``, without inserts there, from those after them (..., state)."""
        extra = np.where(self.faults[rows] == TRUNCATED, TRUNCATED_COST, 0)
        bound = (self.faults[rows] == BLANK) | (self.faults[rows] == DUPLICATE)
        shape = (-1,) + (1,) * (after.ndim - 1)
        to = KEPT[:, self.initials[rows]].T  # rows x states
        to = to.reshape((len(rows),) + (1,) * (after.ndim - 2) + (4,))
        keep = np.take_along_axis(after, np.broadcast_to(np.maximum(to, 0), after.shape), -1)
        keep = np.where(to < 0, NEVER, keep + COST[KEEP])
        turned = after[..., NEXT] + COST[REROLE]
        stay = np.minimum(keep, turned) + extra.reshape(shape)
        stay = np.where(bound.reshape(shape), NEVER, stay)
        return np.minimum(np.minimum(stay, after + COST[DELETE]), NEVER)

    def costs(self, after: np.ndarray) -> np.ndarray:
        """Costs to go at every node, (nodes, ..., state), from those behind every slice."""
        out = np.full((self.node_count, *after.shape[1:]), NEVER)
        out[self.first_node + self.sizes] = after
        order = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[order]
        for back in range(int(sizes[0]) if len(sizes) else 0):
            active = order[: np.searchsorted(-sizes, -back, "left")]
            place = self.sizes[active] - 1 - back
            node = self.first_node[active] + place
            out[node] = with_inserts(self._row_costs(self.starts[active] + place, out[node + 1]))
        return out

    def crossing(self) -> np.ndarray:
        """Cost from every entry state to every state behind each slice (slices, entry, exit)."""
        unit = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
        found = self.costs(np.broadcast_to(unit, (len(self.sizes), 4, 4)))
        return found[self.first_node].transpose(0, 2, 1)

    def arcs(self, costs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tail, edit and head of all optimal arcs; ``ends``: slices behind which nothing comes."""
        slice_of = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        node = np.arange(self.node_count)
        last = node == (self.first_node + self.sizes)[slice_of]
        tails, edits, heads = [], [], []

        def add(nodes, edit, to, price, allowed):
            """Arcs from all four states of ``nodes`` to ``to`` (node, state), where optimal."""
            here = costs[nodes]
            there = costs[to[0][:, None], np.maximum(to[1], 0)]
            fine = allowed & (to[1] >= 0) & (here < NEVER) & (here == price + there)
            at, state = np.nonzero(fine)
            tails.append(nodes[at] * 4 + state)
            edits.append(np.full(len(at), edit))
            heads.append(to[0][at] * 4 + to[1][at, state])

        own = node[~last]
        rows = own - slice_of[own]
        stays = ((self.faults[rows] != BLANK) & (self.faults[rows] != DUPLICATE))[:, None]
        extra = np.where(self.faults[rows] == TRUNCATED, TRUNCATED_COST, 0)[:, None]
        same = np.broadcast_to(np.arange(4), (len(own), 4))
        add(own, DELETE, (own + 1, same), COST[DELETE], np.ones_like(stays))
        open_ = node[~last | ends[slice_of]]
        add(open_, INSERT, (open_, np.broadcast_to(NEXT, (len(open_), 4))), COST[INSERT], np.ones((len(open_), 1), bool))
        add(own, KEEP, (own + 1, KEPT[:, self.initials[rows]].T), COST[KEEP] + extra, stays)
        add(own, REROLE, (own + 1, np.broadcast_to(NEXT, (len(own), 4))), COST[REROLE] + extra, stays)
        return np.concatenate(tails), np.concatenate(edits), np.concatenate(heads)


def least_paths(tails: np.ndarray, edits: np.ndarray, heads: np.ndarray, nodes: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of the least path from each entry node, one path after the other, and the paths' lengths.

    Arcs out of one node have different edits, so the first of them is known before any round; an arc
    that leads to a node without arcs ends its path.
    """
    count = len(tails)
    first = np.full(nodes, count)
    order = np.lexsort((-edits, tails))
    first[tails[order]] = order  # the last written is the least edit of the node
    jump = np.append(first[heads], count)
    rank = np.append(edits + 1, 0)
    length = np.append(np.ones(count, np.int64), 0)
    jumps = []
    while True:
        jumps.append(jump)
        if (jump == count).all():
            break
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        length = length + length[jump]
        jump = jump[jump]
    # Of the arcs out of each entry that of the least audit.
    best = np.full(nodes, count)
    order = np.argsort(-rank[:count], kind="stable")
    best[tails[order]] = order
    begin = best[entries]
    sizes = length[begin]
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    arc = np.repeat(begin, sizes)
    for bit, pointer in enumerate(jumps):
        move = place >> bit & 1 == 1
        arc[move] = pointer[arc[move]]
    return arc, sizes
