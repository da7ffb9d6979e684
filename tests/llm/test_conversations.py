"""Conversation repair against an exhaustive search."""

import hashlib
import heapq
import random

import numpy as np
import pytest

from pagegauge.llm import conversation_repair as repair
from pagegauge.llm import path_ranks

WHITE = " \t\n\v\f\r"
CONV = "conv_id long, turn long, role string, text string, weight int"


def plain_repair(rows):
    """Cheapest first, then least audit, by best-first search over (row, roles so far)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heads = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            lines = "\n".join(f"{r}:{x}" for r, x in out)
            return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()
        if (i, last) in done:
            continue
        done.add((i, last))
        new = [x for x in after[last] if x != "s"][0]
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 3, audit + "I", i, new, (*out, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if faults[i] in ("", "t"):
                extra = 3 * (faults[i] == "t")
                if heads[i] and heads[i] in after[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, heads[i], (*out, (role, text))))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, new, (*out, (name, text))))


def expected(rows):
    by = {}
    for conv, turn, role, text, weight in rows:
        by.setdefault(conv, []).extend([(turn, role, text)] * (weight or 0))
    return sorted((str(c), *plain_repair(own)) for c, own in by.items())


def got(spark, rows, parts=4, extra=True):
    table = spark.createDataFrame(rows, CONV).repartition(parts)
    if extra:
        for name in ("part", "seq", "copies", "key", "fault", "whole", "audit", "n", "of"):
            table = table.withColumn(name, table["conv_id"].cast("string"))
    return sorted(tuple(str(x) if i == 0 else x for i, x in enumerate(r)) for r in repair.digests(repair.repaired(table, weight_col="weight")).collect())


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "So", f"It is {t}.", "", "  \n", None, "Why? \t"])
            rows.append((c, rng.choice([t, t, t, t // 2, t + 3, None]), role, text, rng.choice([1, 1, 1, 0, 2])))
    return rows + [(None, 1, "user", "Who?", 1), (None, 3, "assistant", "Me.", 1), (10**6, None, None, None, 1), (10**6 + 1, 5, "user", "gone", 0)]


@pytest.mark.parametrize("seed,size", [(1, 2048), (2, 5), (3, 1), (4, 3)])
def test_repairs_are_the_cheapest_and_least(spark, monkeypatch, seed, size):
    monkeypatch.setattr(repair, "SLICE", size)
    rows = random_rows(seed, 40, 14)
    assert got(spark, rows) == expected(rows)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """Many slices of one conversation, over several partitions, with long runs of one row."""
    monkeypatch.setattr(repair, "SLICE", 16)
    monkeypatch.setattr(repair, "NUMBERED", 7)
    rng = random.Random(9)
    rows = [(1, t if t % 50 else None, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Word {t}.", "Again.", f"Cut {t}", ""]), 1) for t in range(700)]
    rows += [(1, 77, "user", "Hot.", 60)] + random_rows(2, 5, 6)
    assert got(spark, rows) == expected(rows)


def test_slices_cut_by_bytes_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repair, "SLICE_BYTES", 100)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "long " * 500 + f"{t}.", 1) for c in range(3) for t in range(7)]
    assert got(spark, rows) == expected(rows)


def test_no_conversations(spark):
    assert got(spark, []) == []


def test_ranks_choose_the_least_path_of_any_graph():
    """Paths over random acyclic graphs whose arcs out of a node have different initials."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 30
        arcs = [(a, e, int(rng.integers(a + 1, n))) for a in range(n - 1) for e in rng.permutation(4)[: rng.integers(0, 4)].tolist()]
        if not arcs:
            continue
        tails, edits, heads = (np.array(c) for c in zip(*arcs))

        def least(node):
            own = min(((e, h) for a, e, h in arcs if a == node), default=None)
            return "" if own is None else "DIKR"[own[0]] + least(own[1])

        found, sizes = path_ranks.least_paths(tails, edits, heads, n, np.arange(n))
        text = "".join("DIKR"[e] for e in edits[found])
        ends = np.cumsum(sizes)
        assert [text[b - s : b] for s, b in zip(sizes, ends)] == [least(i) for i in range(n)]
