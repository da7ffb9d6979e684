"""Answers that are the same to a millionth count once, wherever the edges of rounding lie."""

import random

import pytest

from pagegauge.operators import pages as pg

SCHEMA = "session_id long, t long, event_id long, quad array<struct<x:double,y:double>>"
REST = [(0.9, 0.1), (0.9, 0.9), (0.1, 0.9)]


def kept(spark, rows):
    got = pg.first_answers(spark.createDataFrame(rows, SCHEMA), ["session_id"], ["t", "event_id"]).collect()
    return sorted((r.session_id, r.t, r.event_id) for r in got)


def plain(rows):
    def corners(quad):
        return None if quad is None or any(v is None or abs(v) == float("inf") or v != v for p in quad for v in p) else [v for p in quad for v in p]

    def same(a, b):
        return a is b if a is None or b is None else all(abs(x - y) < 1e-6 for x, y in zip(a, b))

    order = sorted((s, t, e, corners(q)) for s, t, e, q in rows if corners(q)) + sorted((s, t, e) for s, t, e, q in rows if not corners(q))
    order = [(*r, None)[:4] for r in order]
    return sorted((s, t, e) for s, t, e, q in order if not any(o[0] == s and o[1:3] < (t, e) and same(o[3], q) for o in order))


def test_a_rounding_edge_parts_nothing(spark):
    edge = 0.1234565
    rows = [(1, 1, 1, [(edge - 5e-8, 0.1), *REST]), (1, 2, 2, [(edge + 5e-8, 0.1), *REST]), (1, 3, 3, [(edge + 2e-6, 0.1), *REST]), (2, 4, 4, [(edge, 0.1), *REST])]
    assert kept(spark, rows) == [(1, 1, 1), (1, 3, 3), (2, 4, 4)]


def test_unmeasured_answers_are_one(spark):
    odd = [None, [(None, 0.1), *REST], [(float("nan"), 0.1), *REST], [(float("inf"), 0.1), *REST]]
    rows = [(1, 5 - i, i, q) for i, q in enumerate(odd)] + [(1, 9, 9, [(0.1, 0.1), *REST])] * 2
    assert kept(spark, rows) == [(1, 2, 3), (1, 9, 9)]
    assert kept(spark, []) == []


@pytest.mark.parametrize("spread", [1e-6, 4e-6, 6e-5])
def test_first_answers_of_a_plain_search(spark, spread):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        quad = [(0.1 + spread * rng.random(), 0.2 + spread * rng.random()), *[(x, y + spread * rng.random() / 8) for x, y in REST]]
        rows.append((1 if i % 3 else 2, rng.randrange(200), i, quad))
    rows += [(1, 300 + i, 1000 + i, rows[i][3]) for i in range(40)]
    got = kept(spark, rows)
    assert got == plain(rows) and 0 < len(got) < len(rows)


def test_round_corners_are_in_one_cell_and_nothing_is_broadcast(spark):
    """Corners at round shares of the frame lie inside their cells; the estimate of a small input moves no table to the driver."""
    names = [f"c{i}" for i in range(8)]
    round_ones = [([v / 10000] * 8,) for v in range(0, 10001, 625)] + [([0.1, 0.1, 0.9, 0.1, 0.9, 0.9, 0.1, 0.9],)]
    met = pg.in_cells(spark.createDataFrame(round_ones, "corners array<double>"), names)
    assert met.count() == len(round_ones)
    rows = spark.createDataFrame([(1, 1, 1, [(0.1, 0.1), *REST])], SCHEMA)
    plan = pg.first_answers(rows, ["session_id"], ["t", "event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
