"""Work that several readers share is done once, and tasks stay small."""

import random

from pyspark.sql import functions as F

from pagegauge.operators import captures, sequences
from pagegauge.plans.captures import capture_freeze
from pagegauge.plans.registry import Tables
from pagegauge.session import ADVISORY, prepare


def test_steps_of_the_steadiest_window_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(step):
        made.add(1)
        return step

    rng = random.Random(5)
    steps = {k: [None if rng.random() < 0.05 else rng.randrange(40) / 64 for _ in range(60)] for k in range(3)}
    rows = [(k, 9_000 * i, 100 * k + i, s) for k, own in steps.items() for i, s in enumerate(own)]
    df = spark.createDataFrame(rows, "session_id long, t long, event_id long, step double").withColumn("step", counted("step"))
    got = sorted(map(tuple, sequences.steadiest(df, frames=5, earliest=2, tail=2).collect()))
    want = []
    for k, own in steps.items():
        whole = [(max(last), nth - 5) for nth in range(7, 59) if None not in (last := own[nth - 4 : nth])]
        worst, start = min(whole)
        want.append((k, worst, start + 2))
    assert got == want
    assert made.value == len(rows)


def test_hints_without_a_refinement_are_not_sorted_with_captures(spark):
    """The answers of a walk; hints that say nothing about a capture are dropped before any exchange."""
    rng = random.Random(6)
    kinds = ["capture", "confirm-open", "confirm-done", "hint", "hint", "hint"]
    rows, t = [], [0, 0]
    for i in range(300):
        s = rng.randrange(2)
        t[s] += rng.choice([50, 400, 70_000])
        kind = rng.choice(kinds)
        rows.append((s, i, t[s], 1, 2.0, kind, kind == "hint" and rng.random() < 0.3))
    log = spark.createDataFrame(rows, "session_id long, event_id long, t long, k int, value double, kind string, is_refine boolean")
    job = captures.stitch(log)
    want = []
    for s in range(2):
        own = [r for r in rows if r[0] == s]
        taps = [r[2] for r in own if r[5] == "capture"]
        for at, upto in zip(taps, [*taps[1:], None]):
            inside = [r for r in own if r[2] > at and (upto is None or r[2] < upto)]
            opened = min((r[2] for r in inside if r[5] == "confirm-open"), default=None)
            done = min((r[2] for r in inside if opened is not None and r[5] == "confirm-done" and r[2] >= opened), default=None)
            refine = max((r[2] for r in own if r[6] and r[2] >= at and (opened is None or r[2] <= opened)), default=None)
            want.append((s, at, upto, opened, done, refine))
    got = job.select("session_id", "t", "next_t", "open_t", "done_t", "refine_t").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plan = job._jdf.queryExecution().optimizedPlan().toString()
    assert "confirm-open,confirm-done" in plan.replace(" ", "") and "is_refine" in plan


def test_freeze_reads_written_clocks_only(spark, sf):
    plan = capture_freeze(Tables(prepare(spark), sf))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in plan


def test_tasks_are_small_unless_the_cluster_names_a_size(spark):
    was = spark.conf.get(ADVISORY, None)
    try:
        spark.conf.unset(ADVISORY)
        assert prepare(spark).conf.get(ADVISORY) == "16m"
        spark.conf.set(ADVISORY, "48m")
        assert prepare(spark).conf.get(ADVISORY) == "48m"
    finally:
        spark.conf.unset(ADVISORY) if was is None else spark.conf.set(ADVISORY, was)
