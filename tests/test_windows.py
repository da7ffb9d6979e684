"""Windows met on slices: answers against a plain walk, and plans without a shuffle of rows by session."""

import random

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import captures, pages, sequences, timeline
from pagegauge.operators.ordered import ordered

SESSIONS = 5


def samples(seed, n=400):
    """Two thirds of all rows in one session."""
    rng = random.Random(seed)
    t = [0] * SESSIONS
    rows = []
    for i in range(n):
        s = 0 if rng.random() < 0.6 else rng.randrange(SESSIONS)
        t[s] += rng.choice([30, 100, 249, 250, 251, 900, 70_000])
        rows.append((s, i, t[s], rng.random() < 0.8, True, True, True, rng.choice([0.01, 0.02, 0.05]), rng.random() < 0.2))
    return rows


SAMPLE = "session_id int, event_id long, t long, shown boolean, frame_known boolean, has_page boolean, judged boolean, err double, capturing boolean"


def given(spark, seed=1):
    rows = samples(seed)
    last = {s: max(r[2] for r in rows if r[0] == s) for s in range(SESSIONS)}
    windows = [(s, end // 10, end * 9 // 10) for s, end in last.items()]
    return rows, windows, spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(windows, "session_id int, from_t long, to_t long")


@pytest.mark.parametrize("width", [100, 5_000, 10**9])
def test_intervals_are_those_of_a_walk(spark, width):
    rows, windows, table, spans = given(spark)
    want = []
    for s, lo, hi in windows:
        own = sorted(r for r in rows if r[0] == s)
        for a, b in zip(own, [*own[1:], None]):
            begin, end = max(lo, a[2]), min(hi, hi if b is None else b[2], a[2] + 250)
            if end > begin:
                want.append((s, a[1], begin, end))
    got = timeline.intervals(table, spans, width=width).select("session_id", "event_id", "begin", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    inside = timeline.in_window(table, spans, width=width).result().collect()
    bounds = {s: (lo, hi) for s, lo, hi in windows}
    assert sorted(r.event_id for r in inside) == sorted(r[1] for r in rows if bounds[r[0]][0] <= r[2] <= bounds[r[0]][1])


def test_open_spans_and_facts_keep_rows_without_any(spark):
    rows, _, table, _ = given(spark, 2)
    facts = spark.createDataFrame([(0, "a"), (3, "b")], "session_id int, fact string")
    got = ordered(table, ["session_id"], ["t", "event_id"], 1000).windowed(facts, how="left").result().collect()
    assert len(got) == len(rows) and all(r.fact == {0: "a", 3: "b"}.get(r.session_id) for r in got)


def test_hint_in_force_since_long_before_the_window(spark):
    changes = spark.createDataFrame(
        [(1, 10, 1, "a"), (1, 500_000, 2, "b"), (1, 900_000, 3, None), (2, 700_000, 4, "c"), (3, 100, 5, "d")],
        "session_id int, t long, event_id long, key string",
    )
    spans = spark.createDataFrame([(1, 400_000, 950_000), (2, 10, 600_000), (3, 100, 200)], "session_id int, from_t long, to_t long")
    got = sequences.hint_spans(changes, spans).select("session_id", "key", "begin", "end").collect()
    want = [(1, "a", 400_000, 500_000), (1, "b", 500_000, 900_000), (1, None, 900_000, 950_000), (3, "d", 100, 200)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_funnel_of_a_walk(spark):
    rng = random.Random(3)
    events = [(rng.randrange(4) if rng.random() < 0.5 else 0, rng.randrange(3000), rng.choice("abcx")) for _ in range(60)] + [(9, 5, "x"), (8, 7, "a"), (8, 7, "b"), (8, 6, "c")]
    table = spark.createDataFrame(events, "s int, t long, kind string")
    steps = {n: F.col("kind") == n for n in "abc"}
    got = pages.funnel(table, "s", "t", steps, 200).collect()[0]
    reached = dict.fromkeys("abc", 0)
    for s in {e[0] for e in events}:
        since = 0
        for n in "abc":
            met = [t for q, t, k in events if q == s and k == n and t >= since]
            if not met:
                break
            since = min(met)
            reached[n] += 1
    assert got.sessions == len({e[0] for e in events}) and [got[n] for n in "abc"] == list(reached.values())


def rows_by_session(df, key):
    """Exchanges on the key alone whose input is not a summary."""
    df.collect()
    found = []

    def summary(node):
        name = node.nodeName()
        if "Aggregate" in name:
            return True
        if "Exchange" in name or "Scan" in name or "QueryStage" in name or "Join" in name:
            return "QueryStage" in name and summary(node.plan()) or False
        children = node.children()
        return children.size() > 0 and all(summary(children.apply(i)) for i in range(children.size()))

    def walk(node):
        name = node.nodeName()
        if name == "Exchange":
            dealt = node.outputPartitioning().toString()
            if dealt.startswith(f"hashpartitioning({key}#") and dealt.count("#") == 1 and not summary(node.child()):
                found.append(node.toString())
        if "QueryStage" in name:
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


def test_rows_are_never_dealt_out_by_session(spark):
    _, _, table, spans = given(spark, 4)
    # One row per session, and seen to be so in the plan.
    spans = spans.groupBy("session_id").agg(F.min("from_t").alias("from_t"), F.max("to_t").alias("to_t"))
    on = table.withColumn("locked", F.col("shown"))
    marks = table.select("session_id", "t", "event_id", F.col("event_id").cast("string").alias("key"))
    jobs = {
        "overlay_accuracy": timeline.overlay_accuracy(table, spans),
        "time_to_lock": timeline.time_to_lock(table, spans),
        "false_locks": timeline.false_locks_per_minute(table, spans),
        "paper_lock": timeline.paper_lock(on, spans),
        "hint_window": sequences.hint_window(marks, spans, ["3"]),
        "churn": sequences.churn(marks, spans),
        "in_force": captures.in_force(table, marks, "key", F.lit("none")),
    }
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, job in jobs.items():
            assert not rows_by_session(job, "session_id"), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
