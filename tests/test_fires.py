"""Automatic captures against windows and marks, worked by hand; the answer does not depend on the slices."""

import pytest

from pagegauge.operators import fires as fr
from test_windows import rows_by_session

FIRES = "session_id long, event_id long, t long, false_fire boolean, pageless boolean, covered boolean, page string"
WINDOWS = "session_id long, kind string, from_t long, to_t long, t string"
MARKS = "session_id long, event_id long, kind string, t long, page long"


def tables(spark):
    fires = [
        (1, 10, 1000, False, False, False, "clash"),
        (1, 11, 2000, False, False, False, "clash"),
        (1, 12, 9000, False, False, True, "clash"),
        (1, 13, 90000, True, False, None, "clash"),
        (2, 20, 1500, None, True, False, "clash"),
    ]
    windows = [
        (1, "tremor", 1000, 2000, "x"),  # both ends count
        (1, "tremor", 1500, 80000, "x"),  # over many slices
        (1, "tremor", 3000, 2500, "x"),  # ends before it starts
        (1, "no_fire", None, 99999, "x"),
        (1, "hint", 89000, 91000, "x"),
        (1, "ready", 500, 600, "x"),
        (1, "ready", 8000, 95000, "x"),
        (3, "tremor", 0, 99999, "x"),
    ]
    marks = [(1, 1, "stable", 2000, None), (1, 2, "page", 1500, 1), (1, 3, "page", 8500, 2)]
    probes = [(1, 10, False), (1, 11, True), (1, 12, None)]
    scenes = [(1, 10, 0.0, True), (1, 11, 0.5, True), (1, 12, 0.0, False)]
    return (
        spark.createDataFrame(fires, FIRES),
        spark.createDataFrame(windows, WINDOWS),
        spark.createDataFrame(marks, MARKS),
        spark.createDataFrame(probes, "session_id long, event_id long, uncertain boolean"),
        spark.createDataFrame(scenes, "session_id long, event_id long, motion double, whole boolean"),
    )


@pytest.mark.parametrize("width", [700, 1_000_000])
def test_a_fire_knows_its_windows(spark, width):
    got = {r["event_id"]: r for r in fr.audit_fires(*tables(spark), width).collect()}
    assert [got[i]["in_tremor"] for i in (10, 11, 12, 13, 20)] == [1, 2, 1, 0, 0]
    assert [got[i]["in_no_fire"] for i in (10, 13)] == [0, 0] and got[13]["in_hint"] == 1
    assert [got[i]["page"] for i in (10, 11, 12, 13, 20)] == [0, 1, 2, 2, 0]
    assert [got[i]["latency_ms"] for i in (10, 11, 12, 20)] == [None, 0, 7000, None]
    assert [got[i]["from_presented_ms"] for i in (10, 12, 20)] == [500, 1000, None]
    # Unmeasured corners are as forbidden as uncertain ones.
    assert [got[i]["unverified"] for i in (10, 11, 12, 13)] == [False, True, True, True]
    assert got[11]["moving"] and not got[10]["moving"] and got[12]["cut"] and not got[13]["cut"]
    assert got[13]["false_fire"] and got[20]["false_fire"] and got[20]["unsafe"]


def test_a_session_of_fires_is_summed(spark):
    given = tables(spark)
    sessions = spark.createDataFrame([(1,), (2,), (3,)], "session_id long")
    got = {r["session_id"]: r for r in fr.fire_summary(fr.audit_fires(*given), sessions).collect()}
    one = got[1]
    assert (one["fires"], one["false_fires"], one["fires_in_tremor"], one["fires_uncertain"]) == (4, 1, 3, 1)
    assert (one["fires_unverified"], one["fires_unsafe"], one["fires_on_covered"]) == (3, 4, 1)
    # Page 2 was taken twice, once falsely.
    assert (one["pages_fired"], one["repeat_fires"], one["latency_p50"]) == (3, 1, 7000.0)
    assert got[2]["pages_fired"] == 0 and got[2]["fires_unsafe"] == 1
    assert got[3]["fires"] == 0 and got[3]["latency_p50"] is None
    nothing = fr.fire_summary(fr.audit_fires(given[0].where("false"), *given[1:]), sessions.where("false"))
    assert nothing.count() == 0


def test_the_sweep_never_deals_rows_out_by_session(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not rows_by_session(fr.audit_fires(*tables(spark)), "session_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("name", ["auto_fire_audit", "auto_fire_summary"])
def test_the_events_are_clocked_once(spark, sf, name):
    """What is left to run reads the written clock, not the events, and still agrees with the SQL."""
    import __spark_entry__ as entry
    from check import compare, connect

    rows = entry.queries()[name](spark, sf)
    assert rows.inputFiles() == []
    problems, _ = compare(rows, connect(sf), entry.oracle_sql()[name])
    assert not problems, problems
