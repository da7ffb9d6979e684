"""Registered queries against their SQL twins on the smallest tables, one or two per family."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from pagegauge.plans import registry

NAMES = [
    "detection_summary",
    "content_box_join",
    "overlay_accuracy",
    "time_to_lock",
    "hint_change_series",
    "capture_stitch",
    "asof_frame",
    "straighten_verdict",
    "regression_gate",
    "evidence_verdict",
    "pii_summary",
    "hint_debounce",
    "ready_cue",
    "nearest_unique_match",
    "page_state_fold",
    "ink_mask_measures",
    "connected_components",
    "occluder_join",
    "session_summary",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf, name):
    problems, rows = compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
    assert not problems, problems
    assert rows > 0


def test_every_query_has_sql_but_the_shutter():
    # Those of subpackages that may be taken out have tests of their own.
    assert set(registry.callables()) - set(registry.oracles()) == {"auto_capture"}


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
