"""Letters of a line against links between all pairs: over strips, chunks and letters of one id."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegauge.operators import imaging as im
from pagegauge.plans import imaging as plans
from pagegauge.plans import registry
from pagegauge.session import prepare

SCHEMA = "page_id long, node long, x0 double, x1 double, y0 double, y1 double, cy double, height double"


def letter(page, node, x, cy, width=9.0, height=12.0):
    return (page, node, x, x + width, cy - height / 2, cy + height / 2, cy, height)


def given(seed, n=500):
    rng = random.Random(seed)
    rows = [
        letter(rng.randrange(2), i, float(rng.randrange(0, 3200)), 40.0 * rng.randrange(3) + rng.random() * 8, rng.choice([6.0, 9.0, 30.0]), rng.choice([10.0, 12.0, 60.0]))
        for i in range(n)
    ]
    rows.append(letter(0, 900, 500.0, 20.0, width=2500.0))  # reaches over several strips
    # Letters of one id on two lines make one line of them.
    rows += [letter(1, 901, 600.0, 20.0), letter(1, 901, 600.0, 700.0), letter(1, 902, 620.0, 700.0)]
    return rows


def want(rows):
    label = {(r[0], r[1]): r[1] for r in rows}
    links = []
    for a in rows:
        for b in rows:
            if a[0] != b[0] or a[1] == b[1] or b[2] < a[2]:
                continue
            both = a[7] + b[7]
            if b[2] - a[3] <= 1.25 * both and abs(a[6] - b[6]) < 0.25 * both and min(a[5], b[5]) - max(a[4], b[4]) > 0.3 * min(a[7], b[7]):
                links.append(((a[0], a[1]), (b[0], b[1])))
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return sorted((r[0], r[1], label[r[0], r[1]]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_over_strips_are_those_of_all_pairs(spark, seed):
    rows = given(seed)
    odd = [(0, 950, None, 9.0, 0.0, 9.0, 4.0, 9.0), letter(0, 951, float("nan"), 20.0), letter(0, 952, 40.0, float("inf")), letter(0, 953, 40.0, 20.0)[:7] + (None,)]
    out = im.link_letters(spark.createDataFrame(rows + odd, SCHEMA), "page_id")
    got = sorted((r.page_id, r.node, r.line) for r in out.collect())
    assert got == sorted(want(rows) + [(r[0], r[1], r[1]) for r in odd])
    assert out.where("again").count() == 1


@pytest.mark.parametrize("at_once", [1, 7, 100])
def test_lines_of_a_strip_go_on_over_chunks(monkeypatch, at_once):
    monkeypatch.setattr(im, "ROWS_AT_ONCE", at_once)
    rows = sorted((r for r in given(3) if r[0] == 0 and r[1] != 900), key=lambda r: r[6])
    names = ["page_id", "node", *im.MEASURES]
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    table = pa.table(columns | {im.STRIP: [0] * len(rows), im.TALLEST: [60.0] * len(rows), "home": [True] * len(rows), "shared": [False] * len(rows), "again": [False] * len(rows)})
    found = pa.Table.from_batches(list(im._lines_of_strips("page_id", [])(iter(table.to_batches(max_chunksize=5))))).to_pylist()
    assert sorted(r["node"] for r in found if r["home"]) == sorted(r[1] for r in rows)
    label = {r["node"]: r["node"] for r in found}
    for _ in rows:
        for r in found:
            if not r["home"] or not r["open"]:
                label[r["node"]] = label[r["line"]] = min(label[r["node"]], label[r["line"]])
    # A line that is not open is called by its smallest letter at once.
    got = sorted((0, r["node"], label[r["line"]] if r["open"] else r["line"]) for r in found if r["home"])
    assert got == want(rows)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1:]


def test_a_fit_deals_letters_out_by_line_once(spark, sf):
    plan = exchanges(plans.polyfit_quadratic(registry.Tables(prepare(spark), sf)))
    # The letters, those of lines that go on, and the four of the lines' names.
    assert len(plan) == 6


def test_medians_of_lines_are_written_before_the_fit(spark, sf):
    """The shuffles of the medians' cells and values do not stand beside those of the fit."""
    plan = exchanges(plans.line_validation(registry.Tables(prepare(spark), sf)))
    assert plan and not any("metric#" in p for p in plan)


def test_letters_of_one_id_count_once(spark):
    rows = [(1, 1_000_003, 1, 1.0, 0.0, 0.0), (1, 3, 2, 1.0, 0.0, 0.0), (1, 4, 2, 1.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    tables = registry.Tables(prepare(spark), "none")
    tables._read["lineitem"] = table
    got = plans.component_link_join(tables).agg(F.sum("letters")).first()[0]
    assert got == 2
