"""Sliced operators against plain per-key answers, with slices small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import folds
from pagegauge.operators.imaging import smallest_reachable
from pagegauge.operators.ordered import asof, interval_join, ordered, trailing
from pagegauge.operators.percentiles import FLOOR_INDEX, LINEAR, LOWER_MIDDLE, WEIGHTED, Wanted, never, percentiles
from pagegauge.streaming import machines as m


def series(seed, n=120, keys=3):
    rng = random.Random(seed)
    rows, t = [], {k: 0 for k in range(keys)}
    for i in range(n):
        k = 0 if rng.random() < 0.6 else rng.randrange(keys)  # one hot key
        t[k] += rng.choice([1, 3, 7, 40, 200])
        rows.append((k, t[k], i, rng.choice([None, 1, 2, 3]), rng.random() < 0.5))
    return rows


@pytest.mark.parametrize("width", [5, 50, 100_000])
def test_step_matches_a_plain_walk(spark, width):
    rows = series(1)
    df = spark.createDataFrame(rows, "k int, t long, i long, v int, f boolean")
    out = (
        ordered(df, ["k"], ["t", "i"], width)
        .step(
            lag={"before": F.col("t")},
            lead={"after": F.col("t")},
            fill={"last_v": F.col("v")},
            ahead={"next_v": F.col("v")},
            running={"total": F.coalesce("v", F.lit(0))},
            peak={"high": F.col("v")},
        )
        .result()
        .collect()
    )
    got = {r["i"]: r for r in out}
    assert len(got) == len(rows)
    for k in range(3):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        last, total, high = None, 0, None
        for j, r in enumerate(own):
            last = r[3] if r[3] is not None else last
            total += r[3] or 0
            high = r[3] if high is None else (high if r[3] is None else max(high, r[3]))
            g = got[r[2]]
            assert g["before"] == (own[j - 1][1] if j else None)
            assert g["after"] == (own[j + 1][1] if j + 1 < len(own) else None)
            assert (g["last_v"], g["total"], g["high"]) == (last, total, high)
            assert g["next_v"] == next((s[3] for s in own[j:] if s[3] is not None), None)


@pytest.mark.parametrize("width", [5, 100_000])
def test_recent_and_trailing(spark, width):
    rows = series(2)
    df = spark.createDataFrame(rows, "k int, t long, i long, v int, f boolean")
    recent = ordered(df, ["k"], ["t", "i"], width).recent("r", F.col("i"), 4).result().collect()
    near = trailing(df, ["k"], "t", F.col("i"), "s", 45, width).collect()
    for k in range(3):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for j, r in enumerate(own):
            mine = next(x for x in recent if x["i"] == r[2])
            assert mine["r"] == [s[2] for s in own[max(0, j - 3) : j + 1]]
            seen = next(x for x in near if x["i"] == r[2])
            assert [s["v"] for s in seen["s"]] == [s[2] for s in own if r[1] - 45 <= s[1] <= r[1]]


@pytest.mark.parametrize("width", [7, 100_000])
def test_asof(spark, width):
    left = [(k, t, i) for k, t, i, *_ in series(3)]
    right = [(k, t, i) for k, t, i, *_ in series(4)]
    l = spark.createDataFrame(left, "k int, t long, i long")
    r = spark.createDataFrame(right, "k int, at long, j long")
    for strict in (False, True):
        got = asof(l, r, ["k"], "t", "at", {"j": F.col("j")}, width, tie="j", strictly_before=strict).collect()
        assert len(got) == len(left)
        for row in got:
            past = [x for x in right if x[0] == row["k"] and (x[1] < row["t"] if strict else x[1] <= row["t"])]
            expect = max(past, key=lambda x: (x[1], x[2]))[2] if past else None
            assert row["j"] == expect


def test_interval_join_each_pair_once(spark):
    rng = random.Random(5)
    a = [(i % 2, i, s := rng.randrange(500), s + rng.randrange(1, 200)) for i in range(40)]
    b = [(i % 2, i, s := rng.randrange(500), s + rng.randrange(1, 200)) for i in range(40)]
    left = spark.createDataFrame(a, "k int, i int, a0 int, a1 int")
    right = spark.createDataFrame(b, "k int, j int, b0 int, b1 int")
    meets = (F.col("a0") < F.col("b1")) & (F.col("a1") > F.col("b0"))
    got = sorted((r["i"], r["j"]) for r in interval_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 30, meets).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])


def test_percentile_conventions(spark):
    rng = random.Random(6)
    rows = [("a", rng.choice([0.5, 1.25, 7.0, rng.random() * 9]), rng.randrange(1, 5)) for _ in range(41)]
    rows += [("b", float(i), 1) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    metric = {"v": (F.col("v"), 0.3)}
    wanted = [
        Wanted("n50", "v", 0.5),
        Wanted("n95", "v", 0.95),
        Wanted("l90", "v", 0.9, LINEAR),
        Wanted("m50", "v", 0.5, LOWER_MIDDLE),
        Wanted("f60", "v", 0.6, FLOOR_INDEX),
    ]
    got = {r["g"]: r for r in percentiles(df, ["g"], metric, wanted).collect()}
    weighted = {
        r["g"]: r["w50"]
        for r in percentiles(df, ["g"], metric, [Wanted("w50", "v", 0.5, WEIGHTED)], weight=F.col("w")).collect()
    }
    for g in ("a", "b"):
        v = sorted(x for name, x, _ in rows if name == g)
        n = len(v)
        assert got[g]["n50"] == v[max(1, -(-n // 2)) - 1]
        pos = 0.9 * (n - 1)
        low = int(pos)
        assert got[g]["l90"] == pytest.approx(v[low] + (v[min(low + 1, n - 1)] - v[low]) * (pos - low))
        assert got[g]["m50"] == v[(n - 1) // 2]
        assert got[g]["f60"] == v[min(n - 1, int(0.6 * n))]
        pairs = sorted((x, w) for name, x, w in rows if name == g)
        total, seen = sum(w for _, w in pairs), 0
        for x, w in pairs:
            seen += w
            if seen >= 0.5 * total - 1e-9:
                assert weighted[g] == x
                break
    assert got["b"]["n50"] == 5 and got["b"]["n95"] == 10


def test_never_is_after_everything(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 4.0), ("b", 1.0), ("b", 2.0), ("b", None)], "g string, v double")
    metric = {"v": (never(F.col("v")), 1.0)}
    got = {r["g"]: r["p50"] for r in percentiles(df, ["g"], metric, [Wanted("p50", "v", 0.5, LOWER_MIDDLE)]).collect()}
    assert got == {"a": None, "b": 2.0}


MACHINES = {
    "rate": (m.RATE_LIMIT, lambda rng, t: {"t": t}),
    "ready": (m.READY_CUE, lambda rng, t: {"t": t, "strict": rng.random() < 0.6, "keep": rng.random() < 0.9}),
    "tick": (m.ONCE_PER_EPISODE, lambda rng, t: {"t": t, "ready": rng.random() < 0.1, "found": rng.random() < 0.5}),
    "hint": (m.HINT_DEBOUNCE, lambda rng, t: {"t": t, "wanted": rng.choice([None, "glare", "glare", "move-back"])}),
    "latch": (m.DIRECTION_LATCH, lambda rng, t: {"t": t, "direction": rng.choice([None, "left", "left", "up", "up"])}),
    "queue": (
        m.CONFLATE,
        lambda rng, t: {"action": rng.choice(["push", "take"]), "priority": rng.choice(["live", "capture"])},
    ),
}


@pytest.mark.parametrize("name", list(MACHINES))
def test_sliced_fold_is_the_sequential_fold(spark, name):
    machine, make = MACHINES[name]
    rng = random.Random(7)
    rows, t = [], {0: 0, 1: 0}
    for i in range(160):
        k = 0 if rng.random() < 0.7 else 1
        t[k] += rng.choice([20, 60, 150, 400])
        rows.append({"k": k, "t": t[k], "event_id": i, **make(rng, t[k])})
    types = {bool: "boolean", str: "string", int: "bigint"}
    fields = {}
    for r in rows:
        for n, v in r.items():
            if v is not None:
                fields[n] = types[type(v)]
    columns = list(rows[0])
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {fields[c]}" for c in columns))
    names = folds.output_names(machine)
    got = {r["event_id"]: tuple(r[n] for n in names) for r in folds.fold(df, ["k"], ["t", "event_id"], machine, 900).collect()}
    for k in (0, 1):
        state = machine.start()
        for r in sorted((r for r in rows if r["k"] == k), key=lambda r: (r["t"], r["event_id"])):
            assert got[r["event_id"]] == machine.step(state, tuple(r[c] for c in machine.inputs)), r


def test_smallest_reachable(spark):
    rng = random.Random(8)
    edges = [("p", i, i + 1) for i in range(30)] + [("p", rng.randrange(40, 60), rng.randrange(40, 60)) for _ in range(12)]
    nodes = spark.createDataFrame([("p", i) for i in range(60)], "s string, node long")
    got = {r["node"]: r["label"] for r in smallest_reachable(nodes, spark.createDataFrame(edges, "s string, a long, b long"), "s").collect()}
    label = list(range(60))
    for _ in range(60):
        for _, a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label))


def test_tall_letters_of_one_line_are_linked(spark):
    """The gap that a line allows follows the letters' heights: 80 px for letters of 40 px, not for 10."""
    from pagegauge.operators.imaging import link_letters

    rows = [(p, i, x, x + h, 100.0 - h / 2, 100.0 + h / 2, 100.0, h) for p, h in ((1, 40.0), (2, 10.0)) for i, x in ((1, 0.0), (2, h + 80.0))]
    letters = spark.createDataFrame(rows, "page_id long, node long, x0 double, x1 double, y0 double, y1 double, cy double, height double")
    got = sorted((r["page_id"], r["node"], r["line"]) for r in link_letters(letters, "page_id").collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 2)]


def test_rounds_of_links_shrink(spark, monkeypatch):
    """A long chain, a wide star and many single nodes: all rounds together write a few times the links, not all nodes each."""
    from pagegauge.operators import imaging

    written, real = [], imaging.cut

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(imaging, "cut", counted)
    chain = [("p", i, i + 1) for i in range(300)] + [("p", 900, i) for i in range(400, 700)]
    nodes = spark.createDataFrame([("p", i) for i in range(4000)], "s string, node long")
    got = {r["node"]: r["label"] for r in imaging.smallest_reachable(nodes, spark.createDataFrame(chain, "s string, a long, b long"), "s").collect()}
    assert got == {i: 0 if i <= 300 else 400 if 400 <= i < 700 or i == 900 else i for i in range(4000)}
    assert sum(written) < 16 * len(chain)


def test_percentiles_of_a_written_table_shuffle_cells_only(spark):
    """The same answers as the plain form; no exchange deals out rows by their value before the cells are known."""
    from pagegauge.operators.percentiles import LINEAR, Wanted, percentiles

    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), -2.5, 0.0]
    rows = [("ab"[i % 2], rng.choice(odd) if i % 9 == 0 else rng.random() * 5) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x double")
    wanted = [Wanted("p50", "m", 0.5, LINEAR), Wanted("p90", "m", 0.9, LINEAR), Wanted("n95", "m", 0.95)]
    plain, written = (percentiles(df, ["k"], {"m": (df["x"], 0.01)}, wanted, written=w) for w in (False, True))
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, plain.collect()))
    by_value = [line for line in written._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert by_value and not any("grid#" in line.split("hashpartitioning")[1].split(")")[0] for line in by_value)


def test_a_fold_makes_its_rows_once_and_keeps_long_numbers(spark):
    """Slices, rounds and outputs read the same written rows; a whole number beside a gap stays whole."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(t):
        made.add(1)
        return t

    far = 2**53 + 1
    rows = [(k, i * 400, 10 * k + i, far if i else None) for k in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "k long, t long, event_id long, far long").withColumn("t", counted("t"))
    out = folds.fold(df, ["k"], ["t", "event_id"], m.RATE_LIMIT, 900).collect()
    assert made.value == len(rows) == len(out)
    assert {r["far"] for r in out} == {None, far}
