"""Order-dependent readings of a series: motion, agreement, hint changes, cadence, waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.operators.detection import rate, with_quad_distance
from pagegauge.operators.ordered import Ordered, asof, ordered, trailing
from pagegauge.operators.percentiles import Wanted, with_percentiles
from pagegauge.operators.timeline import KEY, SLICE_MS, series
from pagegauge.session import written_once

# Motion and agreement limits of the live guidance.
JUMP_THRESHOLD = 0.05
STILL_MAX = 0.015
SHAKE_WINDOW_MS = 600
MOTION_MIN_SPAN_MS = 200
SETTLE_READINGS = 3
AGREE_MAX = 0.006
SPACING_READINGS = 6
ONSET_MIN, ONSET_RATIO, ONSET_HISTORY = 0.012, 3.0, 5
FAST_CHANGE_MS = 1500
COST_SHARE, LONG_TASK_MS = 0.3, 50.0

# Which chip is the active one when several are shown.
HINT_PRIORITY = [
    "move-back",
    "move-closer",
    "move-phone",
    "glare",
    "hold-still",
    "corner-covered",
    "separate-sheets",
    "low-light",
    "not-found",
    "searching",
]


def corner_move(a: Column, b: Column, aspect: float) -> Column:
    """Largest move of a corner between two readings, y stretched by the aspect, over the diagonal."""
    diagonal = float((1 + aspect * aspect) ** 0.5)
    moves = []
    for i in range(4):
        dx = g.corner(a, i)["x"] - g.corner(b, i)["x"]
        dy = (g.corner(a, i)["y"] - g.corner(b, i)["y"]) * aspect
        moves.append(F.sqrt(dx * dx + dy * dy) / diagonal)
    return F.greatest(*moves)


def motion_steps(readings: DataFrame, width: float, height: float) -> DataFrame:
    """Distance to the previous frame's quad, for frames where both were answered."""
    shown = F.when(F.col("shown"), F.col("quad"))
    rows = series(readings.withColumn("quad", shown)).step(lag={"before": F.col("quad")}).result()
    return with_quad_distance(rows, "step", "quad", "before", F.lit(width), F.lit(height))


def motion_summary(steps: DataFrame) -> DataFrame:
    steps = written_once(steps.select(KEY, "step"))
    jumps = F.count_if(F.col("step") > JUMP_THRESHOLD)
    table = steps.groupBy(KEY).agg(
        F.count("step").alias("pairs"),
        F.avg("step").alias("mean"),
        jumps.alias("jumps"),
        rate(jumps, F.count("step")).alias("jump_rate"),
    )
    return with_percentiles(
        table,
        steps,
        [KEY],
        {"step": (F.col("step"), 1e-4)},
        [Wanted("p50", "step", 0.5), Wanted("p95", "step", 0.95)],
    )


def steadiest(steps: DataFrame, frames: int, earliest: int, tail: int) -> DataFrame:
    """Middle frame of the window of ``frames`` whose worst step is smallest; first on ties.

    A frame without an answer breaks every window over it. The steps are written once, so that numbers
    and windows read plain rows and no quad is compared again for them.
    """
    steps = written_once(steps.select(KEY, "t", "event_id", "step"))
    numbered = series(steps).step(running={"nth": F.lit(1).cast("bigint")})
    rows = numbered.recent("last_steps", F.col("step"), frames - 1)
    totals = rows.df.groupBy(KEY).agg(F.max("nth").alias("n"))
    start = F.col("nth") - frames
    windows = (
        rows.windowed(totals)
        .result()
        .where(
            (start >= earliest)
            & (F.col("nth") <= F.col("n") - tail)
            & (F.size("last_steps") == frames - 1)
            & F.forall("last_steps", lambda s: s.isNotNull())
        )
        .withColumn("worst", F.round(F.array_max("last_steps"), 9))
        .withColumn("start", start)
    )
    best = windows.groupBy(KEY).agg(F.min(F.struct("worst", "start")).alias("best"))
    return best.select(KEY, F.col("best.worst").alias("worst"), (F.col("best.start") + frames // 2).alias("frame"))


def motion_over_window(readings: DataFrame, aspect: float, span: int = SHAKE_WINDOW_MS) -> DataFrame:
    """Largest move from the readings of the last ``span`` ms to the newest; null under 200 ms of them."""
    rows = trailing(readings, [KEY], "t", F.col("quad"), "seen", span, SLICE_MS)
    largest = F.array_max(F.transform("seen", lambda r: corner_move(F.col("quad"), r["v"], aspect)))
    covered = F.col("t") - F.get("seen", F.lit(0))["at"]
    return rows.withColumn("motion", F.when(covered >= MOTION_MIN_SPAN_MS, largest)).drop("seen")


def last_moved_at(readings: DataFrame, aspect: float) -> DataFrame:
    """When the newest step over the still limit ended."""
    rows = series(readings).step(lag={"before": F.col("quad")})
    stepped = F.when(corner_move(F.col("quad"), F.col("before"), aspect) > STILL_MAX, F.col("t"))
    return rows.step(fill={"moved_at": stepped}).result().drop("before")


def recent_readings(readings: DataFrame, n: int) -> DataFrame:
    held = F.struct(F.col("t").alias("at"), F.col("quad").alias("quad"))
    return series(readings).recent("last_readings", held, n).result()


def settled(readings: DataFrame, aspect: float) -> DataFrame:
    """The last three readings span 200 ms and none is further than the still limit from the newest."""
    rows = recent_readings(readings, SETTLE_READINGS)
    last = F.col("last_readings")
    far = F.exists(last, lambda r: corner_move(F.col("quad"), r["quad"], aspect) > STILL_MAX)
    spans = F.col("t") - F.get(last, F.lit(0))["at"] >= MOTION_MIN_SPAN_MS
    return rows.withColumn("settled", (F.size(last) >= SETTLE_READINGS) & spans & ~far).drop("last_readings")


def agreeing(readings: DataFrame, aspect: float) -> DataFrame:
    rows = recent_readings(readings, SETTLE_READINGS)
    last = F.col("last_readings")
    far = F.exists(last, lambda r: corner_move(F.col("quad"), r["quad"], aspect) > AGREE_MAX)
    return rows.withColumn("agree", (F.size(last) >= SETTLE_READINGS) & ~far).drop("last_readings")


def spacing(readings: DataFrame) -> DataFrame:
    """Upper-middle of the last five gaps; 0 below three readings."""
    rows = series(readings).recent("times", F.col("t"), SPACING_READINGS).result()
    gaps = F.sort_array(
        F.zip_with(
            F.slice("times", F.lit(2), F.size("times")),
            F.slice("times", F.lit(1), F.size("times") - 1),
            lambda later, earlier: later - earlier,
        )
    )
    middle = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    return rows.withColumn("spacing", F.when(F.size("times") >= 3, middle).otherwise(F.lit(0))).drop("times")


def onsets(scores: DataFrame, score: Column) -> DataFrame:
    """Does a score stand out from the five before it (three at least)?"""
    rows = series(scores.withColumn("score", score)).step(lag={"before": F.col("score")})
    rows = rows.recent("history", F.col("before"), ONSET_HISTORY).result()
    previous = F.sort_array(F.filter("history", lambda v: v.isNotNull()))
    median = F.get(previous, F.floor(F.size(previous) / 2).cast("int"))
    stands_out = F.col("score") > F.greatest(F.lit(ONSET_MIN), ONSET_RATIO * median)
    return rows.withColumn("onset", (F.size(previous) >= 3) & F.coalesce(stands_out, F.lit(False))).drop(
        "history", "before"
    )


def cost_average(passes: DataFrame, cost: Column, duty: float, low: float, high: float) -> DataFrame:
    """Running cost with a 0.3 share for the newest pass, and the interval it asks for.

    The share of a pass 128 passes back is below double precision, so a bounded tail is exact.
    """
    keep = 128
    charged = F.when(cost >= LONG_TASK_MS, cost * 2).otherwise(cost)
    rows = series(passes).recent("charges", charged, keep).result()
    first = F.get("charges", F.lit(0))
    average = F.aggregate(
        F.slice("charges", F.lit(2), F.size("charges")),
        first,
        lambda total, charge: total * (1 - COST_SHARE) + charge * COST_SHARE,
    )
    rows = rows.withColumn("cost_ms", average)
    wanted = F.least(F.lit(high), F.greatest(F.lit(low), F.col("cost_ms") / max(1e-3, duty)))
    return rows.withColumn("interval_ms", wanted).drop("charges")


def hint_changes(log: DataFrame) -> DataFrame:
    """The active chip over time: one row per change, ``key`` null when none is left.

    Each chip's last shown/gone is carried along; the active one is the first shown by
    priority. Changes sharing a moment are one change.
    """
    hints = log.where((F.col("kind") == "hint") & F.col("hint_key").isin(HINT_PRIORITY))
    names = {f"__{i}": k for i, k in enumerate(HINT_PRIORITY)}
    rows = ordered(hints.select(KEY, "t", "event_id", "hint_key", "hint_shown"), [KEY], ["t", "event_id"], SLICE_MS)
    rows = rows.step(fill={n: F.when(F.col("hint_key") == k, F.col("hint_shown")) for n, k in names.items()})
    active = F.coalesce(*[F.when(F.col(n), F.lit(k)) for n, k in names.items()])
    slim = rows.df.select(*rows.keys, "__slice", "t", "event_id", active.alias("key"))
    settled_rows = Ordered(slim, rows.keys, rows.order).step(lead={"next_t": F.col("t")})
    settled_rows = settled_rows.where(F.col("next_t").isNull() | (F.col("next_t") != F.col("t")))
    changed = settled_rows.step(lag={"before": F.col("key")}).result()
    return changed.where(~F.col("key").eqNullSafe(F.col("before"))).select(KEY, "t", "event_id", "key")


def hint_spans(changes: DataFrame, windows: DataFrame) -> DataFrame:
    """The hint in force over a window, as spans; the time before any hint is a null span."""
    held = ordered(changes, [KEY], ["t", "event_id"], SLICE_MS).step(lead={"next_t": F.col("t")})
    spans = windows.select(KEY, "from_t", "to_t")
    # A hint may have been in force since long before the window: that one is looked up from the
    # window's start, the others begin inside it.
    since = {n: F.col(n) for n in ("t", "event_id", "key", "next_t")}
    first = asof(spans, held.result(), [KEY], "from_t", "t", since, SLICE_MS, tie="event_id").where(F.col("t").isNotNull())
    later = held.windowed(spans, "from_t", "to_t", SLICE_MS).where(F.col("t") > F.col("from_t")).result()
    columns = [KEY, "t", "event_id", "key", "next_t", "from_t", "to_t"]
    rows = first.select(*columns).unionByName(later.select(*columns))
    begin = F.greatest("from_t", "t")
    end = F.least("to_t", F.coalesce("next_t", F.col("to_t")))
    return rows.withColumn("begin", begin).withColumn("end", end).where(F.col("end") > F.col("begin"))


def hint_window(changes: DataFrame, windows: DataFrame, expect: list[str]) -> DataFrame:
    held = hint_spans(changes, windows)
    span = F.col("end") - F.col("begin")
    right = F.coalesce(F.col("key").isin(expect), F.lit(False))
    times = held.groupBy(KEY).agg(
        F.sum(F.when(right, span).otherwise(0)).alias("right_ms"),
        F.sum(F.when(~right & F.col("key").isNotNull(), span).otherwise(0)).alias("wrong_ms"),
        F.min(F.when(right, F.col("begin"))).alias("first_right"),
    )
    edge = ordered(changes, [KEY], ["t", "event_id"], SLICE_MS).windowed(windows.select(KEY, "to_t"), "to_t", "to_t", SLICE_MS)
    edge = edge.where(F.col("key").isin(expect) & (F.col("t") == F.col("to_t"))).result()
    at_end = edge.groupBy(KEY).agg(F.min("t").alias("at_end"))
    table = windows.select(KEY, "from_t", "to_t").join(times, KEY, "left").join(at_end, KEY, "left")
    table = table.fillna({"right_ms": 0, "wrong_ms": 0})
    total = F.col("to_t") - F.col("from_t")
    return table.select(
        KEY,
        total.alias("ms"),
        rate(F.col("right_ms"), total).alias("share"),
        rate(F.col("wrong_ms"), total).alias("wrong_share"),
        rate(total - F.col("right_ms") - F.col("wrong_ms"), total).alias("none_share"),
        (F.coalesce("first_right", "at_end") - F.col("from_t")).alias("first_correct_ms"),
    )


def churn(changes: DataFrame, windows: DataFrame) -> DataFrame:
    spans = windows.select(KEY, "from_t", "to_t")
    inside = ordered(changes, [KEY], ["t", "event_id"], SLICE_MS).windowed(spans, "from_t", "to_t", SLICE_MS)
    inside = inside.where(F.col("t").between(F.col("from_t"), F.col("to_t")))
    rows = inside.step(lag={"before": F.col("t")}).result()
    gap = F.col("t") - F.col("before")
    counted = rows.groupBy(KEY).agg(
        F.count("*").alias("changes"),
        F.count_if(gap < FAST_CHANGE_MS).alias("fast_changes"),
        F.min(gap).alias("min_gap_ms"),
    )
    table = windows.select(KEY, "from_t", "to_t").join(counted, KEY, "left")
    table = table.fillna({"changes": 0, "fast_changes": 0})
    seconds = F.greatest(F.lit(0.001), (F.col("to_t") - F.col("from_t")) / 1000.0)
    return table.select(
        KEY, "changes", "fast_changes", "min_gap_ms", (F.col("changes") / seconds).alias("changes_per_second")
    )


def cadence(passes: DataFrame, pauses: DataFrame, width: int = SLICE_MS) -> DataFrame:
    """Intervals between consecutive passes of one source, none of them over a pause."""
    live = passes.where(~F.col("warm_up"))
    rows = series(live).step(lag={"before_t": F.col("t"), "before_source": F.col("source")}).result()
    steps = rows.where(F.col("before_source") == F.col("source")).withColumn("interval", F.col("t") - F.col("before_t"))
    # A pause reaches an interval when it starts before its end and the latest end of the
    # pauses that do so lies after its start: one carried maximum, no pair of the two is formed.
    marks = pauses.select(KEY, F.col("pause_from").alias("t"), F.col("pause_to"))
    both = steps.withColumn("side", F.lit(0)).unionByName(marks.withColumn("side", F.lit(1)), allowMissingColumns=True)
    swept = ordered(both, [KEY], ["t", "side"], width).step(peak={"reach": F.col("pause_to")}).result()
    clear = F.col("reach").isNull() | (F.col("reach") <= F.col("before_t"))
    return swept.where((F.col("side") == 0) & clear).drop("side", "reach", "pause_to")


def cadence_summary(intervals: DataFrame) -> DataFrame:
    by = [KEY, "source"]
    table = intervals.groupBy(*by).agg(
        F.count("*").alias("intervals"),
        F.when(F.avg("interval") != 0, F.stddev_samp("interval") / F.avg("interval")).alias("interval_cv"),
    )
    return with_percentiles(
        table,
        intervals,
        by,
        {"interval": (F.col("interval"), 1.0)},
        [Wanted("interval_p50", "interval", 0.5), Wanted("interval_p95", "interval", 0.95)],
    )


def serial_waits(rows: DataFrame, since: Column, marks: dict[str, Column], keep: list[str]) -> DataFrame:
    """Charge each condition the wait since the one before it (``since`` for the first)."""
    entries = F.array_sort(
        F.filter(
            F.array(*[F.struct(at.cast("bigint").alias("at"), F.lit(n).alias("key")) for n, at in marks.items()]),
            lambda m: m["at"].isNotNull(),
        )
    )
    staged = rows.select(*keep, since.cast("bigint").alias("since"), entries.alias("entries"))
    placed = staged.select(*keep, "since", "entries", F.posexplode("entries").alias("i", "m"))
    before = F.when(F.col("i") == 0, F.col("since")).otherwise(
        F.greatest(F.col("since"), F.get("entries", F.col("i") - 1)["at"])
    )
    wait = F.greatest(F.lit(0), F.col("m.at") - before)
    return placed.select(*keep, F.col("m.key").alias("key"), wait.cast("bigint").alias("ms"))


