"""Viewfinder series as time: samples hold until the next one, and no longer than the gap limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.operators.detection import rate
from pagegauge.operators.ordered import SLICE, Ordered, ordered
from pagegauge.operators.percentiles import WEIGHTED, Wanted, with_percentiles

# The timeline rules.
MAX_SAMPLE_GAP_MS = 250
LOCK_HOLD_MS = 300
FALSE_LOCK_MIN_MS = 300
MAX_UNOBSERVED_SHARE = 0.2
PAPER_LOCK_SAME_SHEET = 0.08
SLICE_MS = 60_000
KEY = "session_id"


def truth_known() -> Column:
    """A sample whose shown quad can be judged: known frame, a page on it, a corner in view."""
    return F.col("frame_known") & F.col("has_page") & F.col("judged")


def within(tolerance: float = g.LOCK_TOLERANCE) -> Column:
    return F.coalesce(F.col("shown") & truth_known() & (F.col("err") <= tolerance), F.lit(False))


def series(samples: DataFrame, width: int = SLICE_MS) -> Ordered:
    return ordered(samples, [KEY], ["t", "event_id"], width)


def intervals(
    samples: DataFrame, windows: DataFrame, max_gap: int = MAX_SAMPLE_GAP_MS, width: int = SLICE_MS
) -> DataFrame:
    """One row per sample that holds for some of its session's window: ``begin``, ``end``."""
    held = series(samples, width).step(lead={"next_t": F.col("t")})
    spans = windows.select(KEY, "from_t", "to_t")
    end = F.least(F.col("to_t"), F.coalesce(F.col("next_t"), F.col("to_t")), F.col("t") + max_gap)
    return (
        held.windowed(spans, "from_t", "to_t", width, reach=max_gap)
        .result()
        .withColumn("begin", F.greatest("from_t", "t"))
        .withColumn("end", end)
        .where(F.col("end") > F.col("begin"))
        .drop("next_t")
    )


def observed(held: DataFrame, windows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per window: ``observed_ms``, ``unobserved_ms`` and the milliseconds meeting each condition."""
    span = F.col("end") - F.col("begin")
    totals = held.groupBy(KEY).agg(
        F.sum(span).alias("observed_ms"),
        *[F.sum(F.when(c, span).otherwise(0)).alias(n) for n, c in sums.items()],
    )
    out = windows.select(KEY, "from_t", "to_t").join(totals, KEY, "left")
    zero = {n: 0 for n in ["observed_ms", *sums]}
    out = out.fillna(zero)
    gap = F.greatest(F.lit(0), F.col("to_t") - F.col("from_t") - F.col("observed_ms"))
    return out.withColumn("unobserved_ms", gap)


def overlay_classes() -> dict[str, Column]:
    shown, known, page = F.col("shown"), F.col("frame_known"), F.col("has_page")
    judged = shown & known & page & F.col("judged")
    err = F.col("err")
    return {
        "none_ms": ~shown,
        "unknown_ms": shown & ~known,
        "on_nothing_ms": shown & known & ~page,
        "unjudged_ms": shown & known & page & ~F.col("judged"),
        "locked_ms": judged & (err <= g.LOCK_TOLERANCE),
        "near_ms": judged & (err > g.LOCK_TOLERANCE) & (err <= g.WRONG_CROP_MAX_CORNER_ERROR),
        "wrong_ms": judged & (err > g.WRONG_CROP_MAX_CORNER_ERROR),
    }


def overlay_accuracy(samples: DataFrame, windows: DataFrame, max_gap: int = MAX_SAMPLE_GAP_MS) -> DataFrame:
    """Time-weighted shares of what the overlay showed; time on an unnamed frame is unobserved."""
    held = intervals(samples, windows, max_gap)
    table = observed(held, windows, overlay_classes())
    scored = F.col("observed_ms") - F.col("unknown_ms")
    shares = [
        rate(F.col(f"{n}_ms"), scored).alias(f"{n}_share")
        for n in ("none", "locked", "near", "wrong", "on_nothing", "unjudged")
    ]
    table = table.select(
        KEY,
        scored.alias("observed_ms"),
        (F.col("unobserved_ms") + F.col("unknown_ms")).alias("unobserved_ms"),
        *shares,
    )
    judged = held.where(F.col("shown") & truth_known())
    return with_percentiles(
        table,
        judged,
        [KEY],
        {"err": (F.col("err"), 1e-3)},
        [Wanted("error_p50", "err", 0.5, WEIGHTED), Wanted("error_p95", "err", 0.95, WEIGHTED)],
        weight=F.col("end") - F.col("begin"),
    )


def false_lock_exposure(samples: DataFrame, windows: DataFrame) -> DataFrame:
    table = observed(intervals(samples, windows), windows, {"shown_ms": F.col("shown")})
    share = rate(F.col("shown_ms"), F.col("observed_ms"))
    return table.select(KEY, "shown_ms", "observed_ms", "unobserved_ms", share.alias("share"))


def runs(rows: Ordered, on: Column, max_gap: int | None) -> Ordered:
    """Islands of consecutive rows with ``on``: adds ``on`` and ``run_start`` (null off a run).

    A gap over ``max_gap`` ends a run: nobody saw it hold.
    """
    marked = rows.with_column("on", on).step(lag={"__was": F.col("on"), "__was_t": F.col("t")})
    fresh = F.col("__was").isNull() | ~F.col("__was")
    if max_gap is not None:
        fresh = fresh | (F.col("t") - F.col("__was_t") > max_gap)
    starts = F.when(F.col("on") & fresh, F.col("t"))
    out = marked.step(fill={"__start": starts}).with_column("run_start", F.when(F.col("on"), F.col("__start")))
    return Ordered(out.df.drop("__was", "__was_t", "__start"), out.keys, out.order)


def in_window(samples: DataFrame, windows: DataFrame, upto: bool = True, width: int = SLICE_MS) -> Ordered:
    spans = windows.select(KEY, "from_t", "to_t")
    rows = series(samples, width).windowed(spans, "from_t", "to_t" if upto else None, width).where(F.col("t") >= F.col("from_t"))
    return rows.where(F.col("t") <= F.col("to_t")) if upto else rows


def time_to_lock(samples: DataFrame, windows: DataFrame, hold: int = LOCK_HOLD_MS) -> DataFrame:
    rows = runs(in_window(samples, windows, upto=False), within(), MAX_SAMPLE_GAP_MS).result()
    held = rows.where(F.col("on") & (F.col("t") - F.col("run_start") >= hold))
    locks = held.groupBy(KEY).agg(F.min(F.col("run_start") - F.col("from_t")).alias("time_to_lock_ms"))
    return windows.select(KEY).join(locks, KEY, "left")


def false_locks_per_minute(samples: DataFrame, windows: DataFrame, hold: int = FALSE_LOCK_MIN_MS) -> DataFrame:
    rows = runs(in_window(samples, windows), F.col("shown"), MAX_SAMPLE_GAP_MS).result()
    lasting = rows.where(F.col("on")).groupBy(KEY, "run_start").agg(F.max("t").alias("last_t"))
    locks = (
        lasting.where(F.col("last_t") - F.col("run_start") >= hold).groupBy(KEY).agg(F.count("*").alias("locks"))
    )
    table = windows.select(KEY, "from_t", "to_t").join(locks, KEY, "left").fillna({"locks": 0})
    minutes = (F.col("to_t") - F.col("from_t")) / 60000.0
    return table.select(KEY, "locks", F.when(minutes > 0, F.col("locks") / minutes).alias("per_minute"))


def stale_after_swap(samples: DataFrame, windows: DataFrame, on_old: Column, max_gap: int) -> DataFrame:
    """How long after ``from_t`` the overlay kept sitting on the page that left, if that was seen."""
    seen = observed(intervals(samples, windows, max_gap), windows, {})
    rows = in_window(samples, windows).step(lead={"next_t": F.col("t")}).result()
    facts = rows.withColumn("on", on_old).groupBy(KEY).agg(
        F.max("t").alias("last_seen"),
        F.max(F.when(F.col("on"), F.col("t"))).alias("last_on"),
        F.max_by("next_t", F.when(F.col("on"), F.col("t"))).alias("left_at"),
    )
    table = seen.join(facts, KEY, "left")
    unseen = F.col("last_seen").isNull() | (F.col("unobserved_ms") > 0)
    outcome = (
        F.when(unseen, "unobserved")
        .when(F.col("last_on").isNull(), "never-on")
        .when(F.col("last_on") == F.col("last_seen"), "stuck")
        .otherwise("left")
    )
    ms = F.when(F.col("outcome") == "never-on", F.lit(0)).when(
        F.col("outcome") == "left", F.col("left_at") - F.col("from_t")
    )
    return table.withColumn("outcome", outcome).select(KEY, "outcome", ms.cast("bigint").alias("ms"))


def paper_lock(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Locked, exact and wrong time of the lock cue; dropouts and unlocked time once it first locked."""
    live = samples.where(~F.col("capturing"))
    held = F.col("locked") & F.col("shown")
    page = held & truth_known() & (F.col("err") <= PAPER_LOCK_SAME_SHEET)
    marked = live.select(
        KEY,
        "event_id",
        "t",
        page.alias("on_page"),
        (page & (F.col("err") <= g.WRONG_CROP_MAX_CORNER_ERROR)).alias("exact"),
        (held & ~page).alias("off_page"),
    )
    spans = intervals(marked, windows)
    table = observed(
        spans,
        windows,
        {"locked_ms": F.col("on_page"), "exact_ms": F.col("exact"), "wrong_lock_ms": F.col("off_page")},
    )
    first = spans.where("on_page").groupBy(KEY).agg(F.min("begin").alias("first_lock"))
    after = (
        ordered(spans, [KEY], ["begin", "event_id"], SLICE_MS)
        .windowed(first, "first_lock", None, SLICE_MS, reach=MAX_SAMPLE_GAP_MS)
        .where(F.col("end") > F.col("first_lock"))
        .step(lag={"was": F.col("on_page")})
        .result()
    )
    span = F.col("end") - F.greatest("begin", "first_lock")
    steady = after.groupBy(KEY).agg(
        F.count_if(F.col("was") & ~F.col("on_page")).alias("dropouts"),
        F.sum(F.when(F.col("on_page"), span).otherwise(0)).alias("locked_steady_ms"),
    )
    table = table.join(first, KEY, "left").join(steady, KEY, "left")
    window = F.col("to_t") - F.col("from_t")
    steady_ms = F.coalesce(F.col("to_t") - F.col("first_lock"), F.lit(0))
    return table.select(
        KEY,
        window.alias("window_ms"),
        "observed_ms",
        "unobserved_ms",
        "locked_ms",
        "exact_ms",
        "wrong_lock_ms",
        rate(F.col("locked_ms"), window).alias("locked_share"),
        (F.col("first_lock") - F.col("from_t")).alias("first_lock_ms"),
        F.coalesce("dropouts", F.lit(0)).alias("dropouts"),
        steady_ms.alias("steady_ms"),
        (steady_ms - F.coalesce("locked_steady_ms", F.lit(0))).alias("steady_unlocked_ms"),
    )


def chained_runs(spans: DataFrame, on: Column, contiguous: bool) -> DataFrame:
    """Per session: number of runs of intervals with ``on``, their total and the longest one.

    ``contiguous`` also ends a run where one interval does not begin as the last one ended.
    """
    rows = ordered(spans.withColumn("on", on), [KEY], ["begin", "event_id"], SLICE_MS)
    rows = rows.step(lag={"was": F.col("on"), "was_end": F.col("end")})
    fresh = F.col("was").isNull() | ~F.col("was")
    if contiguous:
        fresh = fresh | (F.col("was_end") != F.col("begin"))
    rows = rows.step(fill={"run": F.when(F.col("on") & fresh, F.col("begin"))}).result()
    lengths = rows.where("on").groupBy(KEY, "run").agg(F.sum(F.col("end") - F.col("begin")).alias("ms"))
    return lengths.groupBy(KEY).agg(
        F.count("*").alias("runs"), F.sum("ms").alias("total_ms"), F.max("ms").alias("longest_ms")
    )


def static_jitter(readings: DataFrame, windows: DataFrame, width: float, height: float) -> DataFrame:
    """Spread of the shown corners about their own mean, and the mean step, over the diagonal."""
    shown = in_window(readings.where("shown"), windows)
    coordinates = {}
    for i in range(4):
        p = g.corner(F.col("quad"), i)
        coordinates[f"x{i}"] = p["x"] * width
        coordinates[f"y{i}"] = p["y"] * height
    flat = shown.df.select(*shown.keys, SLICE, "t", "event_id", *[c.alias(n) for n, c in coordinates.items()])
    rows = Ordered(flat, shown.keys, shown.order).step(lag={f"was_{n}": F.col(n) for n in coordinates}).result()
    moved = None
    for i in range(4):
        dx, dy = F.col(f"x{i}") - F.col(f"was_x{i}"), F.col(f"y{i}") - F.col(f"was_y{i}")
        one = F.sqrt(dx * dx + dy * dy)
        moved = one if moved is None else moved + one
    spread = None
    for n in coordinates:
        spread = F.var_pop(n) if spread is None else spread + F.var_pop(n)
    diagonal = float((width * width + height * height) ** 0.5)
    table = rows.withColumn("moved", moved).groupBy(KEY).agg(
        F.count("*").alias("samples"),
        (F.sqrt(spread / 4) / diagonal).alias("rms"),
        (F.sum("moved") / ((F.count("*") - 1) * 4) / diagonal).alias("mean_step"),
    )
    return table.where(F.col("samples") >= 2)
