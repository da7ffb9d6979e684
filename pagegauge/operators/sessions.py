"""Whole-session scores: passes, performance, guidance, visibility, framing, and their pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.operators.detection import rate
from pagegauge.operators.ordered import asof
from pagegauge.operators.percentiles import LOWER_MIDDLE, Wanted, never, with_percentiles
from pagegauge.operators.timeline import KEY, SLICE_MS, in_window, intervals, series, truth_known

# Session limits.
LONG_TASK_MS = 50.0
GRID_MS = 50
CUE_SILENT_MS = 300
HINT_SPAN_MAX_MS = 400
FRAMING_EXIT, FRAMING_CLEAR = 0.75, 0.03
READY_TARGET_MS = 2500


def pass_summary(passes: DataFrame) -> DataFrame:
    """Per session and source (warm-up apart): page and no-page frames have their own denominators."""
    c = F.col
    key = F.when(c("warm_up"), F.concat("source", F.lit(" warm-up"))).otherwise(c("source"))
    rows = passes.withColumn("source_key", key)
    page, none = c("frame_known") & c("has_page"), c("frame_known") & ~c("has_page")
    by = [KEY, "source_key"]
    table = rows.groupBy(*by).agg(
        F.count("*").alias("passes"),
        F.count_if("ok").alias("answered"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(page).alias("page_passes"),
        F.count_if(none).alias("no_page_passes"),
        F.count_if(~c("frame_known")).alias("unknown_passes"),
        rate(F.count_if(c("accepted") & page & c("off")), F.count_if(c("accepted") & page)).alias("wrong_rate"),
        rate(F.count_if(c("accepted") & none), F.count_if(none)).alias("false_positive_rate"),
    )
    return with_percentiles(
        table,
        rows,
        by,
        {"ms": (c("pass_ms"), 1.0)},
        [Wanted("ms_p50", "ms", 0.5), Wanted("ms_p95", "ms", 0.95)],
    )


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of an aggregate group; null under three points."""
    return F.when(F.count(y) >= 3, F.regr_slope(y, x))


def performance(samples: DataFrame, windows: DataFrame, task_ms: Column, heap: Column) -> DataFrame:
    rows = in_window(samples, windows).result()
    rows = rows.withColumn("task", F.when(task_ms >= LONG_TASK_MS, task_ms)).withColumn("heap", heap)
    minutes = (F.max("to_t") - F.max("from_t")) / 60000.0
    at = F.when(F.col("heap").isNotNull(), F.struct("t", "event_id"))
    return rows.groupBy(KEY).agg(
        F.count("task").alias("long_tasks"),
        (F.count("task") / minutes).alias("long_tasks_per_minute"),
        (F.coalesce(F.sum("task"), F.lit(0.0)) / (F.max("to_t") - F.max("from_t"))).alias("long_task_share"),
        F.max("task").alias("long_task_max"),
        F.min_by("heap", at).alias("heap_start"),
        F.max_by("heap", at).alias("heap_end"),
        F.max("heap").alias("heap_max"),
        slope(F.col("heap"), (F.col("t") - F.col("from_t")) / 60000.0).alias("heap_slope"),
    )


def startup(samples: DataFrame, locks: DataFrame) -> DataFrame:
    """Camera to model (its ready event, else its first pass) and to the first lock."""
    c = F.col
    first = samples.groupBy(KEY).agg(
        F.min("t").alias("camera_t"),
        F.min(F.when(c("is_ready_event"), c("t"))).alias("ready_t"),
        F.min(F.when(c("source") == "ml", c("t"))).alias("ml_t"),
    )
    model = F.coalesce("ready_t", "ml_t")
    named = F.when(c("ready_t").isNotNull(), "ml-ready").when(c("ml_t").isNotNull(), "first ML pass")
    return first.join(locks, KEY, "left").select(
        KEY, (model - c("camera_t")).alias("camera_to_ml_ms"), named.alias("ml_from"), c("time_to_lock_ms").alias("camera_to_lock_ms")
    )


def occlusion_hint_time(samples: DataFrame, changes: DataFrame) -> DataFrame:
    """Time with an unknown or inferred corner or two sheets, and whether the covered-corner hint was right."""
    c = F.col
    rows = series(samples).step(lead={"next_t": c("t")}).result().where(c("next_t").isNotNull())
    rows = asof(rows, changes, [KEY], "t", "t", {"hint": c("key")}, SLICE_MS, tie="event_id")
    span = F.least(c("next_t") - c("t"), F.lit(HINT_SPAN_MAX_MS))
    covered = c("hint") == "corner-covered"

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, span).otherwise(0))

    return rows.groupBy(KEY).agg(
        total(c("unknown")).alias("unknown_ms"),
        total(c("inferred")).alias("inferred_ms"),
        total(c("separate")).alias("separate_ms"),
        total(covered & c("unknown")).alias("covered_hint_right_ms"),
        total(covered & ~c("unknown")).alias("covered_hint_wrong_ms"),
        total(c("hint") == "separate-sheets").alias("separate_hint_ms"),
    )


def ready_cue(samples: DataFrame, windows: DataFrame, eligible: DataFrame) -> DataFrame:
    """How long the ready cue was on, on what, and how much of the time it was owed."""
    from pagegauge.operators.captures import overlap_ms

    c = F.col
    held = intervals(samples, windows)
    span = c("end") - c("begin")
    on = c("ready")
    judged_page = c("frame_known") & c("has_page") & c("shown") & c("judged")
    on_page = on & judged_page & (c("err") <= g.LOCK_TOLERANCE)
    off_page = on & judged_page & (c("err") > g.LOCK_TOLERANCE)
    no_page = on & c("frame_known") & ~c("has_page")

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, span).otherwise(0)).alias(name)

    times = held.groupBy(KEY).agg(
        total(on, "on_ms"),
        total(on & c("countdown").isNotNull(), "countdown_ms"),
        total(on_page, "on_page_ms"),
        total(off_page, "off_page_ms"),
        total(no_page, "no_page_ms"),
    )
    owed = overlap_ms(held.drop("from_t", "to_t"), eligible).groupBy(KEY).agg(
        F.sum("overlap_ms").alias("eligible_ms"),
        F.sum(F.when(on, c("overlap_ms")).otherwise(0)).alias("eligible_on_ms"),
    )
    table = windows.select(KEY).join(times, KEY, "left").join(owed, KEY, "left").fillna(0)
    judged = c("on_page_ms") + c("off_page_ms") + c("no_page_ms")
    return table.select(
        "*",
        judged.alias("judged_ms"),
        rate(c("on_page_ms"), judged).alias("precision"),
        rate(c("eligible_on_ms"), c("eligible_ms")).alias("recall"),
    )


def grid(holds: DataFrame) -> DataFrame:
    """A moment every 50 ms of each hold."""
    steps = F.sequence("from_t", F.col("to_t") - 1, F.lit(GRID_MS).cast("bigint"))
    return holds.where("to_t > from_t").select(KEY, "name", F.explode(steps).alias("t"))


def visibility(holds: DataFrame, samples: DataFrame, changes: DataFrame, visible: Column, clear: Column) -> DataFrame:
    """Per hold: time the page was in sight or not, and the move-back hints that were and were not owed."""
    c = F.col
    marks = samples.select(
        KEY, "event_id", "t", (c("frame_known") & c("has_page")).alias("known"), visible.alias("visible"), clear.alias("clear"),
        "ready",
    )
    names = ("known", "visible", "clear", "ready")
    payload = {n: c(n) for n in names} | {"seen_t": c("t")}
    rows = asof(grid(holds), marks, [KEY], "t", "t", payload, SLICE_MS, tie="event_id")
    rows = asof(rows, changes, [KEY], "t", "t", {"hint": c("key")}, SLICE_MS, tie="event_id")
    known = F.coalesce(c("known"), F.lit(False))
    back = F.coalesce(c("hint") == "move-back", F.lit(False))

    def total(condition: Column, name: str) -> Column:
        return (F.count_if(condition) * GRID_MS).alias(name)

    table = rows.groupBy(KEY, "name").agg(
        (F.count("*") * GRID_MS).alias("ms"),
        total(c("ready") & (c("t") - c("seen_t") <= CUE_SILENT_MS), "ready_ms"),
        total(~known, "unknown_ms"),
        total(known & c("visible"), "visible_ms"),
        total(known & ~c("visible"), "hidden_ms"),
        total(known & c("visible") & c("clear"), "clear_ms"),
        total(known & c("visible") & c("clear") & back, "move_back_false_ms"),
        total(known & ~c("visible") & back, "move_back_right_ms"),
    )
    share = rate(c("visible_ms"), c("visible_ms") + c("hidden_ms"))
    false_share = rate(c("move_back_false_ms"), c("clear_ms"))
    return table.select("*", share.alias("visible_share"), false_share.alias("move_back_false_share"))


def framing(holds: DataFrame, samples: DataFrame, changes: DataFrame, fill: Column) -> DataFrame:
    """Per hold: how close the page was held, and how long it was asked to be closer or further."""
    c = F.col
    known = c("frame_known") & c("has_page")
    marks = samples.select(KEY, "event_id", "t", F.when(known, fill).alias("fill"))
    rows = asof(grid(holds), marks, [KEY], "t", "t", {"fill": c("fill")}, SLICE_MS, tie="event_id")
    rows = asof(rows, changes, [KEY], "t", "t", {"hint": c("key")}, SLICE_MS, tie="event_id")
    closer = c("hint") == "move-closer"
    wrong = closer & F.coalesce(c("fill") >= FRAMING_EXIT + FRAMING_CLEAR, F.lit(False))

    def total(condition: Column, name: str) -> Column:
        return (F.count_if(condition) * GRID_MS).alias(name)

    return rows.groupBy(KEY, "name").agg(
        F.min_by("fill", "t").alias("fill_at_start"),
        (F.count("*") * GRID_MS).alias("ms"),
        total(closer, "closer_ms"),
        total(wrong, "closer_wrong_ms"),
        total(c("hint") == "move-back", "move_back_ms"),
        total(c("hint").isNotNull() & ~c("hint").isin("move-closer", "move-back"), "other_ms"),
    )


def framing_cells(holds: DataFrame, by: list[str]) -> DataFrame:
    """Per cell: share that got ready and how soon; a hold that never did is after every other."""
    c = F.col
    table = holds.groupBy(*by).agg(
        F.count("*").alias("holds"),
        rate(F.count("ready_ms"), F.count("*")).alias("ready_share"),
        rate(F.count_if(c("ready_ms") <= READY_TARGET_MS), F.count("*")).alias("within_target"),
        F.avg("changes").alias("changes"),
    )
    return with_percentiles(
        table,
        holds,
        by,
        {"ready": (never(c("ready_ms")), 1.0)},
        [Wanted("ready_p50", "ready", 0.5, LOWER_MIDDLE), Wanted("ready_p90", "ready", 0.9)],
    )


def push_rate(pushes: DataFrame) -> DataFrame:
    span = F.max("t") - F.min("t")
    return pushes.groupBy(KEY).agg(
        F.count("*").alias("pushed"), F.when(span > 0, (F.count("*") - 1) * 1000 / span).alias("fps")
    )


def capture_detects(samples: DataFrame) -> DataFrame:
    """Detections made at a capture: how many fell through to the classical one, how many were downgraded."""
    c = F.col
    first_ml = samples.groupBy(KEY).agg(F.min(F.when(c("source") == "ml", c("t"))).alias("first_ml"))
    rows = series(samples.where("is_capture_detect")).windowed(first_ml).result()
    ml_before = F.coalesce(c("first_ml") < c("t"), F.lit(False))
    fell = F.coalesce(c("fell_through"), (c("source") == "classical") & ml_before)
    return rows.groupBy(KEY).agg(
        F.count("*").alias("detects"),
        F.count_if(fell).alias("fall_through"),
        F.when(F.count("ml_skipped") > 0, F.count_if(c("ml_skipped") == "busy")).alias("downgraded"),
    )


