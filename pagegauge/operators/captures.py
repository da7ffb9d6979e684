"""Captures stitched to what followed them, and joined to the image they made a page of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.operators.detection import rate
from pagegauge.operators.ordered import asof, asof_ordered, interval_join, ordered
from pagegauge.operators.percentiles import Wanted, with_percentiles
from pagegauge.operators.timeline import KEY, SLICE_MS

# Capture outcomes and limits.
PAGELESS_CAPTURE = "page-less capture"
UNSCORED_CAPTURE = "unscored"
NEVER_OPENED = "confirm never opened"
SHUTTER_EXPOSE_MS = 150


def frame_on_screen(at: DataFrame, presented: DataFrame, pushed: DataFrame, frame_interval: int) -> DataFrame:
    """The frame on screen at each moment: the last presentation at or before it.

    A session with no presentation log at all falls back to the last push at least one frame
    interval earlier. ``frame_known`` is false where neither names a frame.
    """
    shown = asof(at, presented, [KEY], "t", "t", {"shown_k": F.col("k")}, SLICE_MS, tie="k")
    due = pushed.withColumn("due", F.col("t") + frame_interval)
    both = asof_ordered(shown, due, [KEY], "t", "due", {"pushed_k": F.col("k")}, SLICE_MS, tie="k")
    logged = presented.select(KEY).distinct().withColumn("__logged", F.lit(True))
    both = both.windowed(logged, how="left").result()
    k = F.when(F.col("__logged"), F.col("shown_k")).otherwise(F.col("pushed_k"))
    out = both.withColumn("frame_k", k).drop("shown_k", "pushed_k", "__logged")
    return out.withColumn("frame_known", F.col("frame_k").isNotNull())


def in_force(at: DataFrame, marks: DataFrame, value: str, default: Column) -> DataFrame:
    """The value in force at each moment; before a session's first mark its first one, else ``default``."""
    found = asof_ordered(at, marks, [KEY], "t", "t", {"__value": F.col(value)}, SLICE_MS, tie="event_id")
    first = marks.groupBy(KEY).agg(F.min_by(F.col(value), F.struct("t", "event_id")).alias("__first"))
    joined = found.windowed(first, how="left").result()
    return joined.withColumn(value, F.coalesce("__value", "__first", default)).drop("__value", "__first")


def stitch(log: DataFrame) -> DataFrame:
    """Each capture with the confirm screen it opened, how that ended and the last refinement before.

    A confirm-open belongs to the last capture at or before it, a confirm-done to that opening;
    nothing after the next capture counts.
    """
    kind = F.col("kind")
    # No other row bears on a capture, and once openings hold what ended them only captures look ahead.
    log = log.where(kind.isin("capture", "confirm-open", "confirm-done") | F.col("is_refine"))
    rows = ordered(log, [KEY], ["t", "event_id"], SLICE_MS).step(
        ahead={
            "done": F.when(kind == "confirm-done", F.struct("t", "event_id")),
            "capture_at": F.when(kind == "capture", F.col("t")),
        },
        fill={"refine_at": F.when(F.col("is_refine"), F.col("t"))},
    )
    opening = F.struct(
        F.col("t"), F.col("event_id"), F.col("done.t").alias("done_t"), F.col("refine_at").alias("refine_t")
    )
    rows = rows.where(kind.isin("capture", "confirm-open")).step(
        ahead={"open": F.when(kind == "confirm-open", opening)}, lead={"next_t": F.col("capture_at")}
    )
    last_refine = log.where("is_refine").groupBy(KEY).agg(F.max("t").alias("__last_refine"))
    captures = rows.where(kind == "capture").windowed(last_refine, how="left").result()
    before_next = F.col("next_t").isNull() | (F.col("open.t") < F.col("next_t"))
    opened = F.when(before_next, F.col("open.t"))
    done = F.when(
        opened.isNotNull() & (F.col("next_t").isNull() | (F.col("open.done_t") < F.col("next_t"))), F.col("open.done_t")
    )
    refined = F.when(opened.isNotNull(), F.col("open.refine_t")).otherwise(F.col("__last_refine"))
    return captures.select(
        KEY,
        "event_id",
        "t",
        "k",
        "value",
        "next_t",
        opened.alias("open_t"),
        F.when(opened.isNotNull(), F.col("open.event_id")).alias("open_id"),
        done.alias("done_t"),
        F.when(refined >= F.col("t"), refined).alias("refine_t"),
    )


def image_of(captures: DataFrame, stills: DataFrame, grabs: DataFrame) -> DataFrame:
    """The image a capture made its page of, by the ids it carried; never by time.

    ``stills`` and ``grabs`` are ``image_id, width``. No match is ``known = false``.
    """
    s = stills.select(F.col("image_id").alias("still_id"), F.col("width").alias("__still_width"))
    p = grabs.select(F.col("image_id").alias("grab_id"), F.col("width").alias("__grab_width"))
    both = captures.join(s, "still_id", "left").join(p, "grab_id", "left")
    width = F.when(F.col("still_used"), F.col("__still_width")).otherwise(F.col("__grab_width"))
    image = F.when(F.col("still_used"), F.col("still_id")).otherwise(F.col("grab_id"))
    out = both.withColumn("width", width).withColumn("known", F.col("width").isNotNull())
    source = F.when(F.col("still_used"), F.when(F.col("known"), "still").otherwise("still (unidentified)")).otherwise(
        F.when(F.col("known"), "preview frame").otherwise("preview frame (unidentified)")
    )
    return (
        out.withColumn("image_id", F.when(F.col("known"), image))
        .withColumn("image_source", source)
        .drop("__still_width", "__grab_width")
    )


def capture_verdict(opened: Column, known: Column, has_page: Column, has_corners: Column, wrong: Column) -> Column:
    """The proposal's outcome; an image nobody can name is unscored, never good."""
    return (
        F.when(~opened, NEVER_OPENED)
        .when(~known, UNSCORED_CAPTURE)
        .when(has_page & has_corners, F.when(wrong, "wrong").otherwise("good"))
        .when(has_page, "no corners")
        .when(has_corners, "false positive")
        .otherwise(PAGELESS_CAPTURE)
    )


def crop_verdict(opened: Column, known: Column, has_page: Column, has_corners: Column, wrong: Column) -> Column:
    """A shown or final crop: any crop of an image with no page is a page-less capture."""
    return (
        F.when(~opened, NEVER_OPENED)
        .when(~known, UNSCORED_CAPTURE)
        .when(~has_page, PAGELESS_CAPTURE)
        .when(~has_corners, "no corners")
        .otherwise(F.when(wrong, "wrong").otherwise("good"))
    )


def latency_summary(stitched: DataFrame, by: list[str]) -> DataFrame:
    ms = F.col("open_t") - F.col("t")
    table = stitched.groupBy(*by).agg(
        F.count("*").alias("captures"),
        F.count("open_t").alias("opened"),
        F.count("done_t").alias("confirmed"),
        rate(F.count("open_t"), F.count("*")).alias("opened_rate"),
        F.avg(ms).alias("latency_mean"),
    )
    return with_percentiles(
        table,
        stitched,
        by,
        {"latency": (ms, 1.0)},
        [Wanted("latency_p50", "latency", 0.5), Wanted("latency_p95", "latency", 0.95)],
    )


def overlap_ms(spans: DataFrame, windows: DataFrame, width: int = SLICE_MS) -> DataFrame:
    """Pairs of a session's spans (``begin``, ``end``) and windows (``from_t``, ``to_t``) that overlap."""
    meets = (F.col("begin") < F.col("to_t")) & (F.col("end") > F.col("from_t"))
    pairs = interval_join(spans, windows, [KEY], ("begin", "end"), ("from_t", "to_t"), width, meets)
    return pairs.withColumn("overlap_ms", F.least("end", "to_t") - F.greatest("begin", "from_t"))


def inside_windows(taps: DataFrame, windows: DataFrame, names: list[str], width: int = SLICE_MS) -> DataFrame:
    """A column per named window: does a moment lie in one of that name (ends included)?"""
    points = taps.withColumn("__t2", F.col("t"))
    hit = (F.col("t") >= F.col("from_t")) & (F.col("t") <= F.col("to_t"))
    pairs = interval_join(points, windows, [KEY], ("t", "__t2"), ("from_t", "to_t"), width, hit)
    flags = pairs.groupBy(KEY, "event_id").agg(*[F.bool_or(F.col("name") == n).alias(f"in_{n}") for n in names])
    return taps.join(flags, [KEY, "event_id"], "left").fillna({f"in_{n}": False for n in names})


def shutter_scene(taps: DataFrame, frames: DataFrame, move: Column) -> DataFrame:
    """What the camera saw from a shutter call through the exposure: page whole throughout, and its motion.

    Starts at the last frame at or before the tap; ``move`` compares ``x0, y0`` of a frame with
    ``first_x, first_y`` of that one.
    """
    start = asof(
        taps,
        frames,
        [KEY],
        "t",
        "t",
        {"first_t": F.col("t"), "first_x": F.col("x0"), "first_y": F.col("y0")},
        SLICE_MS,
        tie="event_id",
    ).where(F.col("first_t").isNotNull())
    spans = start.select(
        KEY, F.col("event_id").alias("tap_id"), "first_t", "first_x", "first_y", (F.col("t") + SHUTTER_EXPOSE_MS).alias("upto")
    )
    seen = frames.select(KEY, F.col("t").alias("frame_t"), F.col("t").alias("frame_t2"), "x0", "y0", "whole")
    hit = (F.col("frame_t") >= F.col("first_t")) & (F.col("frame_t") <= F.col("upto"))
    pairs = interval_join(spans, seen, [KEY], ("first_t", "upto"), ("frame_t", "frame_t2"), SLICE_MS, hit)
    return pairs.groupBy(KEY, "tap_id").agg(
        F.bool_and("whole").alias("whole"), F.max(move).alias("motion"), F.count("*").alias("frames")
    )
