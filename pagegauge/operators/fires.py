"""Automatic captures against everything the script said about their moment.

One sweep over the ends of all windows, the marks and the fires of a session: each kind of window
keeps a running count of those open, so a fire knows how many of each it lies in, whatever their
number and overlap, and no fire is paired with a window. The sweep runs in slices of the time axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators.ordered import ordered
from pagegauge.operators.percentiles import Wanted, with_percentiles
from pagegauge.operators.timeline import KEY, SLICE_MS

# Kinds of window a capture is not owed or allowed in, and motion at the shutter.
KINDS = ("tremor", "no_fire", "hint")
SHUTTER_MOTION_MAX = 0.015

COUNTS = [
    "fires", "false_fires", "fires_in_tremor", "fires_in_no_fire", "fires_in_hint", "fires_uncertain", "fires_unverified",
    "fires_moving", "fires_cut", "fires_unsafe", "fires_on_covered", "pages_fired", "repeat_fires",
]


def swept(fires: DataFrame, windows: DataFrame, marks: DataFrame, width: int = SLICE_MS) -> DataFrame:
    """Fires with the number of open windows of each kind, both ends included, and the marks in force.

    ``windows`` is ``session_id, kind, from_t, to_t`` (``ready`` windows say when a page was
    presented); ``marks`` is ``session_id, event_id, kind, t, page`` of kinds ``stable`` and ``page``.
    A window that ends before it starts, or lacks an end, holds nothing. Before the first page mark
    the page is 0; without a stable mark or a presentation that moment is null.
    """
    c = F.col
    spans = windows.where(c("from_t") <= c("to_t"))
    opened = F.struct(c("from_t").cast("bigint").alias("t"), F.lit(0).alias("side"), F.lit(1).alias("step"))
    closed = F.struct(c("to_t").cast("bigint").alias("t"), F.lit(2).alias("side"), F.lit(-1).alias("step"))
    ends = spans.select(KEY, "kind", F.explode(F.array(opened, closed)).alias("e")).select(KEY, "kind", "e.*")
    points = marks.select(
        KEY, "event_id", "kind", c("t").cast("bigint").alias("t"), "page", F.lit(0).alias("side"), F.lit(0).alias("step")
    )
    taps = fires.select(
        KEY,
        "event_id",
        c("t").cast("bigint").alias("t"),
        F.lit(1).alias("side"),
        F.lit(0).alias("step"),
        F.struct("false_fire", "pageless", "covered").alias("fire"),
    )
    rows = ends.unionByName(points, allowMissingColumns=True).unionByName(taps, allowMissingColumns=True)
    kind, starts = c("kind"), c("side") == 0
    line = ordered(rows.where(c("t").isNotNull()), [KEY], ["t", "side", "event_id"], width).step(
        running={f"in_{k}": F.when(kind == k, c("step")).otherwise(0) for k in KINDS},
        fill={
            "stable_t": F.when(kind == "stable", c("t")),
            "presented_t": F.when((kind == "ready") & starts, c("t")),
            "page_now": F.when(kind == "page", c("page")),
        },
    )
    return line.where(c("fire").isNotNull()).result().select(
        KEY,
        "event_id",
        "t",
        "fire.*",
        *[c(f"in_{k}").cast("bigint").alias(f"in_{k}") for k in KINDS],
        F.coalesce(c("page_now"), F.lit(0)).cast("bigint").alias("page"),
        (c("t") - c("stable_t")).alias("latency_ms"),
        (c("t") - c("presented_t")).alias("from_presented_ms"),
    )


def audit_fires(
    fires: DataFrame, windows: DataFrame, marks: DataFrame, probes: DataFrame, scenes: DataFrame, width: int = SLICE_MS
) -> DataFrame:
    """One row per fire: its windows, page, latencies, corners, motion, and whether it was unsafe.

    ``fires`` is ``session_id, event_id, t, false_fire, pageless, covered``; ``probes`` holds
    ``uncertain`` (null: not measured) and ``scenes`` ``motion, whole`` by ``session_id, event_id``.
    A fire without a probe is unverified, hence unsafe; without a scene it neither moved nor was cut.
    """
    c = F.col
    by = [KEY, "event_id"]
    rows = swept(fires, windows, marks, width)
    rows = rows.join(probes.select(*by, "uncertain"), by, "left").join(scenes.select(*by, "motion", "whole"), by, "left")
    moving = F.coalesce(c("motion") > SHUTTER_MOTION_MAX, F.lit(False))
    cut = F.coalesce(~c("whole"), F.lit(False))
    false_fire = F.coalesce(c("false_fire"), F.lit(False)) | F.coalesce(c("pageless"), F.lit(False))
    unverified = F.coalesce(c("uncertain"), F.lit(True))
    rows = rows.select(
        *[n for n in rows.columns if n not in ("false_fire", "motion", "whole")],
        false_fire.alias("false_fire"),
        unverified.alias("unverified"),
        moving.alias("moving"),
        cut.alias("cut"),
    )
    breach = (c("in_no_fire") > 0) | (c("in_tremor") > 0) | c("moving") | c("cut") | c("unverified")
    return rows.select("*", (breach | F.coalesce(c("pageless"), F.lit(False))).alias("unsafe")).drop("pageless")


def fire_summary(audit: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session, those without a fire too: how many broke each rule, pages taken, repeats, latency p50.

    Fires are summed per page first, so a session of many fires is added up in parts.
    """
    c = F.col
    flags = {
        "false_fires": c("false_fire"),
        "fires_in_tremor": c("in_tremor") > 0,
        "fires_in_no_fire": c("in_no_fire") > 0,
        "fires_in_hint": c("in_hint") > 0,
        "fires_uncertain": F.coalesce(c("uncertain"), F.lit(False)),
        "fires_unverified": c("unverified"),
        "fires_moving": c("moving"),
        "fires_cut": c("cut"),
        "fires_unsafe": c("unsafe"),
        "fires_on_covered": F.coalesce(c("covered"), F.lit(False)),
    }
    pages = audit.groupBy(KEY, "page").agg(
        F.count("*").alias("fires"),
        *[F.count_if(v).alias(n) for n, v in flags.items()],
        F.count_if(~c("false_fire")).alias("true_fires"),
    )
    totals = pages.groupBy(KEY).agg(
        *[F.sum(n).alias(n) for n in ("fires", *flags)],
        F.count_if(c("true_fires") > 0).alias("pages_fired"),
        F.sum(c("fires") - 1).alias("repeat_fires"),
    )
    table = sessions.select(KEY).join(totals, KEY, "left").fillna(0, COUNTS)
    wanted = [Wanted("latency_p50", "latency", 0.5), Wanted("presented_p50", "presented", 0.5)]
    metrics = {"latency": (c("latency_ms"), 10.0), "presented": (c("from_presented_ms"), 10.0)}
    return with_percentiles(table, audit, [KEY], metrics, wanted).select(KEY, *COUNTS, "latency_p50", "presented_p50")
