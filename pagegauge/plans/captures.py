"""As-of, interval and capture queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import captures as c
from pagegauge.operators import timeline as tl
from pagegauge.operators.detection import rate
from pagegauge.operators.ordered import asof
from pagegauge.plans import bindings as b
from pagegauge.plans import sequences as seq
from pagegauge.plans.detection import rounded, sql_pct, sql_rate
from pagegauge.plans.registry import Tables, query, view
from pagegauge.session import written_once

# ── as-of ────────────────────────────────────────────────────────────────────


def moments(t: Tables) -> DataFrame:
    return b.clocked(t).select("session_id", "event_id", "event_type", "k", "t")


def asof_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = moments(t)
    # Sessions divisible by ten presented under another name: their own log names no frame.
    logged = F.expr("CASE WHEN session_id % 10 = 0 THEN -1 - session_id ELSE session_id END")
    presented = rows.where("event_type = 'view'").select(logged.alias("session_id"), F.col("event_id").alias("k"), "t")
    pushed = rows.where("event_type = 'click'").select("session_id", F.col("event_id").alias("k"), "t")
    return rows, presented, pushed


view(
    "fx_on_screen",
    """
    WITH shown AS (SELECT CASE WHEN session_id % 10 = 0 THEN -1 - session_id ELSE session_id END AS session_id, event_id, t
                   FROM fx_samples WHERE event_type = 'view')
    SELECT a.session_id, a.event_id, a.t, CASE WHEN l.session_id IS NOT NULL THEN p.event_id ELSE q.event_id END AS frame_k
    FROM fx_samples a
    ASOF LEFT JOIN shown p
      ON a.session_id = p.session_id AND a.t >= p.t
    ASOF LEFT JOIN (SELECT *, t + 33 AS due FROM fx_samples WHERE event_type = 'click') q
      ON a.session_id = q.session_id AND a.t >= q.due
    LEFT JOIN (SELECT DISTINCT session_id FROM shown) l ON l.session_id = a.session_id
    """,
)


@query("asof_frame", "SELECT session_id, event_id, frame_k, frame_k IS NOT NULL AS frame_known FROM fx_on_screen")
def asof_frame(t: Tables) -> DataFrame:
    rows, presented, pushed = asof_parts(t)
    found = c.frame_on_screen(rows, presented, pushed, 33)
    return found.select("session_id", "event_id", "frame_k", "frame_known")


def _sql_in_force(value: str, marks: str, default: str, at: str = "fx_samples") -> str:
    return f"""
    SELECT a.session_id, a.event_id, coalesce(m.v, f.v, {default}) AS v FROM {at} a
    ASOF LEFT JOIN (SELECT session_id, t, {value} AS v FROM fx_samples WHERE {marks}) m
      ON a.session_id = m.session_id AND a.t >= m.t
    LEFT JOIN (SELECT session_id, arg_min({value}, t) AS v FROM fx_samples WHERE {marks} GROUP BY session_id) f
      ON f.session_id = a.session_id"""


@query(
    "asof_region",
    "SELECT session_id, event_id, round(v, 6) AS region_x FROM ("
    + _sql_in_force("k / 1000.0", "event_type = 'purchase' AND k >= 50", "0")
    + ")",
)
def asof_region(t: Tables) -> DataFrame:
    rows = moments(t)
    marks = rows.where("event_type = 'purchase' AND k >= 50").withColumn("region_x", F.col("k") / 1000.0)
    at = rows.select("session_id", "event_id", "t")
    found = c.in_force(at, marks.select("session_id", "event_id", "t", "region_x"), "region_x", F.lit(0.0))
    return rounded(found.select("session_id", "event_id", "region_x"))


@query(
    "asof_hint",
    """
    SELECT a.session_id, a.event_id, h.key AS hint FROM fx_samples a
    ASOF LEFT JOIN fx_hints h ON a.session_id = h.session_id AND a.t >= h.t
    """,
)
def asof_hint(t: Tables) -> DataFrame:
    marks = seq.changes(t)
    found = asof(moments(t), marks, ["session_id"], "t", "t", {"hint": F.col("key")}, tl.SLICE_MS, tie="event_id")
    return found.select("session_id", "event_id", "hint")


@query(
    "asof_script_page",
    "SELECT p.session_id, p.event_id, CAST(p.v AS BIGINT) AS page, s.t AS stable_at FROM ("
    + _sql_in_force("k % 4", "event_type = 'signup'", "0", "(SELECT * FROM fx_samples WHERE event_type = 'purchase')")
    + """) p JOIN fx_samples x USING (event_id) ASOF LEFT JOIN
    (SELECT session_id, t FROM fx_samples WHERE event_type = 'view' AND k % 5 = 0) s
    ON x.session_id = s.session_id AND x.t >= s.t""",
)
def asof_script_page(t: Tables) -> DataFrame:
    rows = moments(t)
    steps = rows.where("event_type = 'signup'").withColumn("page", (F.col("k") % 4).cast("bigint"))
    taps = rows.where("event_type = 'purchase'").select("session_id", "event_id", "t")
    stable = rows.where("event_type = 'view' AND k % 5 = 0")
    paged = c.in_force(taps, steps.select("session_id", "event_id", "t", "page"), "page", F.lit(0).cast("bigint"))
    found = asof(paged, stable, ["session_id"], "t", "t", {"stable_at": F.col("t")}, tl.SLICE_MS)
    return found.select("session_id", "event_id", "page", "stable_at")


@query(
    "overlay_reference_join",
    """
    SELECT s.session_id, s.event_id, s.frame_k, r.page_id IS NOT NULL AS has_reference, r.page_id
    FROM fx_on_screen s LEFT JOIN pages r ON r.page_id = s.frame_k
    """,
)
def overlay_reference_join(t: Tables) -> DataFrame:
    """The reference of the frame on screen then: as-of on the frame, equi join on its id."""
    rows, presented, pushed = asof_parts(t)
    found = c.frame_on_screen(rows, presented, pushed, 33)
    reference = t.pages.select("page_id")
    joined = found.join(reference, F.col("frame_k") == F.col("page_id"), "left")
    return joined.select(
        "session_id", "event_id", "frame_k", F.col("page_id").isNotNull().alias("has_reference"), "page_id"
    )


# ── captures ─────────────────────────────────────────────────────────────────


@query(
    "capture_image_join",
    """
    SELECT c.event_id, c.k % 2 = 0 AS still_used, coalesce(i.known, false) AS known,
           CASE WHEN i.known THEN i.image_id END AS image_id,
           CASE WHEN c.k % 2 = 0 THEN 'still' ELSE 'preview frame' END
             || CASE WHEN i.known THEN '' ELSE ' (unidentified)' END AS image_source
    FROM (SELECT * FROM fx_samples WHERE event_type = 'purchase') c
    LEFT JOIN (SELECT event_id AS image_id, event_type, true AS known FROM events) i
      ON (c.k % 2 = 0 AND i.event_type = 'click' AND i.image_id = c.event_id + 1)
      OR (c.k % 2 <> 0 AND i.event_type = 'view' AND i.image_id = c.event_id + 2)
    """,
)
def capture_image_join(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    captures = rows.where("event_type = 'purchase'").select(
        "event_id",
        (F.col("k") % 2 == 0).alias("still_used"),
        (F.col("event_id") + 1).alias("still_id"),
        (F.col("event_id") + 2).alias("grab_id"),
    )
    images = rows.select(F.col("event_id").alias("image_id"), "event_type", F.lit(720).alias("width"))
    found = c.image_of(captures, images.where("event_type = 'click'"), images.where("event_type = 'view'"))
    return found.select("event_id", "still_used", "known", "image_id", "image_source")


view(
    "fx_stitched",
    """
    SELECT c.session_id, c.event_id, c.t, c.k, c.value, c.next_t, o.open_t, o.open_id, o.done_t,
           (SELECT max(r.t) FROM fx_log r WHERE r.session_id = c.session_id AND r.kind = 'hint' AND r.k >= 90
              AND r.t >= c.t AND (o.open_t IS NULL OR r.t <= o.open_t)) AS refine_t
    FROM (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS next_t FROM fx_log
          WHERE kind = 'capture') c
    LEFT JOIN (
      SELECT c.event_id, arg_min(o.t, o.t) AS open_t, arg_min(o.event_id, o.t) AS open_id, arg_min(o.done_t, o.t) AS done_t
      FROM (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS next_t FROM fx_log
            WHERE kind = 'capture') c
      JOIN (SELECT o.session_id, o.event_id, o.t, d.t AS done_t FROM fx_log o ASOF LEFT JOIN
              (SELECT * FROM fx_log WHERE kind = 'confirm-done') d ON o.session_id = d.session_id AND o.t <= d.t
            WHERE o.kind = 'confirm-open') o
        ON o.session_id = c.session_id AND o.t >= c.t AND (c.next_t IS NULL OR o.t < c.next_t)
      GROUP BY c.event_id) o USING (event_id)
    """,
)


def stitched(t: Tables) -> DataFrame:
    refine = (F.col("kind") == "hint") & (F.col("k") >= 90)
    return c.stitch(b.log(t).withColumn("is_refine", refine))


@query(
    "capture_stitch",
    """
    SELECT session_id, event_id, t, next_t, open_t, open_id,
           CASE WHEN next_t IS NULL OR done_t < next_t THEN done_t END AS done_t, refine_t FROM fx_stitched
    """,
)
def capture_stitch(t: Tables) -> DataFrame:
    return stitched(t).select("session_id", "event_id", "t", "next_t", "open_t", "open_id", "done_t", "refine_t")


@query(
    "capture_latency",
    f"""
    SELECT session_id, count(*) AS captures, count(open_t) AS opened, count(done) AS confirmed,
           {sql_rate('count(open_t)', 'count(*)')} AS opened_rate, round(avg(open_t - t), 6) AS latency_mean,
           CAST({sql_pct('(open_t - t)', 0.5)} AS DOUBLE) AS latency_p50,
           CAST({sql_pct('(open_t - t)', 0.95)} AS DOUBLE) AS latency_p95
    FROM (SELECT *, CASE WHEN next_t IS NULL OR done_t < next_t THEN done_t END AS done FROM fx_stitched)
    GROUP BY session_id
    """,
)
def capture_latency(t: Tables) -> DataFrame:
    return rounded(c.latency_summary(stitched(t), ["session_id"]))


_VERDICT = """CASE WHEN open_t IS NULL THEN 'confirm never opened' WHEN k % 11 = 3 THEN 'unscored'
                WHEN k % 10 <> 7 AND value < 100 THEN CASE WHEN value > 60 THEN 'wrong' ELSE 'good' END
                WHEN k % 10 <> 7 THEN 'no corners' WHEN value < 100 THEN 'false positive'
                ELSE 'page-less capture' END"""
_FINAL = """CASE WHEN open_t IS NULL THEN 'confirm never opened' WHEN k % 11 = 3 THEN 'unscored'
                WHEN k % 10 = 7 THEN 'page-less capture' WHEN value >= 200 THEN 'no corners'
                WHEN value > 80 THEN 'wrong' ELSE 'good' END"""


@query(
    "crop_verdict",
    f"SELECT event_id, {_VERDICT} AS proposal, {_FINAL} AS final FROM fx_stitched",
)
def crop_verdict(t: Tables) -> DataFrame:
    opened, known = F.col("open_t").isNotNull(), F.col("k") % 11 != 3
    page, value = F.col("k") % 10 != 7, F.col("value")
    return stitched(t).select(
        "event_id",
        c.capture_verdict(opened, known, page, value < 100, value > 60).alias("proposal"),
        c.crop_verdict(opened, known, page, value < 200, value > 80).alias("final"),
    )


@query(
    "capture_outcomes",
    f"""
    SELECT session_id, count(*) AS captures, count(*) FILTER (v = 'good') AS good, count(*) FILTER (v = 'wrong') AS wrong,
           count(*) FILTER (v = 'no corners') AS no_corners, count(*) FILTER (v = 'false positive') AS false_positive,
           count(*) FILTER (v = 'page-less capture') AS pageless, count(*) FILTER (v = 'unscored') AS unscored,
           count(*) FILTER (v = 'confirm never opened') AS never_opened,
           {sql_rate("count(*) FILTER (v IN ('wrong', 'false positive', 'no corners', 'confirm never opened'))",
                     "count(*) FILTER (v <> 'unscored')")} AS failed_rate
    FROM (SELECT *, {_VERDICT} AS v FROM fx_stitched) GROUP BY session_id
    """,
)
def capture_outcomes(t: Tables) -> DataFrame:
    opened, known = F.col("open_t").isNotNull(), F.col("k") % 11 != 3
    page, value = F.col("k") % 10 != 7, F.col("value")
    v = F.col("v")
    rows = stitched(t).withColumn("v", c.capture_verdict(opened, known, page, value < 100, value > 60))
    failed = v.isin("wrong", "false positive", "no corners", c.NEVER_OPENED)
    table = rows.groupBy("session_id").agg(
        F.count("*").alias("captures"),
        F.count_if(v == "good").alias("good"),
        F.count_if(v == "wrong").alias("wrong"),
        F.count_if(v == "no corners").alias("no_corners"),
        F.count_if(v == "false positive").alias("false_positive"),
        F.count_if(v == c.PAGELESS_CAPTURE).alias("pageless"),
        F.count_if(v == c.UNSCORED_CAPTURE).alias("unscored"),
        F.count_if(v == c.NEVER_OPENED).alias("never_opened"),
        rate(F.count_if(failed), F.count_if(v != c.UNSCORED_CAPTURE)).alias("failed_rate"),
    )
    return rounded(table)


@query(
    "capture_freeze",
    """
    SELECT c.session_id, c.event_id, count(o.event_id) AS samples, coalesce(bool_or(NOT o.shown), false) AS dropped,
           round(coalesce(max(sqrt((o.value - bs.value) * (o.value - bs.value) / 25000000.0
             + (o.k - bs.k) * (o.k - bs.k) / 100000000.0)) FILTER (o.shown), 0), 6) AS move
    FROM fx_stitched c
    ASOF LEFT JOIN (SELECT * FROM fx_samples WHERE event_type IN ('view', 'error')) bs
      ON c.session_id = bs.session_id AND c.t >= bs.t
    LEFT JOIN (SELECT * FROM fx_samples WHERE event_type IN ('view', 'error')) o
      ON o.session_id = c.session_id AND o.t > c.t AND o.t < c.open_t
    WHERE c.open_t IS NOT NULL AND bs.t IS NOT NULL GROUP BY c.session_id, c.event_id
    """,
)
def capture_freeze(t: Tables) -> DataFrame:
    """How far the drawn quad moved between the tap and the confirm screen, and whether it dropped."""
    t = b.with_clock(t)
    overlay = b.samples(t).where("event_type IN ('view', 'error')")
    taps = written_once(stitched(t).where("open_t IS NOT NULL").select("session_id", "event_id", "t", "open_t"))
    held = asof(
        taps,
        overlay,
        ["session_id"],
        "t",
        "t",
        {"base_value": F.col("value"), "base_k": F.col("k"), "base_t": F.col("t")},
        tl.SLICE_MS,
        tie="event_id",
    ).where(F.col("base_t").isNotNull())
    spans = held.select("session_id", F.col("event_id").alias("tap_id"), F.col("t").alias("tap_t"), "open_t", "base_value", "base_k")
    spans = written_once(spans)
    seen = overlay.select("session_id", F.col("t").alias("at"), F.col("t").alias("at2"), "value", "k", "shown")
    inside = (F.col("at") > F.col("tap_t")) & (F.col("at") < F.col("open_t"))
    pairs = c.interval_join(spans, seen, ["session_id"], ("tap_t", "open_t"), ("at", "at2"), tl.SLICE_MS, inside)
    dv, dk = F.col("value") - F.col("base_value"), F.col("k") - F.col("base_k")
    move = F.sqrt(dv * dv / 25000000.0 + dk * dk / 100000000.0)
    facts = pairs.groupBy("session_id", "tap_id").agg(
        F.count("*").alias("samples"),
        F.bool_or(~F.col("shown")).alias("dropped"),
        F.max(F.when(F.col("shown"), move)).alias("move"),
    )
    table = spans.select("session_id", "tap_id").join(facts, ["session_id", "tap_id"], "left")
    table = table.fillna({"samples": 0, "dropped": False, "move": 0.0})
    return rounded(table.withColumnRenamed("tap_id", "event_id"))


@query(
    "shutter_scene_join",
    """
    SELECT c.session_id, c.event_id AS tap_id, bool_and(f.whole) AS whole, count(*) AS frames,
           round(max(sqrt((f.x0 - s.x0) * (f.x0 - s.x0) + (f.y0 - s.y0) * (f.y0 - s.y0))), 6) AS motion
    FROM fx_log c
    ASOF JOIN (SELECT *, k % 9 <> 1 AS whole FROM fx_readings) s ON c.session_id = s.session_id AND c.t >= s.t
    JOIN (SELECT *, k % 9 <> 1 AS whole FROM fx_readings) f
      ON f.session_id = c.session_id AND f.t >= s.t AND f.t <= c.t + 150
    WHERE c.kind = 'capture' GROUP BY c.session_id, c.event_id
    """,
)
def shutter_scene_join(t: Tables) -> DataFrame:
    frames = b.readings(t).select(
        "session_id",
        "event_id",
        "t",
        (0.1 + F.col("value") / 5000.0).alias("x0"),
        (0.1 + F.col("k") / 10000.0).alias("y0"),
        (F.col("k") % 9 != 1).alias("whole"),
    )
    taps = b.log(t).where("kind = 'capture'").select("session_id", "event_id", "t")
    dx, dy = F.col("x0") - F.col("first_x"), F.col("y0") - F.col("first_y")
    return rounded(c.shutter_scene(taps, frames, F.sqrt(dx * dx + dy * dy)))


# ── intervals against windows ────────────────────────────────────────────────

view(
    "fx_ready_windows",
    """
    SELECT session_id, 'early' AS name, from_t, from_t + (to_t - from_t) // 4 AS to_t FROM fx_windows UNION ALL
    SELECT session_id, 'late' AS name, to_t - (to_t - from_t) // 3 AS from_t, to_t FROM fx_windows
    """,
)


def ready_windows(t: Tables) -> DataFrame:
    spans = b.windows(b.clocked(t))
    early = spans.select(
        "session_id", F.lit("early").alias("name"), "from_t", F.expr("from_t + (to_t - from_t) div 4").alias("to_t")
    )
    late = spans.select(
        "session_id", F.lit("late").alias("name"), F.expr("to_t - (to_t - from_t) div 3").alias("from_t"), "to_t"
    )
    return early.unionByName(late)


@query(
    "interval_overlap",
    """
    SELECT session_id, name, count(*) AS spans, CAST(sum(least(e2, r.to_t) - greatest(b, r.from_t)) AS BIGINT) AS overlap_ms
    FROM (SELECT session_id, event_id, b, e2 FROM fx_intervals) i JOIN fx_ready_windows r USING (session_id)
    WHERE b < r.to_t AND e2 > r.from_t GROUP BY session_id, name
    """,
)
def interval_overlap(t: Tables) -> DataFrame:
    rows = b.samples(t)
    held = tl.intervals(rows, b.windows(rows)).select("session_id", "event_id", "begin", "end")
    pairs = c.overlap_ms(held, ready_windows(t))
    return pairs.groupBy("session_id", "name").agg(
        F.count("*").alias("spans"), F.sum("overlap_ms").alias("overlap_ms")
    )


@query(
    "containment_flags",
    """
    SELECT c.session_id, c.event_id, coalesce(bool_or(r.name = 'early'), false) AS in_early,
           coalesce(bool_or(r.name = 'late'), false) AS in_late
    FROM fx_log c LEFT JOIN fx_ready_windows r ON r.session_id = c.session_id AND c.t BETWEEN r.from_t AND r.to_t
    WHERE c.kind = 'capture' GROUP BY c.session_id, c.event_id
    """,
)
def containment_flags(t: Tables) -> DataFrame:
    taps = b.log(t).where("kind = 'capture'").select("session_id", "event_id", "t")
    flags = c.inside_windows(taps, ready_windows(t), ["early", "late"])
    return flags.select("session_id", "event_id", "in_early", "in_late")


@query(
    "time_grid_join",
    """
    SELECT g.session_id, g.name, count(*) * 50 AS grid_ms, count(*) FILTER (s.ready AND g.at - s.t <= 300) * 50 AS ready_ms,
           count(*) FILTER (h.key = 'move-back') * 50 AS move_back_ms
    FROM (SELECT session_id, name, unnest(range(from_t, to_t, 50)) AS at FROM fx_ready_windows) g
    ASOF LEFT JOIN fx_samples s ON g.session_id = s.session_id AND g.at >= s.t
    ASOF LEFT JOIN fx_hints h ON g.session_id = h.session_id AND g.at >= h.t
    GROUP BY g.session_id, g.name
    """,
)
def time_grid_join(t: Tables) -> DataFrame:
    """Series read on a 50 ms grid inside each hold."""
    grid = ready_windows(t).where("to_t > from_t").select(
        "session_id", "name", F.explode(F.sequence("from_t", F.col("to_t") - 1, F.lit(50).cast("bigint"))).alias("t")
    )
    cue = b.samples(t).select("session_id", "event_id", "t", "ready")
    on = asof(
        grid, cue, ["session_id"], "t", "t", {"ready": F.col("ready"), "seen_t": F.col("t")}, tl.SLICE_MS, tie="event_id"
    )
    both = asof(on, seq.changes(t), ["session_id"], "t", "t", {"hint": F.col("key")}, tl.SLICE_MS, tie="event_id")
    live = F.col("ready") & (F.col("t") - F.col("seen_t") <= 300)
    return both.groupBy("session_id", "name").agg(
        (F.count("*") * 50).alias("grid_ms"),
        (F.count_if(live) * 50).alias("ready_ms"),
        (F.count_if(F.col("hint") == "move-back") * 50).alias("move_back_ms"),
    )
