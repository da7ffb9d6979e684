"""State machine queries: cues, smoothing, arbitration, sampling, each over whole sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import folds
from pagegauge.operators import timeline as tl
from pagegauge.operators.ordered import ordered
from pagegauge.operators.percentiles import Wanted, with_percentiles
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import rounded, sql_pct
from pagegauge.plans.registry import Tables, query, view
from pagegauge.streaming import machines as m

FOLD_SLICE_MS = 600_000
KEY = ["session_id"]
ORDER = ["t", "event_id"]

view("fx_steps_in_order", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS nth FROM fx_samples")


def fold(rows: DataFrame, machine: m.Machine, width: int = FOLD_SLICE_MS) -> DataFrame:
    return folds.fold(rows, KEY, ORDER, machine, width)


def recursive(start: str, step: str, out: str, states: str) -> str:
    """A fold as SQL: ``states`` named columns, ``start`` before the first row, ``step`` from ``f`` and row ``r``."""
    return f"""
    WITH RECURSIVE f AS (
      SELECT session_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, {start}
      FROM (SELECT DISTINCT session_id FROM fx_steps_in_order)
      UNION ALL
      SELECT r.session_id, r.nth, r.event_id, {step} FROM f JOIN fx_steps_in_order r
        ON r.session_id = f.session_id AND r.nth = f.nth + 1)
    SELECT session_id, event_id, {out} FROM f WHERE nth > 0"""


@query(
    "envelope_sequence",
    "SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) - 1 AS seq, "
    "t - min(t) OVER (PARTITION BY session_id) AS since FROM fx_samples",
)
def envelope_sequence(t: Tables) -> DataFrame:
    """Per session a number from 0 and the time since its first event."""
    rows = b.clocked(t).select("session_id", "event_id", "t")
    first = rows.groupBy("session_id").agg(F.min("t").alias("origin"))
    counted = tl.series(rows).step(running={"n": F.lit(1).cast("bigint")}).result()
    joined = counted.join(first, "session_id")
    return joined.select("session_id", "event_id", (F.col("n") - 1).alias("seq"), (F.col("t") - F.col("origin")).alias("since"))


@query(
    "rate_limit_sampler",
    recursive(
        "CAST(NULL AS BIGINT) AS last_t, CAST(NULL AS BIGINT) AS before_t, false AS due",
        "CASE WHEN {d} THEN r.t ELSE f.last_t END, CASE WHEN {d} THEN f.last_t ELSE f.before_t END, {d}".format(
            d="((f.last_t IS NULL OR r.t - f.last_t >= 450) AND (f.before_t IS NULL OR r.t - f.before_t >= 1000))"
        ),
        "due",
        "last_t, before_t",
    ),
)
def rate_limit_sampler(t: Tables) -> DataFrame:
    rows = b.clocked(t).select("session_id", "event_id", "t")
    return fold(rows, m.RATE_LIMIT).select("session_id", "event_id", "due")


_ACTION = "CASE WHEN r.k = 99 THEN 'error' WHEN r.k = 98 THEN 'complete' WHEN r.k % 2 = 0 THEN 'user' ELSE 'other' END"
_PASSED = (
    f"(NOT f.finished AND ({_ACTION} IN ('error', 'complete') OR ({_ACTION} = 'user' AND "
    "(f.last_t IS NULL OR r.t - f.last_t >= 400))))"
)


@query(
    "cancel_debounce",
    recursive(
        "false AS finished, CAST(NULL AS BIGINT) AS last_t, false AS passed",
        f"f.finished OR {_ACTION} IN ('error', 'complete'), CASE WHEN {_PASSED} AND {_ACTION} = 'user' THEN r.t ELSE f.last_t END, {_PASSED}",
        "passed",
        "",
    ),
)
def cancel_debounce(t: Tables) -> DataFrame:
    k = F.col("k")
    action = F.when(k == 99, "error").when(k == 98, "complete").when(k % 2 == 0, "user").otherwise("other")
    rows = b.clocked(t).select("session_id", "event_id", "t", action.alias("action"))
    return fold(rows, m.CANCEL_GATE).select("session_id", "event_id", "passed")


def _quad_columns() -> list:
    quad = b.reading_quad()
    return [F.get(quad, F.lit(i))[a].alias(f"{a}{i}") for i in range(4) for a in "xy"]


def _one_euro_sql() -> str:
    """One channel of the smoother as a recursion; the query keeps x0 and y1."""
    a5 = "(1 / (1 + (1 / (2 * pi() * 5)) / ((r.t - f.at_t) / 1000.0)))"

    def slope(v: str, i: str) -> str:
        return f"(f.d{i} + {a5} * (({v} - f.v{i}) / ((r.t - f.at_t) / 1000.0) - f.d{i}))"

    def value(v: str, i: str) -> str:
        return f"(f.v{i} + (1 / (1 + (1 / (2 * pi() * (1 + 64 * abs({slope(v, i)})))) / ((r.t - f.at_t) / 1000.0))) * ({v} - f.v{i}))"

    x, y = "(0.1::DOUBLE + r.value / 5000.0)", "(0.1::DOUBLE + r.k / 10000.0) * 1.5::DOUBLE"
    first = "f.at_t IS NULL"
    return recursive(
        "CAST(NULL AS BIGINT) AS at_t, 0::DOUBLE AS va, 0::DOUBLE AS da, 0::DOUBLE AS vb, 0::DOUBLE AS db",
        f"r.t, CASE WHEN {first} THEN {x} ELSE {value(x, 'a')} END, CASE WHEN {first} THEN 0 ELSE {slope(x, 'a')} END, "
        f"CASE WHEN {first} THEN {y} ELSE {value(y, 'b')} END, CASE WHEN {first} THEN 0 ELSE {slope(y, 'b')} END",
        "round(va, 6) AS sx0, round(vb / 1.5::DOUBLE, 6) AS sy0",
        "",
    )


@query("one_euro_smooth", _one_euro_sql())
def one_euro_smooth(t: Tables) -> DataFrame:
    rows = b.clocked(t).select("session_id", "event_id", "t", F.lit(1.5).alias("aspect"), *_quad_columns())
    return rounded(fold(rows, m.ONE_EURO).select("session_id", "event_id", "sx0", "sy0"))


_LANE = "CASE WHEN r.nth % 40 < 20 THEN 'main' ELSE 'worker' END"
_CHARGED = f"(CASE WHEN {_LANE} = 'main' AND 5 + r.value >= 50 THEN (5 + r.value) * 2 ELSE 5 + r.value END)"


@query(
    "ewma_cadence",
    recursive(
        "CAST(NULL AS DOUBLE) AS cost, '' AS lane",
        f"CASE WHEN f.cost IS NULL OR f.lane <> {_LANE} THEN {_CHARGED} ELSE f.cost * 0.7::DOUBLE + {_CHARGED} * 0.3::DOUBLE END, {_LANE}",
        "round(cost + 1e-9, 6) AS cost_ms, round(least(400, greatest(120, cost / 0.35::DOUBLE)) + 1e-9, 6) AS interval_ms",
        "",
    ),
)
def ewma_cadence(t: Tables) -> DataFrame:
    counted = tl.series(b.clocked(t)).step(running={"nth": F.lit(1).cast("bigint")}).result()
    lane = F.when(F.col("nth") % 40 < 20, "main").otherwise("worker")
    rows = counted.select("session_id", "event_id", "t", (5 + F.col("value")).alias("pass_ms"), lane.alias("lane"))
    # Costs carry few decimals, so exact ties at the sixth place occur: both sides are nudged off them.
    nudged = [(F.col(c) + 1e-9).alias(c) for c in ("cost_ms", "interval_ms")]
    return rounded(fold(rows, m.CADENCE).select("session_id", "event_id", *nudged))


_SRC = "CASE WHEN r.k % 2 = 1 THEN 'ml' ELSE 'classical' END"
_CONF = "CASE WHEN r.k % 6 <> 0 THEN r.k / 100.0 END::DOUBLE"
_CAP = "(r.t - 4 * (r.k % 50))"
_ACC = f"""(f.src IS NULL OR CASE WHEN {_SRC} = f.src THEN {_CAP} > f.cap
      WHEN {_SRC} = 'ml' THEN f.conf IS NULL OR f.conf < 0.5 OR {_CAP} > f.cap
      ELSE {_CAP} > f.cap AND NOT (({_CONF} IS NULL OR {_CONF} < 0.5) AND r.t - f.cap < 1500) END)"""


@query(
    "arbitrate_sources",
    recursive(
        "CAST(NULL AS VARCHAR) AS src, CAST(NULL AS DOUBLE) AS conf, CAST(NULL AS BIGINT) AS cap, false AS accepted",
        f"CASE WHEN {_ACC} THEN {_SRC} ELSE f.src END, CASE WHEN {_ACC} THEN {_CONF} ELSE f.conf END, "
        f"CASE WHEN {_ACC} THEN {_CAP} ELSE f.cap END, {_ACC}",
        "accepted, src AS tracked",
        "",
    ),
)
def arbitrate_sources(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = b.clocked(t).select(
        "session_id",
        "event_id",
        "t",
        F.when(k % 2 == 1, "ml").otherwise("classical").alias("source"),
        F.when(k % 6 != 0, k / 100.0).alias("confidence"),
        (F.col("t") - 4 * (k % 50)).alias("captured_at"),
    )
    return fold(rows, m.ARBITRATE).select("session_id", "event_id", "accepted", "tracked")


_WANTED = "CASE WHEN r.nth // 6 % 4 = 0 THEN 'move-closer' WHEN r.nth // 6 % 4 = 1 THEN 'glare' WHEN r.nth // 6 % 4 = 2 THEN 'hold-still' END"
_PEND = f"(NOT f.waiting OR {_WANTED} IS DISTINCT FROM f.pending)"
_SINCE = f"(CASE WHEN {_PEND} THEN r.t ELSE f.since END)"
_SAME = f"({_WANTED} IS NOT DISTINCT FROM f.shown)"
_CLEARS = f"({_WANTED} IS NULL AND f.shown IN ('move-closer', 'move-back', 'move-phone'))"
_TAKES = (
    f"(r.t - {_SINCE} >= 300 AND (f.shown IS NULL OR r.t - f.shown_at >= 1000) "
    "AND (f.changed_at IS NULL OR r.t - f.changed_at >= 1500))"
)


@query(
    "hint_debounce",
    recursive(
        "CAST(NULL AS VARCHAR) AS shown, CAST(NULL AS BIGINT) AS shown_at, CAST(NULL AS BIGINT) AS changed_at, "
        "CAST(NULL AS VARCHAR) AS pending, CAST(NULL AS BIGINT) AS since, false AS waiting",
        f"CASE WHEN {_SAME} THEN f.shown WHEN coalesce({_CLEARS}, false) THEN NULL WHEN {_TAKES} THEN {_WANTED} ELSE f.shown END, "
        f"CASE WHEN {_SAME} THEN f.shown_at WHEN coalesce({_CLEARS}, false) OR {_TAKES} THEN r.t ELSE f.shown_at END, "
        f"CASE WHEN {_SAME} THEN f.changed_at WHEN coalesce({_CLEARS}, false) OR {_TAKES} THEN r.t ELSE f.changed_at END, "
        f"CASE WHEN {_SAME} THEN f.pending ELSE {_WANTED} END, CASE WHEN {_SAME} THEN f.since ELSE {_SINCE} END, "
        f"NOT ({_SAME} OR coalesce({_CLEARS}, false) OR {_TAKES})",
        "shown AS shown_hint",
        "",
    ),
)
def hint_debounce(t: Tables) -> DataFrame:
    counted = tl.series(b.clocked(t)).step(running={"nth": F.lit(1).cast("bigint")}).result()
    slot = F.expr("nth div 6 % 4")
    wanted = F.when(slot == 0, "move-closer").when(slot == 1, "glare").when(slot == 2, "hold-still")
    rows = counted.select("session_id", "event_id", "t", wanted.alias("wanted"))
    return fold(rows, m.HINT_DEBOUNCE).select("session_id", "event_id", "shown_hint")


_DIR = "CASE WHEN r.nth % 23 <> 0 THEN CASE WHEN r.nth // 5 % 3 = 0 THEN 'left' WHEN r.nth // 5 % 3 = 1 THEN 'up' ELSE 'right' END END"
_DSINCE = f"(CASE WHEN {_DIR} IS DISTINCT FROM f.pending THEN r.t ELSE f.since END)"
_DTAKES = f"(r.t - {_DSINCE} >= 300 AND r.t - f.shown_at >= 1000)"


@query(
    "direction_latch",
    recursive(
        "CAST(NULL AS VARCHAR) AS shown, CAST(NULL AS BIGINT) AS shown_at, CAST(NULL AS VARCHAR) AS pending, CAST(0 AS BIGINT) AS since",
        f"CASE WHEN {_DIR} IS NULL THEN NULL WHEN f.shown IS NULL THEN {_DIR} WHEN {_DIR} = f.shown THEN f.shown WHEN {_DTAKES} THEN {_DIR} ELSE f.shown END, "
        f"CASE WHEN {_DIR} IS NULL THEN NULL WHEN f.shown IS NULL THEN r.t WHEN {_DIR} = f.shown THEN f.shown_at WHEN {_DTAKES} THEN r.t ELSE f.shown_at END, "
        f"CASE WHEN {_DIR} IS NULL OR f.shown IS NULL OR {_DIR} = f.shown OR {_DTAKES} THEN NULL ELSE {_DIR} END, "
        f"CASE WHEN {_DIR} IS NULL OR f.shown IS NULL OR {_DTAKES} THEN 0 WHEN {_DIR} = f.shown THEN f.since ELSE {_DSINCE} END",
        "shown AS shown_direction",
        "",
    ),
)
def direction_latch(t: Tables) -> DataFrame:
    counted = tl.series(b.clocked(t)).step(running={"nth": F.lit(1).cast("bigint")}).result()
    slot = F.expr("nth div 5 % 3")
    direction = F.when(F.col("nth") % 23 != 0, F.when(slot == 0, "left").when(slot == 1, "up").otherwise("right"))
    rows = counted.select("session_id", "event_id", "t", direction.alias("direction"))
    return fold(rows, m.DIRECTION_LATCH).select("session_id", "event_id", "shown_direction")


_STRICT, _KEEP = "(r.nth % 9 < 6)", "(r.nth % 31 <> 0)"
_RSINCE = "(CASE WHEN f.since IS NULL THEN r.t ELSE f.since END)"
_RON = f"(CASE WHEN f.on_since IS NULL AND r.t - {_RSINCE} >= 100 THEN r.t ELSE f.on_since END)"
_ROFF = "(r.t - coalesce(f.failing, r.t) >= 300)"


@query(
    "ready_cue",
    recursive(
        "CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS on_since, false AS cue, CAST(NULL AS BIGINT) AS failing",
        f"CASE WHEN {_STRICT} THEN {_RSINCE} END, CASE WHEN {_STRICT} THEN {_RON} WHEN {_KEEP} AND f.cue AND NOT {_ROFF} THEN f.on_since END, "
        f"CASE WHEN {_STRICT} THEN f.cue OR {_RON} IS NOT NULL ELSE {_KEEP} AND f.cue AND NOT {_ROFF} END, "
        f"CASE WHEN {_STRICT} OR NOT {_KEEP} THEN NULL WHEN f.cue THEN CASE WHEN NOT {_ROFF} THEN coalesce(f.failing, r.t) END ELSE f.failing END",
        "cue",
        "",
    ),
)
def ready_cue(t: Tables) -> DataFrame:
    counted = tl.series(b.clocked(t)).step(running={"nth": F.lit(1).cast("bigint")}).result()
    rows = counted.select(
        "session_id", "event_id", "t", (F.col("nth") % 9 < 6).alias("strict"), (F.col("nth") % 31 != 0).alias("keep")
    )
    return fold(rows, m.READY_CUE).select("session_id", "event_id", "cue")


@query(
    "once_per_episode",
    recursive(
        "true AS armed, CAST(NULL AS BIGINT) AS off_since, CAST(NULL AS BIGINT) AS lost, false AS tick",
        "CASE WHEN r.k >= 90 THEN false ELSE f.armed OR r.t - coalesce(f.off_since, r.t) >= 2000 OR "
        "(r.k % 3 <> 0 AND r.t - coalesce(f.lost, r.t) >= 1000) END, CASE WHEN r.k < 90 THEN coalesce(f.off_since, r.t) END, "
        "CASE WHEN r.k < 90 AND r.k % 3 <> 0 THEN coalesce(f.lost, r.t) END, r.k >= 90 AND f.armed",
        "tick",
        "",
    ),
)
def once_per_episode(t: Tables) -> DataFrame:
    rows = b.clocked(t).select(
        "session_id", "event_id", "t", (F.col("k") >= 90).alias("ready"), (F.col("k") % 3 == 0).alias("found")
    )
    return fold(rows, m.ONCE_PER_EPISODE).select("session_id", "event_id", "tick")


@query("auto_capture")
def auto_capture(t: Tables) -> DataFrame:
    """Countdown and fires of the automatic shutter, re-decided from logged conditions."""
    k = F.col("k")
    ready = k >= 25
    rows = (
        tl.series(b.clocked(t))
        .step(
            fill={
                "not_ready": F.when(~ready, F.col("t")),
                "confirmed_at": F.when(k % 3 != 0, F.col("t")),
                "motion_at": F.when(k % 29 == 0, F.col("t")),
            }
        )
        .result()
    )
    since = F.coalesce("not_ready", F.lit(0).cast("bigint"))
    jump = F.when(F.col("value") > 150, 0.3).otherwise(0.0)
    missing = k % 17 == 0
    low, high = F.lit(0.1), F.lit(0.9)
    corners = [(low, low), (high, low), (high, high), (low, high)]
    sheet = []
    for i, (x, y) in enumerate(corners):
        sheet += [F.when(~missing, x + jump).alias(f"x{i}"), F.when(~missing, y).alias(f"y{i}")]
    inputs = rows.select(
        "session_id",
        "event_id",
        "t",
        F.when(ready, since).alias("ready_since"),
        F.when(k % 41 != 0, F.greatest(since - 400, F.lit(0))).alias("locked_since"),
        "confirmed_at",
        "motion_at",
        (k % 4 != 0).alias("agree"),
        (k % 7 != 0).alias("steady"),
        F.lit(1.5).alias("aspect"),
        *sheet,
    )
    return rounded(fold(inputs, m.AUTO_CAPTURE).select("session_id", "event_id", "countdown", "fire"))


@query(
    "paper_memory",
    """
    SELECT session_id, event_id, paper_at, paper_at IS NULL OR t - paper_at > 1000 AS expired, last_ok,
           CASE WHEN NOT last_ok THEN 'newest not paper' WHEN paper_at IS NULL THEN 'not read'
                WHEN t - paper_at > 1500 THEN 'not read lately' END AS why
    FROM (SELECT *, max(CASE WHEN ok AND fresh THEN frame_at END) OVER w AS paper_at,
                 last_value(CASE WHEN fresh THEN ok END IGNORE NULLS) OVER w AS last_ok
          FROM (SELECT *, frame_at >= coalesce(max(frame_at) OVER (PARTITION BY session_id ORDER BY t, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), frame_at) AS fresh
                FROM (SELECT *, t - 4 * (k % 50) AS frame_at, k % 4 = 0 AS ok FROM fx_samples))
          WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
    """,
)
def paper_memory(t: Tables) -> DataFrame:
    """The last positive reading, out-of-order ones ignored: an older frame than the newest read is not news."""
    k = F.col("k")
    rows = b.clocked(t).select(
        "session_id", "event_id", "t", (F.col("t") - 4 * (k % 50)).alias("frame_at"), (k % 4 == 0).alias("ok")
    )
    marked = tl.series(rows).step(peak={"newest": F.col("frame_at")})
    fresh = F.col("frame_at") >= F.col("newest")
    held = marked.step(
        fill={"last_ok": F.when(fresh, F.col("ok"))}, peak={"paper_at": F.when(fresh & F.col("ok"), F.col("frame_at"))}
    ).result()
    paper, at = F.col("paper_at"), F.col("t")
    why = (
        F.when(~F.col("last_ok"), "newest not paper").when(paper.isNull(), "not read").when(at - paper > 1500, "not read lately")
    )
    return held.select(
        "session_id", "event_id", "paper_at", (paper.isNull() | (at - paper > 1000)).alias("expired"), "last_ok", why.alias("why")
    )


_CONDITIONS = {"lock": "k % 3 <> 0", "hint": "k % 5 <> 0", "still": "k >= 30", "check": "k % 7 <> 0"}


def _sql_onset(name: str, on: str) -> str:
    return (
        f"CASE WHEN {on} THEN min(CASE WHEN {on} THEN t END) OVER (PARTITION BY session_id, b_{name} ORDER BY t, event_id "
        f"ROWS UNBOUNDED PRECEDING) END AS {name}_since"
    )


@query(
    "fire_timeline",
    "SELECT session_id, event_id, " + ", ".join(_sql_onset(n, c) for n, c in _CONDITIONS.items()) + " FROM (SELECT *, "
    + ", ".join(
        f"sum(CASE WHEN {c} THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY t, event_id) AS b_{n}" for n, c in _CONDITIONS.items()
    )
    + " FROM fx_samples)",
)
def fire_timeline(t: Tables) -> DataFrame:
    """Since when each condition has held without a break."""
    rows = tl.series(b.clocked(t).select("session_id", "event_id", "t", "k"))
    on = {n: F.expr(c) for n, c in _CONDITIONS.items()}
    marked = rows.step(lag={f"was_{n}": c for n, c in on.items()})
    starts = {
        f"{n}_start": F.when(c & ~F.coalesce(F.col(f"was_{n}"), F.lit(False)), F.col("t")) for n, c in on.items()
    }
    held = marked.step(fill=starts).result()
    since = [F.when(c, F.col(f"{n}_start")).alias(f"{n}_since") for n, c in on.items()]
    return held.select("session_id", "event_id", *since)


@query(
    "stall_detector",
    """
    SELECT session_id, event_id AS after_event, t AS stall_from, next_t AS stall_to, next_t - t AS stall_ms FROM (
      SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS next_t FROM fx_samples WHERE event_type = 'view')
    WHERE next_t - t > 800
    """,
)
def stall_detector(t: Tables) -> DataFrame:
    passes = b.clocked(t).where("event_type = 'view'").select("session_id", "event_id", "t")
    rows = tl.series(passes).step(lead={"next_t": F.col("t")}).result()
    gap = F.col("next_t") - F.col("t")
    return rows.where(gap > 800).select(
        "session_id",
        F.col("event_id").alias("after_event"),
        F.col("t").alias("stall_from"),
        F.col("next_t").alias("stall_to"),
        gap.alias("stall_ms"),
    )


@query(
    "tumbling_counts",
    f"""
    SELECT session_id, t // 500 * 500 AS window_ms, count(*) AS passes, round({sql_pct('5 + value', 0.5)}, 6) AS pass_ms_p50
    FROM fx_samples GROUP BY session_id, t // 500 * 500
    """,
)
def tumbling_counts(t: Tables) -> DataFrame:
    rows = b.clocked(t).select(
        "session_id", F.expr("t div 500 * 500").alias("window_ms"), (5 + F.col("value")).alias("pass_ms")
    )
    by = ["session_id", "window_ms"]
    table = rows.groupBy(*by).agg(F.count("*").alias("passes"))
    return rounded(
        with_percentiles(table, rows, by, {"ms": (F.col("pass_ms"), 1.0)}, [Wanted("pass_ms_p50", "ms", 0.5)])
    )


@query(
    "sliding_motion",
    """
    SELECT session_id, w AS window_ms, count(*) AS samples, round(max(value) - min(value), 6) AS spread FROM (
      SELECT session_id, value, unnest([t // 300 * 300, t // 300 * 300 - 300]) AS w FROM fx_samples) GROUP BY session_id, w
    """,
)
def sliding_motion(t: Tables) -> DataFrame:
    """Spread of the readings in 600 ms windows every 300 ms."""
    rows = b.clocked(t).select("session_id", "value", F.timestamp_millis("t").alias("at"))
    windows = rows.groupBy("session_id", F.window("at", "600 milliseconds", "300 milliseconds")).agg(
        F.count("*").alias("samples"), (F.max("value") - F.min("value")).alias("spread")
    )
    return rounded(windows.select("session_id", F.unix_millis("window.start").alias("window_ms"), "samples", "spread"))


@query(
    "session_windows",
    """
    SELECT session_id, min(t) AS from_ms, max(t) AS last_ms, count(*) AS n FROM (
      SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY t, event_id) AS run FROM (
        SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) < 21600000 THEN 0 ELSE 1 END AS brk
        FROM (SELECT user_id AS session_id, event_id, epoch_us(ts) // 1000 AS t FROM events))) GROUP BY session_id, run
    """,
)
def session_windows(t: Tables) -> DataFrame:
    """Visits of a user: activity with no six-hour silence in it.

    The built-in session window merges a key in one task; slices of a month do not.
    """
    rows = t.events.select(
        F.col("user_id").alias("session_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t")
    )
    gap = 6 * 3_600_000
    marked = ordered(rows, KEY, ORDER, 30 * 24 * 3_600_000).step(lag={"before": F.col("t")})
    fresh = F.col("before").isNull() | (F.col("t") - F.col("before") >= gap)
    visits = marked.step(fill={"from_ms": F.when(fresh, F.col("t"))}).result()
    return visits.groupBy("session_id", "from_ms").agg(F.max("t").alias("last_ms"), F.count("*").alias("n"))


@query(
    "late_data_rules",
    """
    SELECT session_id, event_id, CASE WHEN frame_at < newest THEN 'older frame' WHEN t - frame_at > 150 THEN 'stale' ELSE 'used' END AS fate
    FROM (SELECT *, max(frame_at) OVER (PARTITION BY session_id ORDER BY t, event_id) AS newest FROM (
      SELECT *, t - 4 * (k % 50) AS frame_at FROM fx_samples))
    """,
)
def late_data_rules(t: Tables) -> DataFrame:
    rows = b.clocked(t).select("session_id", "event_id", "t", (F.col("t") - 4 * (F.col("k") % 50)).alias("frame_at"))
    marked = tl.series(rows).step(peak={"newest": F.col("frame_at")}).result()
    fate = (
        F.when(F.col("frame_at") < F.col("newest"), "older frame").when(F.col("t") - F.col("frame_at") > 150, "stale").otherwise("used")
    )
    return marked.select("session_id", "event_id", fate.alias("fate"))


@query(
    "conflate_latest",
    """
    SELECT session_id, event_id, CASE WHEN later IS NULL OR later_act = 'take' THEN NULL ELSE later END AS displaced_by FROM (
      SELECT *, lead(event_id) OVER w AS later, lead(act) OVER w AS later_act FROM (
        SELECT session_id, event_id, t, CASE WHEN event_type = 'signup' THEN 'take' ELSE 'push' END AS act FROM fx_samples
        WHERE event_type NOT IN ('purchase')) WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)) WHERE act = 'push'
    """,
)
def conflate_latest(t: Tables) -> DataFrame:
    """Live jobs and the newer one that replaced each before a worker took it (captures keep their own queue)."""
    act = F.when(F.col("event_type") == "signup", "take").otherwise("push")
    rows = b.clocked(t).where("event_type <> 'purchase'").select("session_id", "event_id", "t", act.alias("act"))
    seen = tl.series(rows).step(lead={"later": F.col("event_id"), "later_act": F.col("act")}).result()
    by = F.when(F.col("later_act") == "push", F.col("later"))
    return seen.where("act = 'push'").select("session_id", "event_id", by.alias("displaced_by"))


_TAKE = "(r.event_type IN ('signup', 'click'))"
_CAPTURE = "(r.event_type = 'purchase')"


@query(
    "detect_queue",
    recursive(
        "CAST(NULL AS BIGINT) AS live, CAST([] AS BIGINT[]) AS waiting, CAST(NULL AS BIGINT) AS displaced, CAST(NULL AS BIGINT) AS taken",
        f"CASE WHEN {_TAKE} THEN CASE WHEN len(f.waiting) > 0 THEN f.live END WHEN {_CAPTURE} THEN f.live ELSE r.event_id END, "
        f"CASE WHEN {_TAKE} THEN f.waiting[2:] WHEN {_CAPTURE} THEN list_append(f.waiting, r.event_id) ELSE f.waiting END, "
        f"CASE WHEN NOT {_TAKE} AND NOT {_CAPTURE} THEN f.live END, CASE WHEN {_TAKE} THEN coalesce(f.waiting[1], f.live) END",
        "displaced, taken",
        "",
    ),
)
def detect_queue(t: Tables) -> DataFrame:
    """The whole queue: live jobs conflate, captures wait in order and are taken first."""
    kind = F.col("event_type")
    rows = b.clocked(t).select(
        "session_id",
        "event_id",
        "t",
        F.when(kind.isin("signup", "click"), "take").otherwise("push").alias("action"),
        F.when(kind == "purchase", "capture").otherwise("live").alias("priority"),
    )
    return fold(rows, m.CONFLATE).select("session_id", "event_id", "displaced", "taken")


@query(
    "nearest_unique_match",
    """
    WITH RECURSIVE fires AS MATERIALIZED (
      SELECT c.session_id, c.event_id, row_number() OVER (PARTITION BY c.session_id ORDER BY c.t, c.event_id) AS nth, coalesce(p.near, []) AS near
      FROM fx_samples c LEFT JOIN (
        SELECT c.event_id, list(p.event_id ORDER BY abs(c.t - p.t), p.t) AS near FROM fx_samples c JOIN fx_samples p
          ON p.session_id = c.session_id AND p.event_type = 'view' AND p.t BETWEEN c.t - 250 AND c.t + 50
        WHERE c.event_type = 'purchase' GROUP BY c.event_id) p USING (event_id) WHERE c.event_type = 'purchase'),
    f AS (
      SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS probe_id, CAST([] AS BIGINT[]) AS used FROM fires
      UNION ALL
      SELECT r.session_id, r.nth, r.event_id, list_filter(r.near, lambda x: NOT list_contains(f.used, x))[1],
        CASE WHEN len(list_filter(r.near, lambda x: NOT list_contains(f.used, x))) > 0 THEN list_append(f.used, list_filter(r.near, lambda x: NOT list_contains(f.used, x))[1]) ELSE f.used END
      FROM f JOIN fires r ON r.session_id = f.session_id AND r.nth = f.nth + 1)
    SELECT session_id, event_id, probe_id FROM f WHERE nth > 0
    """,
)
def nearest_unique_match(t: Tables) -> DataFrame:
    """Each fire with its own probe: the nearest in 250 ms before to 50 ms after, used once, in fire order."""
    kind = F.col("event_type")
    rows = (
        b.clocked(t)
        .where("event_type IN ('purchase', 'view')")
        .select(
            "session_id",
            "event_id",
            (F.col("t") + F.when(kind == "purchase", m.PROBE_AFTER).otherwise(0)).alias("due"),
            (kind == "purchase").alias("is_fire"),
        )
    )
    matched = folds.fold(rows, KEY, ["due", "is_fire", "event_id"], m.NEAREST_UNIQUE, FOLD_SLICE_MS)
    return matched.where("is_fire").select("session_id", "event_id", "probe_id")


@query(
    "motion_epoch",
    """
    SELECT image_id, round(score, 6) AS score, score >= 0.1 AS breaks_hold FROM (
      SELECT n.image_id, CASE WHEN p.image_id IS NOT NULL THEN avg(abs(n.luma - p.luma)) / 255 END AS score
      FROM fx_luma n LEFT JOIN fx_luma p ON p.image_id = n.image_id - 1 AND p.x = n.x AND p.y = n.y GROUP BY n.image_id, p.image_id)
    """,
)
def motion_epoch(t: Tables) -> DataFrame:
    """Mean luma change against the strip before; enough of it ends a hold."""
    strip = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 400 * v + 0.5))),
    )
    strips = t.embeddings.select(F.col("vec_id").alias("image_id"), F.lit(0).alias("camera"), strip.alias("strip"))
    rows = ordered(strips, ["camera"], ["image_id"], 4096).step(lag={"before": F.col("strip")}).result()
    total = F.aggregate(
        F.zip_with("strip", "before", lambda a, c: F.abs(a - c)), F.lit(0.0), lambda s, v: s + v
    )
    score = F.when(F.size("before") == F.size("strip"), total / F.size("strip") / 255)
    out = rows.withColumn("score", score)
    return rounded(out.select("image_id", "score", (F.col("score") >= 0.1).alias("breaks_hold")))
