"""Sequence queries: motion, agreement, hints, cadence, waits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import detection as d
from pagegauge.operators import sequences as sq
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import (
    SQL_DIAGONAL,
    rounded,
    sql_distances,
    sql_paired,
    sql_pairing,
    sql_pct,
    sql_rate,
)
from pagegauge.plans.registry import Tables, query, view

ASPECT = 16 / 9

_QUAD = "[" + ", ".join(f"struct_pack(x := {{p}}x{i} * 720, y := {{p}}y{i} * 1280)" for i in range(4)) + "]"
_PREV = ", ".join(
    f"lag(CASE WHEN shown THEN x{i} END) OVER w AS px{i}, lag(CASE WHEN shown THEN y{i} END) OVER w AS py{i}"
    for i in range(4)
)
view(
    "fx_steps",
    f"""
    SELECT *, CASE WHEN both_shown THEN list_max({sql_distances(sql_paired('qa', 'way'), 'qb', SQL_DIAGONAL)}) END AS step
    FROM (SELECT *, {sql_pairing('qa', 'qb')} AS way FROM (
      SELECT *, shown AND px0 IS NOT NULL AS both_shown, {_QUAD.format(p='')} AS qa, {_QUAD.format(p='p')} AS qb,
             CAST(720 AS DOUBLE) AS w, CAST(1280 AS DOUBLE) AS h
      FROM (SELECT *, {_PREV} FROM fx_readings WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))))
    """,
)


def steps(t: Tables) -> DataFrame:
    return sq.motion_steps(b.readings(t), 720.0, 1280.0)


@query(
    "frame_motion_steps",
    f"""
    SELECT session_id, count(step) AS pairs, round(avg(step), 6) AS mean, count(*) FILTER (step > 0.05) AS jumps,
           {sql_rate('count(*) FILTER (step > 0.05)', 'count(step)')} AS jump_rate,
           round({sql_pct('step', 0.5)}, 6) AS p50, round({sql_pct('step', 0.95)}, 6) AS p95
    FROM fx_steps GROUP BY session_id
    """,
)
def frame_motion_steps(t: Tables) -> DataFrame:
    return rounded(sq.motion_summary(steps(t)))


@query(
    "steadiest_window",
    """
    SELECT session_id, round(worst, 6) AS worst, frame FROM (
      SELECT session_id, worst, start + 2 AS frame,
             row_number() OVER (PARTITION BY session_id ORDER BY worst, start) AS place
      FROM (SELECT session_id, nth - 5 AS start, nth, n, round(max(step) OVER w, 9) AS worst, count(step) OVER w AS have
            FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS nth,
                         count(*) OVER (PARTITION BY session_id) AS n FROM fx_steps)
            WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
      WHERE start >= 2 AND nth <= n - 2 AND have = 4) WHERE place = 1
    """,
)
def steadiest_window(t: Tables) -> DataFrame:
    return rounded(sq.steadiest(steps(t), frames=5, earliest=2, tail=2))


def _sql_move(a: str, b_: str) -> str:
    parts = ", ".join(
        f"sqrt(({a}.x{i} - {b_}.x{i}) * ({a}.x{i} - {b_}.x{i}) + (({a}.y{i} - {b_}.y{i}) * {ASPECT!r}::DOUBLE) "
        f"* (({a}.y{i} - {b_}.y{i}) * {ASPECT!r}::DOUBLE)) / {(1 + ASPECT * ASPECT) ** 0.5!r}::DOUBLE"
        for i in range(4)
    )
    return f"greatest({parts})"


view("fx_seen", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS nth FROM fx_readings WHERE shown")


def shown(t: Tables) -> DataFrame:
    return b.readings(t).where("shown")


@query(
    "motion_over_window",
    f"""
    SELECT a.session_id, a.event_id, round(CASE WHEN a.t - min(r.t) >= 200 THEN max({_sql_move('a', 'r')}) END, 6)
           AS motion
    FROM fx_seen a JOIN fx_seen r ON r.session_id = a.session_id AND r.t BETWEEN a.t - 600 AND a.t
    GROUP BY a.session_id, a.event_id, a.t
    """,
)
def motion_over_window(t: Tables) -> DataFrame:
    return rounded(sq.motion_over_window(shown(t), ASPECT).select("session_id", "event_id", "motion"))


@query(
    "last_moved_at",
    f"""
    SELECT session_id, event_id, max(moved) OVER (PARTITION BY session_id ORDER BY nth) AS moved_at FROM (
      SELECT a.session_id, a.event_id, a.nth, CASE WHEN {_sql_move('a', 'r')} > 0.015 THEN a.t END AS moved
      FROM fx_seen a LEFT JOIN fx_seen r ON r.session_id = a.session_id AND r.nth = a.nth - 1)
    """,
)
def last_moved_at(t: Tables) -> DataFrame:
    return sq.last_moved_at(shown(t), ASPECT).select("session_id", "event_id", "moved_at")


@query(
    "settled_on",
    f"""
    SELECT a.session_id, a.event_id, count(*) = 3 AND a.t - min(r.t) >= 200 AND max({_sql_move('a', 'r')}) <= 0.015
           AS settled
    FROM fx_seen a JOIN fx_seen r ON r.session_id = a.session_id AND r.nth BETWEEN a.nth - 2 AND a.nth
    GROUP BY a.session_id, a.event_id, a.t
    """,
)
def settled_on(t: Tables) -> DataFrame:
    return sq.settled(shown(t), ASPECT).select("session_id", "event_id", "settled")


@query(
    "readings_agree",
    f"""
    SELECT a.session_id, a.event_id, count(*) = 3 AND max({_sql_move('a', 'r')}) <= 0.006 AS agree
    FROM fx_seen a JOIN fx_seen r ON r.session_id = a.session_id AND r.nth BETWEEN a.nth - 2 AND a.nth
    GROUP BY a.session_id, a.event_id
    """,
)
def readings_agree(t: Tables) -> DataFrame:
    return sq.agreeing(shown(t), ASPECT).select("session_id", "event_id", "agree")


@query(
    "reading_spacing",
    """
    SELECT session_id, event_id, CASE WHEN nth >= 3 THEN g[len(g) // 2 + 1] ELSE 0 END AS spacing FROM (
      SELECT session_id, event_id, nth, list_sort(list_filter(list(gap) OVER (PARTITION BY session_id ORDER BY nth
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL)) AS g
      FROM (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY nth) AS gap FROM fx_seen))
    """,
)
def reading_spacing(t: Tables) -> DataFrame:
    return sq.spacing(shown(t)).select("session_id", "event_id", "spacing")


@query(
    "watch_onset",
    """
    SELECT session_id, event_id, len(g) >= 3 AND coalesce(score > greatest(CAST(0.012 AS DOUBLE),
           3 * g[len(g) // 2 + 1]), false) AS onset FROM (
      SELECT session_id, event_id, value / 2500.0 AS score, coalesce(list_sort(list(value / 2500.0) OVER (
             PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), []) AS g
      FROM fx_samples)
    """,
)
def watch_onset(t: Tables) -> DataFrame:
    return sq.onsets(b.samples(t), F.col("err")).select("session_id", "event_id", "onset")


@query(
    "ewma_cost",
    """
    WITH RECURSIVE p AS (SELECT session_id, event_id, CASE WHEN 5 + value >= 50 THEN (5 + value) * 2 ELSE 5 + value END
                           AS charge, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS nth
                         FROM fx_samples),
    f AS (SELECT session_id, event_id, nth, CAST(charge AS DOUBLE) AS cost FROM p WHERE nth = 1 UNION ALL
          SELECT p.session_id, p.event_id, p.nth, f.cost * CAST(0.7 AS DOUBLE) + p.charge * CAST(0.3 AS DOUBLE)
          FROM f JOIN p ON p.session_id = f.session_id AND p.nth = f.nth + 1)
    SELECT session_id, event_id, round(cost + 1e-9, 6) AS cost_ms,
           round(least(CAST(400 AS DOUBLE), greatest(CAST(120 AS DOUBLE), cost / CAST(0.35 AS DOUBLE))) + 1e-9, 6) AS interval_ms
    FROM f
    """,
)
def ewma_cost(t: Tables) -> DataFrame:
    rows = sq.cost_average(b.samples(t), 5 + F.col("value"), duty=0.35, low=120.0, high=400.0)
    # Costs carry few decimals, so exact ties at the sixth place occur: both sides are nudged off them.
    nudged = [(F.col(c) + 1e-9).alias(c) for c in ("cost_ms", "interval_ms")]
    return rounded(rows.select("session_id", "event_id", *nudged))


# ── hints ────────────────────────────────────────────────────────────────────

_ACTIVE = ", ".join(
    f"CASE WHEN last_value(CASE WHEN hint_key = '{k}' THEN hint_shown END IGNORE NULLS) OVER w THEN '{k}' END"
    for k in sq.HINT_PRIORITY
)
view(
    "fx_hints",
    f"""
    SELECT session_id, event_id, t, key, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS next_t FROM (
      SELECT *, lag(key) OVER (PARTITION BY session_id ORDER BY t, event_id) AS before FROM (
        SELECT session_id, event_id, t, coalesce({_ACTIVE}) AS key FROM fx_log WHERE kind = 'hint'
        WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)))
    WHERE key IS DISTINCT FROM before
    """,
)


def changes(t: Tables) -> DataFrame:
    return sq.hint_changes(b.log(t))


def spans(t: Tables) -> DataFrame:
    return b.windows(b.clocked(t))


@query("hint_change_series", "SELECT session_id, event_id, t, key FROM fx_hints")
def hint_change_series(t: Tables) -> DataFrame:
    return changes(t)


_EXPECT = "('move-closer', 'move-back', 'move-phone')"


@query(
    "hint_window_share",
    f"""
    SELECT session_id, w.to_t - w.from_t AS ms, {sql_rate('good', '(w.to_t - w.from_t)')} AS share,
           {sql_rate('bad', '(w.to_t - w.from_t)')} AS wrong_share,
           {sql_rate('(w.to_t - w.from_t - good - bad)', '(w.to_t - w.from_t)')} AS none_share,
           CASE WHEN at_start THEN 0 ELSE first_t - w.from_t END AS first_correct_ms
    FROM (SELECT w.session_id, w.from_t, w.to_t,
            coalesce(sum(least(coalesce(next_t, w.to_t), w.to_t) - greatest(t, w.from_t)) FILTER (
              key IN {_EXPECT} AND t < w.to_t AND coalesce(next_t, w.to_t) > w.from_t), 0) AS good,
            coalesce(sum(least(coalesce(next_t, w.to_t), w.to_t) - greatest(t, w.from_t)) FILTER (
              key NOT IN {_EXPECT} AND t < w.to_t AND coalesce(next_t, w.to_t) > w.from_t), 0) AS bad,
            coalesce(bool_or(key IN {_EXPECT} AND t <= w.from_t AND (next_t IS NULL OR next_t > w.from_t)), false)
              AS at_start,
            min(t) FILTER (key IN {_EXPECT} AND t >= w.from_t AND t <= w.to_t) AS first_t
          FROM fx_windows w LEFT JOIN fx_hints h ON h.session_id = w.session_id
          GROUP BY w.session_id, w.from_t, w.to_t) w
    """,
)
def hint_window_share(t: Tables) -> DataFrame:
    table = sq.hint_window(changes(t), spans(t), ["move-closer", "move-back", "move-phone"])
    return rounded(table)


@query(
    "churn",
    """
    SELECT w.session_id, count(h.t) AS changes, count(*) FILTER (h.gap < 1500) AS fast_changes,
           min(h.gap) AS min_gap_ms,
           round(count(h.t) / greatest(0.001, (w.to_t - w.from_t) / 1000.0), 6) AS changes_per_second
    FROM fx_windows w LEFT JOIN (
      SELECT session_id, t, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS gap
      FROM fx_hints JOIN fx_windows USING (session_id) WHERE t BETWEEN from_t AND to_t) h USING (session_id)
    GROUP BY w.session_id, w.from_t, w.to_t
    """,
)
def churn(t: Tables) -> DataFrame:
    return rounded(sq.churn(changes(t), spans(t)))


# ── passes ───────────────────────────────────────────────────────────────────

view(
    "fx_passes",
    """
    SELECT *, CASE WHEN k % 2 = 1 THEN 'ml' ELSE 'classical' END AS source, k % 11 = 0 AS warm_up, 5 + value AS pass_ms,
           event_type <> 'error' AS ok, event_type <> 'error' AND k % 7 <> 0 AS accepted, err > 0.03 AS off
    FROM fx_samples
    """,
)


def passes(t: Tables) -> DataFrame:
    k = F.col("k")
    return b.samples(t).select(
        "*",
        F.when(k % 2 == 1, "ml").otherwise("classical").alias("source"),
        (k % 11 == 0).alias("warm_up"),
        (5 + F.col("value")).alias("pass_ms"),
        F.col("shown").alias("ok"),
        (F.col("shown") & (k % 7 != 0)).alias("accepted"),
        (F.col("err") > 0.03).alias("off"),
    )


@query(
    "cadence_intervals",
    f"""
    SELECT session_id, source, count(*) AS intervals,
           round(CASE WHEN avg(iv) <> 0 THEN stddev_samp(iv) / avg(iv) END, 6) AS interval_cv,
           round(CAST({sql_pct('iv', 0.5)} AS DOUBLE), 6) AS interval_p50,
           round(CAST({sql_pct('iv', 0.95)} AS DOUBLE), 6) AS interval_p95
    FROM (SELECT session_id, source, t - before_t AS iv FROM (
            SELECT *, lag(t) OVER w AS before_t, lag(source) OVER w AS before_source FROM fx_passes WHERE NOT warm_up
            WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)) p
          WHERE before_source = source AND NOT EXISTS (
            SELECT 1 FROM fx_log c WHERE c.session_id = p.session_id AND c.kind = 'capture' AND c.k >= 80
              AND p.before_t < c.t + 150 AND p.t > c.t - 50))
    GROUP BY session_id, source
    """,
)
def cadence_intervals(t: Tables) -> DataFrame:
    pauses = (
        b.log(t)
        .where("kind = 'capture' AND k >= 80")
        .select("session_id", (F.col("t") - 50).alias("pause_from"), (F.col("t") + 150).alias("pause_to"))
    )
    return rounded(sq.cadence_summary(sq.cadence(passes(t), pauses)))


@query(
    "serial_waits",
    """
    SELECT session_id, event_id, key, greatest(0, mark - greatest(since, coalesce(max(mark) OVER (
             PARTITION BY event_id ORDER BY mark, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), since))) AS ms
    FROM (SELECT session_id, event_id, kind, t - 800 AS since, unnest(['check', 'hint', 'lock']) AS key,
                 unnest([done_t, hint_t, open_t]) AS mark
          FROM (SELECT *, max(CASE WHEN kind = 'confirm-done' THEN t END) OVER w AS done_t,
                       max(CASE WHEN kind = 'hint' THEN t END) OVER w AS hint_t,
                       max(CASE WHEN kind = 'confirm-open' THEN t END) OVER w AS open_t FROM fx_log
                WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)) WHERE kind = 'capture')
    WHERE mark IS NOT NULL
    """,
)
def serial_waits(t: Tables) -> DataFrame:
    kind = F.col("kind")
    marks = {"check": "confirm-done", "hint": "hint", "lock": "confirm-open"}
    rows = (
        sq.series(b.log(t))
        .step(fill={f"{n}_at": F.when(kind == source, F.col("t")) for n, source in marks.items()})
        .result()
        .where(kind == "capture")
    )
    return sq.serial_waits(
        rows, F.col("t") - 800, {n: F.col(f"{n}_at") for n in marks}, ["session_id", "event_id"]
    )


@query(
    "ranking_first_n",
    """
    SELECT setting, scene_id, place FROM (
      SELECT setting, scene_id, row_number() OVER (PARTITION BY family, setting ORDER BY scene_id) AS place
      FROM fx_vectors) WHERE place <= 3
    """,
)
def ranking_first_n(t: Tables) -> DataFrame:
    scenes = b.vectors(t).select("family", "setting", "scene_id")
    first = d.worst_rows(scenes, ["family", "setting"], [F.col("scene_id")], 3)
    return first.select("setting", "scene_id", F.col("place").cast("bigint").alias("place"))
