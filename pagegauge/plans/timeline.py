"""Timeline queries: intervals, shares, locks, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import timeline as tl
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import rounded, sql_rate
from pagegauge.plans.registry import Tables, query, view
from pagegauge.session import written_once

view(
    "fx_intervals",
    """
    SELECT *, greatest(from_t, t) AS b, least(to_t, coalesce(next_t, to_t), t + 250) AS e2 FROM (
      SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS next_t FROM fx_samples)
    JOIN fx_windows USING (session_id) WHERE least(to_t, coalesce(next_t, to_t), t + 250) > greatest(from_t, t)
    """,
)


def series(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = written_once(b.samples(t))
    return rows, b.windows(rows)


@query("sample_timeline", 'SELECT session_id, event_id, b AS "begin", e2 AS "end", shown FROM fx_intervals')
def sample_timeline(t: Tables) -> DataFrame:
    rows, spans = series(t)
    return tl.intervals(rows, spans).select("session_id", "event_id", "begin", "end", "shown")


@query(
    "false_lock_exposure",
    f"""
    SELECT session_id, CAST(coalesce(sum(e2 - b) FILTER (shown), 0) AS BIGINT) AS shown_ms,
           CAST(coalesce(sum(e2 - b), 0) AS BIGINT) AS observed_ms,
           CAST(w.to_t - w.from_t - coalesce(sum(e2 - b), 0) AS BIGINT) AS unobserved_ms,
           {sql_rate('sum(e2 - b) FILTER (shown)', 'sum(e2 - b)')} AS share
    FROM fx_windows w LEFT JOIN fx_intervals i USING (session_id) GROUP BY session_id, w.from_t, w.to_t
    """,
)
def false_lock_exposure(t: Tables) -> DataFrame:
    return rounded(tl.false_lock_exposure(*series(t)))


_JUDGED = "shown AND frame_known AND has_page AND judged"


def _sql_weighted(p: float) -> str:
    return f"min(err) FILTER (cum >= CAST({p} AS DOUBLE) * total - 1e-9)"


@query(
    "overlay_accuracy",
    f"""
    SELECT a.*, round(p.p50, 6) AS error_p50, round(p.p95, 6) AS error_p95 FROM (
      SELECT session_id, CAST(obs - unk AS BIGINT) AS observed_ms, CAST(span - obs + unk AS BIGINT) AS unobserved_ms,
             {sql_rate('non', '(obs - unk)')} AS none_share, {sql_rate('loc', '(obs - unk)')} AS locked_share,
             {sql_rate('nea', '(obs - unk)')} AS near_share, {sql_rate('wro', '(obs - unk)')} AS wrong_share,
             {sql_rate('onn', '(obs - unk)')} AS on_nothing_share, {sql_rate('unj', '(obs - unk)')} AS unjudged_share
      FROM (SELECT session_id, w.to_t - w.from_t AS span, coalesce(sum(e2 - b), 0) AS obs,
              coalesce(sum(e2 - b) FILTER (NOT shown), 0) AS non,
              coalesce(sum(e2 - b) FILTER (shown AND NOT frame_known), 0) AS unk,
              coalesce(sum(e2 - b) FILTER (shown AND frame_known AND NOT has_page), 0) AS onn,
              coalesce(sum(e2 - b) FILTER (shown AND frame_known AND has_page AND NOT judged), 0) AS unj,
              coalesce(sum(e2 - b) FILTER ({_JUDGED} AND err <= 0.02), 0) AS loc,
              coalesce(sum(e2 - b) FILTER ({_JUDGED} AND err > 0.02 AND err <= 0.03), 0) AS nea,
              coalesce(sum(e2 - b) FILTER ({_JUDGED} AND err > 0.03), 0) AS wro
            FROM fx_windows w LEFT JOIN fx_intervals i USING (session_id) GROUP BY session_id, w.to_t, w.from_t)) a
    LEFT JOIN (
      SELECT session_id, {_sql_weighted(0.5)} AS p50, {_sql_weighted(0.95)} AS p95 FROM (
        SELECT session_id, err, sum(e2 - b) OVER (PARTITION BY session_id ORDER BY err) AS cum,
               sum(e2 - b) OVER (PARTITION BY session_id) AS total FROM fx_intervals WHERE {_JUDGED})
      GROUP BY session_id) p USING (session_id)
    """,
)
def overlay_accuracy(t: Tables) -> DataFrame:
    return rounded(tl.overlay_accuracy(*series(t)))


view(
    "fx_lock_runs",
    f"""
    SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY t, event_id) AS run FROM (
      SELECT *, CASE WHEN lag(ok) OVER w AND ok AND t - lag(t) OVER w <= 250 THEN 0 ELSE 1 END AS brk FROM (
        SELECT s.*, w.from_t, w.to_t, {_JUDGED} AND err <= 0.02 AS ok FROM fx_samples s JOIN fx_windows w
          USING (session_id) WHERE t >= from_t)
      WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))
    """,
)


@query(
    "time_to_lock",
    """
    SELECT w.session_id, min(r.start - w.from_t) AS time_to_lock_ms FROM fx_windows w LEFT JOIN (
      SELECT session_id, run, min(t) AS start FROM fx_lock_runs WHERE ok GROUP BY session_id, run
      HAVING max(t) - min(t) >= 300) r ON r.session_id = w.session_id GROUP BY w.session_id
    """,
)
def time_to_lock(t: Tables) -> DataFrame:
    return tl.time_to_lock(*series(t))


@query(
    "false_locks_per_minute",
    """
    SELECT w.session_id, count(r.run) AS locks,
           round(CASE WHEN w.to_t > w.from_t THEN count(r.run) / ((w.to_t - w.from_t) / 60000.0) END, 6) AS per_minute
    FROM fx_windows w LEFT JOIN (
      SELECT session_id, run FROM (
        SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY t, event_id) AS run FROM (
          SELECT *, CASE WHEN shown AND lag(shown) OVER w AND t - lag(t) OVER w <= 250 THEN 0 ELSE 1 END AS brk
          FROM (SELECT * FROM fx_samples JOIN fx_windows USING (session_id) WHERE t BETWEEN from_t AND to_t)
          WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)))
      WHERE shown GROUP BY session_id, run HAVING max(t) - min(t) >= 300) r ON r.session_id = w.session_id
    GROUP BY w.session_id, w.to_t, w.from_t
    """,
)
def false_locks_per_minute(t: Tables) -> DataFrame:
    return rounded(tl.false_locks_per_minute(*series(t)))


@query(
    "stale_after_swap",
    """
    SELECT session_id, outcome, CASE outcome WHEN 'never-on' THEN CAST(0 AS BIGINT) WHEN 'left' THEN left_at - from_t
           END AS ms
    FROM (
      SELECT w.session_id, w.from_t, f.left_at,
             CASE WHEN f.last_seen IS NULL OR w.to_t - w.from_t - coalesce(o.obs, 0) > 0 THEN 'unobserved'
                  WHEN f.last_on IS NULL THEN 'never-on' WHEN f.last_on = f.last_seen THEN 'stuck'
                  ELSE 'left' END AS outcome
      FROM fx_windows w LEFT JOIN (
        SELECT session_id, sum(least(to_t, coalesce(n, to_t), t + 410) - greatest(from_t, t)) AS obs FROM (
          SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS n FROM fx_samples)
        JOIN fx_windows USING (session_id)
        WHERE least(to_t, coalesce(n, to_t), t + 410) > greatest(from_t, t) GROUP BY session_id) o USING (session_id)
      LEFT JOIN (
        SELECT session_id, max(t) AS last_seen, max(t) FILTER (ison) AS last_on, max(n) FILTER (ison) AS left_at
        FROM (SELECT *, shown AND judged AND err <= 0.004 AS ison,
                     lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS n
              FROM fx_samples JOIN fx_windows USING (session_id) WHERE t BETWEEN from_t AND to_t)
        GROUP BY session_id) f USING (session_id))
    """,
)
def stale_after_swap(t: Tables) -> DataFrame:
    rows, spans = series(t)
    on_old = F.col("shown") & F.col("judged") & (F.col("err") <= 0.004)
    return tl.stale_after_swap(rows, spans, on_old, max_gap=410)


view(
    "fx_paper",
    f"""
    SELECT *, greatest(from_t, t) AS b, least(to_t, coalesce(n, to_t), t + 250) AS e2 FROM (
      SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS n,
             locked AND {_JUDGED} AND err <= 0.08 AS page, locked AND {_JUDGED} AND err <= 0.03 AS exact,
             locked AND shown AND NOT ({_JUDGED} AND err <= 0.08) AS off
      FROM fx_samples WHERE NOT capturing) JOIN fx_windows USING (session_id)
    WHERE least(to_t, coalesce(n, to_t), t + 250) > greatest(from_t, t)
    """,
)


@query(
    "paper_lock_score",
    f"""
    SELECT w.session_id, w.to_t - w.from_t AS window_ms, CAST(coalesce(obs, 0) AS BIGINT) AS observed_ms,
           CAST(w.to_t - w.from_t - coalesce(obs, 0) AS BIGINT) AS unobserved_ms,
           CAST(coalesce(locked_ms, 0) AS BIGINT) AS locked_ms, CAST(coalesce(exact_ms, 0) AS BIGINT) AS exact_ms,
           CAST(coalesce(off_ms, 0) AS BIGINT) AS wrong_lock_ms,
           {sql_rate('coalesce(locked_ms, 0)', '(w.to_t - w.from_t)')} AS locked_share,
           first_lock - w.from_t AS first_lock_ms, coalesce(dropouts, 0) AS dropouts,
           coalesce(w.to_t - first_lock, 0) AS steady_ms,
           CAST(coalesce(w.to_t - first_lock, 0) - coalesce(steady_locked, 0) AS BIGINT) AS steady_unlocked_ms
    FROM fx_windows w LEFT JOIN (
      SELECT session_id, sum(e2 - b) AS obs, sum(e2 - b) FILTER (page) AS locked_ms,
             sum(e2 - b) FILTER (exact) AS exact_ms, sum(e2 - b) FILTER (off) AS off_ms,
             min(b) FILTER (page) AS first_lock FROM fx_paper GROUP BY session_id) a USING (session_id)
    LEFT JOIN (
      SELECT session_id, count(*) FILTER (was AND NOT page) AS dropouts, sum(e2 - b) FILTER (page) AS steady_locked
      FROM (SELECT *, lag(page) OVER (PARTITION BY session_id ORDER BY b, event_id) AS was FROM fx_paper JOIN (
              SELECT session_id, min(b) FILTER (page) AS fl FROM fx_paper GROUP BY session_id) USING (session_id)
            WHERE e2 > fl) GROUP BY session_id) s USING (session_id)
    """,
)
def paper_lock_score(t: Tables) -> DataFrame:
    return rounded(tl.paper_lock(*series(t)))


def _sql_chain(fresh: str, on: str, source: str) -> str:
    return f"""
      SELECT session_id, count(*) AS runs, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(max(ms) AS BIGINT) AS longest_ms
      FROM (SELECT session_id, run, sum(e2 - b) AS ms FROM (
              SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY b, event_id) AS run FROM (
                SELECT *, CASE WHEN {fresh} THEN 1 ELSE 0 END AS brk FROM (
                  SELECT *, {on} AS ison, coalesce(lag({on}) OVER w, false) AS was, lag(e2) OVER w AS was_end
                  FROM {source} WINDOW w AS (PARTITION BY session_id ORDER BY b, event_id)))
            ) WHERE ison GROUP BY session_id, run) GROUP BY session_id"""


@query(
    "pageless_lock_score",
    _sql_chain(
        "NOT was",
        "locked",
        "(SELECT *, greatest(from_t, t) AS b, least(to_t, coalesce(n, to_t), t + 250) AS e2 FROM (SELECT *, lead(t) "
        "OVER (PARTITION BY session_id ORDER BY t, event_id) AS n FROM fx_samples WHERE NOT capturing) "
        "JOIN fx_windows USING (session_id) "
        "WHERE least(to_t, coalesce(n, to_t), t + 250) > greatest(from_t, t))",
    ),
)
def pageless_lock_score(t: Tables) -> DataFrame:
    rows, spans = series(t)
    return tl.chained_runs(tl.intervals(rows.where(~F.col("capturing")), spans), F.col("locked"), contiguous=False)


@query(
    "longest_off_run",
    _sql_chain(
        "NOT was OR was_end <> b",
        "(shown AND frame_known AND (NOT has_page OR (judged AND err > 0.03)))",
        "fx_intervals",
    ),
)
def longest_off_run(t: Tables) -> DataFrame:
    wrong = F.col("judged") & (F.col("err") > 0.03)
    off = F.col("shown") & F.col("frame_known") & (~F.col("has_page") | wrong)
    return tl.chained_runs(tl.intervals(*series(t)), off, contiguous=True)


_STEP = " + ".join(
    f"sqrt((x{i} - px{i}) * 720 * (x{i} - px{i}) * 720 + (y{i} - py{i}) * 1280 * (y{i} - py{i}) * 1280)"
    for i in range(4)
)
_LAGS = ", ".join(f"lag(x{i}) OVER w AS px{i}, lag(y{i}) OVER w AS py{i}" for i in range(4))
_VARS = " + ".join(f"var_pop(x{i} * 720) + var_pop(y{i} * 1280)" for i in range(4))


@query(
    "static_jitter",
    f"""
    SELECT session_id, count(*) AS samples, round(sqrt(({_VARS}) / 4) / sqrt(720.0 * 720 + 1280 * 1280), 6) AS rms,
           round(sum({_STEP}) / ((count(*) - 1) * 4) / sqrt(720.0 * 720 + 1280 * 1280), 6) AS mean_step
    FROM (SELECT *, {_LAGS} FROM fx_readings JOIN fx_windows USING (session_id)
          WHERE shown AND t BETWEEN from_t AND to_t WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))
    GROUP BY session_id HAVING count(*) >= 2
    """,
)
def static_jitter(t: Tables) -> DataFrame:
    rows = b.readings(t)
    return rounded(tl.static_jitter(rows, b.windows(rows), 720.0, 1280.0))
