"""Session-level queries and the percentile conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import captures as cap
from pagegauge.operators import gates as gt
from pagegauge.operators import sessions as ss
from pagegauge.operators import timeline as tl
from pagegauge.operators.detection import rate
from pagegauge.operators.percentiles import LINEAR, LOWER_MIDDLE, WEIGHTED, Wanted, finite, never, percentiles, with_percentiles
from pagegauge.plans import bindings as b
from pagegauge.plans import captures as cp
from pagegauge.plans import sequences as seq
from pagegauge.plans.detection import rounded, sql_pct, sql_rate
from pagegauge.plans.registry import Tables, query, view
from pagegauge.session import written_once


# ── percentile conventions ───────────────────────────────────────────────────


@query(
    "percentile_nearest_rank",
    f"SELECT l_returnflag, {sql_pct('l_extendedprice', 0.5)} AS p50, {sql_pct('l_extendedprice', 0.95)} AS p95 FROM lineitem GROUP BY l_returnflag",
)
def percentile_nearest_rank(t: Tables) -> DataFrame:
    price = {"price": (F.col("l_extendedprice"), 50.0)}
    return percentiles(t.lineitem, ["l_returnflag"], price, [Wanted("p50", "price", 0.5), Wanted("p95", "price", 0.95)])


@query(
    "percentile_linear",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
)
def percentile_linear(t: Tables) -> DataFrame:
    price = {"price": (F.col("l_extendedprice"), 50.0)}
    table = percentiles(
        t.lineitem, ["l_returnflag"], price, [Wanted("p50", "price", 0.5, LINEAR), Wanted("p90", "price", 0.9, LINEAR)]
    )
    return table.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


@query(
    "percentile_never",
    """
    SELECT l_linestatus, CASE WHEN s[(n - 1) // 2 + 1] < 1e300 THEN s[(n - 1) // 2 + 1] END AS p50, CASE WHEN s[CAST(ceil(0.9::DOUBLE * n) AS BIGINT)] < 1e300 THEN s[CAST(ceil(0.9::DOUBLE * n) AS BIGINT)] END AS p90
    FROM (SELECT l_linestatus, list_sort(list(CASE WHEN l_linenumber <> 7 OR l_tax > 0.02 THEN l_quantity ELSE 1e308 END)) AS s, count(*) AS n FROM lineitem GROUP BY l_linestatus)
    """,
)
def percentile_never(t: Tables) -> DataFrame:
    value = never(F.when((F.col("l_linenumber") != 7) | (F.col("l_tax") > 0.02), F.col("l_quantity")))
    wanted = [Wanted("p50", "q", 0.5, LOWER_MIDDLE), Wanted("p90", "q", 0.9)]
    return percentiles(t.lineitem, ["l_linestatus"], {"q": (value, 1.0)}, wanted)


_WEIGHTED = """
    SELECT l_returnflag, min(v) FILTER (cum >= 0.5::DOUBLE * total - 1e-9) AS p50, min(v) FILTER (cum >= 0.95::DOUBLE * total - 1e-9) AS p95 FROM (
      SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS cum, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)
    GROUP BY l_returnflag"""


@query("percentile_weighted", _WEIGHTED)
def percentile_weighted(t: Tables) -> DataFrame:
    wanted = [Wanted("p50", "price", 0.5, WEIGHTED), Wanted("p95", "price", 0.95, WEIGHTED)]
    return percentiles(
        t.lineitem, ["l_returnflag"], {"price": (F.col("l_extendedprice"), 50.0)}, wanted, weight=F.col("l_quantity")
    )


@query("median_even_avg", "SELECT l_suppkey, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY l_suppkey")
def median_even_avg(t: Tables) -> DataFrame:
    table = percentiles(
        t.lineitem, ["l_suppkey"], {"price": (F.col("l_extendedprice"), 50.0)}, [Wanted("med", "price", 0.5, LINEAR)]
    )
    return table.select("l_suppkey", F.round("med", 4).alias("med"))


@query(
    "weighted_median",
    "SELECT l_suppkey, min(v) FILTER (cum >= 0.5::DOUBLE * total - 1e-9) AS med FROM (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS cum, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) GROUP BY l_suppkey",
)
def weighted_median(t: Tables) -> DataFrame:
    price = {"price": (F.col("l_extendedprice"), 50.0)}
    return percentiles(t.lineitem, ["l_suppkey"], price, [Wanted("med", "price", 0.5, WEIGHTED)], weight=F.col("l_quantity"))


@query(
    "mean_and_rate",
    f"""
    SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linenumber <> 7), 6) AS mean_quantity, {sql_rate('count(*) FILTER (l_discount > 0.05)', 'count(*)')} AS discounted_rate,
      {sql_rate('count(*) FILTER (l_tax > 1)', 'count(*) FILTER (l_linenumber > 99)')} AS no_whole FROM lineitem GROUP BY l_returnflag
    """,
)
def mean_and_rate(t: Tables) -> DataFrame:
    """Means leave out what is not a number; a rate without a whole is null."""
    value = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return rounded(
        t.lineitem.groupBy("l_returnflag").agg(
            F.avg(finite(value)).alias("mean_quantity"),
            rate(F.count_if(F.col("l_discount") > 0.05), F.count("*")).alias("discounted_rate"),
            rate(F.count_if(F.col("l_tax") > 1), F.count_if(F.col("l_linenumber") > 99)).alias("no_whole"),
        )
    )


@query(
    "least_squares_slope",
    "SELECT user_id, event_type, CASE WHEN count(*) >= 3 THEN round(regr_slope(value, event_id / 1000.0), 6) END AS slope FROM events GROUP BY user_id, event_type",
)
def least_squares_slope(t: Tables) -> DataFrame:
    return rounded(t.events.groupBy("user_id", "event_type").agg(ss.slope(F.col("value"), F.col("event_id") / 1000.0).alias("slope")))


# ── sessions ─────────────────────────────────────────────────────────────────


@query(
    "pass_summary",
    f"""
    SELECT session_id, source_key, count(*) AS passes, count(*) FILTER (ok) AS answered, count(*) FILTER (accepted) AS accepted, count(*) FILTER (frame_known AND has_page) AS page_passes,
      count(*) FILTER (frame_known AND NOT has_page) AS no_page_passes, count(*) FILTER (NOT frame_known) AS unknown_passes,
      {sql_rate('count(*) FILTER (accepted AND frame_known AND has_page AND off)', 'count(*) FILTER (accepted AND frame_known AND has_page)')} AS wrong_rate,
      {sql_rate('count(*) FILTER (accepted AND frame_known AND NOT has_page)', 'count(*) FILTER (frame_known AND NOT has_page)')} AS false_positive_rate,
      round({sql_pct('pass_ms', 0.5)}, 6) AS ms_p50, round({sql_pct('pass_ms', 0.95)}, 6) AS ms_p95
    FROM (SELECT *, source || CASE WHEN warm_up THEN ' warm-up' ELSE '' END AS source_key FROM fx_passes) GROUP BY session_id, source_key
    """,
)
def pass_summary(t: Tables) -> DataFrame:
    return rounded(ss.pass_summary(seq.passes(t)))


@query(
    "session_perf",
    """
    SELECT session_id, count(task) AS long_tasks, round(count(task) / ((any_value(to_t) - any_value(from_t)) / 60000.0), 6) AS long_tasks_per_minute,
      round(coalesce(sum(task), 0) / (any_value(to_t) - any_value(from_t)), 6) AS long_task_share, round(max(task), 6) AS long_task_max, round(arg_min(heap, t), 6) AS heap_start,
      round(arg_max(heap, t), 6) AS heap_end, round(max(heap), 6) AS heap_max, CASE WHEN count(heap) >= 3 THEN round(regr_slope(heap, (t - from_t) / 60000.0), 5) END AS heap_slope
    FROM (SELECT *, CASE WHEN 5 + value >= 50 THEN 5 + value END AS task, CASE WHEN k % 2 = 0 THEN 100 + k / 10.0 END::DOUBLE AS heap FROM fx_samples JOIN fx_windows USING (session_id) WHERE t BETWEEN from_t AND to_t)
    GROUP BY session_id
    """,
)
def session_perf(t: Tables) -> DataFrame:
    rows = b.samples(t)
    heap = F.when(F.col("k") % 2 == 0, 100 + F.col("k") / 10.0)
    table = ss.performance(rows, b.windows(rows), 5 + F.col("value"), heap)
    slope = F.round("heap_slope", 5)
    return rounded(table.withColumn("heap_slope", slope))


@query(
    "startup_latency",
    """
    SELECT s.session_id, coalesce(ready_t, ml_t) - camera_t AS camera_to_ml_ms, CASE WHEN ready_t IS NOT NULL THEN 'ml-ready' WHEN ml_t IS NOT NULL THEN 'first ML pass' END AS ml_from, l.lock AS camera_to_lock_ms
    FROM (SELECT session_id, min(t) AS camera_t, min(t) FILTER (k = 77) AS ready_t, min(t) FILTER (k % 2 = 1) AS ml_t FROM fx_samples GROUP BY session_id) s
    LEFT JOIN (SELECT session_id, min(start - from_t) AS lock FROM (SELECT session_id, run, from_t, min(t) AS start FROM fx_lock_runs WHERE ok GROUP BY session_id, run, from_t HAVING max(t) - min(t) >= 300) GROUP BY session_id) l USING (session_id)
    """,
)
def startup_latency(t: Tables) -> DataFrame:
    rows = b.samples(t)
    marked = rows.select(
        "session_id",
        "t",
        (F.col("k") == 77).alias("is_ready_event"),
        F.when(F.col("k") % 2 == 1, "ml").otherwise("classical").alias("source"),
    )
    return ss.startup(marked, tl.time_to_lock(rows, b.windows(rows)))


@query(
    "leak_summary",
    """
    SELECT o_custkey, own, count(*) AS created, count(*) FILTER (o_orderstatus = 'O') AS alive, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS alive_before
    FROM (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS own, o_orderstatus FROM orders) GROUP BY o_custkey, own
    """,
)
def leak_summary(t: Tables) -> DataFrame:
    """Workers created and never ended, the bench's own beside the others."""
    alive = F.col("o_orderstatus") == "O"
    own = (F.col("o_orderpriority") == "1-URGENT").alias("own")
    return t.orders.groupBy("o_custkey", own).agg(
        F.count("*").alias("created"),
        F.count_if(alive).alias("alive"),
        F.count_if(alive & (F.col("o_orderkey") % 2 == 0)).alias("alive_before"),
    )


@query(
    "capture_detect_summary",
    """
    SELECT session_id, count(*) AS detects, count(*) FILTER (CASE k % 5 WHEN 0 THEN true WHEN 1 THEN k % 2 = 0 AND coalesce(ml < t, false) ELSE false END) AS fall_through,
      CASE WHEN count(*) FILTER (k % 3 <> 0) > 0 THEN count(*) FILTER (k % 3 = 1) END AS downgraded
    FROM (SELECT *, min(CASE WHEN k % 2 = 1 THEN t END) OVER (PARTITION BY session_id) AS ml FROM fx_samples) WHERE event_type = 'purchase' GROUP BY session_id
    """,
)
def capture_detect_summary(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = b.clocked(t).select(
        "session_id",
        "t",
        (F.col("event_type") == "purchase").alias("is_capture_detect"),
        F.when(k % 2 == 1, "ml").otherwise("classical").alias("source"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, None).otherwise(False).alias("fell_through"),
        F.when(k % 3 == 1, "busy").when(k % 3 == 2, "ready").alias("ml_skipped"),
    )
    return ss.capture_detects(rows)


@query(
    "occlusion_hint_time",
    """
    SELECT session_id, CAST(coalesce(sum(sp) FILTER (k % 8 = 0), 0) AS BIGINT) AS unknown_ms, CAST(coalesce(sum(sp) FILTER (k % 6 = 0), 0) AS BIGINT) AS inferred_ms, CAST(coalesce(sum(sp) FILTER (k % 15 = 0), 0) AS BIGINT) AS separate_ms,
      CAST(coalesce(sum(sp) FILTER (key = 'corner-covered' AND k % 8 = 0), 0) AS BIGINT) AS covered_hint_right_ms, CAST(coalesce(sum(sp) FILTER (key = 'corner-covered' AND k % 8 <> 0), 0) AS BIGINT) AS covered_hint_wrong_ms,
      CAST(coalesce(sum(sp) FILTER (key = 'separate-sheets'), 0) AS BIGINT) AS separate_hint_ms
    FROM (SELECT s.session_id, s.k, least(s.n - s.t, 400) AS sp, h.key FROM (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS n FROM fx_samples) s
      ASOF LEFT JOIN fx_hints h ON s.session_id = h.session_id AND s.t >= h.t WHERE s.n IS NOT NULL) GROUP BY session_id
    """,
)
def occlusion_hint_time(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = b.clocked(t).select(
        "session_id", "event_id", "t", (k % 8 == 0).alias("unknown"), (k % 6 == 0).alias("inferred"), (k % 15 == 0).alias("separate")
    )
    return ss.occlusion_hint_time(rows, seq.changes(t))


_CUE = """
    SELECT w.session_id, coalesce(on_ms, 0)::BIGINT AS on_ms, coalesce(countdown_ms, 0)::BIGINT AS countdown_ms, coalesce(on_page_ms, 0)::BIGINT AS on_page_ms, coalesce(off_page_ms, 0)::BIGINT AS off_page_ms,
      coalesce(no_page_ms, 0)::BIGINT AS no_page_ms, coalesce(eligible_ms, 0)::BIGINT AS eligible_ms, coalesce(eligible_on_ms, 0)::BIGINT AS eligible_on_ms
    FROM fx_windows w LEFT JOIN (
      SELECT session_id, sum(e2 - b) FILTER (ready) AS on_ms, sum(e2 - b) FILTER (ready AND countdown IS NOT NULL) AS countdown_ms,
        sum(e2 - b) FILTER (ready AND frame_known AND has_page AND shown AND judged AND err <= 0.02) AS on_page_ms, sum(e2 - b) FILTER (ready AND frame_known AND has_page AND shown AND judged AND err > 0.02) AS off_page_ms,
        sum(e2 - b) FILTER (ready AND frame_known AND NOT has_page) AS no_page_ms FROM fx_intervals GROUP BY session_id) a USING (session_id)
    LEFT JOIN (SELECT i.session_id, sum(least(e2, r.to_t) - greatest(b, r.from_t)) AS eligible_ms, sum(least(e2, r.to_t) - greatest(b, r.from_t)) FILTER (i.ready) AS eligible_on_ms
      FROM (SELECT session_id, ready, b, e2 FROM fx_intervals) i JOIN fx_ready_windows r ON r.session_id = i.session_id AND i.b < r.to_t AND i.e2 > r.from_t GROUP BY i.session_id) o USING (session_id)"""
view("fx_cue", _CUE)


def cue(t: Tables) -> DataFrame:
    rows = b.samples(t)
    return ss.ready_cue(rows, b.windows(rows), cp.ready_windows(t))


@query(
    "guidance_score",
    f"SELECT *, on_page_ms + off_page_ms + no_page_ms AS judged_ms, {sql_rate('on_page_ms', '(on_page_ms + off_page_ms + no_page_ms)')} AS precision, {sql_rate('eligible_on_ms', 'eligible_ms')} AS recall FROM fx_cue",
)
def guidance_score(t: Tables) -> DataFrame:
    return rounded(cue(t))


@query(
    "guidance_summary",
    f"""
    SELECT session_id % 8 AS script, count(*) AS runs, sum(on_ms)::BIGINT AS on_ms, {sql_rate('sum(on_page_ms)', 'sum(on_page_ms + off_page_ms + no_page_ms)')} AS precision,
      {sql_rate('sum(eligible_on_ms)', 'sum(eligible_ms)')} AS recall, {sql_rate('sum(no_page_ms)', 'sum(on_ms)')} AS no_page_share FROM fx_cue GROUP BY session_id % 8
    """,
)
def guidance_summary(t: Tables) -> DataFrame:
    """Cue quality pooled over the runs of a script: sums of time before the ratio is taken."""
    pooled = cue(t).groupBy((F.col("session_id") % 8).alias("script")).agg(
        F.count("*").alias("runs"),
        *[F.sum(c).alias(c) for c in ("on_ms", "on_page_ms", "judged_ms", "eligible_ms", "eligible_on_ms", "no_page_ms")],
    )
    return rounded(
        pooled.select(
            "script",
            "runs",
            "on_ms",
            rate(F.col("on_page_ms"), F.col("judged_ms")).alias("precision"),
            rate(F.col("eligible_on_ms"), F.col("eligible_ms")).alias("recall"),
            rate(F.col("no_page_ms"), F.col("on_ms")).alias("no_page_share"),
        )
    )


_POOL = {"shown_ms": "shown", "locked_ms": "shown AND frame_known AND has_page AND judged AND err <= 0.02", "wrong_ms": "shown AND frame_known AND has_page AND judged AND err > 0.03"}


@query(
    "session_summary",
    f"""
    SELECT script, count(*) AS runs, {sql_rate('sum(shown_ms)', 'sum(obs)')} AS shown_share, {sql_rate('sum(locked_ms)', 'sum(obs)')} AS locked_share, {sql_rate('sum(wrong_ms)', 'sum(obs)')} AS wrong_share,
      sum(span - obs)::BIGINT AS unobserved_ms, sum(captures)::BIGINT AS captures, {sql_rate('sum(opened)', 'sum(captures)')} AS opened_rate, max(longest)::BIGINT AS longest_capture_ms,
      count(*) FILTER (captures = 0) AS runs_without_capture, count(lock) AS locked_runs,
      CASE WHEN list_sort(list(coalesce(lock, 1e18::DOUBLE)))[(count(*) - 1) // 2 + 1] < 1e17 THEN list_sort(list(coalesce(lock, 1e18::DOUBLE)))[(count(*) - 1) // 2 + 1] END AS lock_p50
    FROM (SELECT w.session_id % 8 AS script, w.to_t - w.from_t AS span, coalesce(i.obs, 0) AS obs, coalesce(i.shown_ms, 0) AS shown_ms, coalesce(i.locked_ms, 0) AS locked_ms, coalesce(i.wrong_ms, 0) AS wrong_ms,
        coalesce(c.captures, 0) AS captures, coalesce(c.opened, 0) AS opened, c.longest, l.lock
      FROM fx_windows w LEFT JOIN (SELECT session_id, sum(e2 - b) AS obs, {', '.join(f'coalesce(sum(e2 - b) FILTER ({v}), 0) AS {n}' for n, v in _POOL.items())} FROM fx_intervals GROUP BY session_id) i USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS captures, count(open_t) AS opened, max(open_t - t) AS longest FROM fx_stitched GROUP BY session_id) c USING (session_id)
      LEFT JOIN (SELECT session_id, min(start - from_t) AS lock FROM (SELECT session_id, run, from_t, min(t) AS start FROM fx_lock_runs WHERE ok GROUP BY session_id, run, from_t HAVING max(t) - min(t) >= 300) GROUP BY session_id) l USING (session_id))
    GROUP BY script
    """,
)
def session_summary(t: Tables) -> DataFrame:
    """Runs of a script pooled: shares of pooled time, never means of shares; a run that never locked is last."""
    rows = written_once(b.samples(t))
    spans = b.windows(rows)
    times = tl.observed(tl.intervals(rows, spans), spans, {n: F.expr(v) for n, v in _POOL.items()})
    taps = cp.stitched(t).groupBy("session_id").agg(
        F.count("*").alias("captures"), F.count("open_t").alias("opened"), F.max(F.col("open_t") - F.col("t")).alias("longest")
    )
    per_run = (
        times.join(taps, "session_id", "left")
        .join(tl.time_to_lock(rows, spans), "session_id", "left")
        .fillna({"captures": 0, "opened": 0})
        .withColumn("script", F.col("session_id") % 8)
    )
    c = F.col
    observed = F.sum("observed_ms")
    table = per_run.groupBy("script").agg(
        F.count("*").alias("runs"),
        rate(F.sum("shown_ms"), observed).alias("shown_share"),
        rate(F.sum("locked_ms"), observed).alias("locked_share"),
        rate(F.sum("wrong_ms"), observed).alias("wrong_share"),
        F.sum("unobserved_ms").alias("unobserved_ms"),
        F.sum("captures").alias("captures"),
        rate(F.sum("opened"), F.sum("captures")).alias("opened_rate"),
        F.max("longest").alias("longest_capture_ms"),
        F.count_if(c("captures") == 0).alias("runs_without_capture"),
        F.count("time_to_lock_ms").alias("locked_runs"),
    )
    lock = {"lock": (never(c("time_to_lock_ms")), 10.0)}
    return rounded(with_percentiles(table, per_run, ["script"], lock, [Wanted("lock_p50", "lock", 0.5, LOWER_MIDDLE)]))


view(
    "fx_grid",
    """
    SELECT g.session_id, g.name, g.at AS moment, s.t AS seen_t, s.k, coalesce(s.frame_known AND s.has_page, false) AS known, s.ready, h.key
    FROM (SELECT session_id, name, unnest(range(from_t, to_t, 50)) AS at FROM fx_ready_windows) g
    ASOF LEFT JOIN fx_samples s ON g.session_id = s.session_id AND g.at >= s.t ASOF LEFT JOIN fx_hints h ON g.session_id = h.session_id AND g.at >= h.t
    """,
)


def _ms(condition: str) -> str:
    return f"count(*) FILTER ({condition}) * 50"


@query(
    "visibility_score",
    f"""
    SELECT session_id, name, count(*) * 50 AS ms, {_ms('ready AND moment - seen_t <= 300')} AS ready_ms, {_ms('NOT known')} AS unknown_ms, {_ms('known AND k < 70')} AS visible_ms, {_ms('known AND k >= 70')} AS hidden_ms,
      {_ms('known AND k < 50')} AS clear_ms, {_ms("known AND k < 50 AND key = 'move-back'")} AS move_back_false_ms, {_ms("known AND k >= 70 AND key = 'move-back'")} AS move_back_right_ms,
      {sql_rate('count(*) FILTER (known AND k < 70)', 'count(*) FILTER (known)')} AS visible_share, {sql_rate("count(*) FILTER (known AND k < 50 AND key = 'move-back')", 'count(*) FILTER (known AND k < 50)')} AS move_back_false_share
    FROM fx_grid GROUP BY session_id, name
    """,
)
def visibility_score(t: Tables) -> DataFrame:
    k = F.col("k")
    return rounded(ss.visibility(cp.ready_windows(t), b.samples(t), seq.changes(t), k < 70, k < 50))


@query(
    "framing_score",
    f"""
    SELECT session_id, name, round(max(CASE WHEN known THEN 0.5 + k / 200.0 END) FILTER (moment = first_at), 6) AS fill_at_start, count(*) * 50 AS ms, {_ms("key = 'move-closer'")} AS closer_ms,
      {_ms("key = 'move-closer' AND known AND 0.5 + k / 200.0 >= 0.78")} AS closer_wrong_ms, {_ms("key = 'move-back'")} AS move_back_ms, {_ms("key NOT IN ('move-closer', 'move-back')")} AS other_ms
    FROM (SELECT *, min(moment) OVER (PARTITION BY session_id, name) AS first_at FROM fx_grid) GROUP BY session_id, name
    """,
)
def framing_score(t: Tables) -> DataFrame:
    fill = 0.5 + F.col("k") / 200.0
    return rounded(ss.framing(cp.ready_windows(t), b.samples(t), seq.changes(t), fill))


@query(
    "framing_cell_summary",
    f"""
    SELECT o_orderpriority AS view_name, o_orderstatus AS paper, n AS holds, {sql_rate('ready_n', 'n')} AS ready_share, {sql_rate('soon', 'n')} AS within_target, round(ch, 6) AS changes,
      CASE WHEN s[(n - 1) // 2 + 1] < 1e300 THEN round(s[(n - 1) // 2 + 1], 6) END AS ready_p50, CASE WHEN s[CAST(ceil(0.9::DOUBLE * n) AS BIGINT)] < 1e300 THEN round(s[CAST(ceil(0.9::DOUBLE * n) AS BIGINT)], 6) END AS ready_p90
    FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 9 <> 0) AS ready_n, count(*) FILTER (o_orderkey % 9 <> 0 AND o_totalprice / 100 <= 2500) AS soon, avg(o_custkey % 7) AS ch,
        list_sort(list(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 100 ELSE 1e308 END)) AS s FROM orders GROUP BY 1, 2)
    """,
)
def framing_cell_summary(t: Tables) -> DataFrame:
    holds = t.orders.select(
        F.col("o_orderpriority").alias("view_name"),
        F.col("o_orderstatus").alias("paper"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 100).alias("ready_ms"),
        (F.col("o_custkey") % 7).alias("changes"),
    )
    return rounded(ss.framing_cells(holds, ["view_name", "paper"]))


@query(
    "replay_summary",
    f"""
    SELECT s.session_id, s.first_accepted - s.t0 AS first_accepted_ms, s.first_shown - s.t0 AS first_shown_ms, i.share AS shown_share, s.passes, p.pushed, round(p.fps, 6) AS fps, c.captures
    FROM (SELECT session_id, min(t) AS t0, min(t) FILTER (accepted AND NOT warm_up) AS first_accepted, min(t) FILTER (shown) AS first_shown, count(*) FILTER (NOT warm_up) AS passes FROM fx_passes GROUP BY session_id) s
    JOIN (SELECT session_id, {sql_rate('sum(e2 - b) FILTER (shown)', 'sum(e2 - b)')} AS share FROM fx_intervals GROUP BY session_id) i USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) AS pushed, CASE WHEN max(t) > min(t) THEN (count(*) - 1) * 1000 / (max(t) - min(t)) END AS fps FROM fx_samples WHERE event_type = 'click' GROUP BY session_id) p USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) AS captures FROM fx_log WHERE kind = 'capture' GROUP BY session_id) c USING (session_id)
    """,
)
def replay_summary(t: Tables) -> DataFrame:
    """Per clip: first answers, how much of the time something was shown, stream rate, captures."""
    rows = seq.passes(t)
    spans = b.windows(rows)
    c = F.col
    first = rows.groupBy("session_id").agg(
        F.min("t").alias("t0"),
        F.min(F.when(c("accepted") & ~c("warm_up"), c("t"))).alias("first_accepted"),
        F.min(F.when(c("shown"), c("t"))).alias("first_shown"),
        F.count_if(~c("warm_up")).alias("passes"),
    )
    shares = tl.false_lock_exposure(rows, spans).select("session_id", c("share").alias("shown_share"))
    fps = ss.push_rate(rows.where("event_type = 'click'"))
    taps = rows.where("event_type = 'purchase'").groupBy("session_id").agg(F.count("*").alias("captures"))
    table = first.join(shares, "session_id").join(fps, "session_id", "left").join(taps, "session_id", "left")
    return rounded(
        table.select(
            "session_id",
            (c("first_accepted") - c("t0")).alias("first_accepted_ms"),
            (c("first_shown") - c("t0")).alias("first_shown_ms"),
            "shown_share",
            "passes",
            "pushed",
            "fps",
            "captures",
        )
    )


@query(
    "outcome_order",
    "SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, day",
)
def outcome_order(t: Tables) -> DataFrame:
    """All days, the busiest first."""
    days = t.lineitem.groupBy(F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("day"))
    return days.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day")


@query(
    "stream_gate",
    """
    SELECT session_id, 'unscoredCaptures' AS metric, CAST(count(*) FILTER (k % 11 = 3) AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS lim, 'over limit' AS problem
    FROM fx_log WHERE kind = 'capture' GROUP BY session_id HAVING count(*) FILTER (k % 11 = 3) > 0
    """,
)
def stream_gate(t: Tables) -> DataFrame:
    """The batch form of the live gate: absolute limits on a metric table (the stream runs it per micro-batch)."""
    unscored = b.log(t).where("kind = 'capture'").groupBy("session_id").agg(
        F.count_if(F.col("k") % 11 == 3).cast("double").alias("value")
    )
    metrics = unscored.select("session_id", F.lit("unscoredCaptures").alias("metric"), "value")
    return gt.absolute_violations("session", metrics, ["session_id"])


@query(
    "table_function",
    "SELECT session_id, event_id, unnest(range(b, e2, 100)) AS at FROM fx_intervals",
)
def table_function(t: Tables) -> DataFrame:
    """One interval to many moments, as a lateral join."""
    rows = b.samples(t)
    held = tl.intervals(rows, b.windows(rows)).select("session_id", "event_id", "begin", "end")
    steps = F.explode(F.sequence("begin", F.col("end") - 1, F.lit(100).cast("bigint")))
    return held.select("session_id", "event_id", steps.alias("at"))


@query(
    "predicate_hook",
    "SELECT o_orderpriority AS grp, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS large, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1",
)
def predicate_hook(t: Tables) -> DataFrame:
    """Membership and predicates handed in as named expressions."""
    predicates = {"large": F.col("o_totalprice") > 250000, "done": F.col("o_orderstatus") == "F"}
    return t.orders.groupBy(F.col("o_orderpriority").alias("grp")).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in predicates.items()]
    )
