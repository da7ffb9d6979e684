"""Automatic captures audited against the windows, marks, probes and scenes of their session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import fires as fr
from pagegauge.plans import bindings as b
from pagegauge.plans.captures import ready_windows, shutter_scene_join
from pagegauge.plans.machines import nearest_unique_match
from pagegauge.plans.registry import ORACLES, Tables, query, view
from pagegauge.session import written_once

# A shake of the hand lasts this long on both sides of the reading that shows it.
SHAKE_MS = 2000

view("fx_probe_of", ORACLES["nearest_unique_match"])
view("fx_shutter", ORACLES["shutter_scene_join"])
view(
    "fx_rules",
    f"""
    SELECT session_id, CASE name WHEN 'early' THEN 'hint' ELSE 'no_fire' END AS kind, from_t, to_t FROM fx_ready_windows UNION ALL
    SELECT session_id, 'ready', from_t, to_t FROM fx_ready_windows UNION ALL
    SELECT session_id, 'tremor', t - {SHAKE_MS}, t + {SHAKE_MS} FROM fx_log WHERE kind = 'hint' AND k % 13 = 5
    """,
)
view(
    "fx_fires",
    f"""
    WITH tap AS (SELECT * FROM fx_log WHERE kind = 'capture'),
    inside AS (
      SELECT f.event_id, count(*) FILTER (w.kind = 'tremor') AS in_tremor, count(*) FILTER (w.kind = 'no_fire') AS in_no_fire, count(*) FILTER (w.kind = 'hint') AS in_hint
      FROM tap f JOIN fx_rules w ON w.session_id = f.session_id AND f.t BETWEEN w.from_t AND w.to_t GROUP BY f.event_id),
    shown AS (SELECT f.event_id, max(w.from_t) AS at FROM tap f JOIN fx_rules w ON w.session_id = f.session_id AND w.kind = 'ready' AND w.from_t <= f.t GROUP BY f.event_id),
    stable AS (SELECT f.event_id, max(m.t) AS at FROM tap f JOIN fx_log m ON m.session_id = f.session_id AND m.kind = 'confirm-open' AND m.t <= f.t GROUP BY f.event_id),
    turned AS (SELECT f.event_id, arg_max(m.k % 4, (m.t, m.event_id)) AS page FROM tap f JOIN fx_log m ON m.session_id = f.session_id AND m.kind = 'confirm-done' AND m.t <= f.t GROUP BY f.event_id)
    SELECT *, in_no_fire > 0 OR in_tremor > 0 OR moving OR cut OR unverified OR session_id % 40 = 11 AS unsafe FROM (
      SELECT f.session_id, f.event_id, f.t, f.session_id % 6 = 0 AS covered, coalesce(i.in_tremor, 0) AS in_tremor, coalesce(i.in_no_fire, 0) AS in_no_fire, coalesce(i.in_hint, 0) AS in_hint,
        coalesce(p.page, 0)::BIGINT AS page, f.t - s.at AS latency_ms, f.t - w.at AS from_presented_ms, u.uncertain, f.k % 10 = 7 OR f.session_id % 40 = 11 AS false_fire, coalesce(u.uncertain, true) AS unverified,
        coalesce(z.motion > 0.015, false) AS moving, coalesce(NOT z.whole, false) AS cut
      FROM tap f LEFT JOIN inside i USING (event_id) LEFT JOIN shown w USING (event_id) LEFT JOIN stable s USING (event_id) LEFT JOIN turned p USING (event_id)
      LEFT JOIN (SELECT m.event_id, CASE WHEN v.k % 9 <> 2 THEN v.k % 7 = 3 END AS uncertain FROM fx_probe_of m JOIN fx_log v ON v.event_id = m.probe_id) u USING (event_id)
      LEFT JOIN fx_shutter z ON z.tap_id = f.event_id)
    """,
)


def audited(t: Tables) -> DataFrame:
    t = b.with_clock(t)
    log = b.log(t)
    k, session = F.col("k"), F.col("session_id")
    fires = log.where("kind = 'capture'").select(
        "session_id",
        "event_id",
        "t",
        (k % 10 == 7).alias("false_fire"),
        (session % 40 == 11).alias("pageless"),
        (session % 6 == 0).alias("covered"),
    )
    holds = ready_windows(t)
    kind = F.when(F.col("name") == "early", "hint").otherwise("no_fire")
    shakes = log.where("kind = 'hint' AND k % 13 = 5").select(
        "session_id", F.lit("tremor").alias("kind"), (F.col("t") - SHAKE_MS).alias("from_t"), (F.col("t") + SHAKE_MS).alias("to_t")
    )
    windows = holds.select(
        "session_id", F.explode(F.array(kind, F.lit("ready"))).alias("kind"), "from_t", "to_t"
    ).unionByName(shakes)
    stable = log.where("kind = 'confirm-open'").select(
        "session_id", "event_id", F.lit("stable").alias("kind"), "t", F.lit(None).cast("bigint").alias("page")
    )
    turned = log.where("kind = 'confirm-done'").select(
        "session_id", "event_id", F.lit("page").alias("kind"), "t", (k % 4).cast("bigint").alias("page")
    )
    seen = log.select(
        "session_id", F.col("event_id").alias("probe_id"), F.when(k % 9 != 2, k % 7 == 3).alias("uncertain")
    )
    probes = nearest_unique_match(t).where("probe_id IS NOT NULL").join(seen, ["session_id", "probe_id"])
    scenes = shutter_scene_join(t).withColumnRenamed("tap_id", "event_id")
    return fr.audit_fires(fires, windows, stable.unionByName(turned), probes, scenes)


@query("auto_fire_audit", "SELECT * FROM fx_fires")
def auto_fire_audit(t: Tables) -> DataFrame:
    """Each automatic capture: windows it lies in, page, latencies, corners, motion, and whether it was unsafe."""
    return audited(t)


def _count(condition: str, name: str) -> str:
    return f"count(f.event_id) FILTER ({condition}) AS {name}"


@query(
    "auto_fire_summary",
    f"""
    WITH repeated AS (SELECT session_id, sum(n - 1)::BIGINT AS n, count(*) FILTER (good > 0) AS pages FROM (
        SELECT session_id, page, count(*) AS n, count(*) FILTER (NOT false_fire) AS good FROM fx_fires GROUP BY session_id, page) GROUP BY session_id),
    counted AS (
      SELECT w.session_id, count(f.event_id) AS fires, {_count('false_fire', 'false_fires')}, {_count('in_tremor > 0', 'fires_in_tremor')}, {_count('in_no_fire > 0', 'fires_in_no_fire')},
        {_count('in_hint > 0', 'fires_in_hint')}, {_count('uncertain', 'fires_uncertain')}, {_count('unverified', 'fires_unverified')}, {_count('moving', 'fires_moving')}, {_count('cut', 'fires_cut')},
        {_count('unsafe', 'fires_unsafe')}, {_count('covered', 'fires_on_covered')},
        list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[CAST(ceil(0.5 * count(latency_ms)) AS BIGINT)]::DOUBLE AS latency_p50,
        list_sort(list(from_presented_ms) FILTER (from_presented_ms IS NOT NULL))[CAST(ceil(0.5 * count(from_presented_ms)) AS BIGINT)]::DOUBLE AS presented_p50
      FROM fx_windows w LEFT JOIN fx_fires f ON f.session_id = w.session_id GROUP BY w.session_id)
    SELECT c.*, coalesce(r.pages, 0) AS pages_fired, coalesce(r.n, 0) AS repeat_fires FROM counted c LEFT JOIN repeated r ON r.session_id = c.session_id
    """,
)
def auto_fire_summary(t: Tables) -> DataFrame:
    t = b.with_clock(t)
    rows = written_once(audited(t))
    return fr.fire_summary(rows, b.windows(b.clocked(t)))
