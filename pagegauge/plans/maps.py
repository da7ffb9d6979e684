"""Coordinate maps of the scenes, judged on their grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.functions.staging import once
from pagegauge.operators import maps as mp
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import rounded, sql_scale
from pagegauge.plans.registry import Tables, query, view
from pagegauge.plans.rules import production

SIDE = 5
# How far a scene's nodes stray, by its number: from nearly flat to folded.
STRAY = (0.02, 0.1, 0.6, 1.5)


def _sql_node(axis: str, low: str, size: str, offset: int) -> str:
    u, v = f"(k % {SIDE})::DOUBLE / {SIDE - 1}", f"(k // {SIDE})::DOUBLE / {SIDE - 1}"
    flat = f"(1 - {v}) * ((1 - {u}) * q[1].{axis} + {u} * q[2].{axis}) + {v} * ((1 - {u}) * q[4].{axis} + {u} * q[3].{axis})"
    return (
        f"list_transform(range({SIDE * SIDE}), lambda k: CASE WHEN scene_id % 50 <> 17 OR k <> 12 "
        f"THEN 2 * ({flat} - {low}) / ({size} - 1) - 1 + stray * e[k + {offset + 1}] END)"
    )


def _sql_ends(axis: str, most: int) -> str:
    values = f"list_transform(q, lambda p: p.{axis})"
    pad = f"0.08 * (list_max({values}) - list_min({values}))"
    return (
        f"floor(greatest(0, list_min({values}) - {pad}))::DOUBLE AS {axis}_from, "
        f"ceil(least({most}, list_max({values}) + {pad}))::DOUBLE AS {axis}_to"
    )


view(
    "fx_maps",
    f"""
    SELECT scene_id, q, x_from AS l, y_from AS t, cw, ch, {_sql_node('x', 'x_from', 'cw', 0)} AS gx, {_sql_node('y', 'y_from', 'ch', 25)} AS gy
    FROM (SELECT *, greatest(2, x_to - x_from) AS cw, greatest(2, y_to - y_from) AS ch, [{', '.join(f'{s}::DOUBLE' for s in STRAY)}][scene_id % 4 + 1] AS stray
      FROM (SELECT *, {_sql_ends('x', 720)}, {_sql_ends('y', 1280)} FROM (SELECT scene_id, e, {sql_scale('quad')} AS q FROM fx_prod)))
    """,
)


def maps(t: Tables) -> DataFrame:
    """A grid of 5 x 5 nodes per scene: its page stretched over the crop around it, each node strayed by the vector."""
    c = F.col
    rows = once(production(t), {"q": g.scaled(c("quad"), c("w"), c("h"))})
    ends = {}
    for axis, size in (("x", "w"), ("y", "h")):
        values = c("q")[axis]
        low, high = F.array_min(values), F.array_max(values)
        ends[f"{axis}_from"] = F.floor(F.greatest(F.lit(0.0), low - 0.08 * (high - low))).cast("double")
        ends[f"{axis}_to"] = F.ceil(F.least(c(size), high + 0.08 * (high - low))).cast("double")
    rows = once(rows, ends)
    two = F.lit(2.0)
    crop = F.struct(
        c("x_from").alias("left"),
        c("y_from").alias("top"),
        F.greatest(two, c("x_to") - c("x_from")).alias("width"),
        F.greatest(two, c("y_to") - c("y_from")).alias("height"),
    )
    stray = F.element_at(F.array(*[F.lit(s) for s in STRAY]), (c("scene_id") % 4 + 1).cast("int"))
    rows = once(rows, {"crop": crop, "stray": stray})

    def nodes(axis: str, low: str, size: str, offset: int):
        def at(i: int):
            return g.corner(c("q"), i)[axis]

        def node(k):
            u = (k % SIDE).cast("double") / (SIDE - 1)
            v = F.floor(k / SIDE).cast("double") / (SIDE - 1)
            flat = (1 - v) * ((1 - u) * at(0) + u * at(1)) + v * ((1 - u) * at(3) + u * at(2))
            value = 2 * (flat - c(low)) / (c(size) - 1) - 1 + c("stray") * F.get(c("e"), k + offset)
            return F.when((c("scene_id") % 50 != 17) | (k != 12), value)

        return F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), node)

    grids = {"gx": nodes("x", "crop.left", "crop.width", 0), "gy": nodes("y", "crop.top", "crop.height", 25)}
    rows = once(rows, grids)
    return rows.select(
        "scene_id", F.lit(SIDE).alias("gw"), F.lit(SIDE).alias("gh"), "gx", "gy", "crop", c("q").alias("quad"), "w", "h"
    )


_LAST = SIDE - 1


@query(
    "map_grid_guard",
    f"""
    WITH node AS MATERIALIZED (
      SELECT scene_id, k % {SIDE} AS c, k // {SIDE} AS r, l + (gx[k + 1] + 1) * (cw - 1) / 2 AS x, t + (gy[k + 1] + 1) * (ch - 1) / 2 AS y
      FROM fx_maps, range({SIDE * SIDE}) k(k)),
    cell AS MATERIALIZED (
      SELECT a.scene_id, a.c, a.r, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy
      FROM node a JOIN node b ON b.scene_id = a.scene_id AND b.c = a.c + 1 AND b.r = a.r JOIN node c ON c.scene_id = a.scene_id AND c.c = a.c AND c.r = a.r + 1
      JOIN node d ON d.scene_id = a.scene_id AND d.c = a.c + 1 AND d.r = a.r + 1),
    point AS (
      SELECT scene_id, c::DOUBLE AS c, r::DOUBLE AS r, x, y FROM node UNION ALL
      SELECT scene_id, c + 0.5, r + 0.5, (ax + bx + cx + dx) / 4, (ay + by_ + cy + dy) / 4 FROM cell),
    moved AS (
      SELECT p.scene_id, avg(d) AS mean_move, quantile_cont(d, 0.95) AS p95_move, max(d) AS most_move, bool_or(off) AS outside FROM (
        SELECT p.scene_id, sqrt(pow(x - l - c / {_LAST} * (cw - 1), 2) + pow(y - t - r / {_LAST} * (ch - 1), 2)) / sqrt(pow(cw - 1, 2) + pow(ch - 1, 2)) AS d,
          x < -1 OR y < -1 OR x > 720 OR y > 1280 AS off FROM point p JOIN fx_maps m ON m.scene_id = p.scene_id) p GROUP BY p.scene_id),
    bent AS (
      SELECT scene_id, min(xx * yy - xy * yx) AS least_jacobian, min(abs(turn - bend)) AS least_stretch, max(turn + bend) AS most_stretch FROM (
        SELECT *, sqrt(pow((xx + yy) / 2, 2) + pow((xy - yx) / 2, 2)) AS turn, sqrt(pow((xx - yy) / 2, 2) + pow((xy + yx) / 2, 2)) AS bend FROM (
          SELECT q.scene_id, ((1 - b) * (bx - ax) + b * (dx - cx)) * {_LAST} / (cw - 1) AS xx, ((1 - b) * (by_ - ay) + b * (dy - cy)) * {_LAST} / (ch - 1) AS yx,
            ((1 - a) * (cx - ax) + a * (dx - bx)) * {_LAST} / (cw - 1) AS xy, ((1 - a) * (cy - ay) + a * (dy - by_)) * {_LAST} / (ch - 1) AS yy
          FROM cell q JOIN fx_maps m ON m.scene_id = q.scene_id, (VALUES (0::DOUBLE, 0::DOUBLE), (1, 0), (0, 1), (1, 1), (0.5, 0.5)) s(a, b))) GROUP BY scene_id),
    across AS (
      SELECT scene_id, q, greatest(1e-9, sqrt(pow(q[3].x - q[1].x, 2) + pow(q[3].y - q[1].y, 2)), sqrt(pow(q[4].x - q[2].x, 2) + pow(q[4].y - q[2].y, 2))) AS span FROM fx_maps),
    cornered AS (
      SELECT n.scene_id, max(sqrt(pow(x - q[i].x, 2) + pow(y - q[i].y, 2)) / span) AS corner_off
      FROM (SELECT *, CASE WHEN r = 0 AND c = 0 THEN 1 WHEN r = 0 AND c = {_LAST} THEN 2 WHEN r = {_LAST} AND c = {_LAST} THEN 3 WHEN r = {_LAST} AND c = 0 THEN 4 END AS i FROM node) n
      JOIN across a ON a.scene_id = n.scene_id WHERE i IS NOT NULL GROUP BY n.scene_id),
    border AS MATERIALIZED (
      SELECT scene_id, 1 AS i, 2 AS j, c AS k, x, y FROM node WHERE r = 0 UNION ALL SELECT scene_id, 2, 3, r, x, y FROM node WHERE c = {_LAST} UNION ALL
      SELECT scene_id, 4, 3, c, x, y FROM node WHERE r = {_LAST} UNION ALL SELECT scene_id, 1, 4, r, x, y FROM node WHERE c = 0),
    edged AS (
      SELECT scene_id, max(sqrt(pow(px - share * ex, 2) + pow(py - share * ey, 2)) / span) AS edge_off FROM (
        SELECT *, CASE WHEN ex * ex + ey * ey <= 1e-12 THEN 0 ELSE greatest(0, least(1, (px * ex + py * ey) / (ex * ex + ey * ey))) END AS share FROM (
          SELECT n.scene_id, span, n.x * (1 - f) + m.x * f - q[n.i].x AS px, n.y * (1 - f) + m.y * f - q[n.i].y AS py, q[n.j].x - q[n.i].x AS ex, q[n.j].y - q[n.i].y AS ey
          FROM (SELECT base, s * {_LAST} / 64::DOUBLE - base AS f FROM (SELECT s, least(s * {_LAST} // 64, {_LAST - 1}) AS base FROM range(65) z(s))) g
          JOIN border n ON n.k = g.base JOIN border m ON m.scene_id = n.scene_id AND m.i = n.i AND m.j = n.j AND m.k = n.k + 1 JOIN across a ON a.scene_id = n.scene_id)) GROUP BY scene_id),
    whole AS (SELECT scene_id, bool_and(x IS NOT NULL AND y IS NOT NULL) AS ok FROM node GROUP BY scene_id)
    SELECT scene_id, {', '.join(f'CASE WHEN ok THEN round({s}, 6) END AS {s}' for s in mp.STATS)},
      CASE WHEN NOT ok THEN 'nonfinite' WHEN outside THEN 'out-of-bounds' WHEN least_jacobian <= 0.001 THEN 'jacobian' WHEN least_stretch < 0.5 OR most_stretch > 2 THEN 'scale'
        WHEN mean_move > 0.25 OR p95_move > 0.35 OR most_move > 0.5 THEN 'displacement' WHEN corner_off > 0.05 OR edge_off > 0.12 THEN 'boundary' END AS failure
    FROM whole JOIN moved USING (scene_id) JOIN bent USING (scene_id) JOIN cornered USING (scene_id) JOIN edged USING (scene_id)
    """,
)
def map_grid_guard(t: Tables) -> DataFrame:
    return rounded(mp.map_guard(maps(t), ["scene_id"]))
