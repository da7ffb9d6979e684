"""Covered corners: where the answer went, and whether its flags were right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.functions.staging import once
from pagegauge.operators import occlusion as oc
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import (
    SQL_DIAGONAL,
    SQL_FRAME,
    _sql_convex,
    rounded,
    sql_area,
    sql_clip,
    sql_degenerate,
    sql_distances,
    sql_in_frame,
    sql_paired,
    sql_pairing,
    sql_pct,
    sql_rate,
    sql_scale,
)
from pagegauge.plans.registry import Tables, query, view
from pagegauge.plans.rules import _sql_flag, flag

e = b.e


def _sql_corner(ox: int, oy: int) -> str:
    return f"struct_pack(x := mid.x + slide + {ox}.0::DOUBLE, y := mid.y + slide + {oy}.0::DOUBLE)"


_BOARD = "[struct_pack(x := 14.4::DOUBLE, y := 704.0::DOUBLE), struct_pack(x := 705.6::DOUBLE, y := 704.0::DOUBLE), struct_pack(x := 705.6::DOUBLE, y := 1267.2::DOUBLE), struct_pack(x := 14.4::DOUBLE, y := 1267.2::DOUBLE)]"
view(
    "fx_occ",
    f"""
    SELECT *, CASE WHEN d IS NOT NULL THEN {sql_pairing('d', 'q')} END AS way, {sql_in_frame('truth')} AS seen,
      [{_sql_corner(-60, -60)}, {_sql_corner(60, -60)}, {_sql_corner(60, 60)}, {_sql_corner(-60, 60)}] AS occ,
      CASE WHEN scene_id % 4 = 0 THEN {_BOARD} END AS board,
      CASE WHEN d IS NOT NULL THEN NOT {sql_degenerate('d')} AND {_sql_convex('d').replace('1e-12', '1e-9')} ELSE false END AS usable
    FROM (SELECT *, q[scene_id % 4 + 1] AS mid, (scene_id % 5 - 2) * 25.0::DOUBLE AS slide, CASE WHEN scene_id % 3 <> 0 THEN scene_id % 4 END AS cov,
            {SQL_FRAME} AS box FROM (
      SELECT scene_id, variant, family, w, h, e, truth, CASE WHEN det IS NOT NULL THEN {sql_scale('det')} END AS d, {sql_scale('truth')} AS q FROM fx_det
      WHERE truth IS NOT NULL))
    """,
)
_UNIT_BOX = "CASE WHEN usable THEN {v} ELSE box END"
view("fx_occ_page", sql_clip("fx_occ", "q", "box", "page_in", 4))
view("fx_occ_det", sql_clip(f"(SELECT *, {_UNIT_BOX.format(v='d')} AS dd FROM fx_occ_page)", "dd", "box", "d_in", 4))
view("fx_occ_on", sql_clip("fx_occ_det", "occ", "d_in", "on_quad", 8))
view("fx_occ_onpage", sql_clip("fx_occ_on", "on_quad", "q", "on_page", 4))
view("fx_occ_fon", sql_clip("(SELECT *, coalesce(board, occ) AS fb FROM fx_occ_onpage)", "fb", "d_in", "f_quad", 8))
view("fx_occ_all", sql_clip("fx_occ_fon", "f_quad", "q", "f_page", 4))


def _sql_inside(p: str, poly: str) -> str:
    return (
        f"(len(list_filter(range(1, len({poly}) + 1), lambda i: ({poly}[i].y > {p}.y) <> ({poly}[i % len({poly}) + 1].y > {p}.y) AND "
        f"{p}.x < ({poly}[i].x - {poly}[i % len({poly}) + 1].x) * ({p}.y - {poly}[i % len({poly}) + 1].y) / ({poly}[i].y - {poly}[i % len({poly}) + 1].y) + {poly}[i % len({poly}) + 1].x)) % 2 = 1)"
    )


def _sql_cross(i: int, k: int) -> str:
    a, b_, c, d = f"occ[{i + 1}]", f"occ[{(i + 1) % 4 + 1}]", f"q[{k + 1}]", f"q[{(k + 1) % 4 + 1}]"
    rx, ry, sx, sy = f"({b_}.x - {a}.x)", f"({b_}.y - {a}.y)", f"({d}.x - {c}.x)", f"({d}.y - {c}.y)"
    den = f"({rx} * {sy} - {ry} * {sx})"
    t = f"((({c}.x - {a}.x) * {sy} - ({c}.y - {a}.y) * {sx}) / {den})"
    u = f"((({c}.x - {a}.x) * {ry} - ({c}.y - {a}.y) * {rx}) / {den})"
    return (
        f"CASE WHEN abs({den}) >= 1e-12 AND {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1 THEN struct_pack(x := {a}.x + {t} * {rx}, y := {a}.y + {t} * {ry}) END"
    )


def _sql_near(points: str) -> str:
    return f"coalesce(list_min(list_transform({points}, lambda v: sqrt((p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y)))), 1e18)"


view(
    "fx_occ_scored",
    f"""
    SELECT *, CASE WHEN d IS NULL THEN 'lost' WHEN cov IS NULL THEN NULL WHEN own <= 0.015 THEN 'true-corner'
        WHEN {_sql_near('tips')} / dg <= 0.015 THEN 'occluder-tip' WHEN {_sql_near('crossings')} / dg <= 0.015 THEN 'edge-crossing'
        WHEN NOT {_sql_inside('p', 'q')} AND {_sql_inside('p', 'occ')} THEN 'on-occluder' WHEN {_sql_inside('p', 'q')} THEN 'inside-page' ELSE 'elsewhere' END AS mode,
      CASE WHEN usable AND pa > 0 THEN greatest(0, oa) / pa > 0.005 END AS included,
      CASE WHEN usable AND pa > 0 AND board IS NOT NULL THEN greatest(0, oa + fa) / pa > 0.005 END AS foreign_included,
      list_max(list_filter(errs, lambda v, i: seen[i] AND (cov IS NULL OR i <> cov + 1))) AS visible_error
    FROM (SELECT *, errs[cov + 1] AS own, m[cov + 1] AS p, {SQL_DIAGONAL} AS dg, list_filter(occ, lambda v: {_sql_inside('v', 'q')}) AS tips,
        list_filter([{', '.join(_sql_cross(i, k) for i in range(4) for k in range(4))}], lambda v: v IS NOT NULL) AS crossings
      FROM (SELECT *, CASE WHEN d IS NOT NULL THEN {sql_distances('m', 'q', SQL_DIAGONAL)} END AS errs, abs({sql_area('page_in')}) AS pa,
          CASE WHEN len(on_quad) >= 3 THEN abs({sql_area('on_quad')}) - abs({sql_area('on_page')}) ELSE 0 END AS oa,
          CASE WHEN board IS NOT NULL AND len(f_quad) >= 3 THEN abs({sql_area('f_quad')}) - abs({sql_area('f_page')}) ELSE 0 END AS fa
        FROM (SELECT *, CASE WHEN d IS NOT NULL THEN {sql_paired('d', 'way')} END AS m FROM fx_occ_all)))
    """,
)


def scenes(t: Tables) -> DataFrame:
    rows = b.detections(t).where("truth IS NOT NULL")
    c = F.col
    w, h = c("w"), c("h")
    rows = once(
        rows,
        {
            "d": F.when(c("det").isNotNull(), g.scaled(c("det"), w, h)),
            "q": g.scaled(c("truth"), w, h),
            "box": g.frame_polygon(w, h),
            "diag": g.diagonal(w, h),
            "in_frame": g.in_frame(c("truth")),
        },
    )
    slot = (c("scene_id") % 4).cast("int")
    slide = (c("scene_id") % 5 - 2) * 25.0
    mid = F.get("q", slot)

    def at(ox: float, oy: float):
        return mid["x"] + slide + ox, mid["y"] + slide + oy

    board = [(14.4, 704.0), (705.6, 704.0), (705.6, 1267.2), (14.4, 1267.2)]
    return once(
        rows,
        {
            "occluder": g.polygon(at(-60.0, -60.0), at(60.0, -60.0), at(60.0, 60.0), at(-60.0, 60.0)),
            "foreign": F.when(c("scene_id") % 4 == 0, g.polygon(*[(F.lit(x), F.lit(y)) for x, y in board])),
            "occluded": F.when(c("scene_id") % 3 != 0, slot),
            "flags": F.array(*[flag(50 + i) for i in range(4)]),
            "measured": F.array(e(55) <= 0.15, *[F.lit(True)] * 3),
        },
    )


@query(
    "occluder_join",
    """
    SELECT scene_id, variant, mode, round(own, 6) AS covered_error, round(visible_error, 6) AS visible_error, included, foreign_included FROM fx_occ_scored
    """,
)
def occluder_join(t: Tables) -> DataFrame:
    return rounded(
        oc.score(scenes(t)).select(
            "scene_id", "variant", "mode", "covered_error", "visible_error", "included", "foreign_included"
        )
    )


@query(
    "occlusion_summary",
    f"""
    SELECT family, variant, count(*) AS scenes, count(cov) AS covered, count(d) AS accepted, {sql_rate('count(*) FILTER (d IS NULL)', 'count(*)')} AS miss_rate,
      {sql_rate('count(*) FILTER (cov IS NOT NULL AND (d IS NULL OR own > 0.03))', 'count(cov)')} AS over_3_rate,
      {sql_rate('count(*) FILTER (included)', 'count(included)')} AS included_rate, {sql_rate('count(*) FILTER (foreign_included)', 'count(foreign_included)')} AS foreign_rate,
      {', '.join(f"count(*) FILTER (mode = '{m}') AS {m.replace('-', '_')}" for m in [*oc.MODES, 'lost'])},
      round({sql_pct('own', 0.5)}, 6) AS covered_p50, round({sql_pct('own', 0.9)}, 6) AS covered_p90, round({sql_pct('own', 0.95)}, 6) AS covered_p95,
      round({sql_pct('visible_error', 0.5)}, 6) AS visible_p50 FROM fx_occ_scored GROUP BY family, variant
    """,
)
def occlusion_summary(t: Tables) -> DataFrame:
    return rounded(oc.summarize(oc.score(scenes(t)), ["family", "variant"]))


def _sql_reach(step: int) -> str:
    n = f"q[(i + {step}) % 4 + 1]"
    point = f"struct_pack(x := q[i + 1].x + ({n}.x - q[i + 1].x) / ln{step} * (s * 0.5), y := q[i + 1].y + ({n}.y - q[i + 1].y) / ln{step} * (s * 0.5))"
    test = _sql_inside("v", "occ").replace("lambda i:", "lambda z:").replace("occ[i]", "occ[z]").replace("occ[i %", "occ[z %").replace("i % len", "z % len")
    hidden = f"list_transform(list_transform(range(0, CAST(ceil(ln{step}) AS BIGINT)), lambda s: {point}), lambda v: {test})"
    return f"coalesce((list_position({hidden}, false) - 1) * 0.5, ceil(ln{step}) * 0.5)"


def _sql_len(step: int) -> str:
    n = f"q[(i + {step}) % 4 + 1]"
    return f"sqrt(({n}.x - q[i + 1].x) * ({n}.x - q[i + 1].x) + ({n}.y - q[i + 1].y) * ({n}.y - q[i + 1].y)) AS ln{step}"


view(
    "fx_flagged",
    f"""
    SELECT scene_id, variant, family, i, covered, in_frame, provenance, measured, coalesce(reach < 0.02 * dg, false) AS shallow, measured AND provenance <> 'seen' AS flagged FROM (
      SELECT *, CASE WHEN covered THEN greatest({_sql_reach(3)}, {_sql_reach(1)}) END AS reach, f[j + 1] AS provenance, CASE WHEN j = 0 THEN e[55] <= 0.15 ELSE true END AS measured FROM (
        SELECT *, coalesce(cov = i, false) AS covered, seen[i + 1] AS in_frame, CASE WHEN way >= 4 THEN 3 - (i + way % 4) % 4 ELSE (i + way % 4) % 4 END AS j,
          {_sql_len(3)}, {_sql_len(1)}, {SQL_DIAGONAL} AS dg, [{', '.join(_sql_flag(i) for i in range(50, 54))}] AS f
        FROM (SELECT *, CAST(unnest(range(0, 4)) AS INTEGER) AS i FROM fx_occ WHERE d IS NOT NULL)))
    """,
)


@query("provenance_join", "SELECT scene_id, variant, i, covered, shallow, in_frame, provenance, flagged, measured FROM fx_flagged")
def provenance_join(t: Tables) -> DataFrame:
    return oc.corner_flags(oc.score(scenes(t)))


def _n(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


_TP, _FN, _FP = _n("covered AND NOT shallow AND flagged"), _n("covered AND NOT shallow AND NOT flagged"), _n("NOT covered AND flagged")
_SF = _n("shallow AND flagged")


@query(
    "provenance_summary",
    f"""
    SELECT variant, {_TP} + {_FN} AS covered, {_n('shallow')} AS shallow, {_SF} AS shallow_flagged, {sql_rate(_TP, f'({_TP} + {_FN})')} AS recall,
      {sql_rate(f'{_TP} + {_SF}', f"({_TP} + {_FN} + {_n('shallow')})")} AS recall_all, {sql_rate(_TP, f'({_TP} + {_FP})')} AS precision,
      {sql_rate(f'{_TP} + {_SF}', f'({_TP} + {_SF} + {_FP})')} AS precision_all, {_FP} AS false_flags, {sql_rate(_FP, _n('NOT covered'))} AS false_flag_rate,
      {_n("provenance = 'inferred'")} AS inferred, {_n("provenance = 'unknown'")} AS unknown FROM fx_flagged WHERE in_frame GROUP BY variant
    """,
)
def provenance_summary(t: Tables) -> DataFrame:
    return rounded(oc.summarize_flags(oc.corner_flags(oc.score(scenes(t))), ["variant"]))
