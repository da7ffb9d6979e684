"""Rule queries: verdicts and scalar readings over detections and their measures."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.functions.staging import once
from pagegauge.operators import rules as r
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import (
    SQL_DIAGONAL,
    rounded,
    sql_area,
    sql_degenerate,
    sql_distances,
    sql_image_order,
    sql_in_frame,
    sql_paired,
    sql_pairing,
    sql_scale,
)
from pagegauge.plans.registry import Tables, query, view

e = b.e


def production(t: Tables) -> DataFrame:
    return b.detections(t).where("variant = 'production'")


view("fx_prod", "SELECT * FROM fx_det WHERE variant = 'production'")


def sql_xy(points: str, names: str = "x y") -> str:
    return ", ".join(f"round({points}[{i + 1}].{a}, 6) AS {a}{i}" for i in range(4) for a in "xy")


def xy(quad: Column) -> list[Column]:
    return [F.round(g.corner(quad, i)[a], 6).alias(f"{a}{i}") for i in range(4) for a in "xy"]


# ── evidence ─────────────────────────────────────────────────────────────────

view(
    "fx_evidence",
    """
    SELECT scene_id, family, 0.72 + 0.6 * e[1] AS background, 0.03 + 0.3 * abs(e[2]) AS ink, 0.015 + 0.1 * e[3] AS counter_ink,
           0.3 + e[4] AS ink_spread, 0.25 + e[5] AS background_spread, 0.2 + e[6] AS solid_ink,
           CASE WHEN scene_id % 11 <> 0 THEN 0.6 + e[7] END AS margin_uniform, 0.9 + e[8] AS margin_relative,
           2 + scene_id % 3 AS sides_known, scene_id % 5 AS sides_supported FROM fx_prod
    """,
)


def evidence(t: Tables) -> DataFrame:
    scene = F.col("scene_id")
    return production(t).select(
        "scene_id",
        "family",
        (0.72 + 0.6 * e(1)).alias("background"),
        (0.03 + 0.3 * F.abs(e(2))).alias("ink"),
        (0.015 + 0.1 * e(3)).alias("counter_ink"),
        (0.3 + e(4)).alias("ink_spread"),
        (0.25 + e(5)).alias("background_spread"),
        (0.2 + e(6)).alias("solid_ink"),
        F.when(scene % 11 != 0, 0.6 + e(7)).alias("margin_uniform"),
        (0.9 + e(8)).alias("margin_relative"),
        (2 + scene % 3).alias("sides_known"),
        (scene % 5).alias("sides_supported"),
    )


def _sql_text(min_ink: str = "0.025", solid: str = "0.35") -> str:
    return f"""CASE WHEN NOT background >= 0.68 THEN 'background'
      WHEN NOT ink >= CASE WHEN background >= 0.92 THEN 0.012 ELSE {min_ink} END THEN 'ink-low'
      WHEN NOT ink <= 0.45 THEN 'ink-high' WHEN NOT ink_spread >= 0.15 THEN 'ink-spread'
      WHEN NOT counter_ink <= ink * 0.45 + 0.01 THEN 'counter-ink' WHEN NOT background_spread <= 0.35
        THEN 'background-spread' WHEN NOT solid_ink <= {solid} THEN 'solid-ink'
      WHEN NOT (background >= 0.75 OR ink >= 0.22 * (1 - background)) THEN 'ink-of-rest'
      WHEN ink < 0.04 AND ink_spread > 0.75 THEN 'texture' END"""


_SQL_IMAGES = """CASE WHEN margin_uniform IS NULL OR margin_relative IS NULL THEN 'no-margin'
      WHEN NOT margin_uniform >= 0.6 THEN 'margin-uniform' WHEN NOT margin_relative >= 0.9 THEN 'margin-relative'
      WHEN NOT solid_ink >= 0.2 THEN 'solid-ink' WHEN NOT background >= 0.25 THEN 'background'
      WHEN NOT ink >= 0.1 THEN 'ink-low' WHEN NOT ink <= 0.45 THEN 'ink-high' WHEN NOT ink_spread >= 0.15 THEN 'ink-spread' END"""
_SQL_VERDICT = """CASE WHEN NOT (sides_known >= 2 AND sides_supported >= least(3, greatest(2, sides_known - 1))) THEN 'sides'
      WHEN fail_print IS NULL OR fail_panels IS NULL THEN 'ok' ELSE 'surface' END"""
view(
    "fx_evidence_judged",
    f"SELECT *, {_SQL_VERDICT} AS verdict FROM (SELECT *, {_sql_text()} AS fail_print, {_SQL_IMAGES} AS fail_panels FROM fx_evidence)",
)


def judged(t: Tables) -> DataFrame:
    rows = evidence(t).withColumn("rules", r.rule_column(r.PAPER))
    rules = F.col("rules")
    staged = once(rows, {"fail_print": r.text_failure(rules), "fail_panels": r.images_failure(rules)})
    return staged.withColumn("verdict", r.evidence_verdict(rules, F.col("fail_print"), F.col("fail_panels")))


@query("evidence_verdict", "SELECT scene_id, verdict, fail_print, fail_panels FROM fx_evidence_judged")
def evidence_verdict(t: Tables) -> DataFrame:
    return judged(t).select("scene_id", "verdict", "fail_print", "fail_panels")


_NUMBERS = [
    "background",
    "ink",
    "counter_ink",
    "ink_spread",
    "solid_ink",
    "background_spread",
    "margin_uniform",
    "margin_relative",
]


@query(
    "evidence_diagnostic",
    "SELECT scene_id, sides_known, verdict, "
    + ", ".join(f"floor({n} * 100 + 0.5) / 100 AS {n}" for n in _NUMBERS)
    + " FROM fx_evidence_judged",
)
def evidence_diagnostic(t: Tables) -> DataFrame:
    cents = [(F.floor(F.col(n) * 100 + 0.5) / 100).alias(n) for n in _NUMBERS]
    return judged(t).select("scene_id", "sides_known", "verdict", *cents)


@query(
    "evidence_clause_histogram",
    """
    SELECT kind, key, count(*) AS n FROM (
      SELECT 'verdict' AS kind, verdict AS key FROM fx_evidence_judged UNION ALL
      SELECT 'print', coalesce(fail_print, 'ok') FROM fx_evidence_judged WHERE verdict = 'surface' UNION ALL
      SELECT 'panels', coalesce(fail_panels, 'ok') FROM fx_evidence_judged WHERE verdict = 'surface') GROUP BY kind, key
    """,
)
def evidence_clause_histogram(t: Tables) -> DataFrame:
    surface = F.col("verdict") == "surface"

    def entry(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    entries = F.array_compact(
        F.array(
            entry("verdict", F.col("verdict")),
            F.when(surface, entry("print", F.coalesce("fail_print", F.lit("ok")))),
            F.when(surface, entry("panels", F.coalesce("fail_panels", F.lit("ok")))),
        )
    )
    rows = judged(t).select(F.explode(entries).alias("c")).select("c.kind", "c.key")
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"))


@query(
    "merge_histograms",
    """
    SELECT verdict, CAST(sum(n) AS BIGINT) AS n, count(*) AS runs FROM (
      SELECT family, verdict, count(*) AS n FROM fx_evidence_judged GROUP BY family, verdict) GROUP BY verdict
    """,
)
def merge_histograms(t: Tables) -> DataFrame:
    """Counter maps of several runs added up."""
    counted = judged(t).groupBy("family", "verdict").agg(F.count("*").alias("n"))
    per_run = counted.groupBy("family").agg(
        F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("verdicts")
    )
    entries = per_run.select(F.explode("verdicts").alias("verdict", "n"))
    return entries.groupBy("verdict").agg(F.sum("n").alias("n"), F.count("*").alias("runs"))


@query(
    "custom_rules",
    f"""
    SELECT name, count(*) AS scenes, count(*) FILTER (v = 'ok') AS paper FROM (
      SELECT name, {_SQL_VERDICT} AS v FROM (
        SELECT *, 'paper' AS name, {_sql_text()} AS fail_print, {_SQL_IMAGES} AS fail_panels FROM fx_evidence UNION ALL
        SELECT *, 'more ink', {_sql_text(min_ink='0.05')}, {_SQL_IMAGES} FROM fx_evidence UNION ALL
        SELECT *, 'solid allowed', {_sql_text(solid='0.6')}, {_SQL_IMAGES} FROM fx_evidence)) GROUP BY name
    """,
)
def custom_rules(t: Tables) -> DataFrame:
    """The same readings judged under several rule sets."""
    sets = {
        "paper": r.PAPER,
        "more ink": replace(r.PAPER, min_ink=0.05),
        "solid allowed": replace(r.PAPER, max_solid_ink=0.6),
    }
    table = F.array(*[F.struct(F.lit(n).alias("name"), r.rule_column(s).alias("rules")) for n, s in sets.items()])
    rows = evidence(t).select("*", F.inline(table))
    rules = F.col("rules")
    staged = once(rows, {"fail_print": r.text_failure(rules), "fail_panels": r.images_failure(rules)})
    verdict = r.evidence_verdict(rules, F.col("fail_print"), F.col("fail_panels"))
    return staged.groupBy("name").agg(F.count("*").alias("scenes"), F.count_if(verdict == "ok").alias("paper"))


# ── quads ────────────────────────────────────────────────────────────────────


@query(
    "coverage_floor_filter",
    f"""
    SELECT scene_id, variant, round(cov, 6) AS coverage, round(floor, 6) AS floor FROM (
      SELECT *, abs({sql_area('quad')}) AS cov, CASE WHEN source = 'ml' AND coalesce(confidence >= 0.9, false) THEN 0.1
               ELSE CAST(0.35 AS DOUBLE) END * least(1, greatest(0.15, 0.9 + e[40])) AS floor FROM fx_det)
    WHERE cov >= floor
    """,
)
def coverage_floor_filter(t: Tables) -> DataFrame:
    floor = r.coverage_floor(F.col("source"), F.col("confidence"), 0.9 + e(40))
    rows = b.detections(t).select("scene_id", "variant", g.quad_area(F.col("quad")).alias("coverage"), floor.alias("floor"))
    return rounded(rows.where(F.col("coverage") >= F.col("floor")))


def _sql_angle(i: int) -> str:
    p, a, c = f"q[{i + 1}]", f"q[{(i + 3) % 4 + 1}]", f"q[{(i + 1) % 4 + 1}]"
    ax, ay, bx, by = f"({a}.x - {p}.x)", f"({a}.y - {p}.y)", f"({c}.x - {p}.x)", f"({c}.y - {p}.y)"
    norm = f"(sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by}))"
    return f"degrees(acos(greatest(-1, least(1, ({ax} * {bx} + {ay} * {by}) / {norm}))))"


def _sql_side(i: int) -> str:
    a, c = f"q[{i + 1}]", f"q[{(i + 1) % 4 + 1}]"
    return f"sqrt(({c}.x - {a}.x) * ({c}.x - {a}.x) + ({c}.y - {a}.y) * ({c}.y - {a}.y))"


_BORDER = " + ".join(
    "CASE WHEN "
    + " OR ".join(
        f"(q[{i + 1}].{t} AND q[{(i + 1) % 4 + 1}].{t})".replace(".L", ".x <= 14.4")
        .replace(".R", ".x >= 704.6")
        .replace(".T", ".y <= 14.4")
        .replace(".B", ".y >= 1264.6")
        for t in "LRTB"
    )
    + " THEN 1 ELSE 0 END"
    for i in range(4)
)


@query(
    "classical_sanity_filter",
    f"""
    SELECT scene_id, border_sides, round(least_angle, 6) AS least_angle, round(side_ratio, 6) AS side_ratio,
           border_sides < 2 AND least_angle >= 35 AND side_ratio >= 0.18 AS sane
    FROM (SELECT scene_id, {_BORDER} AS border_sides, least({', '.join(_sql_angle(i) for i in range(4))}) AS least_angle,
            least({_sql_side(0)} + {_sql_side(2)}, {_sql_side(3)} + {_sql_side(1)})
              / greatest({_sql_side(0)} + {_sql_side(2)}, {_sql_side(3)} + {_sql_side(1)}) AS side_ratio
          FROM (SELECT scene_id, {sql_scale('quad')} AS q FROM fx_prod))
    """,
)
def classical_sanity_filter(t: Tables) -> DataFrame:
    rows = once(production(t), {"q": g.scaled(F.col("quad"), F.col("w"), F.col("h"))})
    q = F.col("q")
    rows = once(
        rows,
        {
            "border_sides": r.sides_on_border(q, F.col("w"), F.col("h")),
            "least_angle": r.least_angle(q),
            "side_ratio": r.side_ratio(q),
        },
    )
    sane = (F.col("border_sides") < 2) & (F.col("least_angle") >= 35) & (F.col("side_ratio") >= 0.18)
    return rounded(rows.select("scene_id", "border_sides", "least_angle", "side_ratio", sane.alias("sane")))


@query(
    "off_image_filter",
    f"SELECT scene_id, variant FROM fx_det WHERE len(list_filter({sql_in_frame('quad')}, lambda v: NOT v)) > 0",
)
def off_image_filter(t: Tables) -> DataFrame:
    return b.detections(t).where(g.off_image(F.col("quad"))).select("scene_id", "variant")


@query(
    "quad_edited",
    """
    SELECT scene_id, CASE WHEN a IS NULL OR c IS NULL THEN (a IS NULL) <> (c IS NULL) ELSE
      len(list_filter(range(1, 5), lambda i: abs(a[i].x - c[i].x) > 1e-3 OR abs(a[i].y - c[i].y) > 1e-3)) > 0 END AS edited
    FROM (SELECT p.scene_id, p.det AS a, CASE WHEN p.scene_id % 3 = 0 THEN p.det ELSE x.det END AS c FROM fx_prod p
          JOIN (SELECT * FROM fx_det WHERE variant = 'refined') x USING (scene_id))
    """,
)
def quad_edited(t: Tables) -> DataFrame:
    rows = b.detections(t).groupBy("scene_id").pivot("variant", ["production", "refined"]).agg(F.first("det"))
    later = F.when(F.col("scene_id") % 3 == 0, F.col("production")).otherwise(F.col("refined"))
    return rows.select("scene_id", r.quad_moved(F.col("production"), later).alias("edited"))


@query("quad_area", f"SELECT scene_id, variant, round(abs({sql_area('quad')}), 6) AS area FROM fx_det")
def quad_area(t: Tables) -> DataFrame:
    return rounded(b.detections(t).select("scene_id", "variant", g.quad_area(F.col("quad")).alias("area")))


@query("degenerate_quad", f"SELECT scene_id, variant FROM fx_det WHERE {sql_degenerate('quad')}")
def degenerate_quad(t: Tables) -> DataFrame:
    return b.detections(t).where(g.degenerate(F.col("quad"))).select("scene_id", "variant")


@query(
    "match_corners",
    f"""
    SELECT scene_id, CAST(way % 4 AS INTEGER) AS shift, way >= 4 AS reversed, {sql_xy('m')} FROM (
      SELECT *, {sql_paired('quad', 'way')} AS m FROM (
        SELECT *, {sql_pairing('quad', 'truth')} AS way FROM fx_prod WHERE truth IS NOT NULL))
    """,
)
def match_corners(t: Tables) -> DataFrame:
    rows = production(t).where("truth IS NOT NULL")
    rows = once(rows, {"way": g.pairing(F.col("quad"), F.col("truth"))["way"]})
    rows = once(rows, {"m": g.paired(F.col("quad"), F.col("way"))})
    way = F.col("way")
    return rows.select("scene_id", (way % 4).alias("shift"), (way >= 4).alias("reversed"), *xy(F.col("m")))


@query(
    "image_order",
    f"SELECT scene_id, {sql_xy('o')} FROM (SELECT scene_id, {sql_image_order('quad')} AS o FROM fx_prod)",
)
def image_order(t: Tables) -> DataFrame:
    rows = once(production(t), {"o": g.image_order(F.col("quad"))})
    return rows.select("scene_id", *xy(F.col("o")))


@query(
    "corner_errors",
    """
    SELECT scene_id, variant, i - 1 AS corner, round(errs[i], 6) AS error, seen[i] AS in_frame
    FROM (SELECT *, unnest(range(1, 5)) AS i FROM fx_score WHERE errs IS NOT NULL)
    """,
)
def corner_errors(t: Tables) -> DataFrame:
    from pagegauge.plans.detection import scored

    rows = scored(t).where("corner_errors IS NOT NULL")
    corners = rows.select(
        "scene_id", "variant", F.posexplode(F.arrays_zip("corner_errors", "corners_in_frame")).alias("i", "c")
    )
    return rounded(
        corners.select(
            "scene_id",
            "variant",
            F.col("i").cast("bigint").alias("corner"),
            F.col("c.corner_errors").alias("error"),
            F.col("c.corners_in_frame").alias("in_frame"),
        )
    )


@query(
    "clip_polygon",
    f"SELECT scene_id, variant, len(qi) AS page_points, round(abs({sql_area('qi')}), 4) AS page_area FROM fx_clip_truth",
)
def clip_polygon(t: Tables) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    rows = b.detections(t).where("det IS NOT NULL AND truth IS NOT NULL")
    rows = once(rows, {"page": g.clip(g.scaled(F.col("truth"), w, h), g.frame_polygon(w, h))})
    return rows.select(
        "scene_id",
        "variant",
        F.size("page").cast("bigint").alias("page_points"),
        F.round(g.area(F.col("page")), 4).alias("page_area"),
    )


_MINX, _MAXX = "list_min(list_transform(quad, lambda p: p.x))", "list_max(list_transform(quad, lambda p: p.x))"
_MINY, _MAXY = "list_min(list_transform(quad, lambda p: p.y))", "list_max(list_transform(quad, lambda p: p.y))"
_MARGIN = "list_min(list_transform(quad, lambda p: least(p.x, 1 - p.x, p.y, 1 - p.y)))"


def _clip01(v: str) -> str:
    return f"least(1, greatest(0, {v}))"


view(
    "fx_framed",
    f"""
    SELECT *, {_MINX} AS mnx, {_MAXX} AS mxx, {_MINY} AS mny, {_MAXY} AS mxy, {_MARGIN} AS margin,
           greatest({_clip01(_MAXX)} - {_clip01(_MINX)}, {_clip01(_MAXY)} - {_clip01(_MINY)}) AS fill
    FROM (SELECT scene_id, variant, e, list_transform(quad, lambda p: struct_pack(
            x := 0.5 + (p.x - 0.5) * (0.7 + 0.1 * (scene_id % 6)) + (scene_id % 7 - 3) * 0.03,
            y := 0.5 + (p.y - 0.5) * (0.7 + 0.1 * (scene_id % 6)) + (scene_id % 5 - 2) * 0.03)) AS quad FROM fx_prod)
    """,
)


def framed(t: Tables) -> DataFrame:
    """Quads held nearer, farther and off centre, by scene."""
    scale = 0.7 + 0.1 * (F.col("scene_id") % 6)
    dx, dy = (F.col("scene_id") % 7 - 3) * 0.03, (F.col("scene_id") % 5 - 2) * 0.03
    placed = g.map_quad(
        F.col("quad"), lambda p: 0.5 + (p["x"] - 0.5) * scale + dx, lambda p: 0.5 + (p["y"] - 0.5) * scale + dy
    )
    return once(production(t).select("scene_id", "e", "quad"), {"placed": placed}).select(
        "scene_id", "e", F.col("placed").alias("quad")
    )


@query(
    "fill_share",
    "SELECT scene_id, round(fill, 6) AS fill, round(margin, 6) AS margin, fill < 0.7 AS too_far FROM fx_framed",
)
def fill_share(t: Tables) -> DataFrame:
    q = F.col("quad")
    rows = framed(t).select("scene_id", g.fill_share(q).alias("fill"), g.border_margin(q).alias("margin"))
    return rounded(rows.withColumn("too_far", F.col("fill") < r.FramingRules().fill_enter))


_CURRENT = "CASE scene_id % 4 WHEN 0 THEN 'move-closer' WHEN 1 THEN 'move-back' WHEN 2 THEN 'move-phone' END"


@query(
    "framing_hint",
    f"""
    SELECT scene_id, CASE WHEN scene_id % 17 = 0 THEN 'move-back'
      WHEN scene_id % 13 = 0 OR margin < CASE WHEN coalesce(cur IN ('move-back', 'move-phone'), false) THEN 0.03 ELSE 0.015 END
        THEN CASE WHEN fill >= 0.75 OR NOT (mxx - mnx <= 0.94 AND mxy - mny <= 0.94) THEN 'move-back' ELSE 'move-phone' END
      WHEN fill >= CASE WHEN coalesce(cur = 'move-closer', false) THEN 0.75 ELSE 0.7 END THEN NULL
      WHEN margin >= CASE WHEN coalesce(cur = 'move-closer', false) THEN 0.05 ELSE 0.07 END THEN 'move-closer'
      WHEN fill >= 0.65 THEN NULL ELSE 'move-phone' END AS hint
    FROM (SELECT *, {_CURRENT} AS cur FROM fx_framed)
    """,
)
def framing_hint(t: Tables) -> DataFrame:
    scene = F.col("scene_id")
    current = F.when(scene % 4 == 0, "move-closer").when(scene % 4 == 1, "move-back").when(scene % 4 == 2, "move-phone")
    hint = r.framing_hint(F.col("quad"), scene % 17 == 0, scene % 13 == 0, current)
    return framed(t).select("scene_id", hint.alias("hint"))


@query(
    "move_direction",
    """
    SELECT scene_id, CASE WHEN cur IN ('left', 'right') THEN CASE WHEN ry > rx * 1.25 THEN along ELSE across END
        WHEN cur IN ('up', 'down') THEN CASE WHEN rx > ry * 1.25 THEN across ELSE along END
        WHEN rx > ry THEN across ELSE along END AS direction
    FROM (SELECT *, CASE WHEN dx < 0 THEN 'left' ELSE 'right' END AS across, CASE WHEN dy < 0 THEN 'up' ELSE 'down' END AS along,
            abs(dx) / greatest(0.02, (1 - (mxx - mnx)) / 2) AS rx, abs(dy) / greatest(0.02, (1 - (mxy - mny)) / 2) AS ry,
            CASE scene_id % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'up' WHEN 2 THEN 'right' END AS cur
          FROM (SELECT *, (mnx + mxx) / 2 - 0.5 AS dx, (mny + mxy) / 2 - 0.5 AS dy FROM fx_framed))
    """,
)
def move_direction(t: Tables) -> DataFrame:
    slot = F.col("scene_id") % 5
    current = F.when(slot == 0, "left").when(slot == 1, "up").when(slot == 2, "right")
    return framed(t).select("scene_id", r.move_direction(F.col("quad"), current).alias("direction"))


@query(
    "corner_move_pct",
    f"""
    SELECT scene_id, round(list_max({sql_distances(sql_scale('p.quad', 'p.w', 'p.h'), sql_scale('x.quad', 'p.w', 'p.h'),
                                                   SQL_DIAGONAL.replace('w', 'p.w').replace('h', 'p.h'))}) * 100, 6) AS moved_pct
    FROM fx_prod p JOIN (SELECT scene_id, quad FROM fx_det WHERE variant = 'refined') x USING (scene_id)
    """,
)
def corner_move_pct(t: Tables) -> DataFrame:
    rows = b.detections(t).groupBy("scene_id", "w", "h").pivot("variant", ["production", "refined"]).agg(F.first("quad"))
    w, h = F.col("w"), F.col("h")
    apart = g.distances(g.scaled(F.col("production"), w, h), g.scaled(F.col("refined"), w, h), g.diagonal(w, h))
    return rounded(rows.select("scene_id", (F.array_max(apart) * 100).alias("moved_pct")))


@query(
    "lerp_quad",
    "SELECT scene_id, " + ", ".join(
        f"round(p.quad[{i + 1}].{a} + (x.quad[{i + 1}].{a} - p.quad[{i + 1}].{a}) * 0.25, 6) AS {a}{i}" for i in range(4) for a in "xy"
    ) + " FROM fx_prod p JOIN (SELECT scene_id, quad FROM fx_det WHERE variant = 'refined') x USING (scene_id)",
)
def lerp_quad(t: Tables) -> DataFrame:
    rows = b.detections(t).groupBy("scene_id").pivot("variant", ["production", "refined"]).agg(F.first("quad"))
    a, c = F.col("production"), F.col("refined")
    mixed = F.zip_with(a, c, lambda p, q: g.point(p["x"] + (q["x"] - p["x"]) * 0.25, p["y"] + (q["y"] - p["y"]) * 0.25))
    return once(rows, {"m": mixed}).select("scene_id", *xy(F.col("m")))


@query(
    "visible_projection",
    f"SELECT scene_id, {sql_xy('v')} FROM (SELECT scene_id, list_transform(quad, lambda p: struct_pack("
    "x := (p.x - 0.05) / 0.9, y := (p.y - 0.1) / 0.8)) AS v FROM fx_prod)",
)
def visible_projection(t: Tables) -> DataFrame:
    seen = g.map_quad(F.col("quad"), lambda p: (p["x"] - 0.05) / 0.9, lambda p: (p["y"] - 0.1) / 0.8)
    return once(production(t), {"v": seen}).select("scene_id", *xy(F.col("v")))


@query(
    "visible_on_screen",
    """
    SELECT scene_id, inside AND NOT blocked AS visible, clear FROM (
      SELECT scene_id, len(list_filter(quad, lambda p: NOT (p.x >= 0.04 AND p.x <= 0.96 AND p.y >= 0.02 AND p.y <= 0.98))) = 0 AS inside,
        len(list_filter(quad, lambda p: NOT (p.x >= 0.04 + 0.0276 AND p.x <= 0.96 - 0.0276 AND p.y >= 0.02 + 0.0288
          AND p.y <= 0.98 - 0.0288))) = 0 AS clear,
        len(list_filter(quad, lambda p: p.x >= 0.8 AND p.x <= 0.95 AND p.y >= 0.05 AND p.y <= 0.13)) > 0 AS blocked FROM fx_framed)
    """,
)
def visible_on_screen(t: Tables) -> DataFrame:
    """Every corner in the visible region and none under an opaque control; clear with a margin."""
    q = F.col("quad")
    left, top, right, bottom = 0.04, 0.02, 0.96, 0.98
    mx, my = 0.0276, 0.0288
    inside = F.forall(q, lambda p: (p["x"] >= left) & (p["x"] <= right) & (p["y"] >= top) & (p["y"] <= bottom))
    clear = F.forall(
        q,
        lambda p: (p["x"] >= left + mx) & (p["x"] <= right - mx) & (p["y"] >= top + my) & (p["y"] <= bottom - my),
    )
    blocked = F.exists(q, lambda p: (p["x"] >= 0.8) & (p["x"] <= 0.95) & (p["y"] >= 0.05) & (p["y"] <= 0.13))
    return framed(t).select("scene_id", (inside & ~blocked).alias("visible"), clear.alias("clear"))


@query(
    "visible_region",
    """
    SELECT scene_id, round((l - fl) / fw, 6) AS x, round((tp - ft) / fh, 6) AS y, round((rt - l) / fw, 6) AS width,
           round((bt - tp) / fh, 6) AS height
    FROM (SELECT *, greatest(fl, 0) AS l, greatest(ft, ct) AS tp, least(fl + fw, 400) AS rt, least(ft + fh, cb) AS bt FROM (
      SELECT *, CASE WHEN cover THEN (400 - fw) / 2 ELSE (400 - fw) / 2 END AS fl,
             CASE WHEN cover THEN (800 - fh) / 2 ELSE ct + (cb - ct - fh) / 2 END AS ft
      FROM (SELECT *, vw * s AS fw, vh * s AS fh FROM (
        SELECT *, CASE WHEN cover THEN greatest(400 / vw, 800 / vh) ELSE least(400 / vw, (cb - ct) / vh) END AS s FROM (
          SELECT scene_id, scene_id % 2 = 0 AS cover, CAST(720 AS DOUBLE) AS vw, 1280 + 40.0 * (scene_id % 5) AS vh,
                 20.0 + 100 * abs(e[1]) AS ct, 800 - 60.0 - 100 * abs(e[2]) AS cb FROM fx_prod)))))
    """,
)
def visible_region(t: Tables) -> DataFrame:
    """Visible part of a frame drawn on a 400×800 stage under a cover or contain fit and two bars."""
    scene = F.col("scene_id")
    base = production(t).select(
        "scene_id",
        (scene % 2 == 0).alias("cover"),
        F.lit(720.0).alias("vw"),
        (1280 + 40.0 * (scene % 5)).alias("vh"),
        (20.0 + 100 * F.abs(e(1))).alias("top"),
        (800 - 60.0 - 100 * F.abs(e(2))).alias("bottom"),
    )
    c = F.col
    clear_height = c("bottom") - c("top")
    fit = F.when(c("cover"), F.greatest(400 / c("vw"), 800 / c("vh"))).otherwise(
        F.least(400 / c("vw"), clear_height / c("vh"))
    )
    rows = once(base, {"fw": c("vw") * fit, "fh": c("vh") * fit})
    rows = once(
        rows,
        {
            "fl": (400 - c("fw")) / 2,
            "ft": F.when(c("cover"), (800 - c("fh")) / 2).otherwise(c("top") + (clear_height - c("fh")) / 2),
        },
    )
    left, top = F.greatest(c("fl"), F.lit(0.0)), F.greatest(c("ft"), c("top"))
    right, bottom = F.least(c("fl") + c("fw"), F.lit(400.0)), F.least(c("ft") + c("fh"), c("bottom"))
    return rounded(
        rows.select(
            "scene_id",
            ((left - c("fl")) / c("fw")).alias("x"),
            ((top - c("ft")) / c("fh")).alias("y"),
            ((right - left) / c("fw")).alias("width"),
            ((bottom - top) / c("fh")).alias("height"),
        )
    )


_SEEN = ["seen", "inferred", "unknown"]


def _sql_flag(i: int) -> str:
    return f"CASE WHEN e[{i}] > 0.1 THEN 'inferred' WHEN e[{i}] < -0.15 THEN 'unknown' ELSE 'seen' END"


def flag(i: int) -> Column:
    return F.when(e(i) > 0.1, "inferred").when(e(i) < -0.15, "unknown").otherwise("seen")


@query(
    "corner_flags",
    f"""
    SELECT scene_id, CASE WHEN measured THEN sep OR len(list_filter(f, lambda v: v <> 'seen')) > 0 ELSE true END AS uncertain,
           measured AND len(list_filter(f, lambda v: v = 'unknown')) > 0 AS has_unknown,
           measured AND len(list_filter(f, lambda v: v = 'inferred')) > 0 AS has_inferred
    FROM (SELECT scene_id, [{', '.join(_sql_flag(i) for i in range(50, 54))}] AS f, e[54] > 0.2 AS sep,
                 e[55] <= 0.15 AS measured FROM fx_prod)
    """,
)
def corner_flags(t: Tables) -> DataFrame:
    corners = F.create_map(*[v for i, n in enumerate(("tl", "tr", "br", "bl")) for v in (F.lit(n), flag(50 + i))])
    rows = production(t).select("scene_id", F.when(e(55) <= 0.15, corners).alias("corners"), (e(54) > 0.2).alias("separate"))
    told = F.map_values("corners")
    measured = F.col("corners").isNotNull()
    return rows.select(
        "scene_id",
        F.when(measured, F.col("separate") | F.exists(told, lambda v: v != "seen")).otherwise(True).alias("uncertain"),
        (measured & F.coalesce(F.exists(told, lambda v: v == "unknown"), F.lit(False))).alias("has_unknown"),
        (measured & F.coalesce(F.exists(told, lambda v: v == "inferred"), F.lit(False))).alias("has_inferred"),
    )


# ── stills ───────────────────────────────────────────────────────────────────


def _still_map(quad: Column, turns: Column, fov: Column) -> Column:
    """Preview (720×1280) to still (3024×4032 or turned), relabelled by position."""
    turned = turns % 2 == 1
    pw, ph = F.when(turned, 1280.0).otherwise(720.0), F.when(turned, 720.0).otherwise(1280.0)
    sw, sh = F.when(turned, 4032.0).otherwise(3024.0), F.when(turned, 3024.0).otherwise(4032.0)

    def moved(p: Column) -> Column:
        x = F.when(turns == 1, 1 - p["y"]).when(turns == 2, 1 - p["x"]).when(turns == 3, p["y"]).otherwise(p["x"])
        y = F.when(turns == 1, p["x"]).when(turns == 2, 1 - p["y"]).when(turns == 3, 1 - p["x"]).otherwise(p["y"])
        return g.point(0.5 + ((x - 0.5) * pw / 1280.0) * 4032.0 / sw / fov, 0.5 + ((y - 0.5) * ph / 1280.0) * 4032.0 / sh / fov)

    points = F.transform(quad, moved)

    def nearest(sx: int, sy: int, pts: Column) -> Column:
        scored = F.transform(pts, lambda p, i: F.struct((p["x"] * sx + p["y"] * sy).alias("s"), i.alias("i"), p.alias("p")))
        return F.array_min(scored)["p"]

    return g.let(points, lambda pts: F.array(*[nearest(sx, sy, pts) for sx, sy in ((1, 1), (-1, 1), (-1, -1), (1, -1))]))


_TX = "CASE turns WHEN 1 THEN 1 - p.y WHEN 2 THEN 1 - p.x WHEN 3 THEN p.y ELSE p.x END"
_TY = "CASE turns WHEN 1 THEN p.x WHEN 2 THEN 1 - p.y WHEN 3 THEN 1 - p.x ELSE p.y END"


def _sql_near(sx: str, sy: str) -> str:
    keys = f"list_transform(m0, lambda p: {sx} p.x {sy} p.y)"
    return f"m0[list_position({keys}, list_min({keys}))]"


view(
    "fx_mapped",
    f"""
    SELECT *, [{_sql_near('', '+')}, {_sql_near('-', '+')}, {_sql_near('-', '-')}, {_sql_near('', '-')}] AS mapped FROM (
      SELECT *, list_transform(quad, lambda p: struct_pack(
          x := 0.5 + (({_TX}) - 0.5) * pw / 1280 * 4032 / sw / fov, y := 0.5 + (({_TY}) - 0.5) * ph / 1280 * 4032 / sh / fov)) AS m0
      FROM (SELECT *, CASE WHEN turns % 2 = 1 THEN 1280.0::DOUBLE ELSE 720 END AS pw, CASE WHEN turns % 2 = 1 THEN 720.0::DOUBLE
              ELSE 1280 END AS ph, CASE WHEN turns % 2 = 1 THEN 4032.0::DOUBLE ELSE 3024 END AS sw,
              CASE WHEN turns % 2 = 1 THEN 3024.0::DOUBLE ELSE 4032 END AS sh
            FROM (SELECT scene_id, e, quad, scene_id % 4 AS turns, 1 + 0.3 * e[38] AS fov FROM fx_prod)))
    """,
)


def mapped(t: Tables) -> DataFrame:
    rows = production(t).select("scene_id", "e", "quad", (F.col("scene_id") % 4).alias("turns"), (1 + 0.3 * e(38)).alias("fov"))
    return once(rows, {"mapped": _still_map(F.col("quad"), F.col("turns"), F.col("fov"))})


@query("still_mapping", f"SELECT scene_id, {sql_xy('mapped')} FROM fx_mapped")
def still_mapping(t: Tables) -> DataFrame:
    return mapped(t).select("scene_id", *xy(F.col("mapped")))


def _sql_inside(q: str) -> str:
    return f"len(list_filter({q}, lambda p: NOT (p.x >= m AND p.x <= 1 - m AND p.y >= m AND p.y <= 1 - m))) = 0"


_CENTRED = "lambda p: struct_pack(x := p.x - 0.5, y := (p.y - 0.5) * asp)"


@query(
    "still_check",
    f"""
    SELECT scene_id, CASE WHEN corners IS NULL THEN 'no-page' WHEN NOT {_sql_inside('corners')} THEN 'corner-outside'
        WHEN auto AND scene_id % 5 = 0 THEN 'unverified'
        WHEN sqrt(sq / 4) / sqrt(1 + asp * asp) > 0.03 OR scale < 0.6 OR scale > 1.25 OR abs(tx) > 0.12 OR abs(ty / asp) > 0.12
          THEN 'moved'
        WHEN NOT {_sql_inside('predicted')} THEN 'corner-outside' END AS attention
    FROM (SELECT *, list_transform(mapped, lambda p: struct_pack(x := 0.5 + scale * (p.x - 0.5) + tx,
                   y := 0.5 + scale * (p.y - 0.5) + ty / asp)) AS predicted,
        list_sum(list_transform(range(1, 5), lambda i: (scale * a[i].x + tx - c[i].x) * (scale * a[i].x + tx - c[i].x)
          + (scale * a[i].y + ty - c[i].y) * (scale * a[i].y + ty - c[i].y))) AS sq
      FROM (SELECT *, mbx - scale * max_ AS tx, mby - scale * may AS ty FROM (
        SELECT *, list_sum(list_transform(range(1, 5), lambda i: (a[i].x - max_) * (c[i].x - mbx) + (a[i].y - may) * (c[i].y - mby)))
          / list_sum(list_transform(range(1, 5), lambda i: (a[i].x - max_) * (a[i].x - max_) + (a[i].y - may) * (a[i].y - may))) AS scale
        FROM (SELECT *, (a[1].x + a[2].x + a[3].x + a[4].x) / 4 AS max_, (a[1].y + a[2].y + a[3].y + a[4].y) / 4 AS may,
                (c[1].x + c[2].x + c[3].x + c[4].x) / 4 AS mbx, (c[1].y + c[2].y + c[3].y + c[4].y) / 4 AS mby
          FROM (SELECT *, list_transform(mapped, {_CENTRED}) AS a, list_transform(corners, {_CENTRED}) AS c FROM (
            SELECT *, CASE WHEN scene_id % 9 <> 0 THEN list_transform(range(1, 5), lambda i: struct_pack(
                x := 0.5 + (mapped[i].x - 0.5) * 0.7 + 0.2 * e[40 + 2 * i], y := 0.5 + (mapped[i].y - 0.5) * 0.7 + 0.2 * e[41 + 2 * i])) END
                AS corners, scene_id % 2 = 0 AS auto, CASE WHEN scene_id % 2 = 0 THEN 0.004 ELSE 0.002 END AS m,
                CASE WHEN turns % 2 = 1 THEN 0.75 ELSE 4032.0 / 3024 END::DOUBLE AS asp FROM fx_mapped))))))
    """,
)
def still_check(t: Tables) -> DataFrame:
    """First reason a photo disagrees with the live quad mapped into it."""
    c = F.col
    shifted = F.array(
        *[
            g.point(
                0.5 + (g.corner(c("mapped"), i)["x"] - 0.5) * 0.7 + 0.2 * e(42 + 2 * i),
                0.5 + (g.corner(c("mapped"), i)["y"] - 0.5) * 0.7 + 0.2 * e(43 + 2 * i),
            )
            for i in range(4)
        ]
    )
    auto = c("scene_id") % 2 == 0
    rows = once(
        mapped(t),
        {
            "corners": F.when(c("scene_id") % 9 != 0, shifted),
            "margin": F.when(auto, r.STILL_EDGE_MARGIN).otherwise(r.STILL_EDGE_MARGIN_MANUAL),
            "aspect": F.when(c("turns") % 2 == 1, 0.75).otherwise(F.lit(4032.0) / 3024),
        },
    )
    rows = once(rows, r.still_fit(c("mapped"), c("corners"), c("aspect")))
    rows = once(rows, {"scale": F.when(c("den") > 0, c("num") / c("den")).otherwise(1.0)})
    rows = once(rows, {"tx": c("bx") - c("scale") * c("ax"), "ty": c("by") - c("scale") * c("ay")})
    square = None
    for i in range(4):
        a, q = g.corner(c("mapped"), i), g.corner(c("corners"), i)
        dx = c("scale") * (a["x"] - 0.5) + c("tx") - (q["x"] - 0.5)
        dy = c("scale") * ((a["y"] - 0.5) * c("aspect")) + c("ty") - (q["y"] - 0.5) * c("aspect")
        one = dx * dx + dy * dy
        square = one if square is None else square + one
    predicted = g.map_quad(
        c("mapped"),
        lambda p: 0.5 + c("scale") * (p["x"] - 0.5) + c("tx"),
        lambda p: 0.5 + c("scale") * (p["y"] - 0.5) + c("ty") / c("aspect"),
    )
    diagonal = F.sqrt(1 + c("aspect") * c("aspect"))
    rows = once(rows, {"residual": F.sqrt(square / 4) / diagonal, "predicted": predicted})
    moved = (
        (c("residual") > r.STILL_MATCH_RESIDUAL)
        | (c("scale") < r.STILL_SCALE_LOW)
        | (c("scale") > r.STILL_SCALE_HIGH)
        | (F.abs("tx") > r.STILL_MAX_SHIFT)
        | (F.abs(c("ty") / c("aspect")) > r.STILL_MAX_SHIFT)
    )
    attention = (
        F.when(c("corners").isNull(), "no-page")
        .when(~r.inside_margin(c("corners"), c("margin")), "corner-outside")
        .when(auto & (c("scene_id") % 5 == 0), "unverified")
        .when(moved, "moved")
        .when(~r.inside_margin(c("predicted"), c("margin")), "corner-outside")
    )
    return rows.select("scene_id", attention.alias("attention"))


@query(
    "resolve_corner_source",
    """
    SELECT scene_id, CASE WHEN live THEN 'live' WHEN found THEN 'detected' WHEN scene_id % 3 <> 0 THEN 'fallback' END AS corners_from
    FROM (SELECT p.scene_id, coalesce(p.det IS NOT NULL AND 600 + 2000 * p.e[58] BETWEEN 0 AND 800, false) AS live, x.det IS NOT NULL AS found
          FROM fx_prod p JOIN (SELECT * FROM fx_det WHERE variant = 'refined') x USING (scene_id))
    """,
)
def resolve_corner_source(t: Tables) -> DataFrame:
    """Live corners if their buffer was fresh at the tap, else the photo's own, else the fallback."""
    rows = b.detections(t).withColumn("age", 600 + 2000 * e(58))
    sides = rows.groupBy("scene_id").agg(
        F.bool_or((F.col("variant") == "production") & F.col("det").isNotNull() & F.col("age").between(0, 800)).alias("live"),
        F.bool_or((F.col("variant") == "refined") & F.col("det").isNotNull()).alias("found"),
    )
    source = F.when(F.col("live"), "live").when(F.col("found"), "detected").when(F.col("scene_id") % 3 != 0, "fallback")
    return sides.select("scene_id", source.alias("corners_from"))


@query(
    "resolution_check",
    """
    SELECT scene_id, round(expected, 6) AS expected, round(kept, 6) AS kept, abs(kept / expected - 1) <= 0.03 AS as_expected
    FROM (SELECT scene_id, 0.72 * 3024 * CASE WHEN scene_id % 2 = 0 THEN 1 ELSE 1080.0 / 3024 END AS expected,
                 0.72 * 3024 * CASE WHEN scene_id % 2 = 0 THEN 1 ELSE 1080.0 / 3024 END * (1 + 0.3 * e[57]) AS kept FROM fx_prod)
    """,
)
def resolution_check(t: Tables) -> DataFrame:
    """Page pixels kept against those expected of the sensor and source, within 3 %."""
    scale = F.when(F.col("scene_id") % 2 == 0, 1.0).otherwise(F.lit(1080.0) / 3024)
    expected = F.lit(0.72) * 3024 * scale
    rows = once(production(t), {"expected": expected, "kept": expected * (1 + 0.3 * e(57))})
    near = F.abs(F.col("kept") / F.col("expected") - 1) <= 0.03
    return rounded(rows.select("scene_id", "expected", "kept", near.alias("as_expected")))


# ── page measures ────────────────────────────────────────────────────────────


@query(
    "capture_gate_verdict",
    """
    SELECT scene_id, CASE WHEN NOT (lh > 0 AND lh * sb >= 3 AND lh * sb <= 80 * sb) THEN 'unknown' WHEN s < 0.1068 THEN 'blurry'
        WHEN lh * sb < 7 THEN 'too_small' WHEN s * (lh * sb) < 1.64 THEN CASE WHEN s / 0.1068 < lh * sb / 7 THEN 'blurry' ELSE 'too_small' END
        ELSE 'ok' END AS reason
    FROM (SELECT scene_id, 0.15 + e[10] AS s, 6 + 40 * e[11] AS lh, 1 + scene_id % 3 AS sb FROM fx_prod)
    """,
)
def capture_gate_verdict(t: Tables) -> DataFrame:
    reason = r.capture_gate(0.15 + e(10), 6 + 40 * e(11), 1 + F.col("scene_id") % 3)
    return production(t).select("scene_id", reason.alias("reason"))


@query(
    "frame_hint",
    """
    SELECT scene_id, CASE WHEN 0.1 + 0.3 * e[12] < 0.1068 * CAST(0.85 AS DOUBLE) THEN 'hold_still' WHEN 60 + 200 * e[13] < 45 THEN 'low_light'
        ELSE 'good' END AS hint FROM fx_prod
    """,
)
def frame_hint(t: Tables) -> DataFrame:
    return production(t).select("scene_id", r.frame_hint(0.1 + 0.3 * e(12), 60 + 200 * e(13)).alias("hint"))


def _measures(base: int) -> dict[str, Column]:
    return {
        "blank": 0.1 + 0.3 * e(base),
        "ink": 0.2 + 0.1 * e(base + 1),
        "repeat": 0.3 + e(base + 2),
        "lines": F.floor(4 + 20 * e(base + 3)),
        "curvature": 0.004 + 0.02 * e(base + 4),
    }


def _sql_measures(p: str, base: int) -> str:
    return (
        f"0.1 + 0.3 * e[{base}] AS {p}blank, 0.2 + 0.1 * e[{base + 1}] AS {p}ink, 0.3 + e[{base + 2}] AS {p}rep, "
        f"floor(4 + 20 * e[{base + 3}]) AS {p}lines, 0.004 + 0.02 * e[{base + 4}] AS {p}curv"
    )


@query(
    "semantic_verdict",
    f"""
    SELECT scene_id, CASE WHEN scene_id % 12 = 0 THEN 'structural' WHEN ablank - bblank > 0.08 OR bink - aink > 0.02 OR arep - brep > 0.25
        THEN 'regression'
        WHEN least(alines, blines) >= 3 THEN CASE WHEN acurv > greatest(bcurv * 1.6, 0.002) OR NOT
          acurv <= greatest(bcurv * CASE WHEN moved > 0.08 THEN 0.85 ELSE 1.15 END, 0.002) THEN 'regression' ELSE 'accept' END
        WHEN moved <= 0.05 AND edge <= 0.03 THEN 'accept' ELSE 'insufficient-evidence' END AS verdict
    FROM (SELECT scene_id, {_sql_measures('b', 14)}, {_sql_measures('a', 20)}, 0.05 + 0.2 * e[26] AS moved, 0.03 + 0.1 * e[27] AS edge
          FROM fx_prod)
    """,
)
def semantic_verdict(t: Tables) -> DataFrame:
    verdict = r.semantic_verdict(
        F.col("scene_id") % 12 != 0, _measures(14), _measures(20), 0.05 + 0.2 * e(26), 0.03 + 0.1 * e(27)
    )
    return production(t).select("scene_id", verdict.alias("verdict"))


@query(
    "deskew_judgement",
    f"""
    SELECT scene_id, CASE WHEN 0.001 + 0.01 * e[28] > 0.002 OR 0.005 + 0.03 * e[29] > 0.01 THEN 'clips' WHEN resid IS NULL THEN 'unmeasured'
        WHEN abs(resid) > greatest(0.35, 0.5 * abs(5 * e[31])) THEN 'not-level'
        WHEN blines >= 3 AND alines >= 3 AND acurv > greatest(bcurv * 1.6, 0.002) THEN 'bow-worse'
        WHEN blines >= 3 AND alines < greatest(3, 0.6 * blines) THEN 'lines-lost' END AS rejection
    FROM (SELECT scene_id, e, {_sql_measures('b', 14)}, {_sql_measures('a', 20)}, CASE WHEN scene_id % 10 <> 0 THEN 2 * e[30] END AS resid
          FROM fx_prod)
    """,
)
def deskew_judgement(t: Tables) -> DataFrame:
    residual = F.when(F.col("scene_id") % 10 != 0, 2 * e(30))
    why = r.deskew_judgement(
        0.001 + 0.01 * e(28), 0.005 + 0.03 * e(29), residual, 5 * e(31), _measures(14), _measures(20)
    )
    return production(t).select("scene_id", why.alias("rejection"))


def _sql_edge_ratio(i: int, j: int) -> str:
    a, c = _sql_side(i), _sql_side(j)
    return f"greatest({a}, {c}) / greatest(1e-9, least({a}, {c}))"


@query(
    "map_guard",
    f"""
    SELECT scene_id, CASE WHEN fill < 0.55 THEN 'quad-fill' WHEN lo < 25 OR hi > 155 THEN 'quad-angle' WHEN er > 2.5 THEN 'quad-edge-ratio'
        WHEN 400 + 1000 * e[39] < 320 THEN 'crop-resolution' END AS failure
    FROM (SELECT scene_id, e, abs({sql_area('q')}) / ((list_max(list_transform(q, lambda p: p.x)) - list_min(list_transform(q, lambda p: p.x)))
            * (list_max(list_transform(q, lambda p: p.y)) - list_min(list_transform(q, lambda p: p.y)))) AS fill,
            least({', '.join(_sql_angle(i) for i in range(4))}) AS lo, greatest({', '.join(_sql_angle(i) for i in range(4))}) AS hi,
            greatest({_sql_edge_ratio(0, 2)}, {_sql_edge_ratio(3, 1)}) AS er
          FROM (SELECT scene_id, e, {sql_scale('quad')} AS q FROM fx_prod))
    """,
)
def map_guard(t: Tables) -> DataFrame:
    rows = once(production(t), {"q": g.scaled(F.col("quad"), F.col("w"), F.col("h"))})
    return rows.select("scene_id", r.eligibility(F.col("q"), 400 + 1000 * e(39), 320.0).alias("failure"))


_DISPLACED = "(SELECT scene_id, unnest(list_transform(e, lambda v: abs(v))) AS dv FROM fx_prod)"


@query(
    "map_displacement_guard",
    f"""
    SELECT scene_id, round(avg(dv), 6) AS mean, round(quantile_cont(dv, 0.95), 6) AS p95, round(max(dv), 6) AS largest,
           avg(dv) <= 0.25 AND quantile_cont(dv, 0.95) <= 0.35 AND max(dv) <= 0.5 AS ok FROM {_DISPLACED} GROUP BY scene_id
    """,
)
def map_displacement_guard(t: Tables) -> DataFrame:
    """Mean, p95 and largest displacement of a coordinate map's nodes against their bounds."""
    from pagegauge.operators.percentiles import LINEAR, Wanted, with_percentiles

    nodes = production(t).select("scene_id", F.explode("e").alias("v")).select("scene_id", F.abs("v").alias("dv"))
    table = nodes.groupBy("scene_id").agg(F.avg("dv").alias("mean"), F.max("dv").alias("largest"))
    table = with_percentiles(
        table, nodes, ["scene_id"], {"dv": (F.col("dv"), 1e-2)}, [Wanted("p95", "dv", 0.95, LINEAR)]
    )
    ok = (F.col("mean") <= 0.25) & (F.col("p95") <= 0.35) & (F.col("largest") <= 0.5)
    return rounded(table.withColumn("ok", ok))


@query(
    "candidate_acceptance",
    """
    SELECT scene_id, coalesce(cs <= bs + greatest(0.05 * bs, 0.02 * 0.05) AND ca <= ba + greatest(0.05 * ba, 0.02 * 0.05)
        AND len(list_filter(range(1, 5), lambda i: NOT c[i] <= greatest(1.1 * s[i], s[i] + 0.001))) = 0
        AND list_sum(c) / 4 <= 0.5 * (list_sum(s) / 4), false) AS acceptable
    FROM (SELECT scene_id, abs(e[1]) AS bs, abs(e[1]) * (1 + e[5]) AS cs, abs(e[2]) AS ba, CASE WHEN scene_id % 15 <> 0 THEN abs(e[2]) * (1 + e[6]) END AS ca,
            [0.02 + abs(e[7]), 0.02 + abs(e[8]), 0.02 + abs(e[9]), 0.02 + abs(e[10])] AS s,
            [0.02 + 0.3 * abs(e[11]), 0.02 + 0.3 * abs(e[12]), 0.02 + 0.3 * abs(e[13]), 0.02 + 0.3 * abs(e[14])] AS c FROM fx_prod)
    """,
)
def candidate_acceptance(t: Tables) -> DataFrame:
    base = {"straight": F.abs(e(1)), "aligned": F.abs(e(2))}
    new = {
        "straight": F.abs(e(1)) * (1 + e(5)),
        "aligned": F.when(F.col("scene_id") % 15 != 0, F.abs(e(2)) * (1 + e(6))),
    }
    sides = [(0.02 + F.abs(e(7 + i)), 0.02 + 0.3 * F.abs(e(11 + i))) for i in range(4)]
    ok = r.candidate_acceptable(base, new, sides, F.lit(0.05))
    return production(t).select("scene_id", ok.alias("acceptable"))


_CLIP_NAMES = ["ink", "ink_abs", "x0", "y0", "x1", "y1", "band_t", "band_r", "band_b", "band_l"]


def _clip_side(k: int) -> dict[str, Column]:
    lead = 40 + 10 * k
    values = [
        1600 + 2000 * e(lead),
        0.2 + 0.05 * e(lead + 1),
        0.03 + 0.1 * e(lead + 2),
        0.03 + 0.1 * e(lead + 3),
        0.97 + 0.1 * e(lead + 4),
        0.97 + 0.1 * e(lead + 5),
        *[0.01 + 0.05 * e(lead + 6 + i) for i in range(4)],
    ]
    return dict(zip(_CLIP_NAMES, values))


def _sql_clip_side(p: str, k: int) -> str:
    lead = 40 + 10 * k
    values = [
        f"1600 + 2000 * e[{lead}]",
        f"0.2 + 0.05 * e[{lead + 1}]",
        f"0.03 + 0.1 * e[{lead + 2}]",
        f"0.03 + 0.1 * e[{lead + 3}]",
        f"0.97 + 0.1 * e[{lead + 4}]",
        f"0.97 + 0.1 * e[{lead + 5}]",
        *[f"0.01 + 0.05 * e[{lead + 6 + i}]" for i in range(4)],
    ]
    return ", ".join(f"{v} AS {p}{n}" for v, n in zip(values, _CLIP_NAMES))


@query(
    "clipping_check",
    f"""
    SELECT scene_id, CASE WHEN NOT fink >= 1500 THEN 'unmeasured'
        WHEN ratio < 0.92 THEN CASE WHEN abs(wr - hr) <= 0.03 AND ratio / greatest(1e-9, wr * hr) >= 0.97 AND NOT (nt OR nr OR nb OR nl)
          THEN 'shrunk' ELSE 'cut' END
        WHEN ratio < 0.985 AND ((nt AND oband_t > fband_t + 0.004) OR (nr AND oband_r > fband_r + 0.004)
          OR (nb AND oband_b > fband_b + 0.004) OR (nl AND oband_l > fband_l + 0.004)) THEN 'pushed' ELSE 'kept' END AS verdict
    FROM (SELECT *, oink_abs / greatest(1e-9, fink_abs) AS ratio, (ox1 - ox0) / greatest(1e-9, fx1 - fx0) AS wr,
            (oy1 - oy0) / greatest(1e-9, fy1 - fy0) AS hr, oy0 < 0.02 AND NOT fy0 < 0.02 AS nt, ox1 > 0.98 AND NOT fx1 > 0.98 AS nr,
            oy1 > 0.98 AND NOT fy1 > 0.98 AS nb, ox0 < 0.02 AND NOT fx0 < 0.02 AS nl
          FROM (SELECT scene_id, {_sql_clip_side('f', 0)}, {_sql_clip_side('o', 1)} FROM fx_prod))
    """,
)
def clipping_check(t: Tables) -> DataFrame:
    return production(t).select("scene_id", r.clipping(_clip_side(0), _clip_side(1)).alias("verdict"))


_REASONS = ["curl-absent", "timeout", "semantic-regression", "guard-scale", "model-unavailable", "odd"]


@query(
    "outcome_rollup_map",
    f"""
    SELECT outcome, count(*) AS n, bool_and(outcome IN ('nothing', 'declined', 'unverified', 'page')) AS final FROM (
      SELECT CASE WHEN fin AND l_linenumber % 3 = 0 THEN 'transient' WHEN fin AND l_linenumber % 2 = 0 THEN 'nothing' ELSE raw END AS outcome
      FROM (SELECT *, raw IN ('nothing', 'declined', 'unverified', 'page') AS fin FROM (
        SELECT l_linenumber, CASE {b.sql_pick(_REASONS, 'l_partkey % 6')} WHEN 'curl-absent' THEN 'nothing' WHEN 'semantic-regression'
          THEN 'declined' WHEN 'guard-scale' THEN 'page' WHEN 'model-unavailable' THEN 'download' ELSE 'transient' END AS raw FROM lineitem)))
    GROUP BY outcome
    """,
)
def outcome_rollup_map(t: Tables) -> DataFrame:
    reason = b.pick(_REASONS, (F.col("l_partkey") % 6).cast("int"))
    line = F.col("l_linenumber")
    rows = t.lineitem.select(r.outcome_of(reason, line % 3 == 0, line % 2 == 0).alias("outcome"))
    counted = rows.groupBy("outcome").agg(F.count("*").alias("n"))
    return counted.withColumn("final", F.col("outcome").isin(r.FINAL_OUTCOMES))


@query(
    "page_row_verdict",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'quiet'
        WHEN o_orderkey % 5 = 0 THEN 'noCorners' WHEN gate = 'blurry' THEN 'warned' WHEN gate = 'unknown' THEN 'quiet' ELSE 'ok' END AS state, gate
    FROM (SELECT *, CASE WHEN o_custkey % 3 <> 0 THEN CASE o_custkey % 4 WHEN 0 THEN 'blurry' WHEN 1 THEN 'unknown' ELSE 'ok' END END AS gate
          FROM orders)
    """,
)
def page_row_verdict(t: Tables) -> DataFrame:
    """A page's row; its gate reading counts only when taken of the source it still has."""
    c = F.col
    source_revision, gate_revision = F.lit(1), F.when(c("o_custkey") % 3 != 0, 1).otherwise(0)
    reading = F.when(c("o_custkey") % 4 == 0, "blurry").when(c("o_custkey") % 4 == 1, "unknown").otherwise("ok")
    gate = F.when(gate_revision == source_revision, reading)
    state = (
        F.when((c("o_orderstatus") == "F") & (c("o_orderkey") % 7 == 0), "failed")
        .when(c("o_orderstatus") == "P", "quiet")
        .when(c("o_orderkey") % 5 == 0, "noCorners")
        .when(c("gate") == "blurry", "warned")
        .when(c("gate") == "unknown", "quiet")
        .otherwise("ok")
    )
    return t.orders.withColumn("gate", gate).select("o_orderkey", state.alias("state"), "gate")


@query(
    "paper_memory_predicate",
    """
    SELECT scene_id, CASE WHEN NOT 3000 + 20000 * e[15] <= 5000 THEN 'expired' WHEN NOT 0.03 + 0.2 * e[16] <= 0.06 THEN 'drift'
        WHEN scene_id % 6 = 0 THEN 'sides' WHEN len(list_filter([0.9 + e[17], 0.9 + e[18], 0.9 + e[19], 0.9 + e[20]], lambda v: v < 0.8)) > 0
        THEN 'support' WHEN scene_id % 8 = 3 THEN 'open' WHEN NOT 0.03 + 0.1 * e[21] >= 0.015 THEN 'border' END AS why FROM fx_prod
    """,
)
def paper_memory_predicate(t: Tables) -> DataFrame:
    scene = F.col("scene_id")
    why = r.paper_remembered(
        3000 + 20000 * e(15),
        0.03 + 0.2 * e(16),
        F.when(scene % 6 == 0, 3).otherwise(4),
        F.array(*[0.9 + e(17 + i) for i in range(4)]),
        F.when(scene % 8 == 3, 1).otherwise(0),
        0.03 + 0.1 * e(21),
    )
    return production(t).select("scene_id", why.alias("why"))
