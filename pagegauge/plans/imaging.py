"""Pixel, component and line queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import imaging as im
from pagegauge.operators import rasters as rs
from pagegauge.operators.percentiles import LINEAR, Wanted, percentiles
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import rounded
from pagegauge.plans.registry import Tables, query, view
from pagegauge.session import stored, written_once


@query(
    "luma_table",
    "SELECT image_id, y, x, round(CAST(0.299 * luma + 0.587 * (luma * 3 % 256) + 0.114 * (255 - luma) AS DOUBLE), 6) AS luma FROM fx_luma",
)
def luma_table(t: Tables) -> DataFrame:
    level = F.col("luma")
    grey = im.luma(level, level * 3 % 256, 255 - level)
    return rounded(b.luma(t).select("image_id", "y", "x", grey.alias("luma")))


@query(
    "luma_histogram",
    """
    SELECT image_id, round(avg(luma), 6) AS mean_luma, max(luma) FILTER (above >= total * 0.05) AS bright FROM (
      SELECT *, count(*) OVER (PARTITION BY image_id ORDER BY luma DESC) AS above, count(*) OVER (PARTITION BY image_id) AS total FROM fx_luma)
    GROUP BY image_id
    """,
)
def luma_histogram(t: Tables) -> DataFrame:
    return rounded(im.bright_end(b.luma(t)))


view(
    "fx_otsu",
    """
    SELECT image_id, arg_max(level, (round(v, 4), -level)) AS threshold FROM (
      SELECT image_id, level, wb * (total - wb) * (sb / wb - (al - sb) / (total - wb)) * (sb / wb - (al - sb) / (total - wb)) AS v
      FROM (SELECT image_id, luma AS level, CAST(sum(n) OVER w AS DOUBLE) AS wb, CAST(sum(luma * n) OVER w AS DOUBLE) AS sb,
              CAST(sum(n) OVER p AS DOUBLE) AS total, CAST(sum(luma * n) OVER p AS DOUBLE) AS al
            FROM (SELECT image_id, luma, count(*) AS n FROM fx_luma GROUP BY 1, 2)
            WINDOW w AS (PARTITION BY image_id ORDER BY luma), p AS (PARTITION BY image_id)) WHERE total > wb) GROUP BY image_id
    """,
)


@query("otsu_threshold", "SELECT image_id, threshold FROM fx_otsu")
def otsu_threshold(t: Tables) -> DataFrame:
    return im.otsu(b.luma(t))


def _sql_px(source: str, dx: int, dy: int, name: str) -> str:
    return f"LEFT JOIN {source} {name} ON {name}.image_id = c.image_id AND {name}.x = c.x + {dx} AND {name}.y = c.y + {dy}"


def _sql_gradient(source: str) -> str:
    near = {(dx, dy): f"n{i}" for i, (dx, dy) in enumerate((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy)}
    joins = " ".join(_sql_px(source, dx, dy, n).replace("LEFT JOIN", "JOIN") for (dx, dy), n in near.items())

    def v(dx, dy):
        return f"{near[(dx, dy)]}.v"

    gx = f"(-{v(-1, -1)} + {v(1, -1)} - 2 * {v(-1, 0)} + 2 * {v(1, 0)} - {v(-1, 1)} + {v(1, 1)})"
    gy = f"(-{v(-1, -1)} - 2 * {v(0, -1)} - {v(1, -1)} + {v(-1, 1)} + 2 * {v(0, 1)} + {v(1, 1)})"
    return f"SELECT c.image_id, avg(sqrt({gx} * {gx} + {gy} * {gy})) AS g FROM {source} c {joins} GROUP BY c.image_id"


view("fx_grey", "SELECT image_id, y, x, CAST(luma AS DOUBLE) AS v FROM fx_luma")
view(
    "fx_soft",
    "SELECT c.image_id, c.y, c.x, 0.25 * coalesce(u.v, c.v) + 0.5 * c.v + 0.25 * coalesce(d.v, c.v) AS v FROM "
    "(SELECT c.image_id, c.y, c.x, 0.25 * coalesce(l.v, c.v) + 0.5 * c.v + 0.25 * coalesce(r.v, c.v) AS v FROM fx_grey c "
    + _sql_px("fx_grey", -1, 0, "l")
    + " "
    + _sql_px("fx_grey", 1, 0, "r")
    + ") c "
    + _sql_px("(SELECT c.image_id, c.y, c.x, 0.25 * coalesce(l.v, c.v) + 0.5 * c.v + 0.25 * coalesce(r.v, c.v) AS v FROM fx_grey c "
              + _sql_px("fx_grey", -1, 0, "l") + " " + _sql_px("fx_grey", 1, 0, "r") + ")", 0, -1, "u")
    + " "
    + _sql_px("(SELECT c.image_id, c.y, c.x, 0.25 * coalesce(l.v, c.v) + 0.5 * c.v + 0.25 * coalesce(r.v, c.v) AS v FROM fx_grey c "
              + _sql_px("fx_grey", -1, 0, "l") + " " + _sql_px("fx_grey", 1, 0, "r") + ")", 0, 1, "d"),
)


@query(
    "sharpness_ratio",
    f"SELECT image_id, round(greatest(0, least(1, 1 - s.g / a.g)), 6) AS sharpness FROM ({_sql_gradient('fx_grey')}) a JOIN ({_sql_gradient('fx_soft')}) s USING (image_id)",
)
def sharpness_ratio(t: Tables) -> DataFrame:
    return rounded(im.sharpness(b.luma(t)))


@query(
    "text_line_height",
    """
    SELECT i.image_id, CAST(coalesce(r.height, 0) AS DOUBLE) AS height FROM (SELECT DISTINCT image_id FROM fx_luma) i LEFT JOIN (
      SELECT image_id, list_sort(list(n))[len(list(n)) // 2 + 1] AS height FROM (
        SELECT image_id, run, count(*) AS n FROM (
          SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS run FROM (
            SELECT image_id, y, ink, avg(ink) OVER (PARTITION BY image_id) AS m FROM (
              SELECT image_id, y, count(*) FILTER (luma < threshold) / count(*) AS ink FROM fx_luma JOIN fx_otsu USING (image_id) GROUP BY image_id, y))
          WHERE ink > greatest(0.01, m * 0.5)) GROUP BY image_id, run) GROUP BY image_id) r USING (image_id)
    """,
)
def text_line_height(t: Tables) -> DataFrame:
    return im.text_line_height(b.luma(t))


@query(
    "frame_difference",
    """
    SELECT n.image_id, round(avg(abs(n.luma - p.luma)) / 255, 6) AS score FROM fx_luma n
    JOIN fx_luma p ON p.image_id = n.image_id - 1 AND p.x = n.x AND p.y = n.y GROUP BY n.image_id
    """,
)
def frame_difference(t: Tables) -> DataFrame:
    now = b.luma(t)
    before = now.select((F.col("image_id") + 1).alias("image_id"), "y", "x", F.col("luma").alias("was"))
    pairs = now.join(before, ["image_id", "y", "x"])
    return rounded(pairs.groupBy("image_id").agg((F.avg(F.abs(F.col("luma") - F.col("was"))) / 255).alias("score")))


def _sql_box(source: str, value: str, r: int, out: str) -> str:
    """Mean over the square of radius r by a plain neighbour join."""
    return (
        f"SELECT c.*, (SELECT avg(n.{value}) FROM {source} n WHERE n.image_id = c.image_id AND abs(n.x - c.x) <= {r} AND abs(n.y - c.y) <= {r}) AS {out} FROM {source} c"
    )


view(
    "fx_paper_level",
    "SELECT g.*, p.paper, CASE WHEN v < 0.5 * paper THEN 1 ELSE 0 END AS dark FROM fx_grey g JOIN (SELECT image_id, list_sort(list(v))[CAST(floor(0.9::DOUBLE * count(*)) AS BIGINT) + 1] AS paper FROM fx_grey GROUP BY image_id) p USING (image_id)",
)
view("fx_box1", _sql_box("fx_paper_level", "v", 1, "local_mean"))
view("fx_box2", _sql_box("fx_box1", "v", 2, "wide_mean"))
view("fx_box3", "SELECT *, CASE WHEN ds > 0.6 THEN 1 ELSE 0 END AS core FROM (" + _sql_box("fx_box2", "dark", 1, "ds") + ")")
view(
    "fx_ink",
    "SELECT image_id, y, x, v, dark, nc = 0 AS on_page, v < 0.72 * local_mean AND wide_mean > 0.62 * paper AND local_mean > 0.5 * paper AND nc = 0 AS ink FROM ("
    + _sql_box("fx_box3", "core", 1, "nc")
    + ")",
)


SURROUND = {"local": 1, "wide": 2, "reach": 1}


@query(
    "ink_mask_measures",
    """
    SELECT image_id, CAST(8 AS BIGINT) AS w, CAST(8 AS BIGINT) AS h, count(*) FILTER (ink) AS ink, min(x) FILTER (ink) AS bx0, min(y) FILTER (ink) AS by0, max(x) FILTER (ink) AS bx1,
      max(y) FILTER (ink) AS by1, count(*) FILTER (on_page) AS page_area,
      round(count(*) FILTER (dark = 1 AND (x < 1 OR x >= 7 OR y < 1 OR y >= 7)) / count(*) FILTER (x < 1 OR x >= 7 OR y < 1 OR y >= 7), 6) AS border_dark,
      count(*) FILTER (ink AND y < 1) AS band_top, count(*) FILTER (ink AND x >= 7) AS band_right, count(*) FILTER (ink AND y >= 7) AS band_bottom,
      count(*) FILTER (ink AND x < 1) AS band_left FROM fx_ink GROUP BY image_id
    """,
)
def ink_mask_measures(t: Tables) -> DataFrame:
    return rounded(rs.ink_measures(b.rasters(t), **SURROUND, band=1))


def _sql_energy(angles: str) -> str:
    return f"""
      SELECT image_id, deg, round(sum(m * m), 6) AS energy FROM (
        SELECT image_id, deg, bin, sum(m) AS m FROM (
          SELECT image_id, deg, floor(r) AS bin, 1 - (r - floor(r)) AS m FROM {{p}} UNION ALL SELECT image_id, deg, floor(r) + 1, r - floor(r) FROM {{p}})
        GROUP BY image_id, deg, bin) GROUP BY image_id, deg""".replace(
        "{p}",
        f"(SELECT image_id, deg, (y - 4.0) * cos(deg * (pi() / 180)) - (x - 4.0) * sin(deg * (pi() / 180)) AS r FROM (SELECT p.image_id, p.x, p.y, {angles} AS deg FROM fx_ink_points p))",
    )


view(
    "fx_ink_points",
    "SELECT image_id, x, y FROM fx_ink WHERE ink AND image_id IN (SELECT image_id FROM fx_ink WHERE ink GROUP BY image_id HAVING count(*) >= 6)",
)
view(
    "fx_tilt",
    f"SELECT image_id, max(energy) AS ce, arg_max(deg, (energy, -deg)) AS cd, list_sort(list(energy))[81] AS mid FROM ({_sql_energy('unnest(list_transform(range(-80, 81), lambda i: i * 0.25::DOUBLE))')}) GROUP BY image_id",
)
_FINE = _sql_energy(
    "unnest((SELECT list_transform(range(-15, 16), lambda i: t.cd + i * 0.02::DOUBLE) FROM fx_tilt t WHERE t.image_id = p.image_id))"
)


@query(
    "tilt_estimate",
    f"""
    SELECT i.image_id, round(CASE WHEN f.fe > t.ce THEN f.fd ELSE t.cd END, 2) AS tilt_deg, round(greatest(f.fe, t.ce) / t.mid, 6) AS confidence
    FROM (SELECT DISTINCT image_id FROM fx_ink) i LEFT JOIN fx_tilt t USING (image_id)
    LEFT JOIN (SELECT image_id, max(energy) AS fe, arg_max(deg, (energy, -deg)) AS fd FROM ({_FINE}) GROUP BY image_id) f ON f.image_id = t.image_id
    """,
)
def tilt_estimate(t: Tables) -> DataFrame:
    return rounded(rs.tilt(b.rasters(t), **SURROUND, least_points=6))


_R2 = "abs({a}.v - 2 * c.v + {b}.v)"
view(
    "fx_blocks",
    "SELECT c.image_id, c.x // 2 AS bx, c.y // 2 AS by, avg(c.v) AS mean, (coalesce(sum(abs(l.v - 2 * c.v + r.v)), 0) + coalesce(sum(abs(u.v - 2 * c.v + d.v)), 0)) / greatest(1, count(l.v + r.v) + count(u.v + d.v)) AS rough FROM fx_grey c "
    + " ".join(_sql_px("fx_grey", *p) for p in ((-1, 0, "l"), (1, 0, "r"), (0, -1, "u"), (0, 1, "d")))
    + " GROUP BY c.image_id, c.x // 2, c.y // 2",
)
view(
    "fx_texture",
    """
    SELECT l.image_id, n, paper_level, list_sort(list(rough))[len(list(rough)) // 2 + 1] AS paper_rough FROM (
      SELECT image_id, count(*) AS n, list_sort(list(mean))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS paper_level FROM fx_blocks GROUP BY image_id) l
    JOIN fx_blocks k ON k.image_id = l.image_id AND k.mean >= 0.9 * paper_level GROUP BY l.image_id, n, paper_level
    """,
)


@query(
    "texture_blocks",
    "SELECT image_id, n, round(paper_level, 6) AS paper_level, round(paper_rough, 6) AS paper_rough FROM fx_texture",
)
def texture_blocks(t: Tables) -> DataFrame:
    return rounded(im.paper_texture(im.texture_blocks(b.luma(t), 2)))


@query(
    "paint_check",
    """
    SELECT t.image_id, round(CASE WHEN paper_rough >= 0.35 THEN count(*) FILTER (mean >= 0.6 * paper_level AND rough < 0.35 * paper_rough) / count(*) END, 6) AS painted_share
    FROM fx_texture t JOIN fx_blocks b ON b.image_id = t.image_id GROUP BY t.image_id, paper_rough
    """,
)
def paint_check(t: Tables) -> DataFrame:
    blocks = im.texture_blocks(b.luma(t), 2)
    return rounded(im.painted(blocks, im.paper_texture(blocks)))


@query(
    "occupancy_stats",
    """
    SELECT image_id, round(count(*) FILTER (v < background - 40) / count(*), 6) AS ink_share,
      round(count(*) FILTER (abs(v - background) <= 12 AND (x < 1 OR x >= 7 OR y < 1 OR y >= 7)) / count(*) FILTER (x < 1 OR x >= 7 OR y < 1 OR y >= 7), 6) AS blank_border
    FROM fx_grey JOIN (SELECT image_id, list_sort(list(v))[greatest(1, CAST(ceil(0.5 * count(*)) AS BIGINT))] AS background FROM fx_grey GROUP BY image_id) USING (image_id) GROUP BY image_id
    """,
)
def occupancy_stats(t: Tables) -> DataFrame:
    pixels = b.luma(t)
    level = percentiles(pixels, ["image_id"], {"v": (F.col("luma"), 1.0)}, [Wanted("background", "v", 0.5)])
    return rounded(im.occupancy(pixels, level, margin=40, tolerance=12, band=1))


@query(
    "boundary_step",
    """
    SELECT image_id, count(*) AS n, s[CAST(floor(0.1::DOUBLE * (len(s) - 1)) AS BIGINT) + 1] AS p10, s[CAST(floor(0.5::DOUBLE * (len(s) - 1)) AS BIGINT) + 1] AS p50,
      s[CAST(floor(0.9::DOUBLE * (len(s) - 1)) AS BIGINT) + 1] AS p90
    FROM (SELECT image_id, unnest(s) AS one, s FROM (SELECT image_id, list_sort(list(step)) AS s FROM (
      SELECT image_id, v - beside[CAST(floor(0.6::DOUBLE * (len(beside) - 1)) AS BIGINT) + 1] AS step FROM (
        SELECT c.image_id, c.v, list_sort(list_filter([l.v, r.v, u.v, d.v], lambda q: q IS NOT NULL)) AS beside FROM (SELECT * FROM fx_grey WHERE v > 170) c
    """
    + " ".join(_sql_px("(SELECT * FROM fx_grey WHERE v <= 170)", *p) for p in ((-1, 0, "l"), (1, 0, "r"), (0, -1, "u"), (0, 1, "d")))
    + ") WHERE len(beside) > 0) GROUP BY image_id)) GROUP BY image_id, s",
)
def boundary_step(t: Tables) -> DataFrame:
    return im.boundary_step(b.luma(t), F.col("luma") > 170)


@query(
    "interior_evidence",
    """
    SELECT image_id, round(count(*) FILTER (abs(r) <= 12) / count(*), 6) AS background, round(greatest(count(*) FILTER (r <= -22), count(*) FILTER (r >= 22)) / count(*), 6) AS ink,
      round(least(count(*) FILTER (r <= -22), count(*) FILTER (r >= 22)) / count(*), 6) AS counter_ink,
      round(CASE WHEN count(*) FILTER (r <= -22) > 0 THEN count(*) FILTER (solid) / count(*) FILTER (r <= -22) END, 6) AS solid_ink
    FROM (SELECT c.image_id, c.r, coalesce(c.r <= -22 AND l.r <= -22 AND r.r <= -22 AND u.r <= -22 AND d.r <= -22, false) AS solid FROM fx_residual c
    """
    + " ".join(_sql_px("fx_residual", *p) for p in ((-1, 0, "l"), (1, 0, "r"), (0, -1, "u"), (0, 1, "d")))
    + ") GROUP BY image_id",
)
def interior_evidence(t: Tables) -> DataFrame:
    return rounded(im.interior_evidence(b.luma(t), blocks=2, band=12, step=22))


view(
    "fx_residual",
    """
    SELECT g.image_id, g.y, g.x, v - level AS r FROM fx_grey g JOIN (SELECT image_id, y // 4 AS by, x // 4 AS bx, list_sort(list(v))[len(list(v)) // 2 + 1] AS level
      FROM fx_grey GROUP BY 1, 2, 3) k ON k.image_id = g.image_id AND k.by = g.y // 4 AND k.bx = g.x // 4
    """,
)


@query(
    "registration_score",
    """
    SELECT preview, still, max(score) AS score, arg_max(sx, (score, -sx, -sy)) AS sx, arg_max(sy, (score, -sx, -sy)) AS sy FROM (
      SELECT preview, still, sx, sy, round(CASE WHEN saa - sa * sa / n > 1e-4 * n AND sbb - sb * sb / n > 1e-4 * n THEN (sab - sa * sb / n)
          / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) ELSE -1 END, 9) AS score
      FROM (SELECT p.image_id AS preview, s.image_id AS still, d.sx, d.sy, count(*) AS n, sum(p.v) AS sa, sum(s.v) AS sb, sum(p.v * p.v) AS saa, sum(s.v * s.v) AS sbb, sum(p.v * s.v) AS sab
        FROM fx_grey p CROSS JOIN (SELECT CAST(a AS INTEGER) AS sx, CAST(c AS INTEGER) AS sy FROM range(-2, 3) r(a), range(-2, 3) q(c)) d
        JOIN fx_grey s ON s.image_id = p.image_id + 1 AND s.x = p.x + d.sx AND s.y = p.y + d.sy GROUP BY 1, 2, 3, 4 HAVING count(*) >= 32)) GROUP BY preview, still
    """,
)
def registration_score(t: Tables) -> DataFrame:
    pairs = t.embeddings.select(F.col("vec_id").alias("preview"), (F.col("vec_id") + 1).alias("still"))
    return rs.registration(b.rasters(t), pairs, reach=2)


@query(
    "illumination_stats",
    """
    SELECT f.image_id, round(lo, 6) AS field_min, round(hi, 6) AS field_max, round(av, 6) AS field_mean, anchor, round(lift, 6) AS lift, av / greatest(1, lo) * lift > 2.2 AS over_gain
    FROM (SELECT image_id, min(m) AS lo, max(m) AS hi, avg(m) AS av FROM (SELECT image_id, avg(v) AS m FROM fx_grey GROUP BY image_id, x // 4, y // 4) GROUP BY image_id) f
    JOIN (SELECT *, CASE WHEN anchor > 1 THEN 245.0::DOUBLE / anchor ELSE 1 END AS lift FROM (SELECT image_id, list_sort(list(luma))[60] AS anchor FROM fx_luma GROUP BY image_id)) a USING (image_id)
    """,
)
def illumination_stats(t: Tables) -> DataFrame:
    return rounded(im.illumination(b.luma(t), 4))


# ── components ───────────────────────────────────────────────────────────────

view("fx_dark", "SELECT image_id, y, x, y * 8 + x AS id FROM fx_luma WHERE luma < 100")
_COMPONENTS = """
    WITH RECURSIVE reach AS (
      SELECT image_id, id AS a, id AS b FROM fx_dark UNION
      SELECT r.image_id, r.a, n.id FROM reach r JOIN fx_dark c ON c.image_id = r.image_id AND c.id = r.b
      JOIN fx_dark n ON n.image_id = c.image_id AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1)
    SELECT {columns} FROM (
      SELECT image_id, root, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, avg(x) AS cx, avg(y) AS cy
      FROM (SELECT d.*, (SELECT min(b) FROM reach r WHERE r.image_id = d.image_id AND r.a = d.id) AS root FROM fx_dark d) GROUP BY image_id, root) {where}"""
_COLUMNS = "image_id, area, x0, y0, width, height, round(cx, 6) AS cx, round(cy, 6) AS cy"


def parts(t: Tables) -> DataFrame:
    return rs.components(rs.whole(b.rasters(t)), below=100)


@query("connected_components", _COMPONENTS.format(columns=_COLUMNS, where=""))
def connected_components(t: Tables) -> DataFrame:
    return rounded(parts(t).drop("label"))


@query(
    "component_filter",
    _COMPONENTS.format(
        columns=_COLUMNS,
        where="WHERE area >= 8 AND height >= 3 AND height <= 0.05 * 160 AND width <= 0.2 * 40 AND width / height BETWEEN 1.0 / 15 AND 15",
    ),
)
def component_filter(t: Tables) -> DataFrame:
    return rounded(im.letter_like(parts(t), F.lit(160), F.lit(40)).drop("label"))


# Letters of scanned pages: order lines as boxes on seven text lines.
view(
    "fx_letters",
    """
    SELECT page_id, node, x0, x0 + wd AS x1, cy - h / 2 AS y0, cy + h / 2 AS y1, cy, h AS height, x0 + wd / 2 AS cx FROM (
      SELECT l_suppkey AS page_id, l_linenumber * 1000000 + l_partkey AS node, (l_partkey % 400) * 12.0::DOUBLE AS x0, min(6 + l_quantity / 10) AS wd,
        min(l_linenumber * 40 + l_tax * 50 + (l_partkey % 400) * (l_partkey % 400) / 8000.0) AS cy, min(10 + l_discount * 30) AS h FROM lineitem GROUP BY l_suppkey, l_linenumber, l_partkey)
    """,
)


def letters(t: Tables) -> DataFrame:
    """Letters of each page, dealt out by page and strip, as the links need them."""
    slot = F.col("l_partkey") % 400
    x0 = slot * 12.0
    # Repeated rows of a letter have one x0, so they lie in one strip.
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("page_id"), im.strip_of(x0).alias(im.STRIP), "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount"
    )
    rows = rows.repartition("page_id", im.STRIP).groupBy("page_id", im.STRIP, "l_linenumber", "l_partkey").agg(
        F.min(6 + F.col("l_quantity") / 10).alias("wd"),
        F.min(F.col("l_linenumber") * 40 + F.col("l_tax") * 50 + slot * slot / 8000.0).alias("cy"),
        F.min(10 + F.col("l_discount") * 30).alias("height"),
    )
    return rows.select(
        "page_id",
        im.STRIP,
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("node"),
        x0.alias("x0"),
        (x0 + F.col("wd")).alias("x1"),
        (F.col("cy") - F.col("height") / 2).alias("y0"),
        (F.col("cy") + F.col("height") / 2).alias("y1"),
        "cy",
        "height",
        (x0 + F.col("wd") / 2).alias("cx"),
    )


_LINES = """
    WITH RECURSIVE e AS MATERIALIZED (
      SELECT a.page_id, a.node AS a, b.node AS b FROM fx_letters a JOIN fx_letters b ON a.page_id = b.page_id AND a.node <> b.node
        AND b.x0 >= a.x0 AND b.x0 - a.x1 <= 1.25 * (a.height + b.height) AND abs(a.cy - b.cy) < 0.25 * (a.height + b.height)
        AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.3 * least(a.height, b.height)),
    u AS MATERIALIZED (SELECT page_id, a, b FROM e UNION SELECT page_id, b, a FROM e),
    walk(page_id, node, line) USING KEY (page_id, node) AS (
      SELECT page_id, node, node FROM fx_letters UNION
      SELECT u.page_id, u.b, min(w.line) FROM walk w JOIN u ON u.page_id = w.page_id AND u.a = w.node
      JOIN recurring.walk r ON r.page_id = u.page_id AND r.node = u.b WHERE r.line > w.line GROUP BY u.page_id, u.b)"""


def lines(t: Tables, *keep: str) -> DataFrame:
    return im.link_letters(letters(t), "page_id", list(keep))


@query(
    "component_link_join",
    _LINES + " SELECT page_id, line, count(*) AS letters FROM walk GROUP BY page_id, line",
)
def component_link_join(t: Tables) -> DataFrame:
    """Letters of each line; letters of one id are one."""
    return lines(t).groupBy("page_id", "line").agg(F.count_if(~F.col("again")).alias("letters"))


def fitted(t: Tables) -> DataFrame:
    rows = lines(t, "cx", "cy", "height")
    shape = im.quadratic_fit(
        rows,
        ["page_id", "line"],
        "cx",
        "cy",
        also={
            "from_x": F.min("cx"),
            "to_x": F.max("cx"),
            "rms": F.sqrt(F.sum(F.col("residual") * F.col("residual")) / F.count("*")),
            "height_cv": F.stddev_pop("height") / F.avg("height"),
        },
    )
    # Written, so that the shuffles of the medians are gone when the fit deals its letters out.
    middle = stored(percentiles(
        rows, ["page_id", "line"], {"h": (F.col("height"), 0.1)}, [Wanted("line_h", "h", 0.5, LINEAR)]
    ))
    return shape.join(middle.hint("merge"), ["page_id", "line"])


_FIT = """,
    fit AS MATERIALIZED (
      SELECT *, CASE WHEN det > 1e-9 THEN (t0 * (s2 * s4 - s3 * s3) + s2 * (t1 * s3 - s2 * t2)) / det END AS c0, CASE WHEN det > 1e-9 THEN (n * (t1 * s4 - t2 * s3) + s2 * (t0 * s3 - s2 * t1)) / det END AS c1,
        CASE WHEN det > 1e-9 THEN (n * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / det END AS c2 FROM (
        SELECT *, n * (s2 * s4 - s3 * s3) - s2 * s2 * s2 AS det FROM (
          SELECT page_id, line, mx, count(*)::DOUBLE AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(cy) AS t0, sum(u * cy) AS t1, sum(u * u * cy) AS t2 FROM (
            SELECT *, cx - mx AS u FROM (SELECT w.page_id, w.line, l.cx, l.cy, avg(l.cx) OVER (PARTITION BY w.page_id, w.line) AS mx FROM walk w JOIN fx_letters l ON l.page_id = w.page_id AND l.node = w.node))
          GROUP BY page_id, line, mx))),
    shape AS MATERIALIZED (
      SELECT f.page_id, f.line, f.n, f.c0, f.c1, f.c2, f.mx, min(l.cx) AS fx, max(l.cx) AS tx, median(l.height) AS lh, stddev_pop(l.height) / avg(l.height) AS cv,
        sqrt(sum((l.cy - (c0 + c1 * (l.cx - f.mx) + c2 * (l.cx - f.mx) * (l.cx - f.mx))) * (l.cy - (c0 + c1 * (l.cx - f.mx) + c2 * (l.cx - f.mx) * (l.cx - f.mx)))) / count(*)) AS rms
      FROM fit f JOIN walk w ON w.page_id = f.page_id AND w.line = f.line JOIN fx_letters l ON l.page_id = w.page_id AND l.node = w.node GROUP BY f.page_id, f.line, f.n, f.c0, f.c1, f.c2, f.mx)"""


@query(
    "polyfit_quadratic",
    _LINES + _FIT + " SELECT page_id, line, CAST(n AS BIGINT) AS n, CASE WHEN n >= 6 THEN round(c2, 6) END AS c2, CASE WHEN n >= 6 THEN round(c1, 5) END AS c1, CASE WHEN n >= 6 THEN round(c0, 5) END AS c0 FROM shape",
)
def polyfit_quadratic(t: Tables) -> DataFrame:
    """Fit of every line; a line of fewer than six letters has a row without coefficients."""
    fit = im.quadratic_fit(lines(t, "cx", "cy"), ["page_id", "line"], "cx", "cy")
    known = F.col("n") >= 6
    return fit.select(
        "page_id", "line", "n", *[F.when(known, F.round(c, d)).alias(c) for c, d in (("c2", 6), ("c1", 5), ("c0", 5))]
    )


@query(
    "line_validation",
    _LINES + _FIT + """
    SELECT page_id, line, CAST(n AS BIGINT) AS n, valid, valid AND n >= 12 AND (tx - fx) / lh >= 8 AND cv <= 0.5 AS confident FROM (
      SELECT *, coalesce(n >= 4 AND tx - fx >= 3 * lh AND greatest(abs(2 * c2 * (fx - mx) + c1), abs(2 * c2 * (tx - mx) + c1)) <= 0.6 AND rms <= 0.6 * lh, false) AS valid FROM shape)
    """,
)
def line_validation(t: Tables) -> DataFrame:
    """Lines of four letters or more, wide, flat and tight enough; and those to be trusted."""
    c = F.col
    slope = F.greatest(
        F.abs(2 * c("c2") * (c("from_x") - c("mx")) + c("c1")), F.abs(2 * c("c2") * (c("to_x") - c("mx")) + c("c1"))
    )
    span = c("to_x") - c("from_x")
    # What makes a text line.
    valid = (c("n") >= 4) & (span >= 3 * c("line_h")) & (slope <= 0.6) & (c("rms") <= 0.6 * c("line_h"))
    rows = fitted(t).withColumn("valid", F.coalesce(valid, F.lit(False)))
    confident = c("valid") & (c("n") >= 12) & (span / c("line_h") >= 8) & (c("height_cv") <= 0.5)
    return rows.select("page_id", "line", "n", "valid", confident.alias("confident"))


@query(
    "line_straightness",
    """
    SELECT page_id, count(*) AS lines, round(quantile_cont(s, 0.9), 6) AS straightness_p90 FROM (
      SELECT l_suppkey AS page_id, l_linenumber, stddev_pop(l_linenumber * 40 + l_tax * 50) AS s FROM lineitem GROUP BY 1, 2) GROUP BY page_id
    """,
)
def line_straightness(t: Tables) -> DataFrame:
    """Per page the 90th percentile of how far letters stray from their line's own height."""
    height = F.col("l_linenumber") * 40 + F.col("l_tax") * 50
    # Written once: computed again, the last digits of a sum may differ, and a value would be sought in a cell it is not in.
    spread = written_once(t.lineitem.groupBy(F.col("l_suppkey").alias("page_id"), "l_linenumber").agg(F.stddev_pop(height).alias("s")))
    counted = spread.groupBy("page_id").agg(F.count("*").alias("lines"))
    tail = percentiles(spread, ["page_id"], {"s": (F.col("s"), 0.01)}, [Wanted("straightness_p90", "s", 0.9, LINEAR)])
    return rounded(counted.join(tail, "page_id"))
