"""The given tables read as capture data: each binding as a DataFrame and as its SQL twin."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.functions.staging import once
from pagegauge.operators.ordered import ordered
from pagegauge.plans.registry import Tables, view
from pagegauge.session import spread, written_once

SLICE_MS = 60_000
ID_SLICE = 65_536

# Chip names in order of priority.
HINT_KEYS = [
    "searching",
    "not-found",
    "move-back",
    "move-closer",
    "move-phone",
    "low-light",
    "glare",
    "hold-still",
    "corner-covered",
    "separate-sheets",
]


def pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def sql_pick(names: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][({index}) + 1]"


# ── viewfinder samples: events on a clock of 20 + 4k ms per event ────────────

view(
    "fx_samples",
    """
    SELECT user_id AS session_id, event_id, event_type, value, k,
           CAST(sum(20 + 4 * k) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS t,
           event_type <> 'error' AS shown, value / 2500.0 AS err, event_type <> 'signup' AS frame_known,
           k % 10 <> 7 AS has_page, k % 25 <> 3 AS judged, k >= 40 AS ready, k % 3 <> 0 AS locked,
           k % 20 = 19 AS capturing, CASE WHEN k >= 80 THEN k / 100.0 END AS countdown
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
    """,
)


def clocked(t: Tables) -> DataFrame:
    if t.clock is not None:
        return t.clock
    raw = t.events.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    gap = (F.lit(20) + 4 * F.col("k")).cast("bigint")
    return ordered(raw, ["session_id"], ["event_id"], ID_SLICE).step(running={"t": gap}).result()


def with_clock(t: Tables) -> Tables:
    """The same tables with the clocked events written once, for queries that read them many times."""
    return t if t.clock is not None else replace(t, clock=written_once(clocked(t)))


def samples(t: Tables) -> DataFrame:
    k = F.col("k")
    return clocked(t).select(
        "session_id",
        "event_id",
        "event_type",
        "value",
        "k",
        "t",
        (F.col("event_type") != "error").alias("shown"),
        (F.col("value") / 2500.0).alias("err"),
        (F.col("event_type") != "signup").alias("frame_known"),
        (k % 10 != 7).alias("has_page"),
        (k % 25 != 3).alias("judged"),
        (k >= 40).alias("ready"),
        (k % 3 != 0).alias("locked"),
        (k % 20 == 19).alias("capturing"),
        F.when(k >= 80, k / 100.0).alias("countdown"),
    )


view(
    "fx_windows",
    """
    SELECT session_id, min(t) + (max(t) - min(t)) // 10 AS from_t,
           min(t) + ((max(t) - min(t)) * 9) // 10 AS to_t, min(t) AS first_t, max(t) AS last_t
    FROM fx_samples GROUP BY session_id
    """,
)


def windows(sampled: DataFrame) -> DataFrame:
    return (
        sampled.groupBy("session_id")
        .agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
        .select(
            "session_id",
            F.expr("first_t + (last_t - first_t) div 10").alias("from_t"),
            F.expr("first_t + ((last_t - first_t) * 9) div 10").alias("to_t"),
            "first_t",
            "last_t",
        )
    )


# The quad a sample shows: the unit page nudged by the sample's value and k.
view(
    "fx_readings",
    """
    SELECT session_id, event_id, t, k, value, shown, 0.1 + value / 5000.0 AS x0, 0.1 + k / 10000.0 AS y0,
           0.9 + value / 5000.0 AS x1, CAST(0.1 AS DOUBLE) AS y1, CAST(0.9 AS DOUBLE) AS x2,
           0.9 + k / 10000.0 AS y2, CAST(0.1 AS DOUBLE) AS x3, CAST(0.9 AS DOUBLE) AS y3
    FROM fx_samples
    """,
)


def reading_quad() -> Column:
    dx, dy = F.col("value") / 5000.0, F.col("k") / 10000.0
    low, high = F.lit(0.1), F.lit(0.9)
    return g.polygon((low + dx, low + dy), (high + dx, low), (high, high + dy), (low, high))


def readings(t: Tables) -> DataFrame:
    return clocked(t).select(
        "session_id",
        "event_id",
        "t",
        "k",
        "value",
        (F.col("event_type") != "error").alias("shown"),
        reading_quad().alias("quad"),
    )


# ── the probe log: one kind per event type ──────────────────────────────────

view(
    "fx_log",
    """
    SELECT session_id, event_id, t, k, value,
           CASE event_type WHEN 'purchase' THEN 'capture' WHEN 'click' THEN 'confirm-open'
                WHEN 'signup' THEN 'confirm-done' ELSE 'hint' END AS kind,
           event_type = 'view' AS hint_shown,
           """
    + sql_pick(HINT_KEYS, "k % 10")
    + """ AS hint_key
    FROM fx_samples
    """,
)


def log(t: Tables) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "purchase", "capture")
        .when(F.col("event_type") == "click", "confirm-open")
        .when(F.col("event_type") == "signup", "confirm-done")
        .otherwise("hint")
    )
    return clocked(t).select(
        "session_id",
        "event_id",
        "t",
        "k",
        "value",
        kind.alias("kind"),
        (F.col("event_type") == "view").alias("hint_shown"),
        pick(HINT_KEYS, F.col("k") % 10).alias("hint_key"),
    )


# ── detections: vectors as corner offsets, two variants per scene ───────────

UNIT = [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9)]


def _sql_quad(gain: float, offset: int) -> str:
    points = []
    for i, (x, y) in enumerate(UNIT):
        ex, ey = offset + 2 * i + 1, offset + 2 * i + 2
        points.append(
            f"struct_pack(x := CAST({x} AS DOUBLE) + CAST({gain} AS DOUBLE) * e[{ex}] + shift, "
            f"y := CAST({y} AS DOUBLE) + CAST({gain} AS DOUBLE) * e[{ey}])"
        )
    return "[" + ", ".join(points) + "]"


view(
    "fx_vectors",
    """
    SELECT vec_id AS scene_id, label, 'F' || (label % 5) AS family, 's' || (label // 5) AS setting,
           list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e,
           CAST(CASE WHEN vec_id % 9 = 4 THEN -0.12 ELSE 0 END AS DOUBLE) AS shift
    FROM embeddings
    """,
)

view(
    "fx_det",
    f"""
    SELECT scene_id, family, setting, variant, CAST(720 AS DOUBLE) AS w, CAST(1280 AS DOUBLE) AS h,
           CASE WHEN label <> 9 THEN truth END AS truth, quad, accepted,
           CASE WHEN accepted THEN quad END AS det, accepted OR e[33] > -0.1 AS ok, ms, source,
           CASE WHEN source = 'ml' THEN 0.9 + e[32] END AS confidence,
           variant = 'refined' AND e[34] > -0.1 AS refine_ran, e[35] > 0 AS refine_changed,
           5 + 20 * abs(e[36]) AS refine_ms, e, label
    FROM (
      SELECT *, 'production' AS variant, {_sql_quad(0.05, 8)} AS truth,
             CASE scene_id % 50 WHEN 7 THEN [raw[1], raw[3], raw[2], raw[4]]
                  WHEN 13 THEN [raw[1], raw[4], raw[3], raw[2]]
                  WHEN 21 THEN [raw[2], raw[3], raw[4], raw[1]] ELSE raw END AS quad,
             e[25] > -0.1 AS accepted, 100 * (1 + e[26]) AS ms,
             CASE WHEN e[29] > 0 THEN 'ml' ELSE 'classical' END AS source
      FROM (SELECT *, {_sql_quad(0.25, 0)} AS raw FROM fx_vectors)
      UNION ALL
      SELECT *, 'refined' AS variant, {_sql_quad(0.05, 8)} AS truth, raw AS quad,
             e[27] > -0.15 AS accepted, 120 * (1 + e[28]) AS ms,
             CASE WHEN e[30] > 0 THEN 'ml' ELSE 'classical' END AS source
      FROM (SELECT *, {_sql_quad(0.15, 16)} AS raw FROM fx_vectors))
    """,
)


def vectors(t: Tables) -> DataFrame:
    return spread(t.embeddings).select(
        F.col("vec_id").alias("scene_id"),
        "label",
        F.concat(F.lit("F"), (F.col("label") % 5).cast("string")).alias("family"),
        F.concat(F.lit("s"), F.expr("label div 5").cast("string")).alias("setting"),
        F.col("embedding").cast("array<double>").alias("e"),
        F.when(F.col("vec_id") % 9 == 4, -0.12).otherwise(0.0).alias("shift"),
    )


def e(i: int) -> Column:
    """Vector element ``i``, counted from one as in the SQL twin."""
    return F.get(F.col("e"), F.lit(i - 1))


def _offset_quad(gain: float, offset: int) -> Column:
    points = []
    for i, (x, y) in enumerate(UNIT):
        points.append(
            (
                F.lit(x) + F.lit(gain) * e(offset + 2 * i + 1) + F.col("shift"),
                F.lit(y) + F.lit(gain) * e(offset + 2 * i + 2),
            )
        )
    return g.polygon(*points)


def detections(t: Tables) -> DataFrame:
    base = vectors(t)
    variants = F.array(
        F.struct(
            F.lit("production").alias("variant"),
            _offset_quad(0.25, 0).alias("raw"),
            (e(25) > -0.1).alias("accepted"),
            (100 * (1 + e(26))).alias("ms"),
            F.when(e(29) > 0, "ml").otherwise("classical").alias("source"),
        ),
        F.struct(
            F.lit("refined").alias("variant"),
            _offset_quad(0.15, 16).alias("raw"),
            (e(27) > -0.15).alias("accepted"),
            (120 * (1 + e(28))).alias("ms"),
            F.when(e(30) > 0, "ml").otherwise("classical").alias("source"),
        ),
    )
    rows = base.select("*", _offset_quad(0.05, 8).alias("page"), F.explode(variants).alias("v")).select(
        "scene_id", "label", "family", "setting", "e", "page", "v.*"
    )
    raw = F.col("raw")

    def reordered(*order: int) -> Column:
        return F.array(*[g.corner(raw, i) for i in order])

    production = F.col("variant") == "production"
    slot = F.col("scene_id") % 50
    quad = (
        F.when(production & (slot == 7), reordered(0, 2, 1, 3))
        .when(production & (slot == 13), reordered(0, 3, 2, 1))
        .when(production & (slot == 21), reordered(1, 2, 3, 0))
        .otherwise(raw)
    )
    rows = once(rows, {"quad": quad})
    return rows.select(
        "scene_id",
        "family",
        "setting",
        "variant",
        F.lit(720.0).alias("w"),
        F.lit(1280.0).alias("h"),
        F.when(F.col("label") != 9, F.col("page")).alias("truth"),
        "quad",
        "accepted",
        F.when(F.col("accepted"), F.col("quad")).alias("det"),
        (F.col("accepted") | (e(33) > -0.1)).alias("ok"),
        "ms",
        "source",
        F.when(F.col("source") == "ml", 0.9 + e(32)).alias("confidence"),
        ((F.col("variant") == "refined") & (e(34) > -0.1)).alias("refine_ran"),
        (e(35) > 0).alias("refine_changed"),
        (5 + 20 * F.abs(e(36))).alias("refine_ms"),
        "e",
        "label",
    )


# ── content boxes of a scene ─────────────────────────────────────────────────

BOX_KINDS = ["text", "identifier", "mark", "rule"]
HALF_BOX = 0.06


def _sql_box(j: int) -> str:
    cx = f"(CAST({0.14 + 0.24 * j:.2f} AS DOUBLE) + 0.2 * e[{41 + 2 * j}])"
    cy = f"(CAST({0.16 + 0.2 * j:.2f} AS DOUBLE) + 0.2 * e[{42 + 2 * j}])"
    corners = ", ".join(
        f"struct_pack(x := {cx} {sx} CAST({HALF_BOX} AS DOUBLE), y := {cy} {sy} CAST({HALF_BOX} AS DOUBLE))"
        for sx, sy in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"))
    )
    scene = "CASE WHEN scene_id % 7 = 0 THEN -1 - scene_id ELSE scene_id END AS scene_id"
    return f"SELECT {scene}, {j} AS box, '{BOX_KINDS[j]}' AS kind, [{corners}] AS polygon FROM fx_vectors"


view("fx_content", " UNION ALL ".join(_sql_box(j) for j in range(4)))


def content(t: Tables) -> DataFrame:
    """One row per content box; those of scenes divisible by seven are known under another name."""
    boxes = []
    for j, kind in enumerate(BOX_KINDS):
        cx = F.lit(round(0.14 + 0.24 * j, 2)) + 0.2 * e(41 + 2 * j)
        cy = F.lit(round(0.16 + 0.2 * j, 2)) + 0.2 * e(42 + 2 * j)
        half = F.lit(HALF_BOX)
        boxes.append(
            F.struct(
                F.lit(j).alias("box"),
                F.lit(kind).alias("kind"),
                g.polygon(
                    (cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half)
                ).alias("polygon"),
            )
        )
    scene = F.expr("CASE WHEN scene_id % 7 = 0 THEN -1 - scene_id ELSE scene_id END")
    return vectors(t).select(scene.alias("scene_id"), F.explode(F.array(*boxes)).alias("b")).select("scene_id", "b.*")


# ── pixels: a vector as an 8×8 tile ─────────────────────────────────────────

view(
    "fx_luma",
    """
    SELECT vec_id AS image_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
           CAST(least(255, greatest(0, floor(128 + 400 * CAST(embedding[i] AS DOUBLE) + 0.5))) AS INTEGER) AS luma
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
    """,
)


def rasters(t: Tables) -> DataFrame:
    """The same tiles as arrays: an image per row, its values row by row."""
    level = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * v.cast("double") + 0.5))).cast("int"))
    rows = spread(t.embeddings).where(F.size("embedding") > 0)
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("w"), F.expr("size(embedding) div 8").cast("int").alias("h"), level.alias("luma"))


def luma(t: Tables) -> DataFrame:
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * F.col("v").cast("double") + 0.5)))
    return spread(t.embeddings).select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v")).select(
        "image_id",
        F.expr("i div 8").alias("y"),
        (F.col("i") % 8).cast("bigint").alias("x"),
        level.cast("int").alias("luma"),
    )
