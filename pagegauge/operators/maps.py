"""A page's coordinate map against its bounds.

A map is one row: its grid as two arrays (row by row, -1 to 1 over the crop), the crop, the page's
corners and the size of the image. Differences between neighbouring nodes are stencils on those
arrays, so nothing is shuffled and a map of any grid costs its own nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.staging import once
from pagegauge.operators.percentiles import finite

# Bounds of a coordinate map.
MEAN_MOVE, P95_MOVE, MOST_MOVE = 0.25, 0.35, 0.5
CORNER_OFF, EDGE_OFF = 0.05, 0.12
LEAST_JACOBIAN, LEAST_STRETCH, MOST_STRETCH = 1e-3, 0.5, 2.0
SLACK_PX = 1.0
EDGE_SAMPLES = 65

STATS = [
    "mean_move", "p95_move", "most_move", "least_jacobian", "least_stretch", "most_stretch", "corner_off", "edge_off",
]


def _all_finite(values: Column) -> Column:
    return F.coalesce(F.forall(values, lambda v: finite(v).isNotNull()), F.lit(False))


def _upto(n: Column) -> Column:
    """0 … n - 1."""
    return F.sequence(F.lit(0), n - 1)


def _cells() -> Column:
    """Each cell's four nodes (a b over c d) with its place, where a grid has one row or column too."""
    c = F.col
    right, down = F.least(c("__nx"), F.lit(1)), F.least(c("__ny"), F.lit(1)) * c("__gw")
    wide = F.greatest(c("__nx"), F.lit(1))

    def cell(i: Column) -> Column:
        col = i % wide
        row = ((i - col) / wide).cast("int")
        at = row * c("__gw") + col
        named = {"a": at, "b": at + right, "c": at + down, "d": at + down + right}
        nodes = [F.get(c(f"__p{axis}"), place).alias(f"{name}{axis}") for name, place in named.items() for axis in "xy"]
        return F.struct(col.alias("col"), row.alias("row"), *nodes)

    return F.transform(_upto(wide * F.greatest(c("__ny"), F.lit(1))), cell)


def _points() -> Column:
    """Nodes and cell centres, each beside its place on the flat crop."""
    c = F.col
    left, top = c("__crop.left"), c("__crop.top")

    def point(x: Column, y: Column, col: Column, row: Column) -> Column:
        u = F.when(c("__nx") > 0, col / c("__nx")).otherwise(0.0)
        v = F.when(c("__ny") > 0, row / c("__ny")).otherwise(0.0)
        return F.struct(
            x.alias("x"),
            y.alias("y"),
            (left + u * c("__sx")).alias("flat_x"),
            (top + v * c("__sy")).alias("flat_y"),
        )

    def node(i: Column) -> Column:
        col = i % c("__gw")
        return point(F.get(c("__px"), i), F.get(c("__py"), i), col, (i - col) / c("__gw"))

    def centre(q: Column) -> Column:
        x, y = ((q[f"a{a}"] + q[f"b{a}"] + q[f"c{a}"] + q[f"d{a}"]) / 4 for a in "xy")
        return point(x, y, q["col"] + 0.5, q["row"] + 0.5)

    nodes = F.transform(_upto(c("__gw") * c("__gh")), node)
    centres = F.transform(c("__cells"), centre)
    return F.when((c("__nx") > 0) & (c("__ny") > 0), F.concat(nodes, centres)).otherwise(nodes)


def _deformation(q: Column) -> Column:
    """Derivatives at a cell's corners and centre, against the flat crop's."""
    c = F.col
    per_u, per_v = c("__nx") / F.greatest(F.lit(1e-9), c("__sx")), c("__nx") / F.greatest(F.lit(1e-9), c("__sy"))
    down_u, down_v = c("__ny") / F.greatest(F.lit(1e-9), c("__sx")), c("__ny") / F.greatest(F.lit(1e-9), c("__sy"))
    probes = []
    for a, b in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5)):
        along = {k: (1 - b) * (q[f"b{k}"] - q[f"a{k}"]) + b * (q[f"d{k}"] - q[f"c{k}"]) for k in "xy"}
        below = {k: (1 - a) * (q[f"c{k}"] - q[f"a{k}"]) + a * (q[f"d{k}"] - q[f"b{k}"]) for k in "xy"}
        probes.append(
            F.struct(
                (along["x"] * per_u).alias("xx"),
                (along["y"] * per_v).alias("yx"),
                (below["x"] * down_u).alias("xy"),
                (below["y"] * down_v).alias("yy"),
            )
        )
    return F.array(*probes)


def _stretches(m: Column) -> Column:
    turn = F.hypot((m["xx"] + m["yy"]) / 2, (m["xy"] - m["yx"]) / 2)
    bend = F.hypot((m["xx"] - m["yy"]) / 2, (m["xy"] + m["yx"]) / 2)
    return F.struct((m["xx"] * m["yy"] - m["xy"] * m["yx"]).alias("det"), turn.alias("turn"), bend.alias("bend"))


def _corner(i: int, axis: str) -> Column:
    return F.get(F.col("__quad"), F.lit(i))[axis]


def _corner_off() -> Column:
    c = F.col
    last = c("__gw") * c("__gh") - 1
    off = [
        F.hypot(F.get(c("__px"), at) - _corner(i, "x"), F.get(c("__py"), at) - _corner(i, "y"))
        for i, at in enumerate((F.lit(0), c("__nx"), last, last - c("__nx")))
    ]
    return F.greatest(*off) / c("__across")


def _edge_off() -> Column:
    """The furthest of the samples along each border from the page's edge there."""
    c = F.col
    down = c("__gw") * c("__ny")
    furthest = []
    for i, j, start, stride, n in (
        (0, 1, F.lit(0), F.lit(1), c("__nx")),
        (1, 2, c("__nx"), c("__gw"), c("__ny")),
        (3, 2, down, F.lit(1), c("__nx")),
        (0, 3, F.lit(0), c("__gw"), c("__ny")),
    ):
        ex, ey = _corner(j, "x") - _corner(i, "x"), _corner(j, "y") - _corner(i, "y")
        long = ex * ex + ey * ey

        def place(s: Column) -> Column:
            at = s * n / (EDGE_SAMPLES - 1)
            base = F.greatest(F.lit(0), F.least(F.floor(at).cast("int"), n - 1))
            return F.struct(base.alias("base"), (at - base).alias("part"))

        def seen(s: Column) -> Column:
            here, after = start + stride * s["base"], start + stride * F.least(s["base"] + 1, n)
            away = [
                F.get(c(f"__p{k}"), here) * (1 - s["part"]) + F.get(c(f"__p{k}"), after) * s["part"] - _corner(i, k)
                for k in "xy"
            ]
            return F.struct(away[0].alias("x"), away[1].alias("y"))

        def foot(d: Column) -> Column:
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d["x"] * ex + d["y"] * ey) / long))
            return F.struct(d["x"].alias("x"), d["y"].alias("y"), F.when(long > 1e-12, share).otherwise(0.0).alias("share"))

        samples = F.transform(F.sequence(F.lit(0), F.lit(EDGE_SAMPLES - 1)), place)
        feet = F.transform(F.transform(samples, seen), foot)
        furthest.append(F.array_max(F.transform(feet, lambda d: F.hypot(d["x"] - d["share"] * ex, d["y"] - d["share"] * ey))))
    return F.greatest(*furthest) / c("__across")


def map_guard(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, the eight measures and ``failure``: the first bound a map breaks, null where it holds all.

    ``maps`` has ``gw, gh`` (nodes across and down), ``gx, gy`` (arrays, row by row, -1 to 1 over the
    crop), ``crop`` (left, top, width, height), ``quad`` (corners in pixels, clockwise from the top
    left) and ``w, h`` (image). Order: nonfinite, out-of-bounds, jacobian, scale, displacement,
    boundary. A missing or infinite node, corner or crop, and arrays of another length than the
    grid, are ``nonfinite`` and have no measures. Repeated rows are judged each; other columns
    are left out.
    """
    c = F.col
    given = ("gw", "gh", "gx", "gy", "crop", "quad", "w", "h")
    rows = maps.select(*keys, *[c(n).alias(f"__{n}") for n in given])
    nodes = c("__gw") * c("__gh")
    box = F.array(*[c(f"__crop.{n}").cast("double") for n in ("left", "top", "width", "height")])
    whole = (
        (c("__gw") >= 1)
        & (c("__gh") >= 1)
        & (F.size("__gx") == nodes)
        & (F.size("__gy") == nodes)
        & _all_finite(c("__gx"))
        & _all_finite(c("__gy"))
        & _all_finite(box)
        & (F.greatest(c("__crop.width"), c("__crop.height")) > 1)
        & (F.size("__quad") == 4)
        & _all_finite(F.flatten(F.transform("__quad", lambda p: F.array(p["x"], p["y"]))))
        & finite(c("__w")).isNotNull()
        & finite(c("__h")).isNotNull()
    )
    rows = once(rows, {"__whole": F.coalesce(whole, F.lit(False))})
    measured = rows.where("__whole")
    sx, sy = c("__crop.width") - 1.0, c("__crop.height") - 1.0
    measured = once(
        measured,
        {
            "__sx": sx,
            "__sy": sy,
            "__nx": c("__gw").cast("int") - 1,
            "__ny": c("__gh").cast("int") - 1,
            "__px": F.transform("__gx", lambda v: c("__crop.left") + (v + 1) * sx / 2),
            "__py": F.transform("__gy", lambda v: c("__crop.top") + (v + 1) * sy / 2),
            "__across": F.greatest(
                F.lit(1e-9),
                F.hypot(_corner(2, "x") - _corner(0, "x"), _corner(2, "y") - _corner(0, "y")),
                F.hypot(_corner(3, "x") - _corner(1, "x"), _corner(3, "y") - _corner(1, "y")),
            ),
        },
    )
    measured = measured.withColumns({"__gw": c("__gw").cast("int"), "__gh": c("__gh").cast("int")})
    measured = once(measured, {"__cells": _cells()})
    measured = once(measured, {"__points": _points(), "__bent": F.transform(F.flatten(F.transform("__cells", _deformation)), _stretches)})
    outside = F.exists(
        "__points",
        lambda p: (p["x"] < -SLACK_PX)
        | (p["y"] < -SLACK_PX)
        | (p["x"] > c("__w") - 1 + SLACK_PX)
        | (p["y"] > c("__h") - 1 + SLACK_PX),
    )
    moves = F.array_sort(
        F.transform(
            "__points",
            lambda p: F.hypot(p["x"] - p["flat_x"], p["y"] - p["flat_y"]) / F.hypot(c("__sx"), c("__sy")),
        )
    )
    measured = once(measured, {"__outside": outside, "__moves": moves})
    place = 0.95 * (F.size("__moves") - 1)
    low = F.floor(place).cast("int")
    below, above = F.get(c("__moves"), low), F.get(c("__moves"), F.least(low + 1, F.size("__moves") - 1))
    values = {
        "mean_move": F.aggregate("__moves", F.lit(0.0), lambda s, v: s + v) / F.size("__moves"),
        "p95_move": below * (1 - (place - low)) + above * (place - low),
        "most_move": F.array_max("__moves"),
        "least_jacobian": F.array_min(F.transform("__bent", lambda p: p["det"])),
        "least_stretch": F.array_min(F.transform("__bent", lambda p: F.abs(p["turn"] - p["bend"]))),
        "most_stretch": F.array_max(F.transform("__bent", lambda p: p["turn"] + p["bend"])),
        "corner_off": _corner_off(),
        "edge_off": _edge_off(),
    }
    measured = once(measured, values)
    failure = (
        F.when(c("__outside"), "out-of-bounds")
        .when(c("least_jacobian") <= LEAST_JACOBIAN, "jacobian")
        .when((c("least_stretch") < LEAST_STRETCH) | (c("most_stretch") > MOST_STRETCH), "scale")
        .when((c("mean_move") > MEAN_MOVE) | (c("p95_move") > P95_MOVE) | (c("most_move") > MOST_MOVE), "displacement")
        .when((c("corner_off") > CORNER_OFF) | (c("edge_off") > EDGE_OFF), "boundary")
    )
    missing = rows.where("NOT __whole").select(
        *keys, *[F.lit(None).cast("double").alias(n) for n in STATS], F.lit("nonfinite").alias("failure")
    )
    return measured.select(*keys, *STATS, failure.alias("failure")).unionByName(missing)
