"""Quads and polygons as column expressions.

A polygon is ``array<struct<x:double,y:double>>``; a quad is one of four points, top-left,
top-right, bottom-right, bottom-left, in fractions of the frame unless named pixels.
Fixed four-point work is unrolled into plain arithmetic, so it stays in generated code;
only clipping, whose vertex count varies, uses array functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scoring rules' thresholds.
WRONG_CROP_MIN_IOU = 0.9
WRONG_CROP_MAX_CORNER_ERROR = 0.03
CLIPPED_MAX_FRACTION = 0.01
LOOSE_MAX_FRACTION = 0.03
CONTENT_CLIP_MIN_FRACTION = 0.01
LOCK_TOLERANCE = 0.02
IN_FRAME_EPSILON = 1e-6
MIN_AREA = 1e-9

POLYGON = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def corner(quad: Column, i: int) -> Column:
    return F.get(quad, F.lit(i))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(poly: Column, sx: Column, sy: Column) -> Column:
    return F.transform(poly, lambda p: point(p["x"] * sx, p["y"] * sy))


def map_quad(quad: Column, fx: Callable[[Column], Column], fy: Callable[[Column], Column]) -> Column:
    return F.array(*[point(fx(corner(quad, i)), fy(corner(quad, i))) for i in range(4)])


def frame_polygon(width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    return polygon((zero, zero), (width, zero), (width, height), (zero, height))


def _rotated(poly: Column) -> Column:
    return F.concat(F.slice(poly, F.lit(2), F.size(poly)), F.slice(poly, F.lit(1), F.lit(1)))


def signed_area(poly: Column) -> Column:
    """Shoelace area of any polygon; 0 for fewer than three points."""
    terms = F.zip_with(poly, _rotated(poly), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(
        F.size(poly) >= 3, F.aggregate(terms, F.lit(0.0), lambda total, term: total + term) / 2
    ).otherwise(F.lit(0.0))


def area(poly: Column) -> Column:
    return F.abs(signed_area(poly))


def quad_signed_area(quad: Column) -> Column:
    def term(i: int) -> Column:
        a, b = corner(quad, i), corner(quad, (i + 1) % 4)
        return a["x"] * b["y"] - b["x"] * a["y"]

    return (term(0) + term(1) + term(2) + term(3)) / 2


def quad_area(quad: Column) -> Column:
    return F.abs(quad_signed_area(quad))


def turn(a: Column, b: Column, c: Column) -> Column:
    """Cross product of ``b - a`` and ``c - a``."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _edges_cross(quad: Column, i: int) -> Column:
    a, b, c, d = (corner(quad, (i + k) % 4) for k in range(4))
    return (F.signum(turn(a, b, c)) * F.signum(turn(a, b, d)) < 0) & (
        F.signum(turn(c, d, a)) * F.signum(turn(c, d, b)) < 0
    )


def degenerate(quad: Column) -> Column:
    """A quad that crosses itself or has no area."""
    return (quad_area(quad) <= MIN_AREA) | _edges_cross(quad, 0) | _edges_cross(quad, 1)


def convex(quad: Column, slack: float = 1e-12) -> Column:
    turns = []
    for i in range(4):
        a, b, c = (corner(quad, (i + k) % 4) for k in range(3))
        cross = (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
        turns.append(F.when(F.abs(cross) < slack, 0.0).otherwise(F.signum(cross)))
    return ~((F.least(*turns) < 0) & (F.greatest(*turns) > 0))


def _cut(poly: Column, a: Column, b: Column) -> Column:
    """The part of ``poly`` on the left of the line from ``a`` to ``b``."""

    def side(p: Column) -> Column:
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

    def meet(p: Column, q: Column) -> Column:
        dx1, dy1 = q["x"] - p["x"], q["y"] - p["y"]
        dx2, dy2 = b["x"] - a["x"], b["y"] - a["y"]
        denominator = dx1 * dy2 - dy1 * dx2
        along = ((a["x"] - p["x"]) * dy2 - (a["y"] - p["y"]) * dx2) / denominator
        return F.when(denominator == 0, q).otherwise(point(p["x"] + along * dx1, p["y"] + along * dy1))

    nothing = F.array().cast(POLYGON)

    def kept(previous: Column, current: Column) -> Column:
        was_in, is_in = side(previous) >= 0, side(current) >= 0
        return (
            F.when(is_in & was_in, F.array(current))
            .when(is_in, F.array(meet(previous, current), current))
            .when(was_in, F.array(meet(previous, current)))
            .otherwise(nothing)
        )

    n = F.size(poly)
    behind = F.concat(F.slice(poly, n, F.lit(1)), F.slice(poly, F.lit(1), n - 1))
    return F.when(n < 1, nothing).otherwise(F.flatten(F.zip_with(behind, poly, kept)))


def clip(subject: Column, convex_clip: Column) -> Column:
    """The part of ``subject`` inside the convex polygon ``convex_clip`` (either winding)."""
    wound = F.when(signed_area(convex_clip) > 0, convex_clip).otherwise(F.reverse(convex_clip))
    edges = let(
        wound, lambda c: F.zip_with(c, _rotated(c), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )
    return F.aggregate(edges, subject, lambda poly, e: _cut(poly, e["a"], e["b"]))


def overlap_area(subject: Column, convex_clip: Column) -> Column:
    return area(clip(subject, convex_clip))


def area_inside(subject: Column, quad: Column) -> Column:
    """Area of ``subject`` inside a simple quad; a concave one is halved along its inner diagonal."""
    a, b, c, d = (corner(quad, i) for i in range(4))
    first = F.signum(turn(a, b, c))
    second = F.signum(turn(a, c, d))
    halves = F.when(
        first == second, F.array(F.array(a, b, c), F.array(a, c, d))
    ).otherwise(F.array(F.array(b, c, d), F.array(b, d, a)))
    pieces = F.when(convex(quad), F.array(quad)).otherwise(halves)
    return F.aggregate(
        F.transform(pieces, lambda piece: overlap_area(subject, piece)),
        F.lit(0.0),
        lambda total, part: total + part,
    )


def pairing(detected: Column, truth: Column) -> Column:
    """Best of the eight ways to pair corners: ``struct<cost, way>``; way // 4 is the winding,
    way % 4 the shift, and the lowest way wins ties."""
    ways = []
    for way in range(8):
        cost = None
        for i in range(4):
            d, t = corner(detected, paired_index(way, i)), corner(truth, i)
            dx, dy = d["x"] - t["x"], d["y"] - t["y"]
            one = dx * dx + dy * dy
            cost = one if cost is None else cost + one
        ways.append(F.struct(cost.alias("cost"), F.lit(way).alias("way")))
    return F.array_min(F.array(*ways))


def paired_index(way: int, i: int) -> int:
    at = (i + way % 4) % 4
    return 3 - at if way >= 4 else at


def paired(detected: Column, way: Column) -> Column:
    """``detected`` reordered by a pairing's ``way``."""
    shift = way % 4
    base = F.when(way >= 4, F.reverse(detected)).otherwise(detected)
    doubled = F.concat(base, base)
    return F.slice(doubled, shift + 1, F.lit(4))


def distances(a: Column, b: Column, scale: Column) -> Column:
    """Distance of each pair of corners over ``scale``."""

    def one(i: int) -> Column:
        dx = corner(a, i)["x"] - corner(b, i)["x"]
        dy = corner(a, i)["y"] - corner(b, i)["y"]
        return F.sqrt(dx * dx + dy * dy) / scale

    return F.array(*[one(i) for i in range(4)])


def diagonal(width: Column, height: Column) -> Column:
    return F.sqrt(width * width + height * height)


def in_frame(quad: Column) -> Column:
    e = IN_FRAME_EPSILON

    def inside(i: int) -> Column:
        p = corner(quad, i)
        return (p["x"] >= -e) & (p["y"] >= -e) & (p["x"] <= 1 + e) & (p["y"] <= 1 + e)

    return F.array(*[inside(i) for i in range(4)])


def off_image(quad: Column) -> Column:
    return quad.isNotNull() & ~F.forall(in_frame(quad), lambda ok: ok)


def masked_max(values: Column, mask: Column) -> Column:
    """Largest value where the mask holds; null when it holds nowhere."""
    return F.greatest(
        *[F.when(F.get(mask, F.lit(i)), F.get(values, F.lit(i))) for i in range(4)]
    )


def masked_mean(values: Column, mask: Column) -> Column:
    total = reduce(
        lambda a, b: a + b,
        [F.when(F.get(mask, F.lit(i)), F.get(values, F.lit(i))).otherwise(0.0) for i in range(4)],
    )
    n = reduce(
        lambda a, b: a + b, [F.when(F.get(mask, F.lit(i)), 1).otherwise(0) for i in range(4)]
    )
    return F.when(n > 0, total / n)


def image_order(quad: Column) -> Column:
    """Clockwise on the image, from the corner nearest its top-left."""
    clockwise = F.when(quad_signed_area(quad) >= 0, quad).otherwise(F.reverse(quad))

    def turned(c: Column) -> Column:
        sums = [
            F.struct((corner(c, i)["x"] + corner(c, i)["y"]).alias("s"), F.lit(i).alias("i"))
            for i in range(4)
        ]
        first = F.array_min(F.array(*sums))["i"]
        return F.slice(F.concat(c, c), first + 1, F.lit(4))

    return let(clockwise, turned)


def contains(poly: Column, p: Column) -> Column:
    """Even-odd test of a point."""
    pairs = F.zip_with(
        poly,
        _rotated(poly),
        lambda a, b: ((a["y"] > p["y"]) != (b["y"] > p["y"]))
        & (p["x"] < (a["x"] - b["x"]) * (p["y"] - b["y"]) / (a["y"] - b["y"]) + b["x"]),
    )
    hits = F.size(F.filter(pairs, lambda hit: hit))
    return (hits % 2) == 1


def bounds(quad: Column) -> dict[str, Column]:
    xs = [corner(quad, i)["x"] for i in range(4)]
    ys = [corner(quad, i)["y"] for i in range(4)]
    return {
        "min_x": F.least(*xs),
        "max_x": F.greatest(*xs),
        "min_y": F.least(*ys),
        "max_y": F.greatest(*ys),
    }


def border_margin(quad: Column) -> Column:
    parts = []
    for i in range(4):
        p = corner(quad, i)
        parts += [p["x"], 1 - p["x"], p["y"], 1 - p["y"]]
    return F.least(*parts)


def fill_share(quad: Column) -> Column:
    """Largest share of the frame the quad reaches over, along either axis."""
    b = bounds(quad)

    def inside(v: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    return F.greatest(
        inside(b["max_x"]) - inside(b["min_x"]), inside(b["max_y"]) - inside(b["min_y"])
    )


def fits_centred(quad: Column, margin: float) -> Column:
    b = bounds(quad)
    room = 1 - 2 * margin
    return (b["max_x"] - b["min_x"] <= room) & (b["max_y"] - b["min_y"] <= room)


def interior_angle(quad: Column, i: int) -> Column:
    """Angle at corner ``i`` in degrees; 0 where a side has no length."""
    p, before, after = corner(quad, i), corner(quad, (i + 3) % 4), corner(quad, (i + 1) % 4)
    ax, ay = before["x"] - p["x"], before["y"] - p["y"]
    bx, by = after["x"] - p["x"], after["y"] - p["y"]
    lengths = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / lengths))
    return F.when(lengths > 0, F.degrees(F.acos(cosine))).otherwise(0.0)


def side_length(quad: Column, i: int) -> Column:
    a, b = corner(quad, i), corner(quad, (i + 1) % 4)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)
