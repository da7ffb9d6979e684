"""Accept/reject and outcome rules over measured columns."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g

# Thresholds of the detection and capture rules.
ML_TRUSTED_CONFIDENCE = 0.9
ML_TRUSTED_MIN_COVERAGE = 0.1
MIN_COVERAGE = 0.35
ON_SCREEN_MIN_SHARE = 0.15
BORDER_HUG = 0.02
MIN_ANGLE_DEG = 35.0
MIN_SIDE_RATIO = 0.18
QUAD_EDIT_TOLERANCE = 1e-3
SCORE_FLOOR = 1.64
SHARPNESS_FLOOR = 0.1068
TEXT_HEIGHT_FLOOR = 7.0
TEXT_HEIGHT_MIN, TEXT_HEIGHT_MAX = 3.0, 80.0
LIVE_SHARPNESS_FLOOR = SHARPNESS_FLOOR * 0.85
LUMA_FLOOR = 45.0
STILL_EDGE_MARGIN = 0.004
STILL_EDGE_MARGIN_MANUAL = 0.002
STILL_REGISTER_MIN = 0.8
STILL_MATCH_RESIDUAL = 0.03
STILL_SCALE_LOW, STILL_SCALE_HIGH = 0.6, 1.25
STILL_MAX_SHIFT = 0.12


@dataclass(frozen=True)
class EvidenceRules:
    """One set of evidence thresholds; several sets can be judged side by side."""

    # The paper rule set.
    min_sides: int = 3
    min_background: float = 0.68
    min_ink: float = 0.025
    faint_ink: float = 0.012
    faint_background: float = 0.92
    max_ink: float = 0.45
    min_ink_spread: float = 0.15
    max_counter_ratio: float = 0.45
    counter_floor: float = 0.01
    max_background_spread: float = 0.35
    max_solid_ink: float = 0.35
    marginal_background: float = 0.75
    min_ink_of_rest: float = 0.22
    texture_ink: float = 0.04
    texture_spread: float = 0.75
    print_margin_uniform: float = 0.6
    print_margin_relative: float = 0.9
    print_solid_ink: float = 0.2
    print_background: float = 0.25
    print_min_ink: float = 0.1


PAPER = EvidenceRules()


def rule_column(rules: EvidenceRules) -> Column:
    """A rule set as a struct column, so that a table can carry several."""
    return F.struct(*[F.lit(getattr(rules, f.name)).alias(f.name) for f in fields(rules)])


def first_failing(clauses: list[tuple[Column, str]]) -> Column:
    """Name of the first clause that does not hold; null when all do. An unmeasured clause fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in clauses])


def text_failure(r: Column) -> Column:
    c = F.col
    ink_floor = F.when(c("background") >= r["faint_background"], r["faint_ink"]).otherwise(r["min_ink"])
    rest = (c("background") >= r["marginal_background"]) | (c("ink") >= r["min_ink_of_rest"] * (1 - c("background")))
    return first_failing(
        [
            (c("background") >= r["min_background"], "background"),
            (c("ink") >= ink_floor, "ink-low"),
            (c("ink") <= r["max_ink"], "ink-high"),
            (c("ink_spread") >= r["min_ink_spread"], "ink-spread"),
            (c("counter_ink") <= c("ink") * r["max_counter_ratio"] + r["counter_floor"], "counter-ink"),
            (c("background_spread") <= r["max_background_spread"], "background-spread"),
            (c("solid_ink") <= r["max_solid_ink"], "solid-ink"),
            (rest, "ink-of-rest"),
            (~((c("ink") < r["texture_ink"]) & (c("ink_spread") > r["texture_spread"])), "texture"),
        ]
    )


def images_failure(r: Column) -> Column:
    c = F.col
    return first_failing(
        [
            (c("margin_uniform").isNotNull() & c("margin_relative").isNotNull(), "no-margin"),
            (c("margin_uniform") >= r["print_margin_uniform"], "margin-uniform"),
            (c("margin_relative") >= r["print_margin_relative"], "margin-relative"),
            (c("solid_ink") >= r["print_solid_ink"], "solid-ink"),
            (c("background") >= r["print_background"], "background"),
            (c("ink") >= r["print_min_ink"], "ink-low"),
            (c("ink") <= r["max_ink"], "ink-high"),
            (c("ink_spread") >= r["min_ink_spread"], "ink-spread"),
        ]
    )


def evidence_verdict(r: Column, fail_text: Column, fail_images: Column) -> Column:
    needed = F.least(r["min_sides"], F.greatest(F.lit(2), F.col("sides_known") - 1))
    sides = (F.col("sides_known") >= 2) & (F.col("sides_supported") >= needed)
    return (
        F.when(~sides, "sides").when(fail_text.isNull() | fail_images.isNull(), "ok").otherwise("surface")
    )


def coverage_floor(source: Column, confidence: Column, visible_share: Column) -> Column:
    trusted = (source == "ml") & F.coalesce(confidence >= ML_TRUSTED_CONFIDENCE, F.lit(False))
    floor = F.when(trusted, ML_TRUSTED_MIN_COVERAGE).otherwise(MIN_COVERAGE)
    return floor * F.least(F.lit(1.0), F.greatest(F.lit(ON_SCREEN_MIN_SHARE), visible_share))


def sides_on_border(quad: Column, width: Column, height: Column) -> Column:
    """How many sides lie along the frame's edge; ``quad`` in pixels."""
    tolerance = BORDER_HUG * F.least(width, height)
    total = None
    for i in range(4):
        a, b = g.corner(quad, i), g.corner(quad, (i + 1) % 4)
        hugging = (
            ((a["x"] <= tolerance) & (b["x"] <= tolerance))
            | ((a["x"] >= width - 1 - tolerance) & (b["x"] >= width - 1 - tolerance))
            | ((a["y"] <= tolerance) & (b["y"] <= tolerance))
            | ((a["y"] >= height - 1 - tolerance) & (b["y"] >= height - 1 - tolerance))
        )
        one = F.when(hugging, 1).otherwise(0)
        total = one if total is None else total + one
    return total


def least_angle(quad: Column) -> Column:
    return F.least(*[g.interior_angle(quad, i) for i in range(4)])


def side_ratio(quad: Column) -> Column:
    across = (g.side_length(quad, 0) + g.side_length(quad, 2)) / 2
    down = (g.side_length(quad, 3) + g.side_length(quad, 1)) / 2
    return F.when(F.greatest(across, down) > 0, F.least(across, down) / F.greatest(across, down)).otherwise(0.0)


def quad_moved(a: Column, b: Column) -> Column:
    """Did any corner move between two answers? One missing where the other is not counts as moved."""
    far = None
    for i in range(4):
        p, q = g.corner(a, i), g.corner(b, i)
        one = (F.abs(p["x"] - q["x"]) > QUAD_EDIT_TOLERANCE) | (F.abs(p["y"] - q["y"]) > QUAD_EDIT_TOLERANCE)
        far = one if far is None else far | one
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(far)


def capture_gate(sharpness: Column, line_height: Column, scale_back: Column) -> Column:
    """ok / blurry / too_small, or unknown where no text height can be believed (unknown passes)."""
    height = line_height * scale_back
    plausible = (line_height > 0) & (height >= TEXT_HEIGHT_MIN) & (height <= TEXT_HEIGHT_MAX * scale_back)
    worse_sharp = sharpness / SHARPNESS_FLOOR < height / TEXT_HEIGHT_FLOOR
    return (
        F.when(~F.coalesce(plausible, F.lit(False)), "unknown")
        .when(sharpness < SHARPNESS_FLOOR, "blurry")
        .when(height < TEXT_HEIGHT_FLOOR, "too_small")
        .when(sharpness * height < SCORE_FLOOR, F.when(worse_sharp, "blurry").otherwise("too_small"))
        .otherwise("ok")
    )


def frame_hint(sharpness: Column, mean_luma: Column) -> Column:
    return (
        F.when(sharpness < LIVE_SHARPNESS_FLOOR, "hold_still").when(mean_luma < LUMA_FLOOR, "low_light").otherwise("good")
    )


def semantic_verdict(structural_ok: Column, before: dict[str, Column], after: dict[str, Column], moved: Column, edge: Column) -> Column:
    """accept, or why a re-rendered page is refused."""
    # What counts as lost page, and how much curvature may change.
    lost = (
        (after["blank"] - before["blank"] > 0.08)
        | (before["ink"] - after["ink"] > 0.02)
        | (after["repeat"] - before["repeat"] > 0.25)
    )
    lines = F.least(before["lines"], after["lines"])
    ratio = F.when(moved > 0.08, 0.85).otherwise(1.15)
    floor = F.lit(0.002)
    worse = after["curvature"] > F.greatest(before["curvature"] * 1.6, floor)
    allowed = after["curvature"] <= F.greatest(before["curvature"] * ratio, floor)
    timid = (moved <= 0.05) & (edge <= 0.03)
    return (
        F.when(~structural_ok, "structural")
        .when(lost, "regression")
        .when(lines >= 3, F.when(worse | ~allowed, "regression").otherwise("accept"))
        .otherwise(F.when(timid, "accept").otherwise("insufficient-evidence"))
    )


def deskew_judgement(
    clipped: Column, rules_clipped: Column, residual: Column, deg: Column, before: dict[str, Column], after: dict[str, Column]
) -> Column:
    """Why a rotation is refused; null when it stands."""
    # The rotation limits.
    level = F.abs(residual) > F.greatest(F.lit(0.35), 0.5 * F.abs(deg))
    enough = before["lines"] >= 3
    bowed = enough & (after["lines"] >= 3) & (after["curvature"] > F.greatest(before["curvature"] * 1.6, F.lit(0.002)))
    lost = enough & (after["lines"] < F.greatest(F.lit(3.0), 0.6 * before["lines"]))
    return (
        F.when((clipped > 0.002) | (rules_clipped > 0.01), "clips")
        .when(residual.isNull() | F.isnan(residual), "unmeasured")
        .when(level, "not-level")
        .when(bowed, "bow-worse")
        .when(lost, "lines-lost")
    )


def eligibility(quad: Column, crop_side: Column, min_side: float) -> Column:
    """Why a page outline cannot be straightened; null when it can. ``quad`` in pixels."""
    b = g.bounds(quad)
    box = (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])
    fill = F.when(box <= 1e-9, 0.0).otherwise(g.quad_area(quad) / box)
    angles = [g.interior_angle(quad, i) for i in range(4)]

    def ratio(i: int, j: int) -> Column:
        a, c = g.side_length(quad, i), g.side_length(quad, j)
        return F.greatest(a, c) / F.greatest(F.lit(1e-9), F.least(a, c))

    # Outline limits.
    return (
        F.when(fill < 0.55, "quad-fill")
        .when((F.least(*angles) < 25) | (F.greatest(*angles) > 155), "quad-angle")
        .when(F.greatest(ratio(0, 2), ratio(3, 1)) > 2.5, "quad-edge-ratio")
        .when(crop_side < min_side, "crop-resolution")
    )


def candidate_acceptable(base: dict[str, Column], new: dict[str, Column], sides: list[tuple[Column, Column]], text: Column) -> Column:
    """Text no worse than 5 %, boundary error halved, and no side more than a tenth worse."""

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v)

    ok = finite(new["straight"]) & finite(new["aligned"])
    for name in ("straight", "aligned"):
        ok = ok & (new[name] <= base[name] + F.greatest(0.05 * base[name], 0.02 * text))
    before = after = None
    for b, a in sides:
        ok = ok & finite(a) & (a <= F.greatest(1.1 * b, b + 0.001))
        before, after = (b if before is None else before + b), (a if after is None else after + a)
    return F.coalesce(ok & (after / 4 <= 0.5 * (before / 4)), F.lit(False))


def clipping(flat: dict[str, Column], out: dict[str, Column]) -> Column:
    """cut / pushed / shrunk / kept, or unmeasured where the flat page has too little print.

    Each side reads ``ink, ink_abs, x0, y0, x1, y1`` and ``band_t, band_r, band_b, band_l``.
    """
    # Clipping thresholds.
    edge = 0.02
    ratio = out["ink_abs"] / F.greatest(F.lit(1e-9), flat["ink_abs"])

    def touches(p: dict[str, Column]) -> list[Column]:
        return [p["y0"] < edge, p["x1"] > 1 - edge, p["y1"] > 1 - edge, p["x0"] < edge]

    new_touch = [o & ~f for o, f in zip(touches(out), touches(flat))]
    any_touch = new_touch[0] | new_touch[1] | new_touch[2] | new_touch[3]
    bands = ["band_t", "band_r", "band_b", "band_l"]
    pushed = None
    for t, name in zip(new_touch, bands):
        one = t & (out[name] > flat[name] + 0.004)
        pushed = one if pushed is None else pushed | one
    wide = (out["x1"] - out["x0"]) / F.greatest(F.lit(1e-9), flat["x1"] - flat["x0"])
    tall = (out["y1"] - out["y0"]) / F.greatest(F.lit(1e-9), flat["y1"] - flat["y0"])
    per_box = ratio / F.greatest(F.lit(1e-9), wide * tall)
    alike = (F.abs(wide - tall) <= 0.03) & (per_box >= 0.97) & ~any_touch
    return (
        F.when(~F.coalesce(flat["ink"] >= 1500, F.lit(False)), "unmeasured")
        .when(ratio < 0.92, F.when(alike, "shrunk").otherwise("cut"))
        .when(pushed & (ratio < 0.985), "pushed")
        .otherwise("kept")
    )


def still_fit(mapped: Column, corners: Column, aspect: Column) -> dict[str, Column]:
    """Least-squares scale and shift from a mapped preview quad to a photo's corners."""

    def centred(q: Column, i: int) -> tuple[Column, Column]:
        return g.corner(q, i)["x"] - 0.5, (g.corner(q, i)["y"] - 0.5) * aspect

    a = [centred(mapped, i) for i in range(4)]
    b = [centred(corners, i) for i in range(4)]

    def mean(points: list[tuple[Column, Column]], axis: int) -> Column:
        return (points[0][axis] + points[1][axis] + points[2][axis] + points[3][axis]) / 4

    ax, ay, bx, by = mean(a, 0), mean(a, 1), mean(b, 0), mean(b, 1)
    num = den = None
    for (px, py), (qx, qy) in zip(a, b):
        n = (px - ax) * (qx - bx) + (py - ay) * (qy - by)
        d = (px - ax) * (px - ax) + (py - ay) * (py - ay)
        num, den = (n if num is None else num + n), (d if den is None else den + d)
    return {"num": num, "den": den, "ax": ax, "ay": ay, "bx": bx, "by": by}


def inside_margin(quad: Column, margin: Column) -> Column:
    ok = None
    for i in range(4):
        p = g.corner(quad, i)
        one = (p["x"] >= margin) & (p["x"] <= 1 - margin) & (p["y"] >= margin) & (p["y"] <= 1 - margin)
        ok = one if ok is None else ok & one
    return ok


@dataclass(frozen=True)
class FramingRules:
    """How close, how central and how far from the border a sheet has to be held."""

    # Enter and exit bands of the framing hints.
    fill_enter: float = 0.7
    fill_exit: float = 0.75
    room_enter: float = 0.07
    room_exit: float = 0.05
    fill_floor: float = 0.65
    border_enter: float = 0.015
    border_exit: float = 0.03


def framing_hint(quad: Column, cut_off: Column, covered: Column, current: Column, r: FramingRules = FramingRules()) -> Column:
    """move-back / move-phone / move-closer or null; the shown hint widens the band it leaves by."""
    margin, fill = g.border_margin(quad), g.fill_share(quad)
    edging = F.coalesce(current.isin("move-back", "move-phone"), F.lit(False))
    closer = F.coalesce(current == "move-closer", F.lit(False))
    near_edge = covered | (margin < F.when(edging, r.border_exit).otherwise(r.border_enter))
    too_big = (fill >= r.fill_exit) | ~g.fits_centred(quad, r.border_exit)
    filled = fill >= F.when(closer, r.fill_exit).otherwise(r.fill_enter)
    roomy = margin >= F.when(closer, r.room_exit).otherwise(r.room_enter)
    return (
        F.when(cut_off, "move-back")
        .when(near_edge, F.when(too_big, "move-back").otherwise("move-phone"))
        .when(filled, None)
        .when(roomy, "move-closer")
        .when(fill >= r.fill_floor, None)
        .otherwise("move-phone")
    )


def move_direction(quad: Column, current: Column) -> Column:
    """Which way to move the phone; the shown direction is kept until another is a quarter stronger."""
    b = g.bounds(quad)
    dx = (b["min_x"] + b["max_x"]) / 2 - 0.5
    dy = (b["min_y"] + b["max_y"]) / 2 - 0.5
    rx = F.abs(dx) / F.greatest(F.lit(0.02), (1 - (b["max_x"] - b["min_x"])) / 2)
    ry = F.abs(dy) / F.greatest(F.lit(0.02), (1 - (b["max_y"] - b["min_y"])) / 2)
    across = F.when(dx < 0, "left").otherwise("right")
    along = F.when(dy < 0, "up").otherwise("down")
    return (
        F.when(current.isin("left", "right"), F.when(ry > rx * 1.25, along).otherwise(across))
        .when(current.isin("up", "down"), F.when(rx > ry * 1.25, across).otherwise(along))
        .otherwise(F.when(rx > ry, across).otherwise(along))
    )


# The outcome a user sees for each engine reason.
OUTCOMES = {
    "semantic-regression": "declined",
    "semantic-insufficient-evidence": "unverified",
    "ineligible-quad": "page",
    "grid-contract": "page",
    "guard-nonfinite": "page",
    "guard-bounds": "page",
    "guard-jacobian": "page",
    "guard-scale": "page",
    "guard-displacement": "page",
    "guard-boundary": "page",
    "classical-non-convergent": "page",
    "classical-insufficient-features": "page",
    "classical-degenerate-bounds": "page",
    "classical-aspect-outlier": "page",
    "model-unavailable": "download",
    "unsupported": "transient",
    "worker-failed": "transient",
    "timeout": "transient",
    "render-failed": "transient",
    "source-unavailable": "transient",
    "baseline-unavailable": "transient",
    "curl-absent": "nothing",
}
FINAL_OUTCOMES = ["nothing", "declined", "unverified", "page"]


def outcome_of(reason: Column, deskew_failed: Column, already_straight: Column) -> Column:
    pairs = []
    for k, v in OUTCOMES.items():
        pairs += [F.lit(k), F.lit(v)]
    raw = F.coalesce(F.try_element_at(F.create_map(*pairs), reason), F.lit("transient"))
    final = raw.isin(FINAL_OUTCOMES)
    told = F.when(final & deskew_failed, "transient").when(final & already_straight, "nothing").otherwise(raw)
    return F.when(reason.isNotNull(), told)


# The memory of a positive reading.
PAPER_MEMORY_MS = 5000
PAPER_MEMORY_DRIFT = 0.06
MEMORY_SIDE_SUPPORT = 0.8
MEMORY_BORDER = 0.015


def paper_remembered(age_ms: Column, drift: Column, sides_known: Column, support: Column, open_sides: Column, border: Column) -> Column:
    """Why a negative reading is not excused by a recent positive one; null when it is."""
    return first_failing(
        [
            (age_ms <= PAPER_MEMORY_MS, "expired"),
            (drift <= PAPER_MEMORY_DRIFT, "drift"),
            (sides_known == 4, "sides"),
            (F.forall(support, lambda s: s.isNotNull() & (s >= MEMORY_SIDE_SUPPORT)), "support"),
            (open_sides == 0, "open"),
            (border >= MEMORY_BORDER, "border"),
        ]
    )
