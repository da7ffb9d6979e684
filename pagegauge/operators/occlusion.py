"""Where a covered corner's answer went, what it took in, and whether its flags were right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.functions.staging import once
from pagegauge.operators.detection import rate
from pagegauge.operators.percentiles import Wanted, with_percentiles

# Occlusion thresholds.
NEAR_FEATURE = 0.015
INCLUDED_MIN_FRACTION = 0.005
CORNER_GATE = 0.03
SHALLOW_COVER = 0.02
MODES = ["true-corner", "occluder-tip", "edge-crossing", "on-occluder", "inside-page", "elsewhere"]


def _nearest(p: Column, points: Column) -> Column:
    apart = F.transform(
        points, lambda q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    )
    return F.coalesce(F.array_min(apart), F.lit(float("inf")))


def _crossings(poly: Column, page: Column) -> Column:
    """Points where the edges of two polygons meet."""
    edges = lambda c: F.zip_with(
        c,
        F.concat(F.slice(c, F.lit(2), F.size(c)), F.slice(c, F.lit(1), F.lit(1))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def meet(e: Column, f: Column) -> Column:
        rx, ry = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        sx, sy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
        den = rx * sy - ry * sx
        t = ((f["a"]["x"] - e["a"]["x"]) * sy - (f["a"]["y"] - e["a"]["y"]) * sx) / den
        u = ((f["a"]["x"] - e["a"]["x"]) * ry - (f["a"]["y"] - e["a"]["y"]) * rx) / den
        hit = (F.abs(den) >= 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return F.when(hit, g.point(e["a"]["x"] + t * rx, e["a"]["y"] + t * ry))

    pairs = F.flatten(F.transform(edges(poly), lambda e: F.transform(edges(page), lambda f: meet(e, f))))
    return F.filter(pairs, lambda p: p.isNotNull())


def score(df: DataFrame) -> DataFrame:
    """Occlusion columns per answer.

    Reads pixel polygons ``d`` (answer or null), ``q`` (page), ``occluder``, ``foreign`` (or null),
    ``box`` (frame) and ``diag``, and ``occluded`` (covered corner or null), ``in_frame``.
    """
    c = F.col
    answered = c("d").isNotNull()
    rows = once(
        df,
        {
            "__way": F.when(answered, g.pairing(c("d"), c("q"))["way"]),
            "__page": g.area(g.clip(c("q"), c("box"))),
            "__usable": F.coalesce(~g.degenerate(c("d")) & g.convex(c("d"), 1e-9), F.lit(False)),
        },
    )
    rows = once(
        rows,
        {
            "__m": F.when(answered, g.paired(c("d"), c("__way"))),
            "__d_in": F.when(c("__usable"), g.clip(c("d"), c("box"))),
        },
    )
    rows = once(
        rows,
        {
            "errors": g.distances(c("__m"), c("q"), c("diag")),
            "__on": F.when(c("__usable"), g.clip(c("occluder"), c("__d_in"))),
            "__fon": F.when(c("__usable") & c("foreign").isNotNull(), g.clip(c("foreign"), c("__d_in"))),
            "__p": F.get("__m", c("occluded")),
            "__tips": F.filter("occluder", lambda v: g.contains(c("q"), v)),
            "__cross": _crossings(c("occluder"), c("q")),
        },
    )

    def outside(on: Column) -> Column:
        return F.when(F.size(on) >= 3, g.area(on) - g.area(g.clip(on, c("q")))).otherwise(0.0)

    rows = once(rows, {"__out": outside(c("__on")), "__fout": outside(c("__fon"))})
    included = F.when(c("__usable") & (c("__page") > 0), F.greatest(F.lit(0.0), c("__out")) / c("__page"))
    both = F.greatest(F.lit(0.0), c("__out") + c("__fout"))
    foreign = F.when(c("__usable") & (c("__page") > 0) & c("foreign").isNotNull(), both / c("__page"))
    own = F.get("errors", c("occluded"))
    p = c("__p")
    inside = g.contains(c("q"), p)
    mode = (
        F.when(~answered, "lost")
        .when(c("occluded").isNull(), None)
        .when(own <= NEAR_FEATURE, "true-corner")
        .when(_nearest(p, c("__tips")) / c("diag") <= NEAR_FEATURE, "occluder-tip")
        .when(_nearest(p, c("__cross")) / c("diag") <= NEAR_FEATURE, "edge-crossing")
        .when(~inside & g.contains(c("occluder"), p), "on-occluder")
        .when(inside, "inside-page")
        .otherwise("elsewhere")
    )
    seen = F.array(
        *[F.get("in_frame", F.lit(i)) & F.coalesce(c("occluded") != i, F.lit(True)) for i in range(4)]
    )
    out = once(
        rows,
        {
            "mode": mode,
            "covered_error": own,
            "visible_error": g.masked_max(c("errors"), seen),
            "included": included > INCLUDED_MIN_FRACTION,
            "foreign_included": foreign > INCLUDED_MIN_FRACTION,
        },
    )
    return out.drop("__page", "__usable", "__m", "__d_in", "__on", "__fon", "__p", "__tips", "__cross", "__out", "__fout")


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    answered = c("d").isNotNull()
    covered = c("occluded").isNotNull()
    over = covered & (~answered | (c("covered_error") > CORNER_GATE))
    table = scored.groupBy(*by).agg(
        F.count("*").alias("scenes"),
        F.count_if(covered).alias("covered"),
        F.count_if(answered).alias("accepted"),
        rate(F.count_if(~answered), F.count("*")).alias("miss_rate"),
        rate(F.count_if(over), F.count_if(covered)).alias("over_3_rate"),
        rate(F.count_if("included"), F.count("included")).alias("included_rate"),
        rate(F.count_if("foreign_included"), F.count("foreign_included")).alias("foreign_rate"),
        *[F.count_if(c("mode") == m).alias(m.replace("-", "_")) for m in [*MODES, "lost"]],
    )
    return with_percentiles(
        table,
        scored,
        by,
        {"c": (c("covered_error"), 1e-3), "v": (c("visible_error"), 1e-3)},
        [
            Wanted("covered_p50", "c", 0.5),
            Wanted("covered_p90", "c", 0.9),
            Wanted("covered_p95", "c", 0.95),
            Wanted("visible_p50", "v", 0.5),
        ],
    )


def corner_flags(scored: DataFrame) -> DataFrame:
    """One row per true corner of an answered scene: covered, shallowly covered, flagged.

    ``flags`` and ``measured`` are in the answer's corner order; the pairing lines them up with
    the page's corners.
    """
    c = F.col
    rows = scored.where(c("d").isNotNull())
    i = c("i")
    at = F.when(c("__way") >= 4, 3 - (i + c("__way") % 4) % 4).otherwise((i + c("__way") % 4) % 4)
    rows = rows.withColumn("i", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("j", at)
    covered = F.coalesce(c("occluded") == i, F.lit(False))
    ends = {"__covered": covered, "__from": F.get("q", i)}
    ends |= {f"__to{step}": F.get("q", (i + step) % 4) for step in (3, 1)}
    rows = once(rows, ends)
    start = c("__from")

    def length(step: int) -> Column:
        dx, dy = c(f"__to{step}")["x"] - start["x"], c(f"__to{step}")["y"] - start["y"]
        return F.sqrt(dx * dx + dy * dy)

    rows = once(rows, {f"__length{step}": length(step) for step in (3, 1)})
    units = {}
    for step in (3, 1):
        for axis in ("x", "y"):
            units[f"__u{axis}{step}"] = (c(f"__to{step}")[axis] - start[axis]) / c(f"__length{step}")
    rows = once(rows, {**units, "__x": start["x"], "__y": start["y"]})

    def clear(step: int) -> Column:
        """First half pixel along the side that the occluder does not hide; 0 when there is none."""
        hidden = F.transform(
            F.sequence(F.lit(0), F.ceil(f"__length{step}").cast("int") - 1),
            lambda k: g.let(
                g.point(c("__x") + c(f"__ux{step}") * (k * 0.5), c("__y") + c(f"__uy{step}") * (k * 0.5)),
                lambda p: g.contains(c("occluder"), p),
            ),
        )
        return F.when(c("__covered"), F.array_position(hidden, False))

    rows = once(rows, {f"__clear{step}": clear(step) for step in (3, 1)})

    def reach(step: int) -> Column:
        first = c(f"__clear{step}")
        return F.when(first > 0, (first - 1) * 0.5).otherwise(F.ceil(f"__length{step}") * 0.5)

    rows = rows.withColumn("__reach", F.when(c("__covered"), F.greatest(reach(3), reach(1))))
    measured = F.get("measured", c("j"))
    flag = F.get("flags", c("j"))
    return rows.select(
        "scene_id",
        "variant",
        "i",
        c("__covered").alias("covered"),
        F.coalesce(c("__reach") < SHALLOW_COVER * c("diag"), F.lit(False)).alias("shallow"),
        F.get("in_frame", i).alias("in_frame"),
        flag.alias("provenance"),
        (measured & (flag != "seen")).alias("flagged"),
        measured.alias("measured"),
    )


def summarize_flags(corners: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    judged = corners.where("in_frame")
    deep, flagged = c("covered") & ~c("shallow"), c("flagged")
    plain = ~c("covered")
    counts = judged.groupBy(*by).agg(
        F.count_if(deep & flagged).alias("tp"),
        F.count_if(deep & ~flagged).alias("fn"),
        F.count_if(plain & flagged).alias("fp"),
        F.count_if(plain).alias("seen_corners"),
        F.count_if("shallow").alias("shallow"),
        F.count_if(c("shallow") & flagged).alias("shallow_flagged"),
        F.count_if(c("provenance") == "inferred").alias("inferred"),
        F.count_if(c("provenance") == "unknown").alias("unknown"),
    )
    tp, fn, fp, sf = c("tp"), c("fn"), c("fp"), c("shallow_flagged")
    return counts.select(
        *by,
        (tp + fn).alias("covered"),
        "shallow",
        "shallow_flagged",
        rate(tp, tp + fn).alias("recall"),
        rate(tp + sf, tp + fn + c("shallow")).alias("recall_all"),
        rate(tp, tp + fp).alias("precision"),
        rate(tp + sf, tp + sf + fp).alias("precision_all"),
        fp.alias("false_flags"),
        rate(fp, c("seen_corners")).alias("false_flag_rate"),
        "inferred",
        "unknown",
    )
