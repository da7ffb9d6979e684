"""Scoring one detector answer per row against the page's truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegauge.functions import geometry as g
from pagegauge.functions.staging import once
from pagegauge.operators.percentiles import Wanted, with_percentiles
from pagegauge.session import written_once

CONTENT_KINDS = ["text", "identifier", "mark"]


def score_detections(
    df: DataFrame, detected: str = "det", truth: str = "truth", width: str = "w", height: str = "h"
) -> DataFrame:
    """Add the verdict columns of a detection.

    A null quad is "no answer", a null truth "no page". Rows whose truth is not known at all
    do not belong here: filter on their ``*_known`` flag first. Both quads are cut to the frame
    before any area is taken, and corners outside the frame are reported but not judged.
    """
    w, h = F.col(width), F.col(height)
    both = F.col(detected).isNotNull() & F.col(truth).isNotNull()
    frame = g.frame_polygon(w, h)
    staged = once(
        df,
        {
            "__d": F.when(both, g.scaled(F.col(detected), w, h)),
            "__t": F.when(both, g.scaled(F.col(truth), w, h)),
            "corners_in_frame": F.when(both, g.in_frame(F.col(truth))),
        },
    )
    staged = once(
        staged,
        {
            "degenerate": g.degenerate(F.col("__d")),
            "__t_in": g.clip(F.col("__t"), frame),
            "__d_in": g.clip(F.col("__d"), frame),
            "__upright": F.when(both, g.image_order(F.col("__t"))),
            "__way": F.when(both, g.pairing(F.col("__d"), F.col("__t"))["way"]),
        },
    )
    staged = once(
        staged,
        {
            "__t_area": g.area(F.col("__t_in")),
            "__d_area": F.when(F.col("degenerate"), 0.0).otherwise(g.area(F.col("__d_in"))),
            "__overlap": F.when(F.col("degenerate"), 0.0).otherwise(
                g.overlap_area(F.col("__d_in"), F.col("__t_in"))
            ),
            "__order": F.when(both, g.pairing(F.col("__d"), F.col("__upright"))["way"]),
            "__matched": F.when(both, g.paired(F.col("__d"), F.col("__way"))),
        },
    )
    staged = once(staged, {"corner_errors": g.distances(F.col("__matched"), F.col("__t"), g.diagonal(w, h))})
    d_area, t_area, overlap = F.col("__d_area"), F.col("__t_area"), F.col("__overlap")
    union = d_area + t_area - overlap
    errors, judged = F.col("corner_errors"), F.col("corners_in_frame")
    scored = once(
        staged,
        {
            "has_truth": F.col(truth).isNotNull(),
            "detected": F.col(detected).isNotNull(),
            "iou": F.when(both, F.when(union > 0, overlap / union).otherwise(0.0)),
            "max_error": g.masked_max(errors, judged),
            "max_error_all": F.array_max(errors),
            "mean_error": g.masked_mean(errors, judged),
            "clipped_fraction": F.when(both, F.when(t_area > 0, (t_area - overlap) / t_area).otherwise(1.0)),
            "loose_fraction": F.when(
                both, F.when(t_area > 0, F.greatest(F.lit(0.0), d_area - overlap) / t_area).otherwise(0.0)
            ),
            "mirrored": F.col("__order") >= 4,
            "order_wrong": F.col("__order") != 0,
        },
    )
    verdicts = {
        "clipped": F.col("clipped_fraction") > g.CLIPPED_MAX_FRACTION,
        "loose": F.col("loose_fraction") > g.LOOSE_MAX_FRACTION,
        "wrong": F.when(
            both,
            F.col("degenerate")
            | (F.col("iou") < g.WRONG_CROP_MIN_IOU)
            | F.coalesce(F.col("max_error") > g.WRONG_CROP_MAX_CORNER_ERROR, F.lit(False))
            | F.col("order_wrong"),
        ),
        "false_positive": ~F.col("has_truth") & F.col("detected"),
        "miss": F.col("has_truth") & ~F.col("detected"),
    }
    temporary = ["__d", "__t", "__t_in", "__d_in", "__t_area", "__d_area", "__overlap"]
    temporary += ["__way", "__upright", "__order", "__matched"]
    return scored.withColumns(verdicts).drop(*temporary)


def content_loss(
    answers: DataFrame, boxes: DataFrame, key: list[str], detected: str = "det", width: str = "w", height: str = "h"
) -> DataFrame:
    """One row per answer and content box that the frame shows: the share of it the crop lost.

    ``answers`` and ``boxes`` meet on ``key``; boxes are ``kind, polygon`` in frame fractions.
    """
    w, h = F.col(width), F.col(height)
    judged = boxes.where(F.col("kind").isin(CONTENT_KINDS))
    rows = answers.where(F.col(detected).isNotNull()).join(judged, key)
    rows = once(
        rows,
        {
            "__box": g.clip(g.scaled(F.col("polygon"), w, h), g.frame_polygon(w, h)),
            "__quad": g.scaled(F.col(detected), w, h),
        },
    )
    rows = once(
        rows, {"__box_area": g.area(F.col("__box")), "__kept": g.area_inside(F.col("__box"), F.col("__quad"))}
    ).where(F.col("__box_area") > 0)
    lost = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), (F.col("__box_area") - F.col("__kept")) / F.col("__box_area"))
    )
    return rows.withColumn("lost", lost).drop("__box", "__box_area", "__quad", "__kept")


def content_verdicts(losses: DataFrame, by: list[str]) -> DataFrame:
    cut = F.col("lost") > g.CONTENT_CLIP_MIN_FRACTION
    return losses.groupBy(*by).agg(
        F.count("*").alias("boxes_judged"),
        F.count_if(cut).alias("boxes_clipped"),
        F.bool_or(cut).alias("content_cut"),
        F.bool_or(cut & (F.col("kind") == "identifier")).alias("identifier_cut"),
        F.max("lost").alias("max_lost"),
    )


def with_content(scored: DataFrame, losses: DataFrame, known: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Scored answers with content verdicts; ``known`` lists the keys whose content truth exists.

    Unknown content stays null: never "not clipped".
    """
    told = known.select(*key).distinct().withColumn("__told", F.lit(True))
    out = scored.join(content_verdicts(losses, by), by, "left").join(told, key, "left")
    judged = F.coalesce(F.col("__told"), F.lit(False)) & F.col("detected") & F.col("has_truth") & ~F.col("degenerate")
    out = (
        out.withColumn("content_clipped", F.when(judged, F.coalesce(F.col("content_cut"), F.lit(False))))
        .withColumn("identifier_clipped", F.when(judged, F.coalesce(F.col("identifier_cut"), F.lit(False))))
        .withColumn("boxes_judged", F.when(judged, F.coalesce(F.col("boxes_judged"), F.lit(0))))
        .withColumn("boxes_clipped", F.when(judged, F.coalesce(F.col("boxes_clipped"), F.lit(0))))
        .withColumn("max_lost", F.when(judged, F.col("max_lost")))
    )
    return (
        out.withColumn(
            "margin_clipped", F.when(F.col("content_clipped").isNotNull(), F.col("clipped") & ~F.col("content_clipped"))
        )
        .withColumn(
            "severe",
            F.when(
                F.col("detected") & F.col("has_truth"),
                F.when(F.col("wrong") | F.coalesce(F.col("content_clipped"), F.lit(False)), True).when(
                    F.col("content_clipped").isNotNull(), False
                ),
            ),
        )
        .drop("__told", "content_cut", "identifier_cut")
    )


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``; null when there is no whole."""
    return F.when(whole > 0, part / whole)


def summed() -> dict[str, Column]:
    """The yes/no conditions a summary counts."""
    return {
        "scenes": F.lit(True),
        "positives": F.col("has_truth"),
        "answered": F.col("ok"),
        "accepted": F.col("has_truth") & F.col("detected"),
        "wrong": F.col("wrong"),
        "clipped_n": F.col("clipped"),
        "loose_n": F.col("loose"),
        "order_wrong_n": F.col("order_wrong"),
        "content_judged": F.col("content_clipped").isNotNull(),
        "content_unknown": F.col("has_truth") & F.col("detected") & ~F.col("degenerate") & F.col("content_clipped").isNull(),
        "content_clipped_n": F.col("content_clipped"),
        "identifier_clipped_n": F.col("identifier_clipped"),
        "margin_clipped_n": F.col("margin_clipped"),
        "severe_n": F.col("severe"),
        "severe_unknown": F.col("has_truth") & F.col("detected") & F.col("severe").isNull(),
        "false_positives": F.col("false_positive"),
        "from_ml": F.col("accepted") & (F.col("source") == "ml"),
        "from_classical": F.col("accepted") & (F.col("source") == "classical"),
        "refine_runs": F.col("refine_ran"),
        "refine_changed_n": F.col("refine_ran") & F.col("refine_changed"),
    }


def group_names() -> Column:
    """The overlapping groups a scene belongs to: everything, its family, its family and setting."""
    return F.array_compact(
        F.array(
            F.lit("ALL"),
            F.col("family"),
            F.when(F.col("setting").isNotNull(), F.concat_ws("/", "family", "setting")),
        )
    )


def summarize_detections(scored: DataFrame, groups: Column) -> DataFrame:
    """Per group and variant: counts, rates and exact percentiles.

    Counts are taken once at the finest grain and added up into the overlapping groups; only
    the narrow values behind the percentiles are repeated per group.
    """
    conditions = summed()
    scored = written_once(scored)
    counts = scored.groupBy("family", "setting", "variant").agg(
        *[F.count_if(c).alias(n) for n, c in conditions.items()],
        F.sum("mean_error").alias("mean_error_sum"),
        F.count("mean_error").alias("mean_error_n"),
    )
    by = ["grp", "variant"]
    rolled = (
        counts.withColumn("grp", F.explode(groups))
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in [*conditions, "mean_error_sum", "mean_error_n"]])
    )
    c = F.col
    accepted, positives, judged = c("accepted"), c("positives"), c("content_judged")
    negatives = c("scenes") - positives
    table = rolled.select(
        *by,
        "scenes",
        "positives",
        negatives.alias("negatives"),
        rate(c("answered"), c("scenes")).alias("answered_rate"),
        rate(accepted, positives).alias("accepted_rate"),
        (accepted - c("wrong")).alias("good"),
        "wrong",
        (positives - accepted).alias("miss"),
        rate(accepted - c("wrong"), positives).alias("good_rate"),
        rate(c("wrong"), positives).alias("wrong_rate"),
        rate(positives - accepted, positives).alias("miss_rate"),
        rate(c("clipped_n"), accepted).alias("clipped_rate"),
        rate(c("loose_n"), accepted).alias("loose_rate"),
        c("order_wrong_n").alias("order_wrong"),
        "content_judged",
        "content_unknown",
        c("content_clipped_n").alias("content_clipped"),
        rate(c("content_clipped_n"), judged).alias("content_clipped_rate"),
        rate(c("identifier_clipped_n"), judged).alias("identifier_clipped_rate"),
        rate(c("margin_clipped_n"), judged).alias("margin_clipped_rate"),
        c("severe_n").alias("severe"),
        F.when(c("severe_unknown") == 0, rate(c("severe_n"), positives)).alias("severe_rate"),
        rate(c("mean_error_sum"), c("mean_error_n")).alias("mean_corner_error"),
        "false_positives",
        rate(c("false_positives"), negatives).alias("false_positive_rate"),
        "from_ml",
        "from_classical",
        "refine_runs",
        c("refine_changed_n").alias("refine_changed"),
    )
    values = scored.select(
        F.explode(groups).alias("grp"),
        "variant",
        F.when(F.col("has_truth"), F.col("iou")).alias("iou"),
        "max_error",
        "ms",
        F.when(F.col("refine_ran"), F.col("refine_ms")).alias("refine_ms"),
    )
    return with_percentiles(
        table,
        values,
        by,
        {
            "iou": (F.col("iou"), 1e-3),
            "error": (F.col("max_error"), 1e-4),
            "ms": (F.col("ms"), 0.5),
            "refine_ms": (F.col("refine_ms"), 0.1),
        },
        [
            Wanted("iou_p50", "iou", 0.5),
            Wanted("corner_error_p50", "error", 0.5),
            Wanted("corner_error_p95", "error", 0.95),
            Wanted("ms_p50", "ms", 0.5),
            Wanted("ms_p95", "ms", 0.95),
            Wanted("refine_ms_p50", "refine_ms", 0.5),
            Wanted("refine_ms_p95", "refine_ms", 0.95),
        ],
    )


def variant_flips(scored: DataFrame, base: str, other: str) -> DataFrame:
    """Scenes good under one variant and not under the other; only scenes that have a page."""
    good = F.col("has_truth") & F.col("detected") & ~F.coalesce(F.col("wrong"), F.lit(False))
    sides = (
        scored.where(F.col("variant").isin(base, other))
        .groupBy("scene_id")
        .agg(
            F.max(F.when(F.col("variant") == base, good)).alias("base_good"),
            F.max(F.when(F.col("variant") == other, good)).alias("other_good"),
            F.max(F.when(F.col("variant") == base, F.col("has_truth"))).alias("on_page"),
        )
    )
    both = sides.where(F.col("on_page") & F.col("base_good").isNotNull() & F.col("other_good").isNotNull())
    return both.where(F.col("base_good") != F.col("other_good")).select(
        "scene_id", F.when(F.col("base_good"), "good to wrong").otherwise("wrong to good").alias("flip")
    )


def with_quad_distance(df: DataFrame, out: str, a: str, b: str, w: Column, h: Column) -> DataFrame:
    """Add the largest distance between paired corners of two quads, as a share of the diagonal;
    null where either is missing."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    staged = once(
        df,
        {"__a": F.when(both, g.scaled(F.col(a), w, h)), "__b": F.when(both, g.scaled(F.col(b), w, h))},
    )
    staged = once(staged, {"__way": F.when(both, g.pairing(F.col("__a"), F.col("__b"))["way"])})
    staged = once(staged, {"__m": F.when(both, g.paired(F.col("__a"), F.col("__way")))})
    apart = F.array_max(g.distances(F.col("__m"), F.col("__b"), g.diagonal(w, h)))
    return once(staged, {out: apart}).drop("__a", "__b", "__way", "__m")


def worst_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the group limit is applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)
