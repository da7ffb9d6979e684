"""Verdicts on straightened pages, their roll-up and what changed between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.operators.detection import rate
from pagegauge.operators.percentiles import LINEAR, Wanted, finite, with_percentiles
from pagegauge.session import written_once

# Tolerances of the straighten verdict.
TILT_WORSE_DEG = 0.3
TILT_FIXED_DEG = 0.35
BOW_WORSE_ABS = 0.0015
BOW_WORSE_REL = 0.25
BOW_FIXED_REL = 0.6
WEDGE_DARK_FRAC = 0.03
SHOULD_ACT_DEG = 0.5
ASPECT_DRIFT = 0.01
PAINTED_MIN_FRAC = 0.002
DEVICE_BUDGET_MS = 12_000
FINAL_BUCKETS = ["nothing", "declined", "unverified", "page"]


def curled() -> Column:
    return ~F.col("curl").isin("none", "unknown") & F.col("curl").isNotNull()


def verdicts(rows: DataFrame) -> DataFrame:
    """Class, harms and residuals per page. A measure that is missing or not a number is unmeasured.

    Columns read: ``error, accepted, deskewed, should_act, curl, truth_tilt``, the flat and final
    measures ``*_tilt, *_bow, *_dark, *_w, *_h``, ``clip_known, clipped, shrunk, painted_frac, seam``.
    """
    c = F.col
    acted = c("accepted") | c("deskewed")
    flat_tilt, final_tilt = F.abs(finite(c("flat_tilt"))), F.abs(finite(c("final_tilt")))
    flat_bow, final_bow = finite(c("flat_bow")), finite(c("final_bow"))
    truth = F.abs(c("truth_tilt"))
    tilt_measured = flat_tilt.isNotNull() & final_tilt.isNotNull()
    bow_measured = flat_bow.isNotNull() & final_bow.isNotNull()
    bow_limit = flat_bow + F.greatest(F.lit(BOW_WORSE_ABS), BOW_WORSE_REL * flat_bow)
    dark = acted & F.coalesce(c("final_dark") > c("flat_dark") + WEDGE_DARK_FRAC, F.lit(False))
    drift = (c("final_w") / c("final_h")) / (c("flat_w") / c("flat_h")) - 1
    shrunk = F.coalesce(c("shrunk"), F.lit(False)) & c("clip_known")
    harms = F.array(
        F.when(tilt_measured & (final_tilt > flat_tilt + TILT_WORSE_DEG), "tilt"),
        F.when(c("accepted") & bow_measured & (final_bow > bow_limit), "bow"),
        F.when(c("clip_known") & F.coalesce(c("clipped"), F.lit(False)), "clipped"),
        F.when(dark & ((truth < SHOULD_ACT_DEG) | shrunk), "background framed in"),
        F.when(F.abs(drift) > ASPECT_DRIFT, "stretched"),
    )
    bow_unmeasured = (c("accepted") | curled()) & ~bow_measured
    gaps = F.array(
        F.when(~tilt_measured, "tilt unmeasured"),
        F.when(bow_unmeasured, "bow unmeasured"),
        F.when(~c("clip_known") | c("clipped").isNull(), "clipping unmeasured"),
    )
    ok = rows.where(~c("error"))
    page_tilt = F.when(acted, final_tilt).otherwise(flat_tilt)
    page_bow = F.when(acted, final_bow).otherwise(flat_bow)
    bow_fixed = F.coalesce(page_bow <= BOW_FIXED_REL * flat_bow, F.lit(False))
    staged = ok.select(
        "*",
        acted.alias("acted"),
        F.when(acted, F.array_compact(harms)).otherwise(F.array().cast("array<string>")).alias("harm_why"),
        F.when(acted, F.array_compact(gaps)).otherwise(F.array().cast("array<string>")).alias("gap_why"),
        ((truth < SHOULD_ACT_DEG) | F.coalesce(page_tilt <= TILT_FIXED_DEG, F.lit(False))).alias("tilt_ok"),
        (~curled() | bow_fixed).alias("curl_ok"),
        page_tilt.alias("residual_tilt"),
        page_bow.alias("residual_bow"),
        dark.alias("dark_wedge"),
        F.coalesce(c("painted_frac") > PAINTED_MIN_FRAC, F.lit(False)).alias("painted"),
        (acted & c("painted_frac").isNull()).alias("paint_unmeasured"),
    )
    harm = F.size("harm_why") > 0
    unverified = c("acted") & ~harm & (F.size("gap_why") > 0)
    fixed = F.when(c("tilt_ok") & c("curl_ok"), "complete").otherwise("partial")
    done = F.when(c("should_act"), fixed).otherwise("acted-ok")
    cls = (
        F.when(~c("acted"), F.when(c("should_act"), "noop").otherwise("left-alone"))
        .when(harm, "harm")
        .when(unverified, "unverified")
        .otherwise(done)
    )
    return staged.select(
        "*", harm.alias("harm"), unverified.alias("unverified"), cls.alias("cls")
    )


def groups() -> Column:
    """The overlapping groups of a page: everything, its family, and correctly framed tilts."""
    return F.array_compact(
        F.array(
            F.lit("ALL"),
            F.col("family"),
            F.when((F.col("family") == "tilt") & (F.col("quad_mode") == "correct"), "tilt/correct"),
        )
    )


#: What the summary reads of a judged page.
SUMMARIZED = [
    "family", "quad_mode", "curl", "truth_tilt", "cls", "should_act", "acted", "accepted", "deskewed", "harm", "unverified",
    "flat_and_straight", "residual_tilt", "residual_bow", "dark_wedge", "painted", "seam", "paint_unmeasured", "reason",
    "gate_ms", "deskew_ms", "stage_ms",
]


def summarize(judged: DataFrame, errors: DataFrame) -> DataFrame:
    """Counts, rates and percentiles per group; pages that needed work and pages that did not are apart."""
    c = F.col
    judged = written_once(judged.select(*SUMMARIZED))
    cls = c("cls")
    needed = c("should_act")
    tilt_only = needed & (F.abs(c("truth_tilt")) >= SHOULD_ACT_DEG) & ~curled()
    bent = needed & curled()
    conditions = {
        "should_act_n": needed,
        "acted_n": c("acted"),
        "accepted_n": c("accepted"),
        "deskewed_n": c("deskewed"),
        "noop": needed & (cls == "noop"),
        "partial": needed & (cls == "partial"),
        "complete": needed & (cls == "complete"),
        "harm_n": needed & (cls == "harm"),
        "unverified_n": needed & (cls == "unverified"),
        "harm_count": c("harm"),
        "flat_harms": ~needed & c("harm"),
        "nothing_to_do": ~needed,
        "nothing_to_do_acted": ~needed & c("acted"),
        "unverified_count": c("unverified"),
        "flat_and_straight_n": c("flat_and_straight"),
        "true_noop": c("flat_and_straight") & ~c("harm"),
        "tilt_cases": tilt_only,
        "tilt_complete": tilt_only & (cls == "complete"),
        "curl_cases": bent,
        "curl_complete": bent & (cls == "complete"),
        "resid_tilt_unmeasured": needed & c("residual_tilt").isNull(),
        "dark_wedges": c("dark_wedge"),
        "painted_pages": c("painted"),
        "seam_count": c("seam"),
        "paint_unmeasured_n": c("paint_unmeasured"),
        "timeouts": c("reason") == "timeout",
        "over_budget": c("gate_ms") + c("deskew_ms") > DEVICE_BUDGET_MS,
    }
    by = ["family", "quad_mode"]
    counted = judged.groupBy(*by).agg(
        F.count("*").alias("ok_n"), *[F.count_if(v).alias(n) for n, v in conditions.items()]
    )
    failed = errors.groupBy(*by).agg(F.count("*").alias("errors"))
    fine = counted.join(failed, by, "full").fillna(0)
    rolled = (
        fine.withColumn("grp", F.explode(groups()))
        .groupBy("grp")
        .agg(*[F.sum(n).alias(n) for n in ["ok_n", "errors", *conditions]])
    )
    sa = c("should_act_n")
    table = rolled.select(
        "grp",
        (c("ok_n") + c("errors")).alias("scenes"),
        "errors",
        *conditions,
        rate(c("noop"), sa).alias("noop_rate"),
        rate(c("partial"), sa).alias("partial_rate"),
        rate(c("complete"), sa).alias("complete_rate"),
        rate(c("harm_n"), sa).alias("harm_rate"),
        rate(c("unverified_n"), sa).alias("unverified_rate"),
        rate(sa - c("complete"), sa).alias("unfixed_rate"),
        rate(c("true_noop"), c("flat_and_straight_n")).alias("true_noop_rate"),
        rate(c("tilt_complete"), c("tilt_cases")).alias("tilt_complete_rate"),
        rate(c("curl_complete"), c("curl_cases")).alias("curl_complete_rate"),
        rate(c("curl_cases") - c("curl_complete"), c("curl_cases")).alias("curl_unfixed_rate"),
    )
    values = judged.select(
        F.explode(groups()).alias("grp"),
        F.when(needed, c("residual_tilt")).alias("resid"),
        F.when(tilt_only, c("residual_tilt")).alias("tilt_resid"),
        F.when(bent, c("residual_bow")).alias("bow"),
        "stage_ms",
        F.when(c("deskewed"), c("deskew_ms")).alias("deskew_ms"),
    )
    return with_percentiles(
        table,
        values,
        ["grp"],
        {
            "resid": (c("resid"), 0.01),
            "tilt_resid": (c("tilt_resid"), 0.01),
            "bow": (c("bow"), 1e-4),
            "stage_ms": (c("stage_ms"), 1.0),
            "deskew_ms": (c("deskew_ms"), 1.0),
        },
        [
            Wanted("resid_tilt_p50", "resid", 0.5, LINEAR),
            Wanted("resid_tilt_p90", "resid", 0.9, LINEAR),
            Wanted("tilt_only_resid_p50", "tilt_resid", 0.5, LINEAR),
            Wanted("tilt_only_resid_p90", "tilt_resid", 0.9, LINEAR),
            Wanted("curl_resid_bow_p50", "bow", 0.5, LINEAR),
            Wanted("stage_ms_p50", "stage_ms", 0.5, LINEAR),
            Wanted("stage_ms_p90", "stage_ms", 0.9, LINEAR),
            Wanted("deskew_ms_p50", "deskew_ms", 0.5, LINEAR),
            Wanted("deskew_ms_p90", "deskew_ms", 0.9, LINEAR),
        ],
        written=True,
    )


def per_tilt(judged: DataFrame) -> DataFrame:
    c = F.col
    rows = judged.where(c("family") == "tilt").withColumn("tilt", F.abs(c("truth_tilt")))
    table = rows.groupBy("tilt").agg(
        F.count("*").alias("n"),
        F.count_if("deskewed").alias("deskewed"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(c("cls") == "complete").alias("complete"),
        F.count_if("harm").alias("harm"),
        F.count_if("unverified").alias("unverified"),
        F.count_if(c("cls").isin("noop", "left-alone")).alias("noop"),
        F.count_if(~c("deskewed")).alias("abstained"),
    )
    return with_percentiles(
        table,
        rows,
        ["tilt"],
        {"resid": (c("residual_tilt"), 0.01), "est": (F.abs(c("deskew_deg") - c("truth_tilt")), 0.01)},
        [
            Wanted("resid_p50", "resid", 0.5, LINEAR),
            Wanted("resid_p90", "resid", 0.9, LINEAR),
            Wanted("est_err_p90", "est", 0.9, LINEAR),
        ],
    )


def outcome_key() -> Column:
    return F.when(F.col("accepted"), "accepted").otherwise(
        F.concat_ws(" ", F.coalesce("code", F.lit("?")), "reason")
    )


def card() -> Column:
    """The outcome sentence a page shows."""
    c = F.col
    level_flat = F.coalesce(~c("level_evidence") & F.coalesce(c("level_flat"), F.lit(True)), F.lit(False))
    bucket = F.coalesce("bucket", F.lit("transient"))
    final = bucket.isin(FINAL_BUCKETS)
    return (
        F.when(c("accepted") & c("planned"), "both")
        .when(c("accepted"), F.when(level_flat, "none").otherwise("curl"))
        .when(c("deskewed") & (c("reason") == "curl-absent"), "tilt")
        .when(c("deskewed"), F.when(final | (bucket == "better-flat"), "tilt-only").otherwise("tilt-retry"))
        .when(c("failed"), "transient")
        .when(final & level_flat, "nothing")
        .otherwise(F.when(bucket == "better-flat", "declined").otherwise(bucket))
    )


def scene_regressions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Scenes that lost a fix, gained a harm or are gone; both sides are ``id, cls``."""
    p = previous.select("id", F.col("cls").alias("before"))
    n = current.select("id", F.col("cls").alias("now"), F.lit(True).alias("present"))
    both = p.join(n, "id", "left")
    gone = F.col("present").isNull()
    lost = (F.col("before") == "complete") & (F.col("now") != "complete")
    harmed = (F.col("now") == "harm") & (F.col("before") != "harm")
    kinds = F.array_compact(
        F.array(
            F.when(gone, "missing"),
            F.when(~gone & lost, "lost fix"),
            F.when(~gone & harmed, "new harm"),
        )
    )
    return both.select("id", "before", "now", F.explode(kinds).alias("change"))


def flagged(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Scenes to look at, with every reason in order; both sides are ``id, cls, acted`` (and ``harm…``)."""
    c = F.col
    p = previous.select("id", c("cls").alias("was"), c("acted").alias("had_acted"))
    both = current.join(p, "id", "left")
    known = c("was").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(c("harm"), "harm"),
            F.when(c("unverified"), "unverified"),
            F.when(c("seam"), "seam"),
            F.when(known & c("acted") & ~c("had_acted"), "new act"),
            F.when(known & (c("was") == "complete") & (c("cls") != "complete"), "lost fix"),
        )
    )
    rows = both.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return rows.select("id", F.concat_ws(", ", "reasons").alias("reasons"))
