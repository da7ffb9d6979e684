"""Comparing runs: tolerances, absolute limits, floors, scope and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much worse a headline may get before it is a regression.
REGRESSION_TOLERANCE = {
    "wrongRate": 0.02,
    "missRate": 0.02,
    "falsePositiveRate": 0.02,
    "cornerErrorP50": 0.002,
    "contentClippedRate": 0.02,
    "severeRate": 0.02,
    "captureWrongRate": 0.0,
    "cornersAtConfirmMax": 0.015,
    "falseLocksPerMinute": 1.0,
    "captureWrongRateFinal": 0.0,
    "severeCaptureRate": 0.0,
    "pagelessCaptureRate": 0.0,
    "falseLockExposure": 0.05,
    "staleStuck": 0.0,
    "paperUnlockedShare": 0.05,
    "pagelessLockedShare": 0.05,
    "undetectedRate": 0.02,
    "jitterP50": 0.002,
    "offShare": 0.05,
    "unfixedRate": 0.02,
    "noopRate": 0.02,
    "curlUnfixedRate": 0.03,
    "harmCount": 0.0,
    "flatHarms": 0.0,
    "unverifiedCount": 0.0,
    "residTiltP90": 0.1,
    "seamCount": 0.0,
    "timeouts": 1.0,
    "overBudget": 5.0,
}
# What a suite may never exceed.
ABSOLUTE_LIMITS = {
    ("detector", "contentUnknown"): 0.0,
    ("session", "missingCaptures"): 0.0,
    ("session", "confirmNeverOpened"): 0.0,
    ("session", "confirmOffImage"): 0.0,
    ("session", "unscoredCaptures"): 0.0,
    ("session", "contentUnknownCaptures"): 0.0,
    ("session", "missingData"): 0.0,
    ("real-video", "unidentifiedCaptures"): 0.0,
    ("straighten", "errors"): 0.0,
    ("straighten-real", "errors"): 0.0,
}
# Floors of the locked share by CPU rate and session, and the first-lock limit.
PAPER_LOCK_FLOORS = {
    (1, "dim-owner-case"): 0.12,
    (1, "dim-owner-bare"): 0.58,
    (1, "dim-sheet-over"): 0.15,
    (1, "dim-text-page"): 0.6,
    (4, "dim-owner-case"): 0.05,
    (4, "dim-owner-bare"): 0.45,
    (4, "dim-sheet-over"): 0.08,
    (4, "dim-text-page"): 0.4,
}
FIRST_LOCK_P50_MS = {1: 1500.0, 4: None}
PAPER_LOCK_MIN_RUNS = 8
PAPER_LOCK_TARGET = 0.8
DELTA_SLACK = 1e-12


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric, nulls kept."""
    return wide.unpivot(keys, metrics, "metric", "value")


def lookup(table: dict, key: Column) -> Column:
    """A fixed table as an expression, so no join is planned for it."""
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)


def compare_runs(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Old against new long-format metrics: delta and status per (keys, metric).

    A value that was measured and is not any more is a regression; a new one is only a note.
    """
    p = previous.select(*keys, "metric", F.col("value").alias("before"))
    n = current.select(*keys, "metric", F.col("value").alias("now"))
    both = p.join(n, [*keys, "metric"], "full")
    tolerance = lookup(REGRESSION_TOLERANCE, F.col("metric"))
    delta = F.col("now") - F.col("before")
    status = (
        F.when(F.col("before").isNull() & F.col("now").isNull(), "none")
        .when(F.col("before").isNull(), "new")
        .when(F.col("now").isNull(), "lost")
        .when(delta > tolerance + DELTA_SLACK, "regressed")
        .otherwise("ok")
    )
    return both.select(*keys, "metric", "before", "now", delta.alias("delta"), tolerance.alias("tolerance"), status.alias("status"))


def absolute_violations(suite: str, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Limited metrics that are over their limit, or present without a value."""
    limits = {m: v for (s, m), v in ABSOLUTE_LIMITS.items() if s == suite}
    rows = metrics.where(F.col("metric").isin(list(limits))).withColumn("lim", lookup(limits, F.col("metric")))
    value = F.col("value")
    problem = F.when(value.isNull() | F.isnan(value), "no value").when(value > F.col("lim"), "over limit")
    return rows.select(*keys, "metric", "value", "lim", problem.alias("problem")).where("problem IS NOT NULL")


def paper_lock_violations(locks: DataFrame) -> DataFrame:
    """``cpu, session, runs, locked_share, first_lock_p50`` against floors and the first-lock limit."""
    key = F.concat_ws("/", F.col("cpu").cast("string"), "session")
    floors = {f"{cpu}/{session}": floor for (cpu, session), floor in PAPER_LOCK_FLOORS.items()}
    limits = {k: v for k, v in FIRST_LOCK_P50_MS.items() if v is not None}
    rows = locks.withColumn("floor", lookup(floors, key)).where(F.col("floor").isNotNull())
    share, first = F.col("locked_share"), F.col("first_lock_p50")
    limit = lookup(limits, F.col("cpu"))
    enough = F.col("runs") >= PAPER_LOCK_MIN_RUNS
    problems = F.array_compact(
        F.array(
            F.when(~enough, "too few runs"),
            F.when(enough & share.isNull(), "no share"),
            F.when(enough & (share < F.col("floor")), "below floor"),
            F.when(enough & limit.isNotNull() & ~F.coalesce(first <= limit, F.lit(False)), "locked late"),
        )
    )
    return rows.select("cpu", "session", "runs", "locked_share", "floor", F.explode(problems).alias("problem"))


def shared_scope(previous: DataFrame, current: DataFrame, keys: list[str], pooled: Column) -> DataFrame:
    """Keys both runs measured; pooled rows are left out when the two pools differ."""
    p, n = previous.select(*keys).distinct(), current.select(*keys).distinct()
    common = p.intersect(n).withColumn("pooled", pooled)
    differing = p.where(~pooled).exceptAll(n.where(~pooled)).unionByName(n.where(~pooled).exceptAll(p.where(~pooled)))
    flagged = differing.limit(1).select(F.lit(True).alias("pooled"), F.lit(True).alias("__differs"))
    return common.join(F.broadcast(flagged), "pooled", "left").where(F.col("__differs").isNull()).drop("__differs", "pooled")


def config_problems(previous: DataFrame, current: DataFrame, must_match: list[str]) -> DataFrame:
    """Configuration keys that must be equal for two runs to be comparable and are not."""
    p = previous.select("name", F.col("setting").alias("before"))
    n = current.select("name", F.col("setting").alias("now"))
    both = p.join(n, "name", "full").where(F.col("name").isin(must_match))
    return both.where(~F.col("before").eqNullSafe(F.col("now")))


def identity(*columns: str) -> Column:
    """Hash of a run's configuration."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def still_to_do(items: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose content is not in the manifest under the same hash."""
    return items.join(manifest.select(*keys), keys, "left_anti")
