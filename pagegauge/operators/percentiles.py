"""Exact order statistics that never gather a group.

Values are first counted (map-side), then counted again per grid cell; the cells say which
one holds a wanted rank, and only that cell's values are ranked. A group of any size is
spread over its cells, and ties collapse into one counted value. The answers are exact:
the grid decides where to look, never what is returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The four conventions, by how a share p of n values becomes a rank.
NEAREST = "nearest"  # ceil(p n), at least 1
LINEAR = "linear"  # between the two ranks around p (n - 1)
LOWER_MIDDLE = "lower_middle"  # floor(p (n - 1)) + 1
FLOOR_INDEX = "floor_index"  # floor(p n) + 1, at most n
WEIGHTED = "weighted"  # first value whose running weight reaches p of the total

NEVER = float("inf")


@dataclass(frozen=True)
class Wanted:
    out: str
    metric: str
    p: float
    kind: str = NEAREST


def finite(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(math.inf)), number)


def never(value: Column) -> Column:
    """A missing reading as "it never happened": after every number."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(math.inf)).otherwise(number)


def percentiles(
    df: DataFrame,
    keys: list[str],
    metrics: dict[str, tuple[Column, float]],
    wanted: list[Wanted],
    weight: Column | None = None,
    written: bool = False,
) -> DataFrame:
    """One row per key with a column per wanted statistic; ``metrics`` maps a name to (value, grid).

    Null values are left out; infinite ones rank last and come back as null. Of a ``written`` table with few keys the
    values are read twice: only counts per cell are shuffled, and then the values of the cells that hold a rank.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                value.cast("double").alias("v"),
                F.lit(float(grid)).alias("grid"),
            )
            for name, (value, grid) in metrics.items()
        ]
    )
    share = weight.cast("double") if weight is not None else F.lit(1).cast("bigint")
    long = (
        df.select(*keys, share.alias("w"), F.explode(entries).alias("e"))
        .select(*keys, "w", "e.metric", "e.v", "e.grid")
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    )
    if weight is not None:
        long = long.where(F.col("w") > 0)
    top = F.lit(2**62).cast("bigint")
    cell = F.when(F.col("v") == F.lit(math.inf), top).otherwise(
        F.floor(F.col("v") / F.col("grid")).cast("bigint")
    )
    long = long.withColumn("cell", cell)
    by = [*keys, "metric"]
    if written:
        counted = long
    else:
        counted = long.groupBy(*by, "v", "grid", "cell").agg(F.sum("w").alias("w"))
    over = Window.partitionBy(*by)
    cells = counted.groupBy(*by, "cell").agg(F.sum("w").alias("w"))
    upto = over.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(
        *by,
        "cell",
        F.sum("w").over(upto).alias("upto"),
        (F.sum("w").over(upto) - F.col("w")).alias("before"),
        F.sum("w").over(over).alias("total"),
    )
    specs = F.array(
        *[
            F.struct(
                F.lit(s.out).alias("out"),
                F.lit(s.metric).alias("for_metric"),
                F.lit(float(s.p)).alias("p"),
                F.lit(s.kind).alias("kind"),
                F.lit(part).alias("part"),
            )
            for s in wanted
            for part in ((0, 1) if s.kind == LINEAR else (0,))
        ]
    )
    n = F.col("total")
    p = F.col("s.p")
    kind = F.col("s.kind")
    whole = p * (n - 1)
    rank = (
        F.when(kind == NEAREST, F.greatest(F.lit(1.0), F.ceil(p * n).cast("double")))
        .when(kind == LOWER_MIDDLE, F.floor(whole) + 1.0)
        .when(kind == FLOOR_INDEX, F.least(n.cast("double"), F.floor(p * n) + 1.0))
        .when(kind == WEIGHTED, p * n - F.lit(1e-9))
        .when(F.col("s.part") == 0, F.floor(whole) + 1.0)
        .otherwise(F.ceil(whole) + 1.0)
    )
    picks = (
        cells.select("*", F.explode(F.filter(specs, lambda s: s["for_metric"] == F.col("metric"))).alias("s"))
        .withColumn("rank", rank)
        .where(
            ((F.col("before") < F.col("rank")) | ((F.col("before") == 0) & (F.col("rank") <= 0)))
            & (F.col("rank") <= F.col("upto"))
        )
        .select(
            *by,
            "cell",
            (F.col("rank") - F.col("before")).alias("rank"),
            F.col("s.out").alias("out"),
            F.col("s.part").alias("part"),
            (whole - F.floor(whole)).alias("between"),
        )
    )
    holding = picks.select(*by, "cell").distinct()
    inside = Window.partitionBy(*by, "cell").orderBy("v")
    # The cells of a few keys are a few rows; the values they do not hold stay where they are.
    held = counted.join(F.broadcast(holding) if written else holding, [*by, "cell"], "left_semi")
    if written:
        held = held.groupBy(*by, "cell", "v").agg(F.sum("w").alias("w"))
    ranked = held.select(
        *by,
        "cell",
        "v",
        F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("reach"),
        "w",
    )
    chosen = (
        ranked.join(picks, [*by, "cell"])
        .where(
            (F.col("rank") <= F.col("reach"))
            & ((F.col("reach") - F.col("w") < F.col("rank")) | (F.col("reach") == F.col("w")))
        )
        .groupBy(*keys, "out", "part")
        .agg(F.min("v").alias("v"), F.max("between").alias("between"))
    )
    columns = []
    for s in wanted:
        low = F.max(F.when((F.col("out") == s.out) & (F.col("part") == 0), F.col("v")))
        if s.kind == LINEAR:
            high = F.max(F.when((F.col("out") == s.out) & (F.col("part") == 1), F.col("v")))
            between = F.max(F.when(F.col("out") == s.out, F.col("between")))
            low = low + (high - low) * between
        columns.append(F.when(low != F.lit(math.inf), low).alias(s.out))
    return chosen.groupBy(*keys).agg(*columns)


def with_percentiles(
    base: DataFrame,
    df: DataFrame,
    keys: list[str],
    metrics: dict[str, tuple[Column, float]],
    wanted: list[Wanted],
    weight: Column | None = None,
    written: bool = False,
) -> DataFrame:
    """``base`` (one row per key, at least one key column) joined with the statistics of ``df``; null where a group has none."""
    table = percentiles(df, keys, metrics, wanted, weight, written)
    renamed = table.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[s.out for s in wanted])
    match = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        match = one if match is None else match & one
    return base.join(renamed, match, "left").drop(*[f"__k_{k}" for k in keys])
