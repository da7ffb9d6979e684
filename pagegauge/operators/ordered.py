"""Ordered series without whole-key tasks.

A plain ``Window.partitionBy(session).orderBy(t)`` puts a session in one task. One
session may hold a third of all rows, so every ordered operator here is cut into
*slices* of the order axis: windows run inside ``(key, slice)`` and what a slice needs
from its neighbours travels in a summary of one row per slice. The row data is shuffled
once, on ``(key, slice)``; the summary is the only thing ordered per key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE = "__slice"


@dataclass(frozen=True)
class Ordered:
    """Rows of many keyed series, hash-partitioned by ``keys`` and slice, in ``order``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    #: Keys and slices of the rows as they came, from which the slices in use are found.
    places: DataFrame | None = None

    def _window(self, descending: bool = False):
        columns = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, SLICE).orderBy(*columns)

    def with_column(self, name: str, value: Column) -> "Ordered":
        return replace(self, df=self.df.withColumn(name, value))

    def where(self, condition: Column) -> "Ordered":
        return replace(self, df=self.df.where(condition))

    def step(
        self,
        lag: dict[str, Column] | None = None,
        lead: dict[str, Column] | None = None,
        fill: dict[str, Column] | None = None,
        ahead: dict[str, Column] | None = None,
        running: dict[str, Column] | None = None,
        peak: dict[str, Column] | None = None,
    ) -> "Ordered":
        """Add neighbour columns.

        ``lag``/``lead``: value on the previous/next row. ``fill``: last non-null value at or
        before the row. ``ahead``: first non-null value at or after it. ``running``/``peak``:
        running sum/maximum, this row included.
        """
        lag, lead, fill = lag or {}, lead or {}, fill or {}
        ahead, running, peak = ahead or {}, running or {}, peak or {}
        at = F.struct(*self.order)

        def packed(columns: dict[str, Column]) -> Column:
            return F.struct(*[c.alias(n) for n, c in columns.items()])

        aggregates = []
        if lag:
            aggregates.append(F.max_by(packed(lag), at).alias("__lag"))
        if lead:
            aggregates.append(F.min_by(packed(lead), at).alias("__lead"))
        for name, c in fill.items():
            aggregates.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__fill_{name}"))
        for name, c in ahead.items():
            aggregates.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(f"__ahead_{name}"))
        for name, c in running.items():
            aggregates.append(F.sum(c).alias(f"__run_{name}"))
        for name, c in peak.items():
            aggregates.append(F.max(c).alias(f"__peak_{name}"))

        per_key = Window.partitionBy(*self.keys).orderBy(SLICE)
        before = per_key.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*self.keys).orderBy(F.col(SLICE).desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = [F.col(k) for k in self.keys] + [F.col(SLICE)]
        if lag:
            carried.append(F.lag("__lag").over(per_key).alias("__lag"))
        if lead:
            carried.append(F.lead("__lead").over(per_key).alias("__lead"))
        for name in fill:
            carried.append(F.last(f"__fill_{name}", True).over(before).alias(f"__fill_{name}"))
        for name in ahead:
            carried.append(F.last(f"__ahead_{name}", True).over(after).alias(f"__ahead_{name}"))
        for name in running:
            carried.append(F.sum(f"__run_{name}").over(before).alias(f"__run_{name}"))
        for name in peak:
            carried.append(F.max(f"__peak_{name}").over(before).alias(f"__peak_{name}"))
        carry = self.df.groupBy(*self.keys, SLICE).agg(*aggregates).select(*carried)

        rows = self.df.join(carry, [*self.keys, SLICE])
        here = self._window()
        upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        back = self._window(descending=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added: list[Column] = []
        temporary: list[str] = []
        staged: list[Column] = []
        if lag:
            staged.append(F.coalesce(F.lag(packed(lag)).over(here), F.col("__lag")).alias("__lag_row"))
            added += [F.col(f"__lag_row.{n}").alias(n) for n in lag]
            temporary += ["__lag", "__lag_row"]
        if lead:
            staged.append(F.coalesce(F.lead(packed(lead)).over(here), F.col("__lead")).alias("__lead_row"))
            added += [F.col(f"__lead_row.{n}").alias(n) for n in lead]
            temporary += ["__lead", "__lead_row"]
        for name, c in fill.items():
            staged.append(F.coalesce(F.last(c, True).over(upto), F.col(f"__fill_{name}")).alias(name))
            temporary.append(f"__fill_{name}")
        for name, c in ahead.items():
            staged.append(F.coalesce(F.last(c, True).over(back), F.col(f"__ahead_{name}")).alias(name))
            temporary.append(f"__ahead_{name}")
        for name, c in running.items():
            total = F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.coalesce(F.col(f"__run_{name}"), F.lit(0))
            staged.append(total.alias(name))
            temporary.append(f"__run_{name}")
        for name, c in peak.items():
            staged.append(F.greatest(F.max(c).over(upto), F.col(f"__peak_{name}")).alias(name))
            temporary.append(f"__peak_{name}")
        out = rows.select("*", *staged)
        if added:
            out = out.select("*", *added)
        return replace(self, df=out.drop(*temporary))

    def recent(self, name: str, value: Column, n: int) -> "Ordered":
        """Add the values of the last ``n`` rows, this one included, oldest first.

        A slice hands on its last ``n`` rows; a slice holds at least one row, so the ``n``
        slices before it are enough.
        """
        held = F.struct(value.alias("v"))
        place = F.row_number().over(self._window(descending=True))
        last_rows = (
            self.df.select(*self.keys, SLICE, *[c for c in self.order], held.alias("__held"), place.alias("__place"))
            .where(F.col("__place") <= n)
            .groupBy(*self.keys, SLICE)
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("__place")).alias("i"), "__held"))).alias("__tail"))
        )
        near = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(-n, -1)
        carry = last_rows.select(
            *self.keys,
            SLICE,
            F.transform(F.flatten(F.collect_list("__tail").over(near)), lambda r: r["__held"]).alias("__carry"),
        )
        here = self._window().rowsBetween(-(n - 1), Window.currentRow)
        joined = F.concat(F.col("__carry"), F.collect_list(held).over(here))
        rows = self.df.join(carry, [*self.keys, SLICE]).withColumn("__joined", joined)
        size = F.size("__joined")
        taken = F.slice("__joined", F.greatest(F.lit(1), size - (n - 1)), F.lit(n))
        out = rows.withColumn(name, F.transform(taken, lambda r: r["v"]))
        return replace(self, df=out.drop("__carry", "__joined"))

    def windowed(
        self, spans: DataFrame, start: str | None = None, stop: str | None = None, width: int = 1, reach: int = 0, how: str = "inner"
    ) -> "Ordered":
        """Rows beside the spans of their key that touch their slice, met on ``(key, slice)``.

        The table of spans and slices has one row per key, span and slice that holds rows, so an idle
        slice costs nothing and no row is ever dealt out by its key alone. ``start`` and ``stop`` name
        the span's ends on the slices' axis (none: open), ``width`` is that of the slices, and ``reach`` how
        long a row may last. Spans without ends are one row of facts per key; ``how="left"`` keeps rows
        without any. Exact conditions on the rows are the caller's.
        """
        occupied = (self.df if self.places is None else self.places).select(*self.keys, SLICE).distinct()
        touched = occupied.join(spans, list(self.keys))
        if start is not None:
            touched = touched.where(F.col(SLICE) >= F.floor((F.col(start) - reach) / F.lit(width)))
        if stop is not None:
            touched = touched.where(F.col(SLICE) <= F.floor(F.col(stop) / F.lit(width)))
        return replace(self, df=self.df.join(touched, [*self.keys, SLICE], how))

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)


def ordered(df: DataFrame, keys: list[str], order: list[str], width: int, axis: str | None = None) -> Ordered:
    """Slice ``df`` every ``width`` units of its first order column (or of ``axis``)."""
    cut_by = F.floor(F.col(axis or order[0]) / F.lit(width)).cast("bigint")
    sliced = df.withColumn(SLICE, cut_by)
    return Ordered(sliced.repartition(*keys, SLICE), tuple(keys), tuple(order), sliced.select(*keys, SLICE))


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    right_at: str,
    payload: dict[str, Column],
    width: int,
    tie: str | None = None,
    strictly_before: bool = False,
) -> DataFrame:
    return asof_ordered(left, right, keys, at, right_at, payload, width, tie, strictly_before).result()


def asof_ordered(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    right_at: str,
    payload: dict[str, Column],
    width: int,
    tie: str | None = None,
    strictly_before: bool = False,
) -> Ordered:
    """Each left row with the payload of the last right row at or before it; nulls when none.

    ``tie`` orders right rows that share a moment (the greatest wins).
    ``strictly_before`` leaves right rows at the same moment out.
    """
    mark = F.struct(*[c.alias(n) for n, c in payload.items()])
    tie_value = F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")
    right_side, left_side = (1, 0) if strictly_before else (0, 1)
    points = right.select(
        *keys,
        F.col(right_at).alias("__at"),
        F.lit(right_side).alias("__side"),
        tie_value.alias("__tie"),
        mark.alias("__mark"),
    )
    rows = left.select(
        *keys,
        F.col(at).alias("__at"),
        F.lit(left_side).alias("__side"),
        F.lit(0).cast("bigint").alias("__tie"),
        F.struct(*left.columns).alias("__row"),
    )
    both = rows.unionByName(points, allowMissingColumns=True)
    series = ordered(both, keys, ["__at", "__side", "__tie"], width)
    filled = series.step(fill={"__found": F.col("__mark")}).where(F.col("__row").isNotNull())
    rows_found = filled.df.select("__row.*", SLICE, *[F.col(f"__found.{n}").alias(n) for n in payload])
    return Ordered(rows_found, tuple(keys), (at,))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int,
    condition: Column,
) -> DataFrame:
    """Pairs of a key's spans that meet, found through cells of ``width``, each pair once.

    ``condition`` is the exact test on the original columns (strict or closed ends).
    """

    def celled(df: DataFrame, span: tuple[str, str], first: str) -> DataFrame:
        start = F.floor(F.col(span[0]) / F.lit(width)).cast("bigint")
        stop = F.floor(F.col(span[1]) / F.lit(width)).cast("bigint")
        return (
            df.where(F.col(span[0]) <= F.col(span[1]))
            .withColumn(first, start)
            .withColumn("__cell", F.explode(F.sequence(start, stop)))
        )

    a = celled(left, left_span, "__first_left")
    b = celled(right, right_span, "__first_right")
    pairs = a.join(b, [*keys, "__cell"]).where(condition)
    once = F.col("__cell") == F.greatest("__first_left", "__first_right")
    return pairs.where(once).drop("__cell", "__first_left", "__first_right")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def trailing(df: DataFrame, keys: list[str], at: str, value: Column, name: str, span: int, width: int) -> DataFrame:
    """Each row with the values of its key's rows at most ``span`` before it, itself included.

    Rows near the end of a slice are repeated into the slices they can be seen from.
    """
    first = F.floor(F.col(at) / F.lit(width)).cast("bigint")
    last = F.floor((F.col(at) + span) / F.lit(width)).cast("bigint")
    spread = df.withColumn("__home", first).withColumn(SLICE, F.explode(F.sequence(first, last)))
    seen = Window.partitionBy(*keys, SLICE).orderBy(at).rangeBetween(-span, Window.currentRow)
    held = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), value.alias("v"))).over(seen))
    return spread.withColumn(name, held).where(F.col("__home") == F.col(SLICE)).drop("__home", SLICE)
