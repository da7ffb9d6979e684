"""Ordered folds over keys of any size.

A fold is sequential within a key, and one key may hold a third of the rows. Keys are cut into
slices that are folded in parallel from a guessed entry state; a slice whose guess turns out
wrong (its predecessor left another state) is folded again, until every entry state equals what
the slice before it left. The result is the sequential one, whatever the guesses were. Machines
that forget (timers run out, smoothing settles) agree after one or two rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from pagegauge.operators.ordered import SLICE
from pagegauge.session import cut
from pagegauge.streaming.machines import Machine

ENTRY, NEXT, ROW = "__entry", "__next", "__row"


def plain(value):
    """A pandas cell as a Python value: no NaN, no numpy scalars."""
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and value != value else value


def run_rows(machine: Machine, state: list, frame: pd.DataFrame) -> list[tuple]:
    cells = [[plain(v) for v in frame[c].tolist()] for c in machine.inputs]
    return [machine.step(state, row) for row in zip(*cells)]


def output_names(machine: Machine) -> list[str]:
    return [part.strip().split(" ")[0] for part in machine.outputs.split(", ")]


def _typed(frame: pd.DataFrame, machine: Machine) -> pd.DataFrame:
    """Whole-number columns with gaps arrive as floats; hand the machine whole numbers again."""
    for c in machine.inputs:
        if frame[c].dtype.kind == "f":
            values = frame[c].dropna()
            if c in WHOLE and len(values) == len(values[values % 1 == 0]):
                frame[c] = frame[c].astype("Int64")
    return frame


WHOLE = {"t", "ready_since", "locked_since", "confirmed_at", "motion_at", "captured_at", "due", "event_id", "page_id"}


def fold(df: DataFrame, keys: list[str], order: list[str], machine: Machine, width: int, axis: str | None = None) -> DataFrame:
    """``df`` with the machine's outputs, rows taken in ``order`` within each key.

    A slice is ``width`` units of the first order column (or of ``axis``). The rows are written
    once: the slices in use, every round and the outputs read them, whatever it took to make them.
    """
    by = [*keys, SLICE]
    names = output_names(machine)
    kept = [c for c in df.columns if c not in names]
    sliced = cut(df.withColumn(SLICE, F.floor(F.col(axis or order[0]) / F.lit(width)).cast("bigint")))
    start = json.dumps(machine.start())
    entries = _entry_states(sliced.select(*dict.fromkeys([*by, *order, *machine.inputs])), keys, order, machine, start)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    made = to_arrow_schema(T.StructType.fromDDL(machine.outputs))

    def with_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(machine, by, start)
        for batch in batches:
            outs = walk.through(batch)
            rows = batch.filter(pc.is_valid(batch.column(ROW)))
            columns = [pa.array([o[i] for o in outs], field.type) for i, field in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *columns], [*kept, *names])

    return _dealt(sliced, entries, by, order).mapInArrow(with_outputs, f"{schema}, {machine.outputs}")


class _Walk:
    """A machine walking through sorted rows, from the entry state that heads a slice or else from the start."""

    def __init__(self, machine: Machine, by: list[str], start: str):
        self.machine, self.by, self.start = machine, by, start
        self.place, self.state, self.known, self.next = None, None, None, None
        self.left: list[tuple] = []

    def through(self, batch: pa.RecordBatch) -> list[tuple]:
        """Outputs of the batch's rows; slices that ended and have one after them are added to ``left``."""
        cells = [_plain_cells(batch.column(c)) for c in self.machine.inputs]
        head = [batch.column(c).to_pylist() for c in (ROW, ENTRY, NEXT)]
        step, outs = self.machine.step, []
        for place, row, is_row, entry, after in zip(
            zip(*[batch.column(c).to_pylist() for c in self.by]), zip(*cells), *head, strict=True
        ):
            if place != self.place:
                self.leave()
                self.place, self.state, self.next = place, json.loads(self.start), None
            if is_row:
                outs.append(step(self.state, row))
            else:
                self.state, self.next = json.loads(entry), after
        return outs

    def leave(self) -> None:
        if self.next is not None:
            self.left.append((*self.place[:-1], self.next, json.dumps(self.state)))
            self.next = None


def _plain_cells(column: pa.Array) -> list:
    """Cells as Python values, NaN as None."""
    if pa.types.is_floating(column.type):
        column = pc.if_else(pc.is_nan(column), None, column)
    return column.to_pylist()


def _dealt(sliced: DataFrame, states: DataFrame | None, by: list[str], order: list[str]) -> DataFrame:
    """Rows in order, each slice behind the row of its entry state if it has one.

    Slices are dealt over all the shuffle partitions: Python work is heavy per byte, so none are merged for being small.
    """
    rows = sliced.withColumn(ROW, F.lit(True))
    if states is None:
        rows = rows.withColumns({ENTRY: F.lit(None).cast("string"), NEXT: F.lit(None).cast("bigint")})
    else:
        rows = rows.unionByName(states, allowMissingColumns=True)
        rows = rows if NEXT in rows.columns else rows.withColumn(NEXT, F.lit(None).cast("bigint"))
    dealt = rows.repartition(int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return dealt.sortWithinPartitions(*by, F.col(ROW).asc_nulls_first(), *[F.col(c).asc_nulls_last() for c in order])


def _entry_states(sliced: DataFrame, keys: list[str], order: list[str], machine: Machine, start: str) -> DataFrame | None:
    """Entry state of every slice that has one before it; null when no key has two slices."""
    by = [*keys, SLICE]
    per_key = Window.partitionBy(*keys).orderBy(SLICE)
    places = sliced.select(*by).distinct()
    places = places.select(*by, F.lead(SLICE).over(per_key).alias(NEXT))
    places = cut(places.where(F.col(NEXT).isNotNull()))
    if places.isEmpty():
        return None
    schema = ", ".join(f"`{k}` {sliced.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{schema}, {SLICE} bigint, {ENTRY} string"
    fields = to_arrow_schema(T.StructType([*[sliced.schema[k] for k in keys], *T.StructType.fromDDL(f"{SLICE} bigint, {ENTRY} string")]))

    def last_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(machine, by, start)

        def taken() -> pa.RecordBatch:
            rows, walk.left = walk.left, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

        for batch in batches:
            walk.through(batch)
            yield taken()
        walk.leave()
        yield taken()

    def exits(todo: DataFrame) -> DataFrame:
        rows = sliced.join(todo.select(*by), by, "left_semi")
        return _dealt(rows, todo, by, order).mapInArrow(last_states, schema)

    todo = places.withColumn(ENTRY, F.lit(start))
    entries = cut(exits(todo))
    while True:
        # Slices whose entry was just learned and is not what they were folded from.
        wrong = places.join(entries, by).withColumnRenamed(ENTRY, "__found")
        wrong = wrong.join(todo.select(*by, ENTRY), by)
        again = cut(wrong.where(F.col("__found") != F.col(ENTRY)).select(*by, NEXT, F.col("__found").alias(ENTRY)))
        if again.isEmpty():
            return entries
        fresh = cut(exits(again))
        kept = entries.join(fresh.select(*by), by, "left_anti")
        entries = cut(kept.unionByName(fresh))
        folded = again.select(*by, NEXT, ENTRY)
        todo = cut(todo.join(again.select(*by), by, "left_anti").unionByName(folded))
