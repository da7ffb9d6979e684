"""The state machines on a live stream, and the windowed forms of the batch counts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pagegauge.operators.folds import _typed, output_names, run_rows
from pagegauge.operators.gates import absolute_violations
from pagegauge.streaming.machines import Machine

def fold_stream(
    events: DataFrame, key: str, at: str, order: list[str], machine: Machine, watermark: str, idle_ms: int | None = None
) -> DataFrame:
    """Rows with the machine's outputs, as they arrive.

    ``at`` is the event-time column. Within a micro-batch a session's rows are put in order; a
    row older than the newest one already taken is late and dropped, as the batch rules do.
    With ``idle_ms`` the state of a session that has been silent for so long is let go, and the
    session starts afresh if it comes back; without it the stream equals the batch fold for good.
    """
    names = output_names(machine)
    kept = [f for f in events.schema.fields if f.name not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {machine.outputs}"
    columns = [f.name for f in kept]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # One micro-batch of one session: bounded by maxFilesPerTrigger, not by the session.
        frame = pd.concat(list(frames), ignore_index=True).sort_values(order)
        held, newest = (json.loads(v) for v in state.get) if state.exists else (machine.start(), None)
        if newest is not None:
            place = list(zip(*[frame[c].tolist() for c in order]))
            frame = frame[[list(p) > newest for p in place]]
        if len(frame):
            typed = _typed(frame.copy(), machine)
            outs = run_rows(machine, held, typed)
            last = [int(v) for v in frame[order].iloc[-1].tolist()]
            state.update((json.dumps(held), json.dumps(last)))
            out = frame[columns].reset_index(drop=True)
            for i, name in enumerate(names):
                out[name] = pd.Series([o[i] for o in outs], dtype="object")
            yield out
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)

    return (
        events.withWatermark(at, watermark)
        .groupBy(key)
        .applyInPandasWithState(step, schema, "held string, newest string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def tumbling_counts(events: DataFrame, at: str, key: str, size: str, watermark: str) -> DataFrame:
    windows = events.withWatermark(at, watermark).groupBy(key, F.window(at, size))
    return windows.agg(F.count("*").alias("passes"))


def sliding_spread(events: DataFrame, at: str, key: str, value: str, size: str, slide: str, watermark: str) -> DataFrame:
    windows = events.withWatermark(at, watermark).groupBy(key, F.window(at, size, slide))
    return windows.agg(F.count("*").alias("samples"), (F.max(value) - F.min(value)).alias("spread"))


def session_counts(events: DataFrame, at: str, key: str, gap: str, watermark: str) -> DataFrame:
    windows = events.withWatermark(at, watermark).groupBy(key, F.session_window(at, gap))
    return windows.agg(F.count("*").alias("n"))


def drop_repeats(events: DataFrame, at: str, keys: list[str], watermark: str) -> DataFrame:
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def gate_batches(suite: str, keys: list[str], report: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that hands each micro-batch's limit violations to ``report``."""

    def body(batch: DataFrame, batch_id: int) -> None:
        report(absolute_violations(suite, batch, keys), batch_id)

    return body
