"""Cheapest repair of conversations: faults, cost, the least audit among the cheapest, repaired rows.

A conversation's rows stand in order of turn (null first), then role and text. Each has at most one
fault: ``blank`` (no character but white space), else ``duplicate`` (role and text stood before), else
``truncated`` (its last such character is not one of ``.!?``). Edits and their costs are those of
``path_ranks``; the roles that remain begin with at most one system row and then alternate user,
assistant. Among the cheapest repairs the one whose initials are least in ASCII order is taken.

How no conversation has to fit one task: equal rows are counted first, and told apart by a number,
then all rows are put in order by a range partition over conversation, turn, role, text and number,
which cuts a hot conversation as it cuts any other run. Each partition's rows become slices of at most
``SLICE`` rows. A conversation inside one slice is solved there. For the others each slice gives its
costs between the four states on both sides, the slices of a conversation are chained through these
(16 numbers for up to ``SLICE`` rows), and the least path is chained in the same way from the left; then
every slice writes its own part of the audit and of the repaired rows. Duplicates come from counts per
(conversation, role, text), of which only those met in two turns or more are joined back.

An audit is one value of a row, so a conversation has at most 2**31 rows and half a million slices:
that bounds what a chain holds. Only a digest of a whole conversation reads its parts in one task, as a
stream, since a hash of all bytes in order cannot be added up.

Defined cases: null role or text is one space; a null conversation identifier is one conversation; all
rows of one turn are in order of role and text (in code points); initials are the roles' first
characters, whatever the role; a conversation of which all rows have weight 0 has an empty audit; empty
tables give no rows; texts may be of any length; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegauge.llm import path_ranks as paths
from pagegauge.llm.base import Stage, arrow_schema

SLICE = 2048
SLICE_BYTES = 1 << 20
WHITE = " \t\n\v\f\r"
STOPS = (".", "!", "?")
#: Copies of one row that are numbered at once.
NUMBERED = 4096

SLICES = "part int, seq int, whole boolean, turn_min bigint, turn_max bigint, turns bigint, roles array<string>, texts array<string>, faults binary"
SEGMENTS = (
    "part int, seq int, whole boolean, turn_min bigint, turn_max bigint, turns bigint, rows bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, head string, tail string, cost bigint, audit string, roles array<string>, texts array<string>"
)
DIGESTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _with_id(kind: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(ddl).fields])


def _counted(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, weight_col: str | None) -> DataFrame:
    """Different rows (conv_id, turn, role, text) and how often they stand; a conversation without any
    keeps one row of nulls."""
    weight = conversations[weight_col].cast("long") if weight_col else F.lit(1).cast("long")
    own = conversations.select(
        conversations[id_col].alias("conv_id"),
        conversations[turn_col].cast("long").alias("turn"),
        F.coalesce(conversations[role_col], F.lit(" ")).alias("role"),
        F.coalesce(conversations[text_col], F.lit(" ")).alias("text"),
        F.coalesce(weight, F.lit(0)).alias("weight"),
    )
    there = F.col("weight") > 0
    own = own.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "weight")
    return own.groupBy("conv_id", "turn", "role", "text").agg(F.sum("weight").alias("copies"))


def _judged(counted: DataFrame, stage: Stage) -> DataFrame:
    """Every row by itself again, with its fault."""
    key = F.md5("text")
    # Role and text of a conversation in two turns or more; the first turn keeps them.
    again = counted.filter("copies > 0").groupBy("conv_id", "role", key.alias("key"))
    again = again.agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("early"), F.min("turn").alias("turn")).filter("n > 1")
    again = again.select(
        F.col("conv_id").alias("of"), F.col("role").alias("of_role"), "key", F.when(~F.col("early"), F.col("turn")).alias("first_turn"), F.lit(True).alias("met")
    )
    again = stage.keep(again, "again")
    same = counted["conv_id"].eqNullSafe(again["of"]) & (counted["role"] == again["of_role"]) & (key == again["key"])
    rows = counted.join(again, same, "left")
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    later = F.coalesce("met", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    rows = rows.select("conv_id", "turn", "role", "text", "copies", trimmed.alias("trimmed"), later.alias("later"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("copies") - 1, F.lit(0)) / NUMBERED)))
    rows = rows.withColumn("block", blocks).withColumn("left", F.least(F.col("copies") - F.col("block") * NUMBERED, F.lit(NUMBERED)))
    rows = rows.withColumn("number", F.explode(F.sequence(F.least(F.col("left"), F.lit(1)), F.col("left"))))
    rows = rows.withColumn("copy", F.col("number") + F.col("block") * NUMBERED)
    fault = (
        F.when(F.col("trimmed") == "", paths.BLANK)
        .when(F.col("later") | (F.col("copy") > 1), paths.DUPLICATE)
        .when(~F.right(F.col("trimmed"), F.lit(1)).isin(*STOPS), paths.TRUNCATED)
        .otherwise(paths.FINE)
    )
    return rows.select("conv_id", "turn", "role", "text", "copy", fault.cast("byte").alias("fault"))


class _Cutter:
    """Slices of the ordered rows of one partition."""

    def __init__(self, part: int):
        self.part, self.seq = part, 0
        self.conv = None
        self.open = self.first = False
        self.out: list[tuple] = []
        self._reset()
        self.pieces = 0

    def _reset(self) -> None:
        self.roles, self.texts, self.turns, self.faults, self.bytes = [], [], [], bytearray(), 0

    def _flush(self, whole: bool) -> None:
        known = [t for t in self.turns if t is not None]
        span = (known[0], known[-1]) if known else (None, None)
        self.out.append((self.conv, self.part, self.seq, whole, *span, len(set(known)), self.roles, self.texts, bytes(self.faults)))
        self.seq += 1
        self.pieces += 1
        self._reset()

    def add(self, conv, turn, role, text, fault) -> None:
        if not self.open or conv != self.conv:
            if self.open:
                # Neither the partition's first nor its last conversation, in one slice: all of it.
                self._flush(self.pieces == 0 and not self.first)
            self.first = not self.open
            self.conv, self.open, self.pieces = conv, True, 0
        elif self.roles and (len(self.roles) >= SLICE or self.bytes + len(text or "") > SLICE_BYTES):
            self._flush(False)
        if role is not None:
            self.roles.append(role)
            self.texts.append(text)
            self.turns.append(turn)
            self.faults.append(fault)
            self.bytes += len(text)

    def close(self) -> None:
        if self.open:
            self._flush(False)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def slices(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, weight_col: str | None, stage: Stage) -> DataFrame:
    """Rows of each conversation in order, in slices numbered by partition and place (part, seq)."""
    counted = stage.keep(_counted(conversations, id_col, turn_col, role_col, text_col, weight_col), "counted")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "copy")]
    ordered = _judged(counted, stage).repartitionByRange(*order).sortWithinPartitions(*order)
    layout = _with_id(counted.schema["conv_id"].dataType, SLICES)
    fields = arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(TaskContext.get().partitionId())
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            for row in zip(*columns, strict=True):
                cutter.add(*row)
            if rows := cutter.taken():
                yield _batch(rows, fields)
        cutter.close()
        if rows := cutter.taken():
            yield _batch(rows, fields)

    return stage.keep(ordered.mapInArrow(run, layout), "slices")


def _initials(roles: list[str]) -> bytes:
    return bytes([paths.INITIALS.get(r[:1], paths.OTHER) for r in roles])


def _slices_of(initials: list[bytes], faults: list[bytes]) -> paths.Slices:
    flat = [np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for x in (initials, faults)]
    return paths.Slices(*flat, np.array([len(x) for x in faults], dtype=np.int64))


def _walked(own: paths.Slices, after: np.ndarray, ends: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least paths of all slices from ``entries`` (slices, k): edits and states they lead to, path after
    path, their lengths, the states they end in and their costs."""
    costs = own.costs(after)
    tails, edits, heads = own.arcs(costs, ends)
    begin = (own.first_node[:, None] * 4 + entries).ravel()
    arc, sizes = paths.least_paths(tails, edits, heads, own.node_count * 4, begin)
    stop = np.cumsum(sizes)
    final = begin.copy()
    final[sizes > 0] = heads[arc[stop[sizes > 0] - 1]]
    flat = costs.ravel()
    return edits[arc], heads[arc] % 4, sizes, final % 4, flat[begin] - flat[final]


def _bounds(cut: DataFrame, stage: Stage) -> DataFrame:
    """For every slice of a conversation that has several: costs behind it, whether it is the last, and
    the state in which the least path enters it."""
    kind = cut.schema["conv_id"].dataType
    initials = F.transform("roles", lambda r: F.left(r, F.lit(1)))
    cut = stage.keep(cut.select("conv_id", "part", "seq", initials.alias("roles"), "faults"), "cut")
    crossing = _with_id(kind, "part int, seq int, costs array<bigint>")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _slices_of([_initials(r) for r in batch.column("roles").to_pylist()], batch.column("faults").to_pylist()).crossing()
                yield pa.record_batch(
                    [*[batch.column(c) for c in ("conv_id", "part", "seq")], pa.array(found.reshape(batch.num_rows, 16).tolist(), pa.list_(pa.int64()))],
                    schema=arrow_schema(crossing),
                )

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "seq"])
        behind, out = paths.END, []
        for costs in rows["costs"].to_numpy()[::-1]:
            out.append(behind.tolist())
            behind = paths.with_inserts(np.minimum((np.reshape(costs, (4, 4)) + behind).min(1), paths.NEVER))
        return pd.DataFrame({"part": rows["part"], "seq": rows["seq"], "after": out[::-1], "ends": [False] * (len(rows) - 1) + [True]})

    after = cut.mapInArrow(cross, crossing).groupBy("conv_id").applyInPandas(chain, "part int, seq int, after array<bigint>, ends boolean")
    after = stage.keep(after, "after")
    known = cut.join(after, ["part", "seq"]).select("conv_id", "part", "seq", "roles", "faults", "after", "ends")
    leading = _with_id(kind, "part int, seq int, exits array<int>")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _slices_of([_initials(r) for r in batch.column("roles").to_pylist()], batch.column("faults").to_pylist())
                behind = np.array(batch.column("after").to_pylist(), dtype=np.int64)
                ends = batch.column("ends").to_numpy(zero_copy_only=False)
                exits = _walked(own, behind, ends, np.tile(np.arange(4), (batch.num_rows, 1)))[3]
                yield pa.record_batch(
                    [*[batch.column(c) for c in ("conv_id", "part", "seq")], pa.array(exits.reshape(-1, 4).tolist(), pa.list_(pa.int32()))],
                    schema=arrow_schema(leading),
                )

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "seq"])
        state, out = paths.START, []
        for exits in rows["exits"]:
            out.append(state)
            state = int(exits[state])
        return pd.DataFrame({"part": rows["part"], "seq": rows["seq"], "entry": out})

    entry = stage.keep(known.mapInArrow(lead, leading).groupBy("conv_id").applyInPandas(enter, "part int, seq int, entry int"), "entry")
    return after.join(entry, ["part", "seq"])


def repaired(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    weight_col: str | None = None,
) -> DataFrame:
    """Repaired conversations in segments, one per slice and in the order (part, seq): their audit, cost,
    counts of faults, repaired roles and texts, and what neighbours need (first and last initial, turns).
    ``weight_col``: how often a row counts, 0 for a row that only names its conversation."""
    stage = Stage(conversations.sparkSession)
    cut = slices(conversations, id_col, turn_col, role_col, text_col, weight_col, stage)
    bounds = stage.keep(_bounds(cut.filter("NOT whole"), stage), "bounds")
    parts = cut.filter("NOT whole").join(bounds, ["part", "seq"])
    end = F.array(*[F.lit(int(x)).cast("long") for x in paths.END])
    alone = cut.filter("whole").withColumns({"after": end, "ends": F.lit(True), "entry": F.lit(paths.START)})
    layout = _with_id(cut.schema["conv_id"].dataType, SEGMENTS)
    fields = arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            roles, texts, faults = (batch.column(c).to_pylist() for c in ("roles", "texts", "faults"))
            initials = [_initials(r) for r in roles]
            after = np.array(batch.column("after").to_pylist(), dtype=np.int64)
            ends = batch.column("ends").to_numpy(zero_copy_only=False)
            edits, states, sizes, _, costs = _walked(_slices_of(initials, faults), after, ends, batch.column("entry").to_numpy()[:, None])
            audit = np.frombuffer(paths.EDITS, np.uint8)[edits].tobytes().decode()
            edits, states = edits.tolist(), states.tolist()
            made, at = [], 0
            for role, text, fault, size in zip(roles, texts, faults, sizes.tolist(), strict=True):
                new_roles, new_texts, row = [], [], 0
                for edit, state in zip(edits[at : at + size], states[at : at + size], strict=True):
                    if edit == paths.INSERT:
                        new_roles.append(paths.ROLES[state])
                        new_texts.append("")
                        continue
                    if edit != paths.DELETE:
                        new_roles.append(role[row] if edit == paths.KEEP else paths.ROLES[state])
                        new_texts.append(text[row])
                    row += 1
                heads = [r[:1] for r in role]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
                counts = [fault.count(f) for f in (paths.BLANK, paths.DUPLICATE, paths.TRUNCATED)]
                made.append((len(role), *counts, illegal, heads[0] if heads else None, heads[-1] if heads else None, audit[at : at + size], new_roles, new_texts))
                at += size
            columns = list(zip(*made, strict=True))
            out = dict(zip(("rows", "blank", "duplicate", "truncated", "illegal", "head", "tail", "audit", "roles", "texts"), columns, strict=True))
            out["cost"] = costs
            same = ("conv_id", "part", "seq", "whole", "turn_min", "turn_max", "turns")
            yield pa.record_batch([batch.column(f.name) if f.name in same else pa.array(out[f.name], f.type) for f in fields], schema=fields)

    columns = ["conv_id", "part", "seq", "whole", "turn_min", "turn_max", "turns", "roles", "texts", "faults", "after", "ends", "entry"]
    solved = [df.select(*columns).mapInArrow(run, layout).withColumn("whole", F.lit(whole)) for df, whole in ((alone, True), (parts, False))]
    return solved[0].unionByName(solved[1])


class _Digest:
    """One conversation's row, from its segments in order."""

    def __init__(self, conv):
        self.conv, self.sha, self.lines, self.audit = conv, hashlib.sha256(), 0, []
        self.counts = [0] * 5
        self.tail = self.low = self.high = None
        self.turns = 0

    def add(self, s: dict) -> None:
        self.counts = [a + s[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
        if s["rows"]:
            if self.tail is not None and self.tail + s["head"] not in ("su", "ua", "au"):
                self.counts[3] += 1
            self.tail = s["tail"]
        if s["turn_min"] is not None:
            self.turns += s["turns"] - (self.high == s["turn_min"])
            self.low = s["turn_min"] if self.low is None else self.low
            self.high = s["turn_max"]
        self.audit.append(s["audit"])
        for role, text in zip(s["roles"], s["texts"], strict=True):
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return (self.conv, gaps, *self.counts, "".join(self.audit), self.sha.hexdigest())


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation: gaps in its turns, faults, illegal pairs of neighbours, cost, audit, and
    the hash of its repaired rows (``role:text``, in lines)."""
    layout = _with_id(segments.schema["conv_id"].dataType, DIGESTS)
    fields = arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                if current is None or current.conv != s["conv_id"]:
                    if current is not None:
                        rows.append(current.row())
                    current = _Digest(s["conv_id"])
                current.add(s)
            if rows:
                yield _batch(rows, fields)
        if current is not None:
            yield _batch([current.row()], fields)

    several = segments.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return segments.filter("whole").mapInArrow(run, layout).unionByName(several.mapInArrow(run, layout))
