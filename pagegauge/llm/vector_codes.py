"""Vector codes: Lloyd rounds over the parts of integer vectors, comparing only what moved.

A vector is scaled to whole numbers and cut into equal parts; every part position has a codebook.
Each row keeps, for each part, the entry it is assigned to and the exact squared distance to it.
In the next round a part whose entry did not move still has that distance, and no entry at rest can
have become nearer: it is compared with the moved entries only. A part whose entry moved is compared
with all. Equal distances go to the lower index in both ways, so the answer is that of a full scan.

A round is one pass in Arrow batches: it writes the rows with their new entries, and beside them one
row of sums for every entry that the task met; Spark adds those up, and the new codebooks (parts x
entries x width numbers, never more) are made on the driver and sent out with the next pass. Each
pass is written to the shared folder and the one before it is removed, so a lost executor costs a read.
No row ever meets another row: a vector that a third of all rows share is only counted.

Arithmetic is exact. ``floor(scale * x)`` is held within +-``limit(width)``, so that one vector's error
fits a long (131,072 times 1,024 at 64 components; only components beyond that are affected). Small
distances are taken as matrix products in doubles that hold them exactly, larger ones in 64-bit integers.

Defined cases: a row goes when its vector is null or holds a null or non-finite component, or has not
the table's width (the most frequent number of components, above 0, that the parts divide; the larger
among equals). A null identifier is kept and comes after all others; rows with the same identifier
are separate rows, in the order of their vectors. With fewer rows than entries the codebooks are
smaller. Null labels are one label. No rows give no rows, and empty codebooks. ``label_error`` is null
where the sum does not fit a long. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegauge.llm.base import Stage, arrow_schema

#: Sums of products below this are exact in doubles.
EXACT = 1 << 52
#: Rows compared with a codebook at once.
BLOCK = 2048


def limit(width: int) -> int:
    """Largest scaled component: the squared distance of two such vectors fits a long."""
    return int((2**62 / max(width, 1)) ** 0.5) // 2


@dataclass
class Codes:
    """``rows``: id, label, codes (one entry number per part), errors (one squared distance per part);
    ``codebooks``: one array (entries, width of a part) per part."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        numbers = (str(x) for book in self.codebooks for x in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vectors are whole, and these vectors as whole numbers."""
    places, out = [], []
    offsets = column.offsets.to_numpy()
    values = column.values
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    present = column.is_valid().to_numpy(zero_copy_only=False)
    fine = np.isfinite(numbers)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    for i in np.flatnonzero(present).tolist():
        a, b = offsets[i], offsets[i + 1]
        if bad[b] == bad[a] and b > a:
            bound = float(limit(b - a))
            places.append(i)
            out.append(np.floor(scale * numbers[a:b]).clip(-bound, bound).astype(np.int64))
    return np.array(places, dtype=np.int64), out


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of whole-number vectors."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * 4 * top * top < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        found = (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]
        return found.astype(np.int64)
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    for c in range(x.shape[1]):
        out += (x[:, c, None] - entries[None, :, c]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest-numbered nearest entry of every row, and its squared distance."""
    who, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in range(0, len(x), BLOCK):
        d = distances(x[a : a + BLOCK], entries)
        who[a : a + BLOCK] = d.argmin(1)
        far[a : a + BLOCK] = d.min(1)
    return who, far


def reassigned(x: np.ndarray, who: np.ndarray, far: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances after a round. ``who``, ``far``: those before it; ``moved``: numbers of the
    entries that changed."""
    who, far = who.copy(), far.copy()
    changed = np.zeros(len(entries), dtype=bool)
    changed[moved] = True
    again = changed[who]
    if again.any():
        who[again], far[again] = nearest(x[again], entries)
    rest = np.flatnonzero(~again)
    if len(moved) and len(rest):
        new, distance = nearest(x[rest], entries[moved])
        new = moved[new]
        better = (distance < far[rest]) | (distance == far[rest]) & (new < who[rest])
        at = rest[better]
        who[at], far[at] = new[better], distance[better]
    return who, far


def _wide(flat: pa.Array, rows: int) -> np.ndarray:
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per row of a matrix."""
    ends = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def compressed(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> Codes:
    """Codebooks after ``rounds`` rounds, and every kept row under them. The codebooks start as the
    parts of the ``entries`` rows with the smallest identifiers."""
    stage = Stage(vectors.sparkSession)
    own = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("v"))
    head = [T.StructField("id", own.schema["id"].dataType), T.StructField("label", own.schema["label"].dataType)]
    whole = T.StructType([*head, T.StructField("x", T.ArrayType(T.LongType()))])
    fields = arrow_schema(whole)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = scaled(batch.column("v"), scale)
            x = pa.array(found, pa.list_(pa.int64()))
            take = pa.array(places)
            yield pa.record_batch([batch.column("id").take(take), batch.column("label").take(take), x.cast(fields.field("x").type)], schema=fields)

    base = stage.keep(own.mapInArrow(convert, whole), "whole")
    widths = base.groupBy(F.size("x").alias("width")).count().filter(F.col("width") % parts == 0)
    # One row: the table's width.
    width = [r["width"] for r in widths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()]
    width = width[0] if width else 0
    base = base.filter(F.size("x") == width)
    # ``entries`` rows, whatever the table's size.
    first = base.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect() if width else []
    cut = width // parts
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), width)
    books = [start[:, p * cut : (p + 1) * cut].copy() for p in range(parts)]

    rows = T.StructType(
        [
            *head,
            T.StructField("x", T.ArrayType(T.LongType())),
            T.StructField("codes", T.ArrayType(T.IntegerType())),
            T.StructField("errors", T.ArrayType(T.LongType())),
            T.StructField("part", T.IntegerType()),
            T.StructField("entry", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("sums", T.ArrayType(T.LongType())),
        ]
    )
    if not len(first):
        return Codes(stage.spark.createDataFrame([], rows).select("id", "label", "codes", "errors"), books)
    layout = arrow_schema(rows)

    def assigned(table: DataFrame, books: list[np.ndarray], moved: list[np.ndarray] | None) -> DataFrame:
        """``table`` under new codebooks, then the sums of every entry met."""
        shared = stage.spark.sparkContext.broadcast((books, moved))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, moved = shared.value
            sums = [np.zeros_like(b) for b in books]
            counts = [np.zeros(len(b), dtype=np.int64) for b in books]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _wide(batch.column("x"), batch.num_rows)
                old = None if moved is None else (_wide(batch.column("codes"), batch.num_rows), _wide(batch.column("errors"), batch.num_rows))
                codes, errors = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
                for p in range(parts):
                    own = x[:, p * cut : (p + 1) * cut]
                    if old is None:
                        codes[:, p], errors[:, p] = nearest(own, books[p])
                    else:
                        codes[:, p], errors[:, p] = reassigned(own, old[0][:, p], old[1][:, p], books[p], moved[p])
                    counts[p] += np.bincount(codes[:, p], minlength=len(books[p]))
                    np.add.at(sums[p], codes[:, p], own)
                made = [batch.column("id"), batch.column("label"), batch.column("x"), _lists(codes, pa.int32()), _lists(errors, pa.int64())]
                yield pa.record_batch([*[m.cast(f.type) for m, f in zip(made, layout)], *[pa.nulls(len(x), f.type) for f in list(layout)[5:]]], schema=layout)
            met = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
            if met:
                tail = [pa.array(c, f.type) for c, f in zip(zip(*met, strict=True), list(layout)[5:], strict=True)]
                yield pa.record_batch([*[pa.nulls(len(met), f.type) for f in list(layout)[:5]], *tail], schema=layout)

        return table.mapInArrow(run, rows)

    def moved_on(table: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codebooks of floored means, and the numbers of the entries that changed."""
        met = table.filter("part IS NOT NULL")
        total = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[c]) for c in range(cut)]).alias("sums"))
        new = [b.copy() for b in books]
        # At most parts x entries rows.
        for r in total.collect():
            new[r["part"]][r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
        return new, [np.flatnonzero((a != b).any(1)) for a, b in zip(new, books, strict=True)]

    table, name, moved = base, "whole", None
    for i in range(rounds + 1):
        made = stage.keep(assigned(table, books, moved), f"round{i}")
        stage.drop(name)
        table, name = made.filter("part IS NULL"), f"round{i}"
        if i < rounds:
            books, moved = moved_on(made, books)
    return Codes(table.select("id", "label", "codes", "errors"), books)


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, error) with ``label_error``, the error summed over their label."""
    total = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    total = total.select(F.col("label").alias("of_label"), F.expr("try_cast(total AS bigint)").alias("label_error"))
    # Written, so that its size is known when it meets the rows and a frequent label's rows can be split.
    total = Stage(rows.sparkSession).keep(total, "label_errors")
    return rows.join(total, rows["label"].eqNullSafe(total["of_label"]), "left").drop("of_label")
