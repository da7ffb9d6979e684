"""Pages and documents: event folds, size ladder, outcomes, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.operators.detection import rate
from pagegauge.operators.ordered import ordered
from pagegauge.session import cut

# Document rules.
UNDO_MS = 5000
PDF_OVERHEAD = 1.02
MAX_PAGES = 20  # that a document is meant to hold
SAME_CORNER = 1e-6  # two answers are one where every coordinate differs by less

#: Side of the cells in which answers meet, in the distance that makes them the same.
CELL = 16
#: Share of a side by which cells are moved, so that no multiple of 1e-4 (frame borders, round shares) lies near a border.
OFF = 0.125


def commit_removals(events: DataFrame, keys: list[str], width: int) -> DataFrame:
    """When each removal took effect: after five seconds, or as soon as another removal came; null when undone."""
    rows = ordered(events, keys, ["t", "event_id"], width).step(lead={"next_action": F.col("action"), "next_t": F.col("t")})
    removal = rows.result().where(F.col("action") == "remove")
    due = F.col("t") + UNDO_MS
    soon = F.col("next_t").isNotNull() & (F.col("next_t") < due)
    at = F.when(soon & (F.col("next_action") == "undo"), None).otherwise(F.when(soon, F.col("next_t")).otherwise(due))
    return removal.select(*keys, "event_id", "t", at.cast("bigint").alias("committed_t"))


def first_fit(measured: DataFrame, by: list[str], budget: float) -> DataFrame:
    """First rung of a document that fits; else the last one and how many pages would have to go.

    ``measured`` is ``…by, rung, bytes, page_count``.
    """
    c = F.col
    table = measured.groupBy(*by).agg(
        F.min(F.when(c("bytes") <= budget, c("rung"))).alias("fit"),
        F.max("rung").alias("last"),
        F.max_by("bytes", "rung").alias("floor_bytes"),
        F.max("page_count").alias("page_count"),
    )
    per_page = c("floor_bytes") / c("page_count")
    needed = F.ceil((c("floor_bytes") - budget) / per_page)
    remove = F.when(c("page_count") <= 1, F.lit(1)).otherwise(
        F.least(F.greatest(F.lit(1), needed), c("page_count") - 1)
    )
    return table.select(
        *by,
        F.coalesce("fit", "last").alias("rung"),
        c("fit").isNotNull().alias("fits"),
        F.when(c("fit").isNull(), remove).cast("bigint").alias("remove_pages"),
    )


def document_bytes(pages: DataFrame, by: list[str], status: Column, size: Column) -> DataFrame:
    total = F.coalesce(F.sum(F.when(status == "ready", size)), F.lit(0))
    return pages.groupBy(*by).agg(F.floor(total * PDF_OVERHEAD + 0.5).cast("bigint").alias("pdf_bytes"))


def numbered_pages(pages: DataFrame, by: list[str], order: str, width: int, limit: int = MAX_PAGES) -> DataFrame:
    """Every page of a document with its place, counted without gaps; ``over_limit`` marks those beyond the limit."""
    counted = ordered(pages, by, [order], width).step(running={"place": F.lit(1).cast("bigint")}).result()
    return counted.withColumn("over_limit", F.col("place") > limit)


def latest(rows: DataFrame, by: list[str], at: list[str], columns: list[str]) -> DataFrame:
    """Newest row of each key; the greatest ``at`` wins, and partial winners are kept before the shuffle."""
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*at)).alias("n"))
    return newest.select(*by, "n.*")


def upsert_labels(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Per image the newer label, the incoming one on ties; nothing is removed.

    ``kept_newer`` marks images whose stored label was newer than a different incoming one.
    """
    c = current.select(key, F.struct(*[n for n in current.columns if n != key]).alias("old"))
    i = incoming.select(key, F.struct(*[n for n in incoming.columns if n != key]).alias("new"))
    both = c.join(i, key, "full")
    newer = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old.t") > F.col("new.t"))
    kept = newer & ~F.col("old").eqNullSafe(F.col("new"))
    merged = F.when(F.col("new").isNull() | newer, F.col("old")).otherwise(F.col("new"))
    return both.select(key, merged.alias("m"), kept.alias("kept_newer")).select(key, "m.*", "kept_newer")


def funnel(events: DataFrame, by: str, at: str, steps: dict[str, Column], width: int) -> DataFrame:
    """How many sessions reached each step, none counted before the step it follows.

    A step is reached by its first event at or after the moment the step before it was reached.
    """
    names = list(steps)
    # A row per event and step it could be; at one moment a step comes before the one that follows it.
    could = F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(steps.values())])
    marks = events.select(by, at, F.explode(F.filter(could, lambda i: i.isNotNull())).alias("__nth"))
    rows = ordered(marks, [by], [at, "__nth"], width)
    for i, name in enumerate(names):
        on = F.col("__nth") == i
        if i:
            on = on & F.col(names[i - 1]).isNotNull()
        # The greatest of the negatives so far is the first moment.
        rows = rows.step(peak={name: F.when(on, -F.col(at))})
    reached = events.groupBy(by).agg(F.lit(1).alias("__one")).join(
        rows.result().groupBy(by).agg(*[F.max(n).alias(n) for n in names]), by, "left"
    )
    table = reached.agg(F.count("*").alias("sessions"), *[F.count(n).alias(n) for n in names])
    rates = [rate(F.col(n), F.col("sessions")).alias(f"{n}_rate") for n in names]
    return table.select("sessions", *names, *rates)


def first_answers(rows: DataFrame, by: list[str], at: list[str], quad: str = "quad") -> DataFrame:
    """Answers that no earlier one of their key was the same as: ``…by``, ``…at`` and ``corners``.

    The same is within ``SAME_CORNER`` in all eight coordinates, so no rounding edge parts two answers. Equal answers
    are one from the start. Of those in a box half that wide only the first can be new; it meets the
    earlier ones in cells ``CELL`` times as wide, to which an answer near a border is copied on both
    sides. So a key with many repeated answers compares each of them with a few boxes, not with one another.

    A quad that is null or holds a null or non-finite coordinate is one answer for each key, the first of them.
    Coordinates are shares of the frame. Of answers at one moment the smaller corners count as earlier.
    """
    flat = F.flatten(F.transform(quad, lambda p: F.array(p["x"], p["y"])))
    measured = F.forall(flat, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    keyed = rows.select(*by, F.struct(*at).alias("at"), F.when(measured, flat).alias("corners"))
    own = cut(keyed.groupBy(*by, "corners").agg(F.min("at").alias("at")))
    box = F.transform("corners", lambda v: F.floor(v / (SAME_CORNER / 2)))
    new = own.groupBy(*by, box.alias("box")).agg(F.min(F.struct("at", "corners")).alias("a")).select(*by, "a.*")
    names = [f"__c{i}" for i in range(8)]
    n = new.select("*", *[_cell(i, 0.0).alias(name) for i, name in enumerate(names)]).alias("n")
    o = in_cells(own.where(F.col("corners").isNotNull()), names).alias("o")
    same = F.forall(F.zip_with("n.corners", "o.corners", lambda a, b: F.abs(a - b) < SAME_CORNER), lambda near: near)
    earlier = F.struct("o.at", "o.corners") < F.struct("n.at", "n.corners")
    on = same & earlier
    for c in [*by, *names]:
        on &= F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    # An inner join, of which Spark can split a hot cell on either side; the repeats are then taken out. Both sides
    # hold every answer, whatever their estimate from the packed input says: they are sorted, not broadcast.
    repeats = n.join(o.hint("merge"), on).select(*[F.col(f"n.{c}").alias(c) for c in [*by, "at", "corners"]]).distinct().alias("r")
    gone = F.lit(True)
    for c in [*by, "at", "corners"]:
        gone &= F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}"))
    return new.alias("f").join(repeats.hint("merge"), gone, "left_anti").select(*by, "at.*", "corners")


def _cell(i: int, slack: float) -> Column:
    return F.floor((F.get("corners", F.lit(i)) + slack) / (CELL * SAME_CORNER) + OFF)


def in_cells(answers: DataFrame, names: list[str]) -> DataFrame:
    """Answers with the cells they may be met in, once for each: their own, and those beyond a border within reach."""
    for i, name in enumerate(names):
        around = F.sequence(_cell(i, -1.001 * SAME_CORNER), _cell(i, 1.001 * SAME_CORNER))
        answers = answers.select("*", F.explode(around).alias(name))
    return answers
