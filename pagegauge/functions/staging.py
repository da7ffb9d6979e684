"""Working a column out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns as a one-row generator.

    The optimizer copies a projected expression into every filter and projection above it; a
    chain of geometry columns grows exponentially that way. It does not look into a generator,
    so these are evaluated once per row and later columns read the results.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
