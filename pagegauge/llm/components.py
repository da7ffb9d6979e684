"""Connected components of a table of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.base import Stage


def _done(edges: DataFrame) -> bool:
    """Are the links stars: every node links to one node, and that one to none?"""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    nodes = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, label) of every node that has a link; the label is the smallest node it can reach.

    ``links`` has columns a and b. In turn every node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows; the links are few columns and each round is a written table.
    Stars have one row per node in the end.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = both.join(least, "a")
        if large:
            moved = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        # Every link goes from its larger node to its smaller one.
        return moved.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = stage.keep(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    turn = 0
    while not _done(edges):
        turn += 1
        edges = stage.keep(star(star(edges, True), False), f"{name}-{turn}")
        stage.drop(f"{name}-{turn - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label"))
    ).distinct()
