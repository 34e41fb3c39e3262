"""Connected components of link tables that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlens.operators.scratch import scratch_table


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """``id, label`` for every id of the links; the label is the smallest id that links reach.

    Large and small stars in turn: every id's larger neighbours are hung below its
    smallest neighbour, then its smaller ones. The number of rounds grows with the
    logarithm of the longest chain. Every round is written to scratch. A star's centre
    may have any number of links: the smallest neighbour is an aggregate that is
    combined before the shuffle, and the join back is one that adaptive execution splits.
    """
    links = scratch_table(_pairs(edges.select(F.col(first).alias("u"), F.col(second).alias("v"))), "links")
    mark = _mark(links)
    while True:
        links = scratch_table(_star(links, large=True), "links")
        links = scratch_table(_star(links, large=False), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")).union(roots.join(links.select(F.col("u").alias("id")), "id", "left_anti"))


def _pairs(links: DataFrame) -> DataFrame:
    """Every link once, the larger id first."""
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(links: DataFrame):
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = sides.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return _pairs(moved)
