"""Ordered statistics without single-task groups.

Row numbers and running totals need an order over a group that may hold most of the rows.
Here a group is spread over range partitions of its order, each part is totalled, and the
running totals of the (few) parts are added to the running totals inside each part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlens.operators.scratch import scratch_table

#: Groups whose figures may be sent to all rows.
FEW_GROUPS = 10_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches null keys; with no keys the right side must be one row."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def few_or_written(figures: DataFrame, name: str = "figures") -> tuple[DataFrame, bool]:
    """Figures computed once: up to FEW_GROUPS rows are held by the driver and may be sent to all tasks, more are a written table."""
    rows = figures.limit(FEW_GROUPS + 1).collect()
    if len(rows) <= FEW_GROUPS:
        return figures.sparkSession.createDataFrame(rows, figures.schema), True
    return scratch_table(figures, name), False


def beside(df: DataFrame, figures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the figures of their group; rows of groups without figures are dropped.

    Up to FEW_GROUPS rows of figures are sent to the rows, so a few large groups need no
    shuffle of the rows. More groups are joined on the keys, where adaptive execution
    splits the large ones.
    """
    figures, few = few_or_written(figures)
    return join_keys(df, F.broadcast(figures) if few else figures, keys)


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "ordered") -> DataFrame:
    """Rows range-partitioned by (keys, order) with the part number ``_part``, written once."""
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    return scratch_table(ranged, name)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: Column, name: str
) -> DataFrame:
    """Adds ``name``: the running total of ``weight`` in every group, in the given order.

    The order must be unique within a group for a repeatable result.
    """
    parts = spread(df.withColumn("_weight", weight), keys, order)
    by_part = parts.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn(name, F.sum("_weight").over(inside))
    rows = join_keys(rows, offsets, [*keys, "_part"])
    return rows.withColumn(name, F.col(name) + F.col("_offset")).drop("_weight", "_offset", "_part")


def numbered(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Row numbers 1..n over the whole table, or within the keys."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name)


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))


def mode(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Most frequent value, the smallest of ties; null where no value repeats."""
    counts = value_counts(df, column, keys)
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(column)).alias("neg"))).alias("_best"))
    return best.select(*keys, F.when(F.col("_best.n") > 1, -F.col("_best.neg")).alias(name))


def percent_rank_of(df: DataFrame, column: str, probe: float, keys: Sequence[str] = (), digits: int = 3, name: str = "percent_rank") -> DataFrame:
    """Percent rank of one probe value, interpolated between its neighbours; null outside the values.

    One pass of counts and neighbours; nothing is sorted.
    """
    x = F.col(column)
    rows = df.groupBy(*keys).agg(
        F.max(F.when(x <= probe, x)).alias("_low"), F.min(F.when(x >= probe, x)).alias("_high"), F.count_if(x < probe).alias("_below"), F.count(x).alias("_total"),
    )
    low, high = F.col("_low"), F.col("_high")
    gap = F.try_divide(F.lit(probe) - low, high - low)
    place = F.when(low == probe, F.col("_below").cast("double")).otherwise(F.col("_below") - 1 + gap)
    return rows.select(*keys, F.when(low.isNotNull() & high.isNotNull(), F.round(F.try_divide(place, F.col("_total") - 1), digits)).alias(name))


def standardized(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "z") -> DataFrame:
    """(x - mean) / sample deviation of the group."""
    figures = F.struct(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    if not keys:
        s = df.agg(figures).scalar()
        return df.withColumn(name, F.try_divide(F.col(column) - s["mean"], s["sd"]))
    s = df.groupBy(*keys).agg(figures.alias("_s"))
    return beside(df, s, keys).withColumn(name, F.try_divide(F.col(column) - F.col("_s.mean"), F.col("_s.sd"))).drop("_s")


def mean_deviation(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Mean of |x - mean|."""
    if not keys:
        mean = df.agg(F.avg(column)).scalar()
        return df.select(F.abs(F.col(column) - mean).alias("_d")).agg(F.avg("_d").alias(name))
    means = df.groupBy(*keys).agg(F.avg(column).alias("_mean"))
    rows = beside(df.select(*keys, column), means, keys)
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col(column) - F.col("_mean"))).alias(name))
