"""Ranks, neighbours and nearest keys, carried by the rows themselves.

The rows go through the ranges of their order once, as whole rows; equal values may be cut
by a range's end. Each range then finds what it can by itself, and what it lacks - the rows
before it, the last key seen, the values beyond its ends - is a table of a few rows for
each end of a range, sent to all tasks. Nothing is joined back on a value, so neither a
frequent value, nor null, nor a large group meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlens.operators.ordered import beside, few_or_written, join_keys
from marketlens.operators.scratch import scratch_table


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Rows dealt by ranges of keys and order, with ``_part``, the number of the range; written once."""
    dealt = df.repartitionByRange(*keys, *order, F.monotonically_increasing_id())  # equal rows may be cut as well
    return scratch_table(dealt.withColumn("_part", F.spark_partition_id()), name)


def _before(parts: DataFrame, keys: Sequence[str], **figures: Column) -> DataFrame:
    """Figures of the earlier ranges of a group, for every range but its first one.

    Every end of a range cuts one group at most, so there are fewer rows than ranges.
    """
    earlier = Window.partitionBy(*keys).orderBy("_part")
    rows = parts.withColumn("_nth", F.row_number().over(earlier))
    upto = earlier.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*keys, "_part", "_nth", *[c.over(upto).alias(n) for n, c in figures.items()]).filter("_nth > 1").drop("_nth")


def _smaller(df: DataFrame, column: str, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """``_smaller``: the rows of the group that come before all rows of this value; null without a value."""
    x, on = F.col(column), [*keys, "_part"]
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    dealt = df.repartitionByRange(*keys, order, F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    inside = F.rank().over(Window.partitionBy(*on).orderBy(order)) - 1
    parts = scratch_table(dealt.withColumn("_inside", inside), "ranges")

    first, last = (F.max, F.min) if descending else (F.min, F.max)
    ends = parts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), first(column).alias("_first"), last(column).alias("_last"), F.max(F.when(x.isNotNull(), F.col("_inside"))).alias("_of_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part")
    offset = F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("_offset", offset)
    # a value that the end of a range cuts: what comes before the first of its rows
    ends = ends.withColumn("_start", F.min(F.col("_offset") + F.col("_of_last")).over(Window.partitionBy(*keys, "_last")))
    cut = F.when(F.col("_first") == F.lag("_last").over(earlier), F.struct(F.col("_first").alias("value"), F.lag("_start").over(earlier).alias("before")))
    # every end of a range cuts one group at most, so there are fewer rows than ranges
    later = ends.select(*on, "_offset", cut.alias("_cut"), F.row_number().over(earlier).alias("_nth")).filter("_nth > 1").drop("_nth")
    rows = join_keys(parts, F.broadcast(later), on, "left")
    before = F.when(x == F.col("_cut.value"), F.col("_cut.before")).otherwise(F.col("_inside") + F.coalesce("_offset", F.lit(0)))
    return rows.withColumn("_smaller", F.when(x.isNotNull(), before).cast("bigint")).drop("_part", "_inside", "_offset", "_cut")


def ranked(df: DataFrame, column: str, keys: Sequence[str] = (), descending: bool = True, name: str = "rank") -> DataFrame:
    """Rank of every row; ties share the first place, rows without a value have none."""
    return _smaller(df, column, keys, descending).withColumn(name, (F.col("_smaller") + 1).cast("bigint")).drop("_smaller")


def percent_ranked(df: DataFrame, column: str, keys: Sequence[str] = (), digits: int = 3, name: str = "percent_rank") -> DataFrame:
    """First place / (n - 1) of every row, rounded; null without a value or where it is the only one."""
    rows = _smaller(df, column, keys)
    if keys:
        rows = beside(rows, df.groupBy(*keys).agg(F.count(column).alias("_total")), keys)
    else:
        rows = rows.withColumn("_total", df.agg(F.count(column)).scalar())
    share = F.round(F.try_divide(F.col("_smaller").cast("double"), F.col("_total") - 1), digits)
    return rows.withColumn(name, share).drop("_smaller", "_total")


def shifted(df: DataFrame, column: str, rows: int, order: Sequence[str], keys: Sequence[str] = (), name: str = "shifted") -> DataFrame:
    """Value ``rows`` places further (negative: earlier) in the order; null beyond the ends.

    Only values within that distance of the end of a range can be wanted by another range.
    """
    on, by = [*keys, "_part"], [F.col(c) for c in order]
    parts = in_ranges(df, keys, by, "ranges")
    inside = Window.partitionBy(*on).orderBy(*by)
    sizes = parts.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    offsets = _before(sizes, keys, _offset=F.sum("_size"))
    placed = join_keys(parts.withColumn("_row", F.row_number().over(inside)), F.broadcast(offsets), on, "left")
    placed = placed.withColumns({
        "_place": F.col("_row") + F.coalesce("_offset", F.lit(0)),
        "_near": F.lead(F.col(column), rows).over(inside) if rows >= 0 else F.lag(F.col(column), -rows).over(inside),
        "_after": F.count(F.lit(1)).over(Window.partitionBy(*on)) - F.col("_row"),
    })
    # rows near an end, of groups that go on in another range
    several = join_keys(placed, F.broadcast(offsets.select(*keys).distinct()), keys, "left_semi") if keys else placed
    distance = abs(rows)
    edges = several.filter((F.col("_row") <= distance) | (F.col("_after") < distance)).select(*keys, (F.col("_place") - rows).alias("_place"), F.col(column).alias("_far"))
    edges, few = few_or_written(edges, "range-edges")
    found = join_keys(placed, F.broadcast(edges) if few else edges, [*keys, "_place"], "left")
    beyond = F.col("_after") < rows if rows >= 0 else F.col("_row") <= -rows
    return found.withColumn(name, F.when(beyond, F.col("_far")).otherwise(F.col("_near"))).drop("_part", "_row", "_offset", "_place", "_near", "_after", "_far")


def asof(
    probes: DataFrame, probe: str, table: DataFrame, key: str, value: str, keys: Sequence[str] = (),
    name: str = "found", forward: bool = False,
) -> DataFrame:
    """Adds the value of the largest key <= probe (``forward``: smallest key >= probe).

    Whole probe rows and distinct keys are dealt by ranges together; inside a range the
    last key seen is carried on, and each range starts with the last key of the ranges
    before it. Equal table keys keep the smallest value; null probes find nothing.
    """
    at = (lambda c: F.negative(F.col(c))) if forward else F.col
    on = [*keys, "_part"]
    entries = table.filter(F.col(key).isNotNull()).groupBy(*keys, at(key).alias("_at")).agg(F.min(value).alias("_value"))
    entries = entries.select(*keys, "_at", F.struct("_at", "_value").alias("_entry"), F.lit(0).alias("_side"))
    wanted = probes.filter(F.col(probe).isNotNull()).select(*keys, at(probe).alias("_at"), F.lit(1).alias("_side"), F.struct(*[c for c in probes.columns if c not in keys]).alias("_rest"))
    parts = in_ranges(entries.unionByName(wanted, allowMissingColumns=True), keys, [F.col("_at"), F.col("_side")], "nearest")
    ends = parts.groupBy(*on).agg(F.max("_entry").alias("_end"))
    starts = _before(ends, keys, _start=F.max("_end"))
    inside = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = parts.withColumn("_seen", F.last("_entry", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    found = join_keys(seen, F.broadcast(starts), on, "left")
    rows = found.select(*[F.col(k) if k in keys else F.col(f"_rest.{k}").alias(k) for k in probes.columns], F.coalesce("_seen", "_start")["_value"].alias(name))
    return rows.unionByName(probes.filter(F.col(probe).isNull()), allowMissingColumns=True)
