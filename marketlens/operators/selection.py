"""Exact values at places of a sorted column, without sorting it.

The range of the column is cut into bins and the rows of every bin are counted; the bin
that holds the wanted place is the next range. A pass over the rows shuffles no more than
counts, and a frequent value or a large group is one count per task. A few passes leave so
few rows around each place that their distinct values are counted and the place is read
off.

Bins are of equal width at first. Later ones follow a scale that is linear between powers
of two, so values of very different sizes come apart as well: one such pass reaches a power
of two, and every further one takes twelve bits of the rest.

Defined results: null values have no place; NaN stands behind all numbers; places outside
0..n-1 have no value; a group without values has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

from marketlens.operators.ordered import FEW_GROUPS, beside, join_keys
from marketlens.operators.scratch import scratch_table

BINS = 4096
#: Rows around a place whose distinct values are counted at once.
LAST_ROWS = 20_000
#: Above every exponent of a double, so that the scale of a positive number is positive.
_ABOVE = 1100


def _number(c: str, kind: DataType) -> str:
    """SQL of a double that never falls where the column rises."""
    if isinstance(kind, NumericType):
        return f"cast({c} as double)"
    if isinstance(kind, DateType):
        return f"cast(unix_date({c}) as double)"
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return f"cast(unix_micros(cast({c} as timestamp)) as double)"
    raise TypeError(f"places need numbers, dates or times, not {kind.simpleString()}")


def _scale(v: str) -> str:
    """SQL of the exponent and the share of the way to the next power of two, with the sign."""
    exponent = f"floor(log2(abs({v})))"
    return f"""case when isnan({v}) then {2 * _ABOVE + 1}D when {v} = 0 then 0D when abs({v}) = double('infinity') then signum({v}) * {2 * _ABOVE}
        else signum({v}) * ({exponent} + {_ABOVE - 1} + abs({v}) / pow(2D, {exponent})) end"""


def _bin(v: str, low: str, high: str, even: bool) -> str:
    share = f"try_divide({_scale(v)} - {_scale(low)}, {_scale(high)} - {_scale(low)})"
    if even:
        share = f"case when isnan({high} - {low}) or {high} - {low} = double('infinity') then {share} else try_divide({v} - {low}, {high} - {low}) end"
    return f"cast(least(floor(coalesce({share}, 0D) * {BINS}), {BINS - 1}) as int)"


class _State:
    """Range, rows before it and rows in it for every wanted place of every group."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], wanted: int, column: str):
        self.keys, self.wanted, self.column = list(keys), wanted, column
        kept = rows.limit(FEW_GROUPS + 1).collect()
        #: Few groups are held here and sent to the rows, more are a written table.
        self.held = kept if len(kept) <= FEW_GROUPS else None
        self.frame = rows.sparkSession.createDataFrame(kept, rows.schema) if self.held is not None else scratch_table(rows, "places")

    def beside(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        if not self.keys:
            schema: StructType = self.frame.schema
            return rows.withColumns({c: F.lit(self.held[0][c]).cast(schema[c].dataType) for c in columns}) if self.held else rows.limit(0).withColumns({c: F.lit(None).cast(schema[c].dataType) for c in columns})
        few = self.frame.select(*self.keys, *columns)
        return join_keys(rows, F.broadcast(few) if self.held is not None else few, self.keys)

    def most(self) -> int:
        """Rows of the largest range that holds more than one value."""
        if self.held is not None:
            return max((r[f"inside{i}"] for r in self.held for i in range(self.wanted) if r[f"place{i}"] is not None and r[f"low{i}"] != r[f"high{i}"]), default=0)
        sizes = [F.max(F.when(F.col(f"low{i}") != F.col(f"high{i}"), F.col(f"inside{i}"))) for i in range(self.wanted)]
        return max((x for x in self.frame.agg(*sizes).first() if x is not None), default=0)

    def within(self, i: int) -> str:
        return f"(place{i} is not null and low{i} != high{i} and {self.column} >= low{i} and {self.column} <= high{i})"

    def inside(self, rows: DataFrame, columns: Sequence[str], entry: Callable[[int], str]) -> DataFrame:
        """Rows within the range of any place, with the columns and ``entry(i)`` as fields for every such place i."""
        anywhere = " or ".join(self.within(i) for i in range(self.wanted))
        each = ", ".join(f"if({self.within(i)}, named_struct({entry(i)}), null)" for i in range(self.wanted))
        return rows.filter(anywhere).select(*columns, F.expr(f"inline(array_compact(array({each})))"))

    def _range_of(self, i: int, kind: str, shared: bool) -> str:
        """SQL of the last range that starts at or before place i, of the list in ``_ranges``."""
        mine = "_ranges" if shared else f"filter(_ranges, r -> r.i = {i})"
        nothing = f"named_struct('low', cast(null as {kind}), 'high', cast(null as {kind}), 'before', before{i}, 'inside', 0L)"
        further = f"if(now.before + now.inside > place{i}, now, named_struct('low', r.low, 'high', r.high, 'before', now.before + now.inside, 'inside', r.n))"
        return f"if(place{i} is not null and size({mine}) > 0, aggregate({mine}, {nothing}, (now, r) -> {further}), null) as _r{i}"

    def picked(self, counted: DataFrame, low: str, high: str, shared: bool = False) -> DataFrame:
        """The range of every place among the counted ones, in their order.

        A group's counted ranges are few (bins, or values of the last rows), so they are one list.
        ``shared`` ranges serve all places, others have the number of their place in ``_i``.
        """
        entry = f"'low', {low}, 'high', {high}, 'n', _n" + ("" if shared else ", 'i', _i")
        lists = counted.groupBy(*self.keys).agg(F.expr(f"sort_array(collect_list(named_struct({entry}))) as _ranges"))
        if not self.keys:
            whole = self.beside(lists, self.frame.columns)
        else:
            whole = join_keys(self.frame, F.broadcast(lists) if self.held is not None else lists, self.keys, "left")
        kind = self.frame.schema["low0"].dataType.simpleString()
        whole = whole.selectExpr("*", *[self._range_of(i, kind, shared) for i in range(self.wanted)])
        found = [f"if(_r{i} is not null, _r{i}.{c}, {c}{i}) as {c}{i}" for i in range(self.wanted) for c in ("low", "high", "before", "inside")]
        return whole.selectExpr(*[f"`{k}`" for k in self.keys], "total", *[f"place{i}" for i in range(self.wanted)], *found)


def at_places(df: DataFrame, column: str, places: Callable[[Column], Sequence[Column]], keys: Sequence[str] = ()) -> DataFrame:
    """Values at 0-based places of every sorted group.

    ``places`` gives the places from the number of values. Returns the keys, ``total``, and
    for every place i ``value{i}``, ``before{i}`` (smaller values) and ``equal{i}``.
    """
    kind, keys = df.schema[column].dataType, list(keys)
    rows = df.select(*keys, F.col(column).alias("_x")).filter("_x is not null").withColumn("_v", F.expr(_number("_x", kind)))
    wanted = len(places(F.lit(1)))
    whole = rows.groupBy(*keys).agg(F.expr("count(1) as total"), F.expr("min(_x) as _low"), F.expr("max(_x) as _high")).filter("total > 0")
    whole = whole.select("*", *[place.cast("bigint").alias(f"_place{i}") for i, place in enumerate(places(F.col("total")))])
    first = [x for i in range(wanted) for x in (f"if(_place{i} >= 0 and _place{i} < total, _place{i}, null) as place{i}", f"_low as low{i}", f"_high as high{i}", f"0L as before{i}", f"total as inside{i}")]
    state = _State(whole.selectExpr(*[f"`{k}`" for k in keys], "total", *first), keys, wanted, "_x")

    ends = [f"{c}{i}" for c in ("place", "low", "high") for i in range(wanted)]
    most, passes = state.most(), 0
    while most > LAST_ROWS:
        counts = [F.expr("count(1) as _n"), F.expr("min(_x) as _from"), F.expr("max(_x) as _to")]
        bins = [_bin("_v", _number(f"low{i}", kind), _number(f"high{i}", kind), even=not passes) for i in range(wanted)]
        if not passes:  # all places have the range of the group
            counted = state.beside(rows, ends[:: wanted]).groupBy(*keys, F.expr(bins[0]).alias("_bin")).agg(*counts)
        else:
            inside = state.inside(state.beside(rows, ends), [*keys, "_x"], lambda i, bins=bins: f"'_i', {i}, '_bin', {bins[i]}")
            counted = inside.groupBy(*keys, "_i", "_bin").agg(*counts)
        state = _State(state.picked(counted, "_from", "_to", shared=not passes), keys, wanted, "_x")
        passes += 1
        if (now := state.most()) == most and passes > 1:
            break  # only whole numbers beyond the precision of doubles come to this: at most 2^11 distinct values
        most = now

    last = state.frame
    if most:
        counted = state.inside(state.beside(rows, ends), [*keys, "_x"], lambda i: f"'_i', {i}").groupBy(*keys, "_i", "_x").agg(F.expr("count(1) as _n"))
        last = state.picked(counted, "_x", "_x")
    out = [f"if(place{i} is not null, {c}{i}, null) as {name}{i}" for i in range(wanted) for c, name in (("low", "value"), ("before", "before"), ("inside", "equal"))]
    return last.selectExpr(*[f"`{k}`" for k in keys], "total", *out)


def percentile(df: DataFrame, column: str, p: float, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Exact percentile with linear interpolation at p * (n - 1)."""
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    at = lambda total: F.lit(p) * (total - 1)
    rows = at_places(df, column, lambda total: [F.floor(at(total)), F.ceil(at(total))], keys)
    share = at(F.col("total")) - F.floor(at(F.col("total")))
    # equal neighbours stay as they are, also infinite ones
    between = F.when(F.col("value0") == F.col("value1"), F.col("value0").cast("double")).otherwise(F.col("value0") + (F.col("value1") - F.col("value0")) * share)
    return rows.select(*keys, between.alias(name))


def median(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    return percentile(df, column, 0.5, keys, name)


def quartile(df: DataFrame, column: str, q: int, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    return percentile(df, column, q / 4, keys, name)


def kth_smallest(df: DataFrame, column: str, k: int, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Null where the group has fewer than k values."""
    return at_places(df, column, lambda total: [F.lit(k - 1)], keys).select(*keys, F.col("value0").alias(name))


def kth_largest(df: DataFrame, column: str, k: int, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    return at_places(df, column, lambda total: [total - k], keys).select(*keys, F.col("value0").alias(name))


def trimmed_mean(df: DataFrame, column: str, share: float, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Mean after floor(n * share / 2) values are cut from each end; null where nothing is left.

    The lowest and the highest value that stay are found by their places; one more pass
    adds up what lies between them.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    cut = lambda total: F.floor(total * share / 2)
    edges = at_places(df, column, lambda total: [cut(total), total - cut(total) - 1], keys).select(*keys, F.struct("*").alias("_e"))
    rows = df.select(*keys, column).filter(F.col(column).isNotNull())
    rows = beside(rows, edges, keys) if keys else rows.withColumn("_e", edges.select("_e").scalar())
    x, low, high, total = F.col(column), F.col("_e.value0"), F.col("_e.value1"), F.col("_e.total")
    sums = rows.groupBy(*keys).agg(F.sum(F.when((x > low) & (x < high), x)).alias("_between"), F.max("_e").alias("_e"))
    lowest = low * (F.col("_e.before0") + F.col("_e.equal0") - cut(total))
    highest = high * (total - cut(total) - F.col("_e.before1"))
    kept = total - 2 * cut(total)
    mean = F.when(low == high, low.cast("double")).when(low < high, F.try_divide(lowest + highest + F.coalesce(F.col("_between"), F.lit(0)), kept))
    return sums.select(*keys, F.when(kept > 0, mean).alias(name))
