"""List filters: row tests on one column, combined by AND over the filtered columns.

Row tests are plain Columns. Tests that need a figure of the whole column (mean, n-th
value) take it from a one-row aggregate as a scalar subquery, or per group by a join
with the aggregated groups; no window runs over ungrouped rows.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlens.operators import ordered, selection

#: Buckets for each of the n wanted values of a group.
BUCKETS = 4


def is_blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def in_values(c: Column, values: Sequence, blanks: bool = False) -> Column:
    """Value in set; blank cells pass only where ``blanks`` is set."""
    return F.when(is_blank(c), F.lit(blanks)).otherwise(c.isin(*values))


def in_date_groups(ts: Column, prefixes: Sequence[str], blanks: bool = False) -> Column:
    """The timestamp starts with one of the prefixes, e.g. '2024', '202401', '2024011512'.

    Every prefix is a range of the raw column, so the test reaches the scan.
    """
    within = reduce(or_, [(ts >= F.lit(start)) & (ts < F.lit(end)) for start, end in map(_span_of, prefixes)])
    return within | ts.isNull() if blanks else within


def _span_of(prefix: str) -> tuple[dt.datetime, dt.datetime]:
    """First moment of a year, month, day, hour, minute or second written as digits, and of the next one."""
    sizes = {4: "years", 6: "months", 8: "days", 10: "hours", 12: "minutes", 14: "seconds"}
    if len(prefix) not in sizes:
        raise ValueError(f"not a date prefix: {prefix}")
    start = dt.datetime(int(prefix[:4]), int(prefix[4:6] or 1), int(prefix[6:8] or 1), *(int(prefix[i : i + 2] or 0) for i in (8, 10, 12)))
    if len(prefix) == 4:
        return start, start.replace(year=start.year + 1)
    if len(prefix) == 6:
        return start, start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
    return start, start + dt.timedelta(**{sizes[len(prefix)]: 1})


def wildcard_regex(pattern: str) -> str:
    """``*`` and ``?`` are wildcards, ``~`` takes the next character literally."""
    parts, escaped = [], False
    for ch in pattern:
        if escaped:
            parts.append(re.escape(ch))
            escaped = False
        elif ch == "~":
            escaped = True
        elif ch == "*":
            parts.append(".*")
        elif ch == "?":
            parts.append(".")
        else:
            parts.append(re.escape(ch))
    if escaped:
        parts.append("~")
    return "(?is)^" + "".join(parts) + "$"


_COMPARE = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


def custom_rule(c: Column, operator: str, value) -> Column:
    """One rule: a comparison with a number, a blank test, or a wildcard match of text."""
    if isinstance(value, (int, float, dt.date)):
        return _COMPARE[operator](c, F.lit(value))
    if value is None or value == "":
        return {"=": is_blank(c), "<>": ~is_blank(c)}.get(operator, F.lit(True))
    match = F.rlike(c.cast("string"), F.lit(wildcard_regex(value)))
    return ~match if operator == "<>" else match


def custom(c: Column, rules: Sequence[tuple], join: str = "or") -> Column:
    """One or two rules joined by ``and`` or ``or``; blank cells fail unless a rule asks for them."""
    combine = and_ if join == "and" else or_
    test = reduce(combine, [custom_rule(c, op, v) for op, v in rules])
    asks_blank = any(v is None or v == "" for _, v in rules)
    return F.coalesce(test, F.lit(False)) if asks_blank else F.coalesce(~is_blank(c) & test, F.lit(False))


def in_months(d: Column, months: Sequence[int]) -> Column:
    return F.coalesce(F.month(d).isin(*months), F.lit(False))


def in_quarter(d: Column, quarter: int) -> Column:
    return F.coalesce(F.quarter(d) == quarter, F.lit(False))


def relative_range(kind: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """Half-open day range [start, end) of a relative date rule; weeks start on Sunday."""
    day = dt.timedelta(days=1)

    def month_start(shift: int) -> dt.date:
        months = today.year * 12 + today.month - 1 + shift
        return dt.date(months // 12, months % 12 + 1, 1)

    if kind in ("yesterday", "today", "tomorrow"):
        start = today + {"yesterday": -1, "today": 0, "tomorrow": 1}[kind] * day
        return start, start + day
    if kind == "yearToDate":
        return dt.date(today.year, 1, 1), today + day
    which, unit = re.fullmatch(r"(last|this|next)(Week|Month|Quarter|Year)", kind).groups()
    shift = {"last": -1, "this": 0, "next": 1}[which]
    if unit == "Week":
        start = today - ((today.weekday() + 1) % 7) * day + shift * 7 * day
        return start, start + 7 * day
    if unit == "Month":
        return month_start(shift), month_start(shift + 1)
    if unit == "Quarter":
        first = -((today.month - 1) % 3)
        return month_start(first + 3 * shift), month_start(first + 3 * shift + 3)
    return dt.date(today.year + shift, 1, 1), dt.date(today.year + shift + 1, 1, 1)


def in_relative_range(d: Column, kind: str, today: dt.date) -> Column:
    start, end = relative_range(kind, today)
    return F.coalesce((d >= F.lit(start)) & (d < F.lit(end)), F.lit(False))


def passing(df: DataFrame, tests: Sequence[Column]) -> DataFrame:
    """Rows that pass every column test."""
    return df.filter(reduce(and_, tests))


def beside_average(df: DataFrame, column: str, above: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Rows above (or below) the mean of the column, over all rows or within the keys."""
    x = F.col(column)
    if not keys:
        mean = df.agg(F.avg(column)).scalar()
        return df.filter(x > mean) if above else df.filter(x < mean)
    means = df.groupBy(*keys).agg(F.avg(column).alias("_mean"))
    joined = ordered.beside(df, means, keys)
    return joined.filter(x > F.col("_mean") if above else x < F.col("_mean")).drop("_mean")


def top_n(df: DataFrame, column: str, n: int, top: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Rows at or beyond the n-th value, ties kept.

    Zeros and blanks are left out when the n-th value is taken. No group reaches one task
    whole: over all rows a task keeps its n best, per group see ``group_edges``.
    """
    n = max(1, n)
    x = F.col(column)
    valued = df.filter(x.isNotNull() & (x != 0))
    pick = F.min if top else F.max
    order = x.desc() if top else x.asc()
    if not keys:
        edge = valued.select(column).orderBy(order).limit(n).agg(pick(column)).scalar()
        return df.filter(x >= edge) if top else df.filter(x <= edge)
    joined = ordered.beside(df, group_edges(valued, column, n, top, keys), keys)
    return joined.filter(x >= F.col("_edge") if top else x <= F.col("_edge")).drop("_edge")


def group_edges(valued: DataFrame, column: str, n: int, top: bool, keys: Sequence[str]) -> DataFrame:
    """The n-th value of every group as ``_edge``.

    The rows of a group are dealt to buckets and only the best of each is kept: the n-th
    of these stands behind no more than the group's n-th value, so few rows beyond it are
    left to be counted. No row is sorted.
    """
    x, best = F.col(column), F.max if top else F.min
    rows = valued.select(*keys, column)
    bucket = F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS * n))
    bests = rows.groupBy(*keys, bucket.alias("_bucket")).agg(best(column).alias("_best"))
    safe = bests.groupBy(*keys).agg(F.get(F.sort_array(F.collect_list("_best"), asc=not top), F.lit(n - 1)).alias("_safe"))
    beyond = (x >= F.col("_safe") if top else x <= F.col("_safe")) | F.col("_safe").isNull()
    counted = ordered.beside(rows, safe, keys).filter(beyond).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(x.desc() if top else x.asc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("_upto", F.sum("_n").over(upto)).filter(F.col("_upto") - F.col("_n") < n)
    return reached.groupBy(*keys).agg((F.min if top else F.max)(column).alias("_edge"))


def top_percent(df: DataFrame, column: str, percent: float, top: bool = True) -> DataFrame:
    """As ``top_n`` with N = floor(percent * rows / 100), at least 1, however many rows that are.

    The n-th value comes from counts of the value range, not from a sort.
    """
    x = F.col(column)
    rows = df.agg(F.count(F.lit(1))).first()[0]
    n = max(1, math.floor(percent * rows / 100))
    place = lambda total: [F.greatest(total - n, F.lit(0)) if top else F.least(F.lit(n), total) - 1]
    edge = selection.at_places(df.filter(x.isNotNull() & (x != 0)), column, place).select("value0").scalar()
    return df.filter(x >= edge) if top else df.filter(x <= edge)


# Row validation: every rule is one Column that is true for a valid row.
_VALID = {
    "between": lambda c, a, b: (c >= a) & (c <= b),
    "notBetween": lambda c, a, b: (c < a) | (c > b),
    "equal": lambda c, a, b: c == a,
    "notEqual": lambda c, a, b: c != a,
    "greaterThan": lambda c, a, b: c > a,
    "lessThan": lambda c, a, b: c < a,
    "greaterThanOrEqual": lambda c, a, b: c >= a,
    "lessThanOrEqual": lambda c, a, b: c <= a,
}


def validation_rule(kind: str, column: str, operator: str = "between", low=None, high=None, choices=()) -> Column:
    """True for valid rows. Kinds: list, whole, decimal, date, time, textLength; blank cells are valid."""
    c = F.col(column)
    if kind == "list":
        test = c.isin(*choices)
    else:
        value = {
            "whole": c, "decimal": c, "date": F.to_date(c),
            "time": F.date_format(c, "HH:mm:ss"), "textLength": F.length(c),
        }[kind] if kind in ("date", "time", "textLength", "whole", "decimal") else c
        a = None if low is None else F.lit(low)
        b = None if high is None else F.lit(high)
        test = _VALID[operator](value, a, b)
        if kind == "whole":
            test = test & (c == F.floor(c))
    return F.coalesce(test, F.lit(True))


def validation_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows checked and rows rejected, from a single pass."""
    figures = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(~test).alias(name) for name, test in rules.items()],
    )
    return figures.unpivot("_rows", list(rules), "rule_name", "rejected").withColumnRenamed("_rows", "checked")


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break at least one rule, with the names of the broken rules."""
    broken = F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in rules.items()]))
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)
