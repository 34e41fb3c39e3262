"""Logic and type tests as Columns. An error value of the spreadsheet is null here."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from marketlens.functions.criteria import number


def and_all(*tests: Column) -> Column: return reduce(and_, tests)
def or_any(*tests: Column) -> Column: return reduce(or_, tests)
def not_(test: Column) -> Column: return ~test
def all_rows(test: Column) -> Column: return F.bool_and(test)
def any_row(test: Column) -> Column: return F.bool_or(test)
def if_(test: Column, yes, no=False) -> Column: return F.when(test, yes).otherwise(no)
def iferror(value: Column, fallback) -> Column: return F.coalesce(value, F.lit(fallback))
def isblank(x: Column) -> Column: return x.isNull()
def iserr(source: Column, value: Column) -> Column: return source.isNotNull() & value.isNull()
def iserror(source: Column, value: Column) -> Column: return source.isNotNull() & value.isNull()
def isna(found: Column) -> Column: return found.isNull()
def iseven(x: Column) -> Column: return F.floor(F.abs(x)) % 2 == 0
def isodd(x: Column) -> Column: return F.floor(F.abs(x)) % 2 == 1
def isnumber(x: Column) -> Column: return number(x).isNotNull()
def islogical(x: Column) -> Column: return F.coalesce(F.upper(x.cast("string")).isin("TRUE", "FALSE"), F.lit(False))
def istext(x: Column) -> Column: return x.isNotNull() & ~isnumber(x) & ~islogical(x)
def isnontext(x: Column) -> Column: return ~istext(x)


def n(x: Column) -> Column:
    """Number of the cell: truth values are 1 and 0, other text and blanks 0."""
    upper = F.upper(x.cast("string"))
    return F.when(upper == "TRUE", 1.0).when(upper == "FALSE", 0.0).otherwise(F.coalesce(number(x), F.lit(0.0)))


def delta(a: Column, b=0) -> Column: return (a == b).cast("int")
def gestep(x: Column, step=0) -> Column: return (x >= step).cast("int")
