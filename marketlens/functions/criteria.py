"""Criteria such as ``">5"``, ``"<>abc"`` or ``"red"`` as Columns.

Text is compared without case; a numeric operand compares numbers.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

_COMPARE = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def number(c: Column) -> Column:
    """The value as a number, null where it is none."""
    return c.cast("string").try_cast("double")


def condition(c: Column, criterion) -> Column:
    operator, operand = re.fullmatch(r"(?s)(<=|>=|<>|<|>|=)?(.*)", str(criterion)).groups()
    compare = _COMPARE[operator or "="]
    try:
        value = float(operand)
    except ValueError:
        if operand == "":
            blank = c.isNull() | (c.cast("string") == "")
            return ~blank if operator == "<>" else blank
        return F.coalesce(compare(F.upper(c.cast("string")), F.lit(operand.upper())), F.lit(False))
    test = compare(number(c), F.lit(value))
    if operator == "<>":
        test = F.coalesce(test, c.isNotNull())
    return F.coalesce(test, F.lit(False))


def criteria_table(rows: Sequence[Mapping[str, object]]) -> Column:
    """A criteria table: OR within a column, AND across the columns; empty cells ask nothing."""
    names = list(dict.fromkeys(name for row in rows for name in row))
    tests = []
    for name in names:
        given = [row[name] for row in rows if row.get(name) not in (None, "")]
        if given:
            tests.append(reduce(or_, [condition(F.col(name), g) for g in given]))
    return reduce(and_, tests) if tests else F.lit(True)
