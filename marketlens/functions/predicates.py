"""Predicates of tag groups: every function gives one boolean Column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

# Fixed values of the tag menu: yes and no become flags, the unknown sex becomes null.
YES, NO, UNKNOWN_SEX = "是", "否", "未知"
FLAGS = {YES: "1", NO: "0"}


def any_of(terms: Iterable[Column]) -> Column:
    return reduce(or_, terms)


def all_of(terms: Iterable[Column]) -> Column:
    return reduce(and_, terms)


def _date(value) -> Column:
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value.strip()))


def is_missing(field: str) -> Column:
    """Tag type 0: the field holds no value."""
    return F.col(field).isNull()


def equals_any(field: str, values: Sequence[str]) -> Column:
    """Tag types 1 and 2: the field equals one of the values."""
    values = [FLAGS.get(v, v) for v in values]
    return F.col(field) == values[0] if len(values) == 1 else F.col(field).isin(*values)


def comma_values(text: str) -> list[str]:
    """Values of a comma list; the full-width comma separates as well."""
    return text.replace("，", ",").split(",")


def in_ranges(field: str, ranges: Sequence[tuple]) -> Column:
    """Tag type 3: inside one of the closed number ranges; a plain value means equality."""
    return any_of(
        F.col(field).between(r[0], r[1]) if isinstance(r, (tuple, list)) else F.col(field) == r for r in ranges
    )


def in_date_ranges(field: str, ranges: Sequence[tuple]) -> Column:
    """Tag type 4: the day of the field is inside one of the closed day ranges.

    Written on the raw column as [start, end + 1 day), so that file statistics and
    partition pruning apply.
    """
    def one(start, end):
        return (F.col(field) >= _date(start)) & (F.col(field) < F.date_add(_date(end), 1))

    return any_of(one(*r) for r in ranges)


def contains_any(field: str, words: Sequence[str]) -> Column:
    """The text holds one of the words, taken literally."""
    return any_of(F.contains(F.col(field), F.lit(w)) for w in words)


def group_predicate(terms: Sequence[Column], null_terms: Sequence[Column]) -> Column | None:
    """``(a and b) or n``: a null term lets a row past every other term of its group."""
    if not terms and not null_terms:
        return None
    parts = ([all_of(terms)] if terms else []) + list(null_terms)
    return any_of(parts)
