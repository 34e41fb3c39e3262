"""Types and values of untyped cells.

Notations are told apart by the signs they are split at: a slash for fractions, a last
percent sign, a leading dollar sign, colons for times of day. What is left between the
signs must be digits, and as many as the notation wants.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The error codes of cells.
ERROR_CODES = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")
DIGITS = "0123456789"


def _only(x: Column, letters: str) -> Column:
    return (F.translate(x, letters, "") == "") & (x != "")


def _digits(x: Column, least: int = 1, most: int | None = None) -> Column:
    fits = _only(x, DIGITS) & (F.length(x) >= least)
    return fits if most is None else fits & (F.length(x) <= most)


def _unsigned(x: Column) -> Column:
    """A cell without its first sign."""
    return F.when(F.left(x, F.lit(1)).isin("+", "-"), F.substring(x, 2, 1 << 30)).otherwise(x)


def _signed(x: Column, value: Column) -> Column:
    return F.when(F.startswith(x, F.lit("-")), -value).otherwise(value)


def _decimal(x: Column) -> Column:
    """Value of digits with at most one point among them; else null."""
    return F.when(_only(x, DIGITS + "."), x.try_cast("double"))


def _number(x: Column) -> Column:
    """Value of a plain or scientific number; else null."""
    return F.when(_only(x, DIGITS + "+-.eE"), x.try_cast("double"))


def value_type(x: Column) -> Column:
    """null, s (text), n (number), b (truth value), e (error code) or f (formula)."""
    without_minus = F.when(F.startswith(x, F.lit("-")), F.substring(x, 2, 1 << 30)).otherwise(x)
    return (
        F.when(x.isNull(), "null").when(x == "", "s").when(F.startswith(x, F.lit("=")) & (F.length(x) > 1), "f")
        .when(_decimal(without_minus).isNotNull(), "n").when(x.isin(*ERROR_CODES), "e").when(F.upper(x).isin("TRUE", "FALSE"), "b").otherwise("s")
    )


def _fraction(x: Column) -> Column:
    """``n/d`` or ``whole n/d``, with an optional sign."""
    sides = F.split(x, "/", -1)
    pieces = F.array_remove(F.split(_unsigned(sides[0]), " ", -1), "")
    below, last = F.ltrim(F.get(sides, F.lit(1))), F.element_at(pieces, -1)
    part = F.try_divide(last.try_cast("double"), below.try_cast("double"))
    whole = F.when(F.size(pieces) == 2, pieces[0].try_cast("double")).otherwise(0.0)
    fits = (F.size(sides) == 2) & F.size(pieces).isin(1, 2) & F.forall(pieces, lambda p: _digits(p)) & _digits(below)
    return F.when(fits, _signed(x, whole + part))


def _percent(x: Column) -> Column:
    number = F.rtrim(F.substring(x, 1, F.length(x) - 1))
    return F.when(F.endswith(x, F.lit("%")), _signed(number, _decimal(_unsigned(number))) / 100)


def _dollars(x: Column) -> Column:
    """Whole dollars, in groups of three after commas or without any, and cents in two digits."""
    amount = F.split(F.ltrim(F.substring(x, 2, 1 << 30)), r"\.", -1)
    thousands = F.split(amount[0], ",", -1)
    grouped = _digits(thousands[0], 1, 3) & F.forall(F.slice(thousands, 2, 1 << 30), lambda g: _digits(g, 3, 3))
    cents = (F.size(amount) == 1) | (F.size(amount) == 2) & _digits(F.get(amount, F.lit(1)), 2, 2)
    fits = F.startswith(x, F.lit("$")) & cents & (grouped | _digits(amount[0]))
    return F.when(fits, F.replace(F.array_join(amount, "."), F.lit(","), F.lit("")).try_cast("double"))


def _time_of_day(x: Column) -> Column:
    """Hours and minutes, perhaps seconds, as a share of the day."""
    parts = F.split(x, ":", -1)
    hours, rest = parts[0], F.slice(parts, 2, 1 << 30)
    fits = F.size(parts).isin(2, 3) & _digits(hours, 1, 2) & (hours.try_cast("int") < 24) & F.forall(rest, lambda p: _digits(p, 2, 2) & (p.try_cast("int") < 60))
    seconds = hours.try_cast("double") * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0))
    return F.when(fits, seconds / 86400)


def normalised(x: Column) -> Column:
    """Numeric value of a cell: numbers, fractions, percentages, dollar amounts and times of day; else null."""
    truth = F.when(F.upper(x) == "TRUE", 1.0).when(F.upper(x) == "FALSE", 0.0)
    return F.coalesce(truth, _number(x), _fraction(x), _percent(x), _dollars(x), _time_of_day(x))


def typed(x: Column) -> list[Column]:
    """(type, num, text) of a cell; what normalises to a number counts as one."""
    kind, number = value_type(x), normalised(x)
    kind = F.when((kind == "s") & number.isNotNull(), "n").otherwise(kind)
    return [kind.alias("type"), number.alias("num"), F.when(kind == "s", x).alias("text")]
