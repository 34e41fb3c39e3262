"""Number functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.functions.units import unit


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


acos, acosh, asin, asinh, atan, atanh = F.acos, F.acosh, F.asin, F.asinh, F.atan, F.atanh
cos, cosh, exp, sin, sinh, sqrt, tan, tanh = F.cos, F.cosh, F.exp, F.sin, F.sinh, F.sqrt, F.tan, F.tanh
abs_, degrees, radians, log10, ln, sign, pi = F.abs, F.degrees, F.radians, F.log10, F.ln, F.signum, F.pi


def atan2(x, y) -> Column:
    """Arguments are (x, y); null at the origin."""
    return F.when((_col(x) != 0) | (_col(y) != 0), F.atan2(_col(y), _col(x)))


def _same_sign(x: Column, s: Column) -> Column:
    return F.signum(x) == F.signum(s)


def ceiling(x: Column, significance) -> Column:
    """Up (away from zero) to a multiple; null where the signs differ."""
    s = _col(significance)
    return F.when(s == 0, F.lit(0.0)).when(_same_sign(x, s), F.ceil(F.try_divide(x, s)) * s)


def floor(x: Column, significance) -> Column:
    """Down (toward zero) to a multiple; null where the signs differ or the multiple is zero."""
    s = _col(significance)
    return F.when(_same_sign(x, s) & (s != 0), F.floor(F.try_divide(x, s)) * s)


def int_(x: Column) -> Column: return F.floor(x)


def _scaled(x: Column, digits: Column | int, cut) -> Column:
    scale = F.pow(F.lit(10.0), digits) if isinstance(digits, Column) else 10.0 ** digits
    return F.signum(x) * cut(F.abs(x) * scale) / scale


def trunc(x: Column, digits: Column | int = 0) -> Column: return _scaled(x, digits, F.floor)
def round_(x: Column, digits: Column | int = 0) -> Column: return _scaled(x, digits, F.round) if isinstance(digits, Column) else F.round(x, digits)
def roundup(x: Column, digits: Column | int = 0) -> Column: return _scaled(x, digits, F.ceil)
def rounddown(x: Column, digits: Column | int = 0) -> Column: return _scaled(x, digits, F.floor)


def mround(x: Column, multiple) -> Column:
    m = _col(multiple)
    return F.when(m == 0, F.lit(0.0)).when(_same_sign(x, m), F.round(F.try_divide(x, m), 0) * m)


def even(x: Column) -> Column: return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


def odd(x: Column) -> Column:
    up = F.ceil(F.abs(x))
    return F.when(x == 0, F.lit(1.0)).otherwise(F.signum(x) * (up + F.when(up % 2 == 0, 1).otherwise(0)))


def mod(x: Column, y) -> Column:
    """Remainder with the sign of the divisor; null for divisor zero."""
    y = _col(y)
    return x - y * F.floor(F.try_divide(x, y))


def quotient(x: Column, y) -> Column:
    """Whole part of the division; 0 for divisor zero."""
    share = F.coalesce(F.try_divide(x.cast("double"), _col(y).cast("double")), F.lit(0.0))
    return (F.signum(share) * F.floor(F.abs(share))).cast("bigint")


def power(x: Column, y) -> Column: return F.pow(x, _col(y))
def log(x: Column, base: float = 10) -> Column: return F.log(float(base), x)
def sqrtpi(x: Column) -> Column: return F.sqrt(F.pi() * x)


def fact(n: Column) -> Column:
    """n! as a double; null for negative n."""
    k = F.floor(n).cast("int")
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: a * i)
    return F.when(n >= 0, whole)


def rand(seed: int) -> Column: return F.rand(seed)
def randbetween(low: int, high: int, seed: int) -> Column: return F.floor(F.rand(seed) * (high - low + 1)) + low


def convert(x: Column, source: str, target: str) -> Column:
    """Between two units of one kind, with decimal prefixes; null for units that do not match."""
    a, b = unit(source), unit(target)
    if a is None or b is None or a.kind != b.kind:
        return F.lit(None).cast("double")
    return (x * a.factor + a.offset - b.offset) / b.factor


def convert_table(df: DataFrame, value: str, source: str, target: str, units: DataFrame, name: str = "converted") -> DataFrame:
    """The same with the unit names in columns: two joins to a table of (unit, kind, factor, offset)."""
    a = units.select(F.col("unit").alias(source), F.col("kind").alias("_k1"), F.col("factor").alias("_f1"), F.col("offset").alias("_o1"))
    b = units.select(F.col("unit").alias(target), F.col("kind").alias("_k2"), F.col("factor").alias("_f2"), F.col("offset").alias("_o2"))
    rows = df.join(a, source, "left").join(b, target, "left")
    value_ = (F.col(value) * F.col("_f1") + F.col("_o1") - F.col("_o2")) / F.col("_f2")
    same = F.col("_k1") == F.col("_k2")
    return rows.withColumn(name, F.when(same, value_)).drop("_k1", "_f1", "_o1", "_k2", "_f2", "_o2")
