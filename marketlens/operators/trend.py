"""Trend fits per group: linear, logarithmic, exponential, power and polynomial."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from marketlens.operators.ordered import beside, numbered

KINDS = ("linear", "logarithmic", "exponential", "power")
ORDERS = (2, 3, 4, 5, 6)
#: A matrix beyond this condition has fewer distinct x than unknowns, but for rounding.
MOST_CONDITION = 1e12


def signed_log(x: Column) -> Column:
    """ln x; -ln|x| below zero; zero stays zero."""
    return F.when(x > 0, F.ln(F.when(x > 0, x))).when(x < 0, -F.ln(F.when(x < 0, -x))).otherwise(x)


def _scales(kind: str, y: Column, x: Column) -> tuple[Column, Column]:
    return (
        signed_log(y) if kind in ("exponential", "power") else y,
        signed_log(x) if kind in ("logarithmic", "power") else x,
    )


def with_order_as_x(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "x") -> DataFrame:
    """x = 1..n in the given order, where a series has no x values."""
    return numbered(df, order, keys, name)


def fit_columns(kind: str, y: Column, x: Column, const: bool = True) -> dict[str, Column]:
    """Aggregates of one fit. Linear and logarithmic: a + b x; exponential: a b^x; power: a x^b.

    Without ``const`` the line goes through the origin of the scales it is fitted on, so a
    is 0, or 1 where y is a logarithm, and r2 is measured against the sum of squares.
    """
    v, u = _scales(kind, y, x)
    if const:
        slope, intercept, r2 = F.regr_slope(v, u), F.regr_intercept(v, u), F.regr_r2(v, u)
    else:
        paired = u.isNotNull() & v.isNotNull()
        suu, svv, suv = (F.sum(F.when(paired, p)) for p in (u * u, v * v, u * v))
        slope, r2 = F.try_divide(suv, suu), F.try_divide(suv * suv, suu * svv)
        intercept = F.when(slope.isNotNull(), 0.0)
    if kind == "exponential":
        slope = F.exp(slope)
    if kind in ("exponential", "power"):
        intercept = F.exp(intercept)
    return {"slope": slope, "intercept": intercept, "r2": r2}


def fit(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), kind: str = "linear", const: bool = True) -> DataFrame:
    columns = fit_columns(kind, F.col(y), F.col(x), const)
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def fitted(df: DataFrame, y: str, x: str, at: DataFrame, keys: Sequence[str] = (), kind: str = "linear", const: bool = True, name: str = "fitted") -> DataFrame:
    """Rows of ``at`` (with the keys and x) and the y that the fit of their group gives there."""
    line = fit(df, y, x, keys, kind, const).select(*keys, F.struct("slope", "intercept").alias("_line"))
    rows = beside(at, line, keys) if keys else at.withColumn("_line", line.scalar())
    return rows.withColumn(name, predict(kind, F.col("_line.slope"), F.col("_line.intercept"), F.col(x))).drop("_line")


def predict(kind: str, slope: Column, intercept: Column, x: Column) -> Column:
    """y at x."""
    return {
        "linear": lambda: intercept + slope * x,
        "logarithmic": lambda: intercept + slope * signed_log(x),
        "exponential": lambda: intercept * F.pow(slope, x),
        "power": lambda: intercept * F.pow(x, slope),
    }[kind]()


def invert(kind: str, slope: Column, intercept: Column, y: Column) -> Column:
    """x at y."""
    rest = F.try_divide(y - intercept, slope)
    share = F.try_divide(y, intercept)
    share = F.when(share > 0, share)
    return {
        "linear": lambda: rest,
        "logarithmic": lambda: F.exp(rest),
        "exponential": lambda: F.try_divide(F.ln(share), F.ln(slope)),
        "power": lambda: F.pow(share, F.try_divide(F.lit(1.0), slope)),
    }[kind]()


def all_fits(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), const: bool = True) -> DataFrame:
    """Every kind of fit in one pass, one row per group and kind."""
    wide = df.groupBy(*keys).agg(*[F.struct(F.lit(k).alias("kind"), *[c.alias(n) for n, c in fit_columns(k, F.col(y), F.col(x), const).items()]).alias(k) for k in KINDS])
    return wide.select(*keys, F.explode(F.array(*KINDS)).alias("f")).select(*keys, "f.*")


def best_fit(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), orders: Sequence[int] = ORDERS, const: bool = True) -> DataFrame:
    """The fit of the highest r2 per group among all kinds and the polynomials of the given orders.

    Lines and polynomials come from the same pass over the rows. Polynomials always have
    a constant; without ``const`` their r2 is measured like that of the lines.
    """
    if not orders:
        fits = all_fits(df, y, x, keys, const).select(*keys, "kind", F.array("intercept", "slope").alias("coefficients"), "r2")
    else:
        sums = _sums(df, y, x, max(orders), keys, lines=True)
        total = "_syy" if const else "_square"
        lines = F.array(*[_line(kind, const) for kind in KINDS])
        curves = F.transform(_curves(orders, total), lambda c: F.struct(F.concat(F.lit("polynomial_"), c["order"].cast("string")).alias("kind"), c["coefficients"].alias("coefficients"), c["r2"].alias("r2")))
        fits = sums.select(*keys, F.inline(F.concat(lines, curves)))
    best = fits.filter(F.col("r2").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("kind", "coefficients", "r2"), "r2").alias("_b"))
    return best.select(*keys, "_b.*")


def fit_statistics(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of the linear fit."""
    from marketlens.functions.aggregates import linest

    columns = linest(F.col(y), F.col(x))
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


@pandas_udf(ArrayType(ArrayType(DoubleType())))
def _solve(orders: pd.Series, sums: pd.Series, products: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """For every order: the explained sum of squares and the ascending coefficients; empty where there is no fit.

    Sums of powers become sums of Chebyshev polynomials, of which the product of two is the
    mean of two others, so they give the matrix of every order.
    """
    out = []
    for wanted, s, p, a, b in zip(orders, sums, products, low, high):
        top = len(p) - 1
        basis = np.zeros((2 * top + 1, 2 * top + 1))
        for k in range(2 * top + 1):
            powers = np.polynomial.chebyshev.cheb2poly(np.eye(2 * top + 1)[k])
            basis[k, : len(powers)] = powers
        found, s, p = [], basis @ np.asarray(s, dtype=float), basis[: top + 1, : top + 1] @ np.asarray(p, dtype=float)
        for k in wanted:
            at = np.arange(k + 1)
            matrix = (s[at[:, None] + at] + s[np.abs(at[:, None] - at)]) / 2  # of products of two basis polynomials
            if not np.isfinite(matrix).all() or np.linalg.cond(matrix) > MOST_CONDITION:
                found.append([])
                continue
            c = np.linalg.solve(matrix, p[: k + 1])
            curve = np.polynomial.Chebyshev(c, domain=[a, b]).convert(kind=np.polynomial.Polynomial).coef
            found.append([float(c @ p[: k + 1]), *np.pad(curve, (0, k + 1 - len(curve)))])
        out.append(found)
    return pd.Series(out)


#: Scales of x and y that lines are fitted on.
_X, _Y = {False: "x", True: "lx"}, {False: "y", True: "ly"}


def _sums(df: DataFrame, y: str, x: str, order: int, keys: Sequence[str], lines: bool = False) -> DataFrame:
    """Per group, the sums that polynomials up to ``order`` need, and those of the ``lines``, in one pass over the rows.

    An earlier pass takes means and ranges, so that x is mapped to -1..1 for its powers and
    the sums of products are those of deviations.
    """
    paired = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.filter(paired).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    names = ("x", "lx", "y", "ly") if lines else ("y",)
    if lines:
        rows = rows.withColumns({"_lx": signed_log(F.col("_x")), "_ly": signed_log(F.col("_y"))})
    figures = F.struct(F.min("_x").alias("low"), F.max("_x").alias("high"), F.min("_y").alias("least"), F.max("_y").alias("most"), *[F.avg(f"_{c}").alias(c) for c in names])
    rows = beside(rows, rows.groupBy(*keys).agg(figures.alias("_s")), keys) if keys else rows.withColumn("_s", rows.agg(figures).scalar())
    share = F.try_divide(2 * F.col("_x") - F.col("_s.low") - F.col("_s.high"), F.col("_s.high") - F.col("_s.low"))
    rows = rows.select(*keys, "_s", share.alias("_u"), *[(F.col(f"_{c}") - F.col(f"_s.{c}")).alias(f"_{c}") for c in names])
    powers = [F.lit(1.0)]
    for k in range(1, 2 * order + 1):  # each from two lower ones that are columns already
        rows = rows.withColumn(f"_u{k}", F.col("_u") if k == 1 else F.col(f"_u{k // 2}") * F.col(f"_u{k - k // 2}"))
        powers.append(F.col(f"_u{k}"))
    pairs = ["y_y", *(["x_x", "lx_lx", "ly_ly", "x_y", "lx_y", "x_ly", "lx_ly"] if lines else [])]
    sums = rows.groupBy(*keys).agg(
        *[F.sum(p).alias(f"_m{k}") for k, p in enumerate(powers)], *[F.sum(F.col("_y") * p).alias(f"_p{k}") for k, p in enumerate(powers[: order + 1])],
        *[F.sum(F.col(f"_{p.split('_')[0]}") * F.col(f"_{p.split('_')[1]}")).alias(f"_{p}") for p in pairs], F.count(F.lit(1)).alias("_n"), F.struct(*[F.max(f"_s.{c}").alias(c) for c in ("low", "high", "least", "most", *names)]).alias("_s"),
    )
    arrays = {"_m": F.array(*[f"_m{k}" for k in range(2 * order + 1)]), "_p": F.array(*[f"_p{k}" for k in range(order + 1)])}
    return sums.withColumns(arrays | {"_syy": F.col("_y_y"), "_square": F.col("_y_y") + F.col("_n") * F.col("_s.y") * F.col("_s.y")})


def _line(kind: str, const: bool) -> Column:
    """Kind, intercept and slope, and r2 of a line, from the sums of deviations."""
    u, v = _X[kind in ("logarithmic", "power")], _Y[kind in ("exponential", "power")]
    mu, mv, n = F.col(f"_s.{u}"), F.col(f"_s.{v}"), F.col("_n")
    suu, svv, suv = F.col(f"_{u}_{u}"), F.col(f"_{v}_{v}"), F.col(f"_{u}_{v}")
    if const:
        slope = F.when(F.col("_s.low") < F.col("_s.high"), F.try_divide(suv, suu))
        intercept = mv - slope * mu
        r2 = F.when(F.col("_s.least") == F.col("_s.most"), F.when(slope.isNotNull(), 1.0)).otherwise(F.try_divide(slope * suv, svv))
    else:
        suu, svv, suv = suu + n * mu * mu, svv + n * mv * mv, suv + n * mu * mv
        slope = F.try_divide(suv, suu)
        intercept, r2 = F.when(slope.isNotNull(), 0.0), F.try_divide(suv * suv, suu * svv)
    slope = F.exp(slope) if kind == "exponential" else slope
    intercept = F.exp(intercept) if kind in ("exponential", "power") else intercept
    return F.struct(F.lit(kind).alias("kind"), F.array(intercept, slope).alias("coefficients"), r2.alias("r2"))


def _curves(orders: Sequence[int], total: str = "_syy") -> Column:
    """Order, ascending coefficients and r2 of every order that has more points than unknowns allow for, as an array."""
    if not all(2 <= k <= 6 for k in orders):
        raise ValueError("orders must be 2..6")
    wanted = F.array(*[F.lit(k) for k in sorted(set(orders))])
    solved = F.arrays_zip(wanted.alias("order"), _solve(wanted, "_m", "_p", F.col("_s.low"), F.col("_s.high")).alias("solved"))
    able = F.filter(solved, lambda f: (F.size(f["solved"]) > 0) & (f["order"] < F.col("_n")))
    mean = F.col("_s.y")
    rest = F.col("_syy") if total == "_syy" else F.col("_square")
    return F.transform(able, lambda f: F.struct(
        f["order"].alias("order"),
        F.transform(F.slice(f["solved"], 2, f["order"] + 1), lambda c, i: F.when(i == 0, c + mean).otherwise(c)).alias("coefficients"),
        F.try_divide(f["solved"][0] + (rest - F.col("_syy")), rest).alias("r2"),
    ))


def polynomials(df: DataFrame, y: str, x: str, orders: Sequence[int] = ORDERS, keys: Sequence[str] = ()) -> DataFrame:
    """Polynomial fits of all the orders: ``order``, ascending coefficients and r2, a row for each group and order.

    Two passes whatever the orders: the range of x, then sums of its powers up to twice the
    highest order, which hold the matrix of every order. Only the small systems of each
    group are solved in Python. A group whose points or distinct x
    are too few has no fit of that order.
    """
    return _sums(df, y, x, max(orders), keys).select(*keys, F.inline(_curves(orders)))


def polynomial(df: DataFrame, y: str, x: str, order: int, keys: Sequence[str] = ()) -> DataFrame:
    """Polynomial fit of one order, 2..6: ascending coefficients and r2."""
    return polynomials(df, y, x, [order], keys).drop("order")


def polynomial_value(coefficients: Column, x: Column) -> Column:
    """Value of an ascending coefficient array at x, by Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda a, c: a * x + c)
