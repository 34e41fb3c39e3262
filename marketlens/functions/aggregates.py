"""Spreadsheet aggregates as aggregate Columns, for any ``groupBy(...).agg(...)``.

Every function here is built from aggregates with partial results, so it combines
map-side. Aggregates that need an order live in ``marketlens.operators.ordered``.
Errors of the spreadsheet (division by zero, no number) are nulls.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from marketlens.functions.criteria import condition, number


def as_number_a(c: Column) -> Column:
    """Values of the ...A aggregates: truth values are 1 and 0, other text is 0, blanks are left out."""
    text = c.cast("string")
    return (
        F.when(c.isNull() | (text == ""), None)
        .when(F.upper(text) == "TRUE", F.lit(1.0))
        .when(F.upper(text) == "FALSE", F.lit(0.0))
        .otherwise(F.coalesce(number(c), F.lit(0.0)))
    )


def sum_(x): return F.sum(x)
def sumif(tested, criterion, value): return F.coalesce(F.sum(F.when(condition(tested, criterion), value)), F.lit(0.0))
def sumsq(x): return F.sum(x * x)
def sumproduct(*xs):
    product = xs[0]
    for x in xs[1:]:
        product = product * x
    return F.sum(product)
def sumx2my2(x, y): return F.sum(x * x - y * y)
def sumx2py2(x, y): return F.sum(x * x + y * y)
def sumxmy2(x, y): return F.sum((x - y) * (x - y))
def product(x): return F.product(x)
def count(x): return F.count(number(x))
def counta(x): return F.count(x)
def countblank(x): return F.count_if(x.isNull() | (x.cast("string") == ""))
def countif(tested, criterion): return F.count_if(condition(tested, criterion))
def average(x): return F.avg(x)
def averagea(x): return F.avg(as_number_a(x))
def averageif(tested, criterion, value): return F.avg(F.when(condition(tested, criterion), value))
def max_(x): return F.max(x)
def maxa(x): return F.max(as_number_a(x))
def maxif(tested, criterion, value): return F.max(F.when(condition(tested, criterion), value))
def min_(x): return F.min(x)
def mina(x): return F.min(as_number_a(x))
def minif(tested, criterion, value): return F.min(F.when(condition(tested, criterion), value))
def devsq(x): return F.var_pop(x) * F.count(x)
def stdev(x): return F.stddev_samp(x)
def stdeva(x): return F.stddev_samp(as_number_a(x))
def stdevp(x): return F.stddev_pop(x)
def stdevpa(x): return F.stddev_pop(as_number_a(x))
def var(x): return F.var_samp(x)
def vara(x): return F.var_samp(as_number_a(x))
def varp(x): return F.var_pop(x)
def varpa(x): return F.var_pop(as_number_a(x))


def skew(x):
    """Sample-adjusted skewness; Spark gives the population figure."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x):
    """Sample-adjusted excess kurtosis; Spark gives the population excess."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def geomean(x): return F.when(F.min(x) > 0, F.exp(F.avg(F.ln(F.when(x > 0, x)))))
def harmean(x): return F.when(F.min(x) > 0, F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)))
def covar(y, x): return F.covar_pop(y, x)
def correl(y, x): return F.corr(y, x)
def pearson(y, x): return F.corr(y, x)
def rsq(y, x): return F.regr_r2(y, x)
def slope(y, x): return F.regr_slope(y, x)
def intercept(y, x): return F.regr_intercept(y, x)


def steyx(y, x):
    n = F.regr_count(y, x)
    rest = F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x))
    return F.when(n > 2, F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (n - 2).cast("double"))))


def forecast(at, y, x): return F.regr_intercept(y, x) + F.regr_slope(y, x) * at


def linest(y, x, const: bool = True) -> dict[str, Column]:
    """Linear fit: coefficients and statistics, all from one aggregation. Without ``const`` the line goes through the origin."""
    if not const:
        return _linest_through_origin(y, x)
    n = F.regr_count(y, x)
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    explained = F.try_divide(sxy * sxy, sxx)
    rest = syy - explained
    deviation = F.when(n > 2, F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (n - 2).cast("double"))))
    mean_x = F.regr_avgx(y, x)
    return {
        "slope": F.regr_slope(y, x),
        "intercept": F.regr_intercept(y, x),
        "slope_se": F.try_divide(deviation, F.sqrt(sxx)),
        "intercept_se": deviation * F.sqrt(F.try_divide(F.lit(1.0), n.cast("double")) + F.try_divide(mean_x * mean_x, sxx)),
        "r2": F.regr_r2(y, x),
        "residual_sd": deviation,
        "f": F.try_divide(explained, F.try_divide(rest, (n - 2).cast("double"))),
        "df": n - 2,
        "ss_reg": explained,
        "ss_res": rest,
        "covariance": F.covar_pop(y, x),
        "correlation": F.corr(y, x),
    }


def _linest_through_origin(y, x) -> dict[str, Column]:
    paired = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(paired, 1))
    sxx, syy, sxy = (F.sum(F.when(paired, v)) for v in (x * x, y * y, x * y))
    explained = F.try_divide(sxy * sxy, sxx)
    rest = syy - explained
    deviation = F.when(n > 1, F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (n - 1).cast("double"))))
    return {
        "slope": F.try_divide(sxy, sxx), "intercept": F.lit(0.0), "slope_se": F.try_divide(deviation, F.sqrt(sxx)), "intercept_se": F.lit(None).cast("double"),
        "r2": F.try_divide(explained, syy), "residual_sd": deviation, "f": F.try_divide(explained, F.try_divide(rest, (n - 1).cast("double"))), "df": n - 1,
        "ss_reg": explained, "ss_res": rest, "covariance": F.covar_pop(y, x), "correlation": F.corr(y, x),
    }


def logest(y, x, const: bool = True) -> dict[str, Column]:
    """Exponential fit y = b * m^x over the positive y; without ``const`` b is 1."""
    ly = F.ln(F.when(y > 0, y))
    if not const:
        fit = _linest_through_origin(ly, x)
        return {"m": F.exp(fit["slope"]), "b": F.lit(1.0), "r2": fit["r2"]}
    return {"m": F.exp(F.regr_slope(ly, x)), "b": F.exp(F.regr_intercept(ly, x)), "r2": F.regr_r2(ly, x)}


@pandas_udf(DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(-v / math.sqrt(2)))


def z_score(x: Column, mean: float, sigma: float | None = None) -> Column:
    """Aggregate: z of the mean of x against ``mean``."""
    sd = F.stddev_samp(x) if sigma is None else F.lit(float(sigma))
    return F.try_divide(F.avg(x) - mean, F.try_divide(sd, F.sqrt(F.count(x).cast("double"))))


def one_sided_p(z: Column) -> Column:
    """1 - Phi(z), for the one row per group that ``z_score`` leaves."""
    return F.lit(1.0) - _normal_cdf(z)


def confidence(x: Column, alpha: float) -> Column:
    """Half width of the confidence interval of the mean."""
    quantile = NormalDist().inv_cdf(1 - alpha / 2)
    return F.lit(quantile) * F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double")))


# The aggregate codes of SUBTOTAL.
SUBTOTAL = {
    1: average, 2: count, 3: counta, 4: max_, 5: min_, 6: product, 7: stdev, 8: stdevp, 9: sum_, 10: var, 11: varp,
}


def subtotal(code: int, x: Column) -> Column:
    return SUBTOTAL[code](x)
