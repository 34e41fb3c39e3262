"""Registered trend fit queries (TRD rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import trend as T
from marketlens.registry import add, query

KEYS = ["l_returnflag"]
Y, X = "l_extendedprice", "l_quantity"
_LOGY, _LOGX = "ln(l_extendedprice)", "ln(l_quantity)"


def fit(name, kind, y, x, slope, intercept):
    def run(t):
        rows = T.fit(t.lineitem, Y, X, KEYS, kind)
        return rows.select(*KEYS, F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))

    add(name, run, f"""select l_returnflag, round({slope.format(f'regr_slope({y}, {x})')}, 5) as slope, round({intercept.format(f'regr_intercept({y}, {x})')}, 3) as intercept,
        round(regr_r2({y}, {x}), 6) as r2 from lineitem group by 1""")


fit("trd_1_linear", "linear", Y, X, "{}", "{}")
fit("trd_2_logarithmic", "logarithmic", Y, _LOGX, "{}", "{}")
fit("trd_3_exponential", "exponential", _LOGY, X, "exp({})", "exp({})")
fit("trd_4_power", "power", _LOGY, _LOGX, "{}", "exp({})")


@query(
    "trd_1_linear_by_order",
    """with o as (select o_orderstatus, o_totalprice as y, row_number() over (partition by o_orderstatus order by o_orderdate, o_orderkey) as x from orders)
    select o_orderstatus, round(regr_slope(y, x), 5) as slope, round(regr_intercept(y, x), 3) as intercept from o group by 1""",
)
def _(t):
    rows = T.with_order_as_x(t.orders, ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    return T.fit(rows, "o_totalprice", "x", ["o_orderstatus"]).select("o_orderstatus", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


# Order two by elimination on the standardised x.
@query(
    "trd_5_polynomial",
    """with s as (select l_returnflag, avg(l_quantity) as m, stddev_pop(l_quantity) as sd from lineitem group by 1),
    u as (select l_returnflag, m, sd, (l_quantity - m) / sd as u, l_extendedprice as y from lineitem join s using (l_returnflag)),
    q as (select l_returnflag, any_value(m) as m, any_value(sd) as sd, count(*) as n, sum(u * u * u) as s3, sum(u * u * u * u) as s4, sum(y) as t0, sum(u * y) as t1, sum(u * u * y) as t2,
      regr_syy(y, u) as syy, avg(y) as ym from u group by 1),
    c as (select *, (t2 - t0 - s3 * t1 / n) / (s4 - n - s3 * s3 / n) as c2 from q), d as (select *, (t1 - s3 * c2) / n as c1, t0 / n - c2 as c0 from c)
    select l_returnflag, round(c0 + c1 * (10 - m) / sd + c2 * power((10 - m) / sd, 2), 3) as at_10, round(c0 + c1 * (45.5 - m) / sd + c2 * power((45.5 - m) / sd, 2), 3) as at_45,
      round((c0 * (t0 - n * ym) + c1 * t1 + c2 * (t2 - n * ym)) / syy, 6) as r2 from d""",
)
def _(t):
    rows = T.polynomial(t.lineitem, Y, X, 2, KEYS)
    at = lambda v: F.round(T.polynomial_value(F.col("coefficients"), F.lit(v)), 3)
    return rows.select("l_returnflag", at(10.0).alias("at_10"), at(45.5).alias("at_45"), F.round("r2", 6).alias("r2"))


def _orthogonal(column: str, table: str, first: str, y: str, x: str) -> str:
    """SQL tables ``fits`` (r2 of every order) and ``e0..e6`` (the basis), by orthogonal polynomials built on the rows one order after the other."""
    parts = [
        f"base as (select {column} as g, {y}::double as y, {x}::double as x from {table} where {y} is not null and {x} is not null)",
        "s as (select g, avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, count(*) as n, regr_syy(y, x) as syy from base group by g)",
        "r as (select g, (x - mx) / sx as u, y - my as y, 1.0::double as p0, 0.0::double as q0 from base join s using (g))",
    ]
    for k in range(7):
        parts.append(f"e{k} as (select g, sum(y * p{k}) / sum(p{k} * p{k}) as c{k}, sum(u * p{k} * p{k}) / sum(p{k} * p{k}) as a{k}, sum(p{k} * p{k}) as w{k} from {'r' if k == 0 else f'r{k}'} group by g)")
        if k < 6:
            before = f"e{k}.w{k} / e{k - 1}.w{k - 1} * p{k - 1}" if k else "0"
            joined = f" join e{k - 1} using (g)" if k else ""
            parts.append(f"r{k + 1} as (select g, u, y, {', '.join(f'p{i}' for i in range(k + 1))}, (u - a{k}) * p{k} - {before} as p{k + 1} from {'r' if k == 0 else f'r{k}'} join e{k} using (g){joined})")
    joins = " ".join(f"join e{k} using (g)" for k in range(7))
    explained = " + ".join(f"case when o >= {k} then c{k} * c{k} * w{k} else 0 end" for k in range(7))
    parts.append(f"fits as (select g, o, ({explained}) / syy as r2 from s {joins} cross join (select unnest([2, 3, 4, 5, 6]) as o))")
    return f"with {first}" + ", ".join(parts)


def _at(value: float) -> str:
    """SQL of the fitted y at x: the basis by its recurrence, from the table of all coefficients."""
    u, steps = f"(({value} - mx) / sx)", []
    for k in range(7):
        if k == 0:
            steps.append("1.0::double as b0")
        else:
            before = f" - w{k - 1} / w{k - 2} * b{k - 2}" if k > 1 else ""
            steps.append(f"({u} - a{k - 1}) * b{k - 1}{before} as b{k}")
    return ", ".join(steps)


def _curve_sql() -> str:
    joins = " ".join(f"join e{k} using (g)" for k in range(7))
    value = "my + " + " + ".join(f"case when o >= {k} then c{k} * b{k} else 0 end" for k in range(7))
    parts = [f"v{i} as (select *, {_at(v)} from s {joins})" for i, v in enumerate((10, 45.5))]
    return (_orthogonal("l_returnflag", "lineitem", "", Y, X) + ", " + ", ".join(parts) + f"""
    select fits.g as l_returnflag, o as "order", round(x.at_10, 3) as at_10, round(y.at_45, 3) as at_45, round(r2, 6) as r2 from fits
    join (select g, o, {value} as at_10 from v0 cross join (select unnest([2, 3, 4, 5, 6]) as o)) x using (g, o) join (select g, o, {value} as at_45 from v1 cross join (select unnest([2, 3, 4, 5, 6]) as o)) y using (g, o)""")


@query("trd_5_polynomial_orders", _curve_sql())
def _(t):
    rows = T.polynomials(t.lineitem, Y, X, keys=KEYS)
    at = lambda v: F.round(T.polynomial_value(F.col("coefficients"), F.lit(v)), 3)
    return rows.select("l_returnflag", "order", at(10.0).alias("at_10"), at(45.5).alias("at_45"), F.round("r2", 6).alias("r2"))


_LINES = f"select l_returnflag, regr_r2({Y}, {X}) as linear, regr_r2({Y}, {_LOGX}) as logarithmic, regr_r2({_LOGY}, {X}) as exponential, regr_r2({_LOGY}, {_LOGX}) as power from lineitem group by 1"


@query(
    "trd_6_best_fit",
    _orthogonal("l_returnflag", "lineitem", f"f as ({_LINES}), ", Y, X) + """, u as (select l_returnflag, kind, r2 from (unpivot f on linear, logarithmic, exponential, power into name kind value r2) union all select g, 'polynomial_' || o, r2 from fits)
    select l_returnflag, arg_max(kind, r2) as kind, round(max(r2), 6) as r2 from u group by 1""",
)
def _(t):
    return T.best_fit(t.lineitem, Y, X, KEYS).select("l_returnflag", "kind", F.round("r2", 6).alias("r2"))


@query(
    "trd_6_best_line",
    f"with f as ({_LINES}), u as (unpivot f on linear, logarithmic, exponential, power into name kind value r2) select l_returnflag, arg_max(kind, r2) as kind, round(max(r2), 6) as r2 from u group by 1",
)
def _(t):
    return T.best_fit(t.lineitem, Y, X, KEYS, orders=()).select("l_returnflag", "kind", F.round("r2", 6).alias("r2"))


_ORIGIN = "select l_returnflag, '{kind}' as kind, {slope} as slope, {intercept} as intercept, sum({u} * {v}) * sum({u} * {v}) / (sum({u} * {u}) * sum({v} * {v})) as r2 from lineitem group by 1"


def _origin(kind, v, u):
    slope = f"sum({u} * {v}) / sum({u} * {u})"
    return _ORIGIN.format(kind=kind, u=u, v=v, slope=f"exp({slope})" if kind == "exponential" else slope, intercept=1.0 if kind in ("exponential", "power") else 0.0)


# Lines and curves without a constant, and the best of them.
@query(
    "trd_6_fits_through_origin",
    "with f as (" + " union all ".join(_origin(k, v, u) for k, v, u in (("linear", Y, X), ("logarithmic", Y, _LOGX), ("exponential", _LOGY, X), ("power", _LOGY, _LOGX))) + """)
    select l_returnflag, kind, round(slope, 5) as slope, intercept::double as intercept, round(r2, 6) as r2, r2 = max(r2) over (partition by l_returnflag) as best from f""",
)
def _(t):
    fits = T.all_fits(t.lineitem, Y, X, KEYS, const=False)
    best = T.best_fit(t.lineitem, Y, X, KEYS, orders=(), const=False).select("l_returnflag", F.col("kind").alias("_best"))
    return fits.join(best, "l_returnflag").select("l_returnflag", "kind", F.round("slope", 5).alias("slope"), "intercept", F.round("r2", 6).alias("r2"), (F.col("kind") == F.col("_best")).alias("best"))


@query(
    "trd_7_statistics",
    f"""with s as (select l_returnflag, regr_count({Y}, {X}) as n, regr_sxx({Y}, {X}) as sxx, regr_syy({Y}, {X}) as syy, regr_sxy({Y}, {X}) as sxy, regr_r2({Y}, {X}) as r2,
      covar_pop({Y}, {X}) as cv, corr({Y}, {X}) as cr from lineitem group by 1)
    select l_returnflag, round(r2, 6) as r2, round(sqrt((syy - sxy * sxy / sxx) / (n - 2)), 3) as residual_sd, round(sxy * sxy / sxx / 1e9, 3) as ss_reg, round((syy - sxy * sxy / sxx) / 1e9, 3) as ss_res,
      cast(n as bigint) - 2 as df, round((sxy * sxy / sxx) / ((syy - sxy * sxy / sxx) / (n - 2)), 2) as f, round(cv, 2) as covariance, round(cr, 6) as correlation from s""",
)
def _(t):
    rows = T.fit_statistics(t.lineitem, Y, X, KEYS)
    digits = {"r2": 6, "residual_sd": 3, "f": 2, "covariance": 2, "correlation": 6}
    big = [F.round(F.col(c) / 1e9, 3).alias(c) for c in ("ss_reg", "ss_res")]
    return rows.select("l_returnflag", "df", *[F.round(c, d).alias(c) for c, d in digits.items()], *big)


@query(
    "trd_8_prediction",
    f"""with f as (select l_returnflag, regr_slope({_LOGY}, {X}) as b, regr_intercept({_LOGY}, {X}) as a, regr_slope({Y}, {X}) as lb, regr_intercept({Y}, {X}) as la from lineitem group by 1)
    select l_returnflag, round(exp(a) * power(exp(b), 20), 3) as forward, round((ln(30000) - a) / b, 1) as backward, round((30000 - la) / lb, 4) as linear_backward from f""",
)
def _(t):
    e = T.fit(t.lineitem, Y, X, KEYS, "exponential")
    linear = T.fit(t.lineitem, Y, X, KEYS).select("l_returnflag", F.col("slope").alias("lb"), F.col("intercept").alias("la"))
    s, i = F.col("slope"), F.col("intercept")
    return e.join(linear, "l_returnflag").select(
        "l_returnflag", F.round(T.predict("exponential", s, i, F.lit(20.0)), 3).alias("forward"),
        F.round(T.invert("exponential", s, i, F.lit(30000.0)), 1).alias("backward"),
        F.round(T.invert("linear", F.col("lb"), F.col("la"), F.lit(30000.0)), 4).alias("linear_backward"))
