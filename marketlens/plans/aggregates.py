"""Registered aggregate queries (AGG rows): every aggregate per return flag and line status."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import aggregates as A
from marketlens.operators import ordered as O
from marketlens.operators import selection as S
from marketlens.operators import trend as T
from marketlens.registry import add, query

KEYS = ["l_returnflag", "l_linestatus"]
GROUPS = ", ".join(KEYS)


def X(): return F.col("l_quantity")
def Y(): return F.col("l_extendedprice")
def D(): return F.col("l_discount")
def TAX(): return F.col("l_tax")



# A column of mixed cells: numbers, truth values, words, empty text and nulls.
MIXED_SQL = """case when l_linenumber = 1 then 'TRUE' when l_linenumber = 2 then 'false' when l_linenumber = 3 then 'n/a'
    when l_linenumber = 4 then '' when l_linenumber = 5 then null else cast(cast(l_quantity as integer) as varchar) end"""
MIXED_NUMBER_SQL = f"""case when ({MIXED_SQL}) is null or ({MIXED_SQL}) = '' then null when upper({MIXED_SQL}) = 'TRUE' then 1 when upper({MIXED_SQL}) = 'FALSE' then 0
    else coalesce(try_cast(({MIXED_SQL}) as double), 0) end"""


def M():
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, "TRUE").when(n == 2, "false").when(n == 3, "n/a").when(n == 4, "").when(n == 5, None)
        .otherwise(X().cast("int").cast("string"))
    )


def grouped(name: str, column, sql: str, digits: int | None = 6) -> None:
    text = sql if digits is None else f"round(cast({sql} as double), {digits})"

    def run(t):
        value = column() if digits is None else F.round(column().cast("double"), digits)
        return t.lineitem.groupBy(*KEYS).agg(value.alias("value"))

    add(name, run, f"select {GROUPS}, {text} as value from lineitem group by {GROUPS}")


grouped("agg_1_sum", lambda: A.sum_(Y()), "sum(l_extendedprice)", 2)
grouped("agg_2_sumif", lambda: A.sumif(F.lower("l_returnflag"), "n", X()), "coalesce(sum(l_quantity) filter (where upper(l_returnflag) = 'N'), 0)")
grouped("agg_3_sumsq", lambda: A.sumsq(X()), "sum(l_quantity * l_quantity)", 2)
grouped("agg_4_sumproduct", lambda: A.sumproduct(X(), D()), "sum(l_quantity * l_discount)", 4)
grouped("agg_5_sumx2my2", lambda: A.sumx2my2(X(), D()), "sum(l_quantity * l_quantity - l_discount * l_discount)", 4)
grouped("agg_6_sumx2py2", lambda: A.sumx2py2(X(), D()), "sum(l_quantity * l_quantity + l_discount * l_discount)", 4)
grouped("agg_7_sumxmy2", lambda: A.sumxmy2(X(), D()), "sum((l_quantity - l_discount) * (l_quantity - l_discount))", 4)
grouped("agg_8_product", lambda: A.product(1 + TAX() / 1000), "product(1 + l_tax / 1000)")
grouped("agg_10_count", lambda: A.count(M()), f"count(try_cast(({MIXED_SQL}) as double))", None)
grouped("agg_11_counta", lambda: A.counta(M()), f"count({MIXED_SQL})", None)
grouped("agg_12_countblank", lambda: A.countblank(M()), f"count(*) filter (where ({MIXED_SQL}) is null or ({MIXED_SQL}) = '')", None)
grouped("agg_13_countif", lambda: A.countif(X(), ">=25"), "count(*) filter (where l_quantity >= 25)", None)
grouped("agg_14_average", lambda: A.average(Y()), "avg(l_extendedprice)", 4)
grouped("agg_15_averagea", lambda: A.averagea(M()), f"avg({MIXED_NUMBER_SQL})")
grouped("agg_16_averageif", lambda: A.averageif(X(), "<10", Y()), "avg(l_extendedprice) filter (where l_quantity < 10)", 4)
grouped("agg_17_max", lambda: A.max_(Y()), "max(l_extendedprice)")
grouped("agg_18_maxa", lambda: A.maxa(M()), f"max({MIXED_NUMBER_SQL})")
grouped("agg_19_maxif", lambda: A.maxif(X(), "=7", Y()), "max(l_extendedprice) filter (where l_quantity = 7)")
grouped("agg_20_min", lambda: A.min_(Y()), "min(l_extendedprice)")
grouped("agg_21_mina", lambda: A.mina(M()), f"min({MIXED_NUMBER_SQL})")
grouped("agg_22_minif", lambda: A.minif(X(), "<>7", Y()), "min(l_extendedprice) filter (where l_quantity <> 7)")
grouped("agg_31_devsq", lambda: A.devsq(X()), "var_pop(l_quantity) * count(l_quantity)", 4)
grouped("agg_32_stdev", lambda: A.stdev(X()), "stddev_samp(l_quantity)")
grouped("agg_33_stdeva", lambda: A.stdeva(M()), f"stddev_samp({MIXED_NUMBER_SQL})")
grouped("agg_34_stdevp", lambda: A.stdevp(X()), "stddev_pop(l_quantity)")
grouped("agg_35_stdevpa", lambda: A.stdevpa(M()), f"stddev_pop({MIXED_NUMBER_SQL})")
grouped("agg_36_var", lambda: A.var(X()), "var_samp(l_quantity)")
grouped("agg_37_vara", lambda: A.vara(M()), f"var_samp({MIXED_NUMBER_SQL})")
grouped("agg_38_varp", lambda: A.varp(X()), "var_pop(l_quantity)")
grouped("agg_39_varpa", lambda: A.varpa(M()), f"var_pop({MIXED_NUMBER_SQL})")
grouped("agg_40_skew", lambda: A.skew(Y()), "skewness(l_extendedprice)", 5)
grouped("agg_41_kurt", lambda: A.kurt(Y()), "kurtosis(l_extendedprice)", 5)
grouped("agg_42_geomean", lambda: A.geomean(Y()), "exp(avg(ln(l_extendedprice)))", 4)
grouped("agg_43_harmean", lambda: A.harmean(Y()), "count(l_extendedprice) / sum(1 / l_extendedprice)", 4)
grouped("agg_44_covar", lambda: A.covar(Y(), X()), "covar_pop(l_extendedprice, l_quantity)", 3)
grouped("agg_45_correl", lambda: A.correl(Y(), X()), "corr(l_extendedprice, l_quantity)")
grouped("agg_46_pearson", lambda: A.pearson(Y(), D()), "corr(l_extendedprice, l_discount)")
grouped("agg_47_rsq", lambda: A.rsq(Y(), X()), "regr_r2(l_extendedprice, l_quantity)")
grouped("agg_48_slope", lambda: A.slope(Y(), X()), "regr_slope(l_extendedprice, l_quantity)", 4)
grouped("agg_49_intercept", lambda: A.intercept(Y(), X()), "regr_intercept(l_extendedprice, l_quantity)", 3)
grouped("agg_50_steyx", lambda: A.steyx(Y(), X()), "sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (regr_count(l_extendedprice, l_quantity) - 2))", 3)
grouped("agg_51_forecast", lambda: A.forecast(30, Y(), X()), "regr_intercept(l_extendedprice, l_quantity) + 30 * regr_slope(l_extendedprice, l_quantity)", 3)
grouped("agg_57_confidence", lambda: A.confidence(X(), 0.05), "1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(l_quantity))")


@query(
    "agg_9_subtotal",
    """select case when grouping(l_returnflag) = 1 then 'ALL' else l_returnflag end as flag, case when grouping(l_linestatus) = 1 then 'ALL' else l_linestatus end as status,
    round(avg(l_quantity), 6) as c1, count(l_quantity) as c2, count(l_quantity) as c3, max(l_quantity) as c4, min(l_quantity) as c5, round(product(1 + l_tax / 100000), 9) as c6, round(stddev_samp(l_quantity), 6) as c7,
    round(stddev_pop(l_quantity), 6) as c8, sum(l_quantity) as c9, round(var_samp(l_quantity), 6) as c10, round(var_pop(l_quantity), 6) as c11
    from lineitem group by rollup (l_returnflag, l_linestatus)""",
)
def _(t):
    codes = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    figures = [(F.round(A.subtotal(c, X()), 6) if c in (1, 7, 8, 10, 11) else A.subtotal(c, X())).alias(f"c{c}") for c in codes if c != 6]
    figures.append(F.round(A.subtotal(6, 1 + F.col("l_tax") / 100000), 9).alias("c6"))  # small factors, as a product of quantities overflows
    rows = t.lineitem.rollup(*KEYS).agg(F.grouping("l_returnflag").alias("g1"), F.grouping("l_linestatus").alias("g2"), *figures)
    return rows.select(
        F.when(F.col("g1") == 1, "ALL").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("g2") == 1, "ALL").otherwise(F.col("l_linestatus")).alias("status"), *[f"c{c}" for c in codes])


def ordered(name: str, build, sql: str, digits: int = 6) -> None:
    def run(t):
        rows = build(t.lineitem)
        return rows.select(*KEYS, F.round(F.col("value").cast("double"), digits).alias("value"))

    add(name, run, f"select {GROUPS}, round(cast({sql} as double), {digits}) as value from lineitem group by {GROUPS}")


PRICE = "l_extendedprice"
ordered("agg_23_median", lambda d: S.median(d, PRICE, KEYS), "median(l_extendedprice)", 4)
ordered("agg_25_percentile", lambda d: S.percentile(d, PRICE, 0.3, KEYS), "quantile_cont(l_extendedprice, 0.3)", 4)
ordered("agg_26_quartile", lambda d: S.quartile(d, PRICE, 3, KEYS), "quantile_cont(l_extendedprice, 0.75)", 4)

_PLACED = "with p as (select *, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) as up, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice desc) as down, count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem)\n"
add("agg_24_mode", lambda t: O.mode(t.lineitem, "l_quantity", KEYS),
    f"""with c as (select {GROUPS}, l_quantity, count(*) as n from lineitem group by all), r as (select *, row_number() over (partition by {GROUPS} order by n desc, l_quantity) as k from c)
    select {GROUPS}, case when n > 1 then l_quantity end as value from r where k = 1""")
add("agg_27_trimmean", lambda t: S.trimmed_mean(t.lineitem, PRICE, 0.2, KEYS).select(*KEYS, F.round("value", 4).alias("value")),
    _PLACED + f"select {GROUPS}, round(avg(l_extendedprice), 4) as value from p where up > floor(n * 0.2 / 2) and down > floor(n * 0.2 / 2) group by {GROUPS}")
add("agg_28_large", lambda t: S.kth_largest(t.lineitem, PRICE, 5, KEYS), _PLACED + f"select {GROUPS}, l_extendedprice as value from p where down = 5")
add("agg_29_small", lambda t: S.kth_smallest(t.lineitem, PRICE, 5, KEYS), _PLACED + f"select {GROUPS}, l_extendedprice as value from p where up = 5")
add("agg_30_avedev", lambda t: O.mean_deviation(t.lineitem, PRICE, KEYS).select(*KEYS, F.round("value", 4).alias("value")),
    f"with m as (select {GROUPS}, avg(l_extendedprice) as m from lineitem group by all) select {GROUPS}, round(avg(abs(l_extendedprice - m)), 4) as value from lineitem join m using ({GROUPS}) group by all")


@query(
    "agg_52_linest",
    f"""with s as (select {GROUPS}, regr_count(l_extendedprice, l_quantity) as n, regr_sxx(l_extendedprice, l_quantity) as sxx, regr_syy(l_extendedprice, l_quantity) as syy,
      regr_sxy(l_extendedprice, l_quantity) as sxy, regr_avgx(l_extendedprice, l_quantity) as mx, regr_slope(l_extendedprice, l_quantity) as b,
      regr_intercept(l_extendedprice, l_quantity) as a, regr_r2(l_extendedprice, l_quantity) as r2 from lineitem group by all)
    select {GROUPS}, round(b, 4) as slope, round(a, 3) as intercept, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) as slope_se,
      round(sqrt((syy - sxy * sxy / sxx) / (n - 2)) * sqrt(1.0 / n + mx * mx / sxx), 3) as intercept_se, round(r2, 6) as r2,
      round(sqrt((syy - sxy * sxy / sxx) / (n - 2)), 3) as residual_sd, cast(n as bigint) - 2 as df from s""",
)
def _(t):
    fit = A.linest(Y(), X())
    digits = {"slope": 4, "intercept": 3, "slope_se": 4, "intercept_se": 3, "r2": 6, "residual_sd": 3}
    return t.lineitem.groupBy(*KEYS).agg(*[F.round(fit[k], d).alias(k) for k, d in digits.items()], fit["df"].alias("df"))


@query(
    "agg_52_linest_through_origin",
    f"""with s as (select {GROUPS}, count(*) as n, sum(l_quantity * l_quantity) as sxx, sum(l_extendedprice * l_extendedprice) as syy, sum(l_quantity * l_extendedprice) as sxy,
      sum(l_quantity * ln(l_extendedprice)) as sxl from lineitem group by all)
    select {GROUPS}, round(sxy / sxx, 4) as slope, round(sqrt((syy - sxy * sxy / sxx) / (n - 1) / sxx), 4) as slope_se, round(sxy * sxy / sxx / syy, 6) as r2,
      cast(n as bigint) - 1 as df, round(exp(sxl / sxx), 6) as m from s""",
)
def _(t):
    fit, growth = A.linest(Y(), X(), const=False), A.logest(Y(), X(), const=False)
    digits = {"slope": 4, "slope_se": 4, "r2": 6}
    return t.lineitem.groupBy(*KEYS).agg(*[F.round(fit[k], d).alias(k) for k, d in digits.items()], fit["df"].alias("df"), F.round(growth["m"], 6).alias("m"))


@query(
    "agg_53_logest",
    f"""select {GROUPS}, round(exp(regr_slope(ln(l_extendedprice), l_quantity)), 6) as m, round(exp(regr_intercept(ln(l_extendedprice), l_quantity)), 3) as b,
    round(regr_r2(ln(l_extendedprice), l_quantity), 6) as r2 from lineitem group by {GROUPS}""",
)
def _(t):
    fit = A.logest(Y(), X())
    return t.lineitem.groupBy(*KEYS).agg(F.round(fit["m"], 6).alias("m"), F.round(fit["b"], 3).alias("b"), F.round(fit["r2"], 6).alias("r2"))


@query(
    "agg_54_trend",
    """with f as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem group by 1),
    x as (select distinct l_returnflag, l_quantity as x from lineitem) select l_returnflag, x, round(a + b * x, 3) as fitted from x join f using (l_returnflag)""",
)
def _(t):
    fit = t.lineitem.groupBy("l_returnflag").agg(A.slope(Y(), X()).alias("b"), A.intercept(Y(), X()).alias("a"))
    new_x = t.lineitem.select("l_returnflag", X().alias("x")).distinct()
    return new_x.join(fit, "l_returnflag").select("l_returnflag", "x", F.round(F.col("a") + F.col("b") * F.col("x"), 3).alias("fitted"))


@query(
    "agg_55_growth",
    """with f as (select l_returnflag, regr_slope(ln(l_extendedprice), l_quantity) as b, regr_intercept(ln(l_extendedprice), l_quantity) as a from lineitem group by 1),
    x as (select distinct l_returnflag, l_quantity as x from lineitem) select l_returnflag, x, round(exp(a) * power(exp(b), x), 3) as fitted from x join f using (l_returnflag)""",
)
def _(t):
    fit = A.logest(Y(), X())
    fitted = t.lineitem.groupBy("l_returnflag").agg(fit["m"].alias("m"), fit["b"].alias("b"))
    new_x = t.lineitem.select("l_returnflag", X().alias("x")).distinct()
    return new_x.join(fitted, "l_returnflag").select("l_returnflag", "x", F.round(F.col("b") * F.pow("m", "x"), 3).alias("fitted"))


@query(
    "agg_54_trend_through_origin",
    """with f as (select l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) as b, sum(l_quantity * ln(l_extendedprice)) / sum(l_quantity * l_quantity) as g from lineitem group by 1),
    x as (select distinct l_returnflag, l_quantity from lineitem) select l_returnflag, l_quantity, round(b * l_quantity, 3) as trend, round(power(exp(g), l_quantity), 3) as growth from x join f using (l_returnflag)""",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_quantity").distinct()
    rows = T.fitted(t.lineitem, PRICE, "l_quantity", rows, ["l_returnflag"], const=False, name="trend")
    rows = T.fitted(t.lineitem, PRICE, "l_quantity", rows, ["l_returnflag"], "exponential", const=False, name="growth")
    return rows.select("l_returnflag", "l_quantity", F.round("trend", 3).alias("trend"), F.round("growth", 3).alias("growth"))


# The SQL integrates the normal density by the midpoint rule.
@query(
    "agg_56_ztest",
    f"""with z as (select {GROUPS}, (avg(l_quantity) - 25.4) / (stddev_samp(l_quantity) / sqrt(count(l_quantity))) as z from lineitem group by all),
    s as (select {GROUPS}, z, unnest(generate_series(0, 1999)) as i from z)
    select {GROUPS}, round(z, 6) as z, round(0.5 - sum(exp(-power(z * (i + 0.5) / 2000, 2) / 2)) * z / 2000 / sqrt(2 * pi()), 6) as p_value from s group by {GROUPS}, z""",
)
def _(t):
    rows = t.lineitem.groupBy(*KEYS).agg(A.z_score(X(), 25.4).alias("z"))
    return rows.select(*KEYS, F.round("z", 6).alias("z"), F.round(A.one_sided_p(F.col("z")), 6).alias("p_value"))
