"""Registered cash-flow and schedule queries (FIN rows).

Loans and assets are orders; flows are the line items of an order in line order. Loan
sums are square roots, so that no rounded figure lies exactly between two digits.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from marketlens.functions import finance as N
from marketlens.operators import cashflow as C
from marketlens.operators import ordered as O
from marketlens.registry import add, query

KEY = ["l_orderkey"]
_ORDER = "l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_quantity"
FLOWS_SQL = f"""flows as (select l_orderkey, i, l_shipdate, case when i = 1 then -l_extendedprice else l_extendedprice * 0.4 end as v
    from (select *, row_number() over (partition by l_orderkey order by {_ORDER}) as i from lineitem))"""


def flows(t):
    # an order has a handful of lines, so they are numbered in one window per order
    line = Window.partitionBy(*KEY).orderBy(*_ORDER.split(", "))
    placed = t.lineitem.select(*KEY, *_ORDER.split(", ")).withColumn("i", F.row_number().over(line))
    amount = F.when(F.col("i") == 1, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 0.4)
    return placed.select("l_orderkey", "i", "l_shipdate", amount.alias("v"))


def _r(column, digits=4):
    return F.round(column, digits)


@query("fin_1_npv", f"with {FLOWS_SQL} select l_orderkey, round(sum(v / power(1.05::double, i)), 3) as npv from flows group by 1")
def _(t):
    return C.npv(flows(t), KEY, "i", "v", 0.05).select("l_orderkey", _r("npv", 3).alias("npv"))


@query(
    "fin_2_xnpv",
    f"""with {FLOWS_SQL}, f as (select l_orderkey, min(l_shipdate) as d0, min(v) as lo, max(v) as hi from flows group by 1)
    select l_orderkey, case when min(lo) <= 0 and max(hi) >= 0 then round(sum(v / power(1.08::double, date_diff('day', d0, l_shipdate) / 365.0::double)), 3) end as xnpv from flows join f using (l_orderkey) group by 1""",
)
def _(t):
    return C.xnpv(flows(t), KEY, "l_shipdate", "v", 0.08).select("l_orderkey", _r("xnpv", 3).alias("xnpv"))


@query(
    "fin_3_mirr",
    f"""with {FLOWS_SQL}, s as (select l_orderkey, count(*) as n, sum(case when v >= 0 then v / power(1.12::double, i - 1) else 0 end) as p, sum(case when v < 0 then v / power(1.1::double, i - 1) else 0 end) as q from flows group by 1)
    select l_orderkey, case when p <> 0 and q <> 0 and n > 1 then round(power(-p * power(1.12::double, n) / (q * 1.12), 1.0::double / (n - 1)) - 1, 6) end as mirr from s""",
)
def _(t):
    return C.mirr(flows(t), KEY, "i", "v", 0.1, 0.12).select("l_orderkey", _r("mirr", 6).alias("mirr"))


# Bisection in SQL over the logarithm of growth: one outgoing first flow makes the value fall in the
# rate, so the root is unique. Rates outside the range that the bracket can reach are null, as are
# those of investments that never pay back. Growth is compared as well as the rate, which may be huge.
def _bisection(flows_sql: str, time: str, name: str) -> str:
    return f"""with recursive {flows_sql},
    timed as (select l_orderkey, list({time}) as tm, list(v) as v, max(v) > 0 and min(v) < 0 as pays from flows group by 1),
    steps as (select 0 as k, l_orderkey, tm, v, pays, -25.0::double as lo, 130.0::double as hi from timed
      union all
      select k + 1, l_orderkey, tm, v, pays, case when f > 0 then (lo + hi) / 2 else lo end, case when f > 0 then hi else (lo + hi) / 2 end
      from (select *, list_sum([x[1] * exp(-x[2] * (lo + hi) / 2) for x in list_zip(v, [t - list_min(tm) for t in tm])]) as f from steps) where k < 60),
    roots as (select l_orderkey, case when pays and (lo + hi) / 2 between ln(1e-9) and ln(0.1) + 128 * ln(2.6) then (lo + hi) / 2 end as g from steps where k = 60)
    select l_orderkey, case when g < 5 then round(exp(g) - 1, 6) end as {name}, round(g, 6) as growth from roots"""


def _with_growth(rows, name):
    growth = F.log1p(F.col(name))
    return rows.select("l_orderkey", F.when(growth < 5, _r(name, 6)).alias(name), _r(growth, 6).alias("growth"))


@query("fin_4_irr", _bisection(FLOWS_SQL, "cast(i as double)", "irr"))
def _(t):
    return _with_growth(C.irr(flows(t), KEY, "i", "v"), "irr")


DATED_SQL = """flows as (select l_orderkey, date_diff('day', d0, l_shipdate) / 365.0::double as years, case when l_shipdate = d0 then -l_extendedprice else l_extendedprice * 0.4 end as v
    from (select *, min(l_shipdate) over (partition by l_orderkey) as d0 from lineitem))"""


@query("fin_5_xirr", _bisection(DATED_SQL, "years", "xirr"))
def _(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d0"))
    amount = F.when(F.col("l_shipdate") == F.col("d0"), -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 0.4)
    dated = t.lineitem.join(first, "l_orderkey").select("l_orderkey", "l_shipdate", amount.alias("v"))
    return _with_growth(C.xirr(dated, KEY, "l_shipdate", "v"), "xirr")


@query("fin_6_fvschedule", "select l_orderkey, round(100 * sqrt(l_orderkey + 2) * product(1 + l_tax), 4) as fv from lineitem group by 1")
def _(t):
    return C.fvschedule(t.lineitem, KEY, "l_tax", 100 * F.sqrt(F.col("l_orderkey") + 2)).select("l_orderkey", _r("fv").alias("fv"))


LOANS_SQL = "loans as (select o_orderkey, (o_custkey % 5) / 100.0::double as r, cast(3 + o_orderkey % 10 as integer) as n, 100 * sqrt(o_totalprice) as pv from orders)"
SCHEDULE_SQL = f"""with {LOANS_SQL}, pay as (select *, case when r = 0 then -pv / n else -pv * power(1 + r, n) * r / (power(1 + r, n) - 1) end as p from loans),
    steps as (select *, unnest(generate_series(1, n)) as per from pay),
    parts as (select *, -r * (pv * power(1 + r, per - 1) + p * case when r = 0 then per - 1 else (power(1 + r, per - 1) - 1) / r end) as interest from steps)"""


def loans(t):
    return t.orders.select(
        "o_orderkey", ((F.col("o_custkey") % 5) / 100).alias("r"), (3 + F.col("o_orderkey") % 10).cast("int").alias("n"), (100 * F.sqrt("o_totalprice")).alias("pv"))


def R(): return F.col("r")
def NP(): return F.col("n")
def PV(): return F.col("pv")
def PER(): return F.col("period")


def loan(name, column, sql, digits=4):
    add(name, lambda t: loans(t).select("o_orderkey", _r(column(), digits).alias("value")), f"with {LOANS_SQL} select o_orderkey, round({sql}, {digits}) as value from loans")


def per_period(name, column, sql, digits=4):
    add(name, lambda t: C.schedule(loans(t), "n").select("o_orderkey", "period", _r(column(), digits).alias("value")),
        f"{SCHEDULE_SQL} select o_orderkey, cast(per as integer) as period, round({sql}, {digits}) as value from parts")


_ANN = "case when r = 0 then n else (power(1 + r, n) - 1) / r end"
loan("fin_7_pmt", lambda: N.pmt(R(), NP(), PV(), 500.0, 1), f"(-500 - pv * power(1 + r, n)) / ((1 + r) * ({_ANN}))")
per_period("fin_8_ipmt", lambda: N.ipmt(R(), PER(), NP(), PV()), "interest")
per_period("fin_9_ppmt", lambda: N.ppmt(R(), PER(), NP(), PV()), "p - interest")
per_period("fin_10_ispmt", lambda: N.ispmt(R(), PER(), NP(), PV()), "case when per = n then 0 else -r * (pv - pv / n * per) end")


def cumulative(name, column, sql):
    def run(t):
        rows = C.schedule(loans(t), "n").filter(PER().between(2, 5))
        return rows.groupBy("o_orderkey").agg(_r(F.sum(column()), 3).alias("value"))

    add(name, run, f"{SCHEDULE_SQL} select o_orderkey, round(sum({sql}), 3) as value from parts where per between 2 and 5 group by 1")


cumulative("fin_11_cumipmt", lambda: N.ipmt(R(), PER(), NP(), PV()), "interest")
cumulative("fin_12_cumprinc", lambda: N.ppmt(R(), PER(), NP(), PV()), "p - interest")
loan("fin_13_fv", lambda: N.fv(R(), NP(), F.lit(-100.0), -PV()), f"pv * power(1 + r, n) + 100 * ({_ANN})")
loan("fin_14_pv", lambda: N.pv(R(), NP(), F.lit(-250.0), 1000.0, 1), f"(250 * (1 + r) * ({_ANN}) - 1000) / power(1 + r, n)")
loan("fin_15_nper", lambda: N.nper(R(), -PV() * 0.09, PV()), "case when r = 0 then 1 / 0.09::double else ln((-pv * 0.09::double / r) / (pv - pv * 0.09::double / r)) / ln(1 + r) end", 6)
loan("fin_16_effect", lambda: N.effect(R() + 0.01, NP()), "power(1 + (r + 0.01) / n, n) - 1", 8)
loan("fin_17_nominal", lambda: N.nominal(R() + 0.01, NP()), "n * (power(r + 1.01, 1.0::double / n) - 1)", 8)


def SALVAGE(): return PV() * 0.1


per_period("fin_18_sln", lambda: N.sln(PV(), SALVAGE(), NP()), "(pv - pv * 0.1) / n")
per_period("fin_19_syd", lambda: N.syd(PV(), SALVAGE(), NP(), PER()), "(pv - pv * 0.1) * (n - per + 1) * 2 / (n * (n + 1))")


# Declining balances run period by period in SQL and by closed form in Spark.
def _declining(rate: str, step: str) -> str:
    return f"""with recursive {LOANS_SQL}, walk as (select o_orderkey, n, pv, pv * 0.1 as salvage, 0 as per, 0.0::double as used, 0.0::double as dep from loans
      union all select o_orderkey, n, pv, salvage, per + 1, used + {step}, {step} from (select *, {rate} as q from walk) where per < n)
    select o_orderkey, cast(per as integer) as period, round(dep, 3) as value from walk where per > 0"""


add("fin_20_db", lambda t: C.schedule(loans(t), "n").select("o_orderkey", "period", _r(N.db(PV(), SALVAGE(), NP(), PER(), 7), 3).alias("value")),
    _declining("round(1 - power(0.1::double, 1.0::double / n), 3)", "case when per = 0 then pv * q * 7 / 12 else (pv - used) * q end"))
add("fin_21_ddb", lambda t: C.schedule(loans(t), "n").select("o_orderkey", "period", _r(N.ddb(PV(), SALVAGE(), NP(), PER()), 3).alias("value")),
    _declining("2.0::double / n", "least((pv - used) * q, pv - salvage - used)"))
