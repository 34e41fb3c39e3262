"""Registered filter queries (FLT rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.functions import predicates as P
from marketlens.operators import listfilter as L
from marketlens.operators import runs as R
from marketlens.plans import standins as S
from marketlens.plans.runs import EFFECTS_SQL, RUNS_SQL, effects, runs  # noqa: F401
from marketlens.registry import query

_M = S.cte("members")


@query("flt_1_missing", _M + "select member_no from members where (named = '1' and balance > 5000) or sex is null or risk_level is null")
def _(t):
    p = P.group_predicate(
        [P.equals_any("named", ["是"]), F.col("balance") > 5000], [P.is_missing("sex"), P.is_missing("risk_level")]
    )
    return S.members(t).filter(p).select("member_no")


@query("flt_2_equal_or_in", _M + "select member_no, sex from members where (sex = '男' or sex is null) and named in ('0')")
def _(t):
    p = P.group_predicate([P.equals_any("sex", ["男"]) | P.is_missing("sex"), P.equals_any("named", ["否"])], [])
    return S.members(t).filter(p).select("member_no", "sex")


@query("flt_3_comma_list", _M + "select member_no from members where device_type in ('BUILDING','FURNITURE','MACHINERY')")
def _(t):
    p = P.equals_any("device_type", P.comma_values("BUILDING，FURNITURE,MACHINERY"))
    return S.members(t).filter(p).select("member_no")


@query(
    "flt_4_number_ranges",
    "select o_orderkey, o_totalprice from orders where (o_totalprice >= 1000 and o_totalprice <= 20000) or (o_totalprice >= 300000 and o_totalprice <= 310000)",
)
def _(t):
    return t.orders.filter(P.in_ranges("o_totalprice", [(1000, 20000), (300000, 310000)])).select("o_orderkey", "o_totalprice")


@query(
    "flt_5_date_ranges",
    """select o_orderkey from orders where (cast(o_orderdate as date) >= date '1996-02-28' and cast(o_orderdate as date) <= date '1996-03-02')
    or (cast(o_orderdate as date) >= date '1998-12-30' and cast(o_orderdate as date) <= date '1999-01-05')""",
)
def _(t):
    p = P.in_date_ranges("o_orderdate", [("1996-02-28", "1996-03-02"), ("1998-12-30", "1999-01-05")])
    return t.orders.filter(p).select("o_orderkey")


@query("flt_6_conjunction", _M + "select member_no from members where named = '1' and balance between 0 and 5000 and device_type in ('BUILDING','HOUSEHOLD')")
def _(t):
    p = P.group_predicate(
        [P.equals_any("named", ["是"]), P.in_ranges("balance", [(0, 5000)]), P.equals_any("device_type", ["BUILDING", "HOUSEHOLD"])],
        [],
    )
    return S.members(t).filter(p).select("member_no")


@query("flt_7_contains_words", "select p_partkey, p_name from part where p_name like '%red%' or p_name like '%bolt%'")
def _(t):
    return t.part.filter(P.contains_any("p_name", ["red", "bolt"])).select("p_partkey", "p_name")


@query(
    "flt_8_status_and_type",
    S.cte("trades") + """select status, fund_trans_type, count(*) as n, cast(sum(fund_trans_amount) as double) as amount
    from trades where status in (6,8,9,11) and fund_trans_type = 1 group by all""",
)
def _(t):
    rows = S.trades(t).filter(F.col("status").isin(6, 8, 9, 11) & (F.col("fund_trans_type") == 1))
    return rows.groupBy("status", "fund_trans_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fund_trans_amount").cast("double").alias("amount")
    )


@query(
    "flt_9_date_window",
    S.cte("issues", "trades") + """select 'issue' as kind, count(*) as n from issues where cast(create_time as date) between date '1997-01-05' and date '1997-01-15'
    union all select 'trade', count(*) from trades where cast(trans_time as date) between date '1997-01-05' and date '1997-06-30'""",
)
def _(t):
    a = S.issues(t).filter(P.in_date_ranges("create_time", [("1997-01-05", "1997-01-15")]))
    b = S.trades(t).filter(P.in_date_ranges("trans_time", [("1997-01-05", "1997-06-30")]))
    n = F.count(F.lit(1)).alias("n")
    return a.agg(n).select(F.lit("issue").alias("kind"), "n").unionByName(b.agg(n).select(F.lit("trade").alias("kind"), "n"))


@query(
    "flt_10_recycle_flags",
    f"""with runs as ({RUNS_SQL}), flagged as (select id, submitter, case when submitter = 'user3' then 1 else recycle end as recycle from runs)
    select case when recycle = 1 then 'recycled' else 'active' end as state, submitter, count(*) as n from flagged group by all""",
)
def _(t):
    flagged = R.set_recycled(runs(t), F.col("submitter") == "user3", True)
    active, recycled = R.active(flagged), R.recycled(flagged)
    both = active.withColumn("state", F.lit("active")).unionByName(recycled.withColumn("state", F.lit("recycled")))
    return both.groupBy("state", "submitter").agg(F.count(F.lit(1)).alias("n"))


_BLANKED = "case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then '' else o_orderpriority end"


def _blanked(t):
    c = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderpriority"))
    return t.orders.withColumn("priority", c)


@query(
    "flt_11_values_and_blanks",
    f"select o_orderkey, priority from (select o_orderkey, {_BLANKED} as priority from orders) where priority in ('1-URGENT','5-LOW') or priority is null or priority = ''",
)
def _(t):
    return _blanked(t).filter(L.in_values(F.col("priority"), ["1-URGENT", "5-LOW"], blanks=True)).select("o_orderkey", "priority")


@query(
    "flt_12_date_groups",
    "select event_id from events where strftime(ts, '%Y%m%d%H%M%S') like '20240103%' or strftime(ts, '%Y%m%d%H%M%S') like '2024011508%'",
)
def _(t):
    return t.events.filter(L.in_date_groups(F.col("ts"), ["20240103", "2024011508"])).select("event_id")


@query(
    "flt_13_custom_rules",
    f"""select o_orderkey from (select *, {_BLANKED} as priority from orders)
    where (o_totalprice >= 1000 and o_totalprice < 250000) and (lower(priority) like '%urgent' or lower(priority) like '_-low')""",
)
def _(t):
    return L.passing(_blanked(t), [
        L.custom(F.col("o_totalprice"), [(">=", 1000), ("<", 250000)], "and"),
        L.custom(F.col("priority"), [("=", "*Urgent"), ("=", "?-low")], "or"),
    ]).select("o_orderkey")


@query(
    "flt_14_month_or_quarter",
    """select 'months' as kind, count(*) as n from orders where month(o_orderdate) in (2, 11)
    union all select 'quarter', count(*) from orders where quarter(o_orderdate) = 3""",
)
def _(t):
    d = F.col("o_orderdate")
    return t.orders.agg(
        F.count_if(L.in_months(d, [2, 11])).alias("months"), F.count_if(L.in_quarter(d, 3)).alias("quarter")
    ).unpivot([], ["months", "quarter"], "kind", "n")


_REL = {
    "yesterday": ("1998-08-11", "1998-08-12"), "today": ("1998-08-12", "1998-08-13"), "tomorrow": ("1998-08-13", "1998-08-14"),
    "lastWeek": ("1998-08-02", "1998-08-09"), "thisWeek": ("1998-08-09", "1998-08-16"), "nextWeek": ("1998-08-16", "1998-08-23"),
    "lastMonth": ("1998-07-01", "1998-08-01"), "thisMonth": ("1998-08-01", "1998-09-01"), "nextMonth": ("1998-09-01", "1998-10-01"),
    "lastQuarter": ("1998-04-01", "1998-07-01"), "thisQuarter": ("1998-07-01", "1998-10-01"), "nextQuarter": ("1998-10-01", "1999-01-01"),
    "lastYear": ("1997-01-01", "1998-01-01"), "thisYear": ("1998-01-01", "1999-01-01"), "nextYear": ("1999-01-01", "2000-01-01"),
    "yearToDate": ("1998-01-01", "1998-08-13"),
}


@query(
    "flt_15_relative_dates",
    " union all ".join(
        f"select '{k}' as kind, count(*) as n from orders where o_orderdate >= timestamp '{a}' and o_orderdate < timestamp '{b}'"
        for k, (a, b) in _REL.items()
    ),
)
def _(t):
    today = dt.date(1998, 8, 12)
    counts = [F.count_if(L.in_relative_range(F.col("o_orderdate"), k, today)).alias(k) for k in _REL]
    return t.orders.agg(*counts).unpivot([], list(_REL), "kind", "n")


@query(
    "flt_16_beside_average",
    """select 'above' as kind, o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)
    union all select 'below_in_status', o.o_orderkey from orders o join (select o_orderstatus as s, avg(o_totalprice) as m from orders group by 1) on o.o_orderstatus = s
    where o_totalprice < m""",
)
def _(t):
    above = L.beside_average(t.orders, "o_totalprice").select(F.lit("above").alias("kind"), "o_orderkey")
    below = L.beside_average(t.orders, "o_totalprice", above=False, keys=["o_orderstatus"])
    return above.unionByName(below.select(F.lit("below_in_status").alias("kind"), "o_orderkey"))


@query(
    "flt_17_top_and_bottom",
    """with v as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, l_extendedprice from lineitem),
    q as (select l_quantity, row_number() over (order by l_quantity desc) as d, row_number() over (order by l_extendedprice) as a, l_extendedprice from v where l_quantity <> 0),
    g as (select l_returnflag as f, min(l_extendedprice) as e from (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice desc) as n from v) where n <= 10 group by 1)
    select 'top' as kind, count(*) as n, cast(sum(l_quantity) as double) as total from v where l_quantity >= (select min(l_quantity) from q where d <= 20)
    union all select 'bottom', count(*), round(sum(l_extendedprice), 2) from v where l_extendedprice <= (select max(l_extendedprice) from q where a <= 15)
    union all select 'grouped', count(*), round(sum(l_extendedprice), 2) from v join g on l_returnflag = f where l_extendedprice >= e
    union all select 'percent', count(*), cast(sum(l_quantity) as double) from v where l_quantity >= (select min(l_quantity) from q where d <= (select greatest(1, floor(0.5 * count(*) / 100)) from v))""",
)
def _(t):
    li = t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice")
    n, total = F.count(F.lit(1)).alias("n"), lambda c: F.round(F.sum(c), 2).alias("total")
    parts = [
        ("top", L.top_n(li, "l_quantity", 20).agg(n, total("l_quantity"))),
        ("bottom", L.top_n(li, "l_extendedprice", 15, top=False).agg(n, total("l_extendedprice"))),
        ("grouped", L.top_n(li, "l_extendedprice", 10, keys=["l_returnflag"]).agg(n, total("l_extendedprice"))),
        ("percent", L.top_percent(li, "l_quantity", 0.5).agg(n, total("l_quantity"))),
    ]
    frames = [f.select(F.lit(k).alias("kind"), "n", "total") for k, f in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query(
    "flt_18_every_column_passes",
    """select o_orderkey from orders where o_orderstatus in ('F','O') and month(o_orderdate) = 5 and o_totalprice > 100000
    and lower(o_orderpriority) like '%e%'""",
)
def _(t):
    return L.passing(t.orders, [
        L.in_values(F.col("o_orderstatus"), ["F", "O"]), L.in_months(F.col("o_orderdate"), [5]),
        L.custom(F.col("o_totalprice"), [(">", 100000)]), L.custom(F.col("o_orderpriority"), [("=", "*e*")]),
    ]).select("o_orderkey")


@query(
    "flt_19_validation_report",
    """with f as (select count(*) as checked, count(*) filter (where l_returnflag not in ('A','N')) as flag_list,
      count(*) filter (where not (l_quantity between 5 and 45) or l_quantity <> floor(l_quantity)) as whole_quantity,
      count(*) filter (where l_discount > 0.08) as small_discount,
      count(*) filter (where cast(l_shipdate as date) < date '1996-01-01') as ship_day,
      count(*) filter (where length(l_linestatus) <> 1) as status_length,
      count(*) filter (where l_tax >= 0.02 and l_tax <= 0.03) as tax_outside from lineitem)
    select checked, rule_name, rejected from f unpivot (rejected for rule_name in (flag_list, whole_quantity, small_discount, ship_day, status_length, tax_outside))""",
)
def _(t):
    rules = {
        "flag_list": L.validation_rule("list", "l_returnflag", choices=["A", "N"]),
        "whole_quantity": L.validation_rule("whole", "l_quantity", "between", 5, 45),
        "small_discount": L.validation_rule("decimal", "l_discount", "lessThanOrEqual", 0.08),
        "ship_day": L.validation_rule("date", "l_shipdate", "greaterThanOrEqual", dt.date(1996, 1, 1)),
        "status_length": L.validation_rule("textLength", "l_linestatus", "equal", 1),
        "tax_outside": L.validation_rule("decimal", "l_tax", "notBetween", 0.02, 0.03),
    }
    return L.validation_report(t.lineitem, rules)
