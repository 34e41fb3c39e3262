"""Registered date function queries (DT rows) over orders and the shipping days of line items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.functions import dates as D
from marketlens.registry import add, query



def DAY(): return F.col("o_orderdate")
def SHIP(): return F.col("l_shipdate")


HOLIDAYS = [dt.date(y, m, d) for y in range(1995, 2003) for m, d in ((1, 1), (5, 1), (10, 1), (10, 2), (12, 25))]
_FREE = "(select unnest([" + ", ".join(f"date '{h}'" for h in HOLIDAYS) + "]) as h)"


def order(name, column, sql):
    add(name, lambda t: t.orders.select("o_orderkey", column().alias("value")), f"select o_orderkey, {sql} as value from orders")


def _text(column):
    return column.cast("string")


order(
    "dt_1_date", lambda: _text(D.date(F.year(DAY()), (F.col("o_custkey") % 30 - 5).cast("int"), (F.col("o_orderkey") % 70 - 10).cast("int"))),
    "cast(cast(make_date(year(o_orderdate), 1, 1) + to_months(cast(o_custkey % 30 - 6 as integer)) + to_days(cast(o_orderkey % 70 - 11 as integer)) as date) as varchar)",
)
order(
    "dt_2_datevalue",
    lambda: _text(D.datevalue(F.when(F.col("o_custkey") % 3 == 0, F.date_format(DAY(), "yyyy/M/d")).when(F.col("o_custkey") % 3 == 1, F.date_format(DAY(), "d-MMM-yyyy")).otherwise(F.lit("no date")))),
    "case when o_custkey % 3 < 2 then cast(cast(o_orderdate as date) as varchar) end",
)
order("dt_3_time", lambda: F.round(D.time(F.col("o_custkey") % 30, F.col("o_orderkey") % 90, F.col("o_custkey") % 100), 8),
      "round(((o_custkey % 30) * 3600 + (o_orderkey % 90) * 60 + o_custkey % 100) % 86400 / 86400.0::double, 8)")
add("dt_4_timevalue", lambda t: t.events.select("event_id", F.round(D.timevalue(F.date_format("ts", "H:mm:ss")), 8).alias("value")),
    "select event_id, round((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400.0::double, 8) as value from events")

_PAIR = "(select l_orderkey, l_linenumber, l_partkey, cast(o_orderdate as date) as s, cast(l_shipdate as date) as e from orders join lineitem on o_orderkey = l_orderkey)"


def pair(name, build, sql, alter=""):
    def run(t):
        rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        return rows.select("l_orderkey", "l_linenumber", "l_partkey", *build())

    add(name, run, f"select l_orderkey, l_linenumber, l_partkey, {sql} from {_PAIR}{alter}")


_M = "((year(e) - year(s)) * 12 + month(e) - month(s) - (day(e) < day(s))::int)"
_MD = "case when day(e) < day(s) then day(e) + greatest(day(e - day(e)::int) - day(s), 0) else day(e) - day(s) end"
_YD = """case when year(e) > year(s) then case when gap < 0 then gap + 365 else gap end else date_diff('day', s, e) end"""
pair(
    "dt_5_datedif", lambda: [D.datedif(DAY(), SHIP(), u).alias(u.lower()) for u in ("D", "M", "Y", "MD", "YM", "YD")],
    f"""case when s < e then date_diff('day', s, e) end as d, case when s < e then {_M} end as m,
    case when s < e then year(e) - year(s) - (strftime(e, '%m%d') < strftime(s, '%m%d'))::int end as y, case when s < e then {_MD} end as md,
    case when s < e then (month(e) - month(s) + 12) % 12 - (day(e) < day(s))::int end as ym, case when s < e then {_YD} end as yd""",
    """ cross join lateral (select dayofyear(case when month(e) = 2 and day(e) = 29 and not (year(s) % 4 = 0 and (year(s) % 100 <> 0 or year(s) % 400 = 0)) then make_date(year(s), 3, 1)
      else make_date(year(s), month(e), day(e)) end) - dayofyear(s) as gap)""",
)
_US_FROM = "case when day(s) = 31 or (month(s) = 2 and s = last_day(s)) then 30 else day(s) end"
_US = f"((case when day(e) = 31 and ({_US_FROM}) = 30 then 30 else day(e) end) + month(e) * 30 + year(e) * 360 - ({_US_FROM}) - month(s) * 30 - year(s) * 360)"
_EU = "(least(day(e), 30) + month(e) * 30 + year(e) * 360 - least(day(s), 30) - month(s) * 30 - year(s) * 360)"
pair("dt_6_days360", lambda: [D.days360(DAY(), SHIP()).alias("us"), D.days360(DAY(), SHIP(), True).alias("eu")], f"{_US} as us, {_EU} as eu")

_LEAP = "(({0} % 4 = 0 and {0} % 100 <> 0) or {0} % 400 = 0)"
_LY, _EY = _LEAP.format("year(s)"), _LEAP.format("year(e)")
_DAYS = "date_diff('day', s, e)"
_LATE = "(month(e) * 100 + day(e) >= 229)"
pair(
    "dt_7_yearfrac", lambda: [F.round(D.yearfrac(DAY(), SHIP(), b), 8).alias(f"b{b}") for b in range(5)],
    f"""round({_US} / 360, 8) as b0, case when s < e then round({_DAYS} / (365 + case when year(s) = year(e) then ({_EY} and (month(s) < 3 or {_LATE}))::int
      when year(e) = year(s) + 1 and leaps = 0 and {_LY} and {_DAYS} > 365 then 0.5 when year(e) = year(s) + 1 and {_DAYS} < 366 then leaps
      else leaps / (year(e) - year(s) + 1) end), 8) end as b1,
    case when s < e then round({_DAYS} / 360, 8) end as b2, case when s < e then round({_DAYS} / 365, 8) end as b3, round({_EU} / 360, 8) as b4""",
    """ cross join lateral (select ((month(s) < 3 and """ + _LY + """)::int + greatest(0, ((year(e) - 1) // 4 - (year(e) - 1) // 100 + (year(e) - 1) // 400) - (year(s) // 4 - year(s) // 100 + year(s) // 400))
      + (""" + _LATE + " and " + _EY + """)::int)::double as leaps)""",
)

# Working days are counted on a calendar in SQL and by arithmetic in Spark.
_CALENDAR = f"""cal as (select cast(d as date) as d, isodow(d) < 6 and cast(d as date) not in (select h from {_FREE}) as w from generate_series(date '1994-01-01', date '2003-12-31', interval 1 day) g(d)),
    counted as (select d, w, sum(w::int) over (order by d) as n from cal)"""


@query(
    "dt_8_networkdays",
    f"""with {_CALENDAR} select l_orderkey, l_linenumber, l_partkey, cast(case when s <= e then b.n - a.n + a.w::int else -(a.n - b.n + b.w::int) end as bigint) as value
    from {_PAIR} join counted a on a.d = s join counted b on b.d = e""",
)
def _(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", D.networkdays(DAY(), SHIP(), HOLIDAYS).alias("value"))


@query(
    "dt_9_workday",
    f"""with {_CALENDAR}, works as (select n, min(d) as d from counted where w group by n)
    select o_orderkey, cast(f.d as varchar) as after_8, cast(b.d as varchar) as before_13 from orders join counted c on c.d = cast(o_orderdate as date)
    join works f on f.n = c.n + 8 join works b on b.n = c.n - 13 + (1 - c.w::int)""",
)
def _(t):
    return t.orders.select("o_orderkey", _text(D.workday(DAY(), 8, HOLIDAYS)).alias("after_8"), _text(D.workday(DAY(), -13, HOLIDAYS)).alias("before_13"))


@query(
    "dt_9_workday_of_columns",
    f"""with {_CALENDAR}, works as (select n, min(d) as d from counted where w group by n),
    steps as (select o_orderkey, cast(o_orderdate as date) as s, o_orderkey % 41 - 20 as k from orders)
    select o_orderkey, cast(case when k = 0 then s else f.d end as varchar) as value
    from steps join counted c on c.d = s join works f on f.n = c.n + k + case when k < 0 then 1 - c.w::int else 0 end""",
)
def _(t):
    return t.orders.select("o_orderkey", _text(D.workday(DAY(), F.col("o_orderkey") % 41 - 20, HOLIDAYS)).alias("value"))


order("dt_10_day", lambda: D.day(DAY()), "cast(day(o_orderdate) as integer)")
order("dt_11_month", lambda: D.month(DAY()), "cast(month(o_orderdate) as integer)")
order("dt_12_year", lambda: D.year(DAY()), "cast(year(o_orderdate) as integer)")


def event(name, column, sql):
    add(name, lambda t: t.events.select("event_id", column().alias("value")), f"select event_id, {sql} as value from events")


event("dt_13_hour", lambda: D.hour(F.col("ts")), "cast(hour(ts) as integer)")
event("dt_14_minute", lambda: D.minute(F.col("ts")), "cast(minute(ts) as integer)")
event("dt_15_second", lambda: D.second(F.col("ts")), "cast(floor(second(ts)) as integer)")
order("dt_16_weekday", lambda: (D.weekday(DAY(), 1) * 100 + D.weekday(DAY(), 2) * 10 + D.weekday(DAY(), 3)).cast("int"),
      "cast((dayofweek(o_orderdate) + 1) * 100 + isodow(o_orderdate) * 10 + isodow(o_orderdate) - 1 as integer)")
_W = "(ceil((dayofyear(o_orderdate) - 1 - (7 - (dayofweek(date_trunc('year', o_orderdate)) + {0}) % 7)) / 7.0) + 1)"
order("dt_17_weeknum", lambda: D.weeknum(DAY(), 1) * 100 + D.weeknum(DAY(), 2), f"cast({_W.format(1)} * 100 + {_W.format(0)} as integer)")
order("dt_18_now", lambda: (D.now() > DAY().cast("timestamp")).cast("int"), "cast(current_timestamp > o_orderdate::timestamptz as integer)")
order("dt_19_today", lambda: (D.today() > F.to_date(DAY())).cast("int"), "cast(current_date > cast(o_orderdate as date) as integer)")
order("dt_20_edate", lambda: _text(D.edate(DAY(), -5)), "cast(cast(cast(o_orderdate as date) - interval 5 months as date) as varchar)")
order("dt_21_eomonth", lambda: _text(D.eomonth(DAY(), 2)), "cast(last_day(cast(cast(o_orderdate as date) + interval 2 months as date)) as varchar)")
