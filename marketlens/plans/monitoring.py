"""Registered monitoring row sets (MON rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import monitoring as M
from marketlens.registry import query

REF = dt.date(2024, 1, 20)
# Activities are events: signup, view, click, purchase and error stand for the five kinds.
ACT = """with act as (select cast(user_id as varchar) as member_no, case event_type when 'signup' then 'register' when 'view' then 'certify' when 'click' then 'bind' when 'purchase' then 'deal' else 'withdraw' end as kind,
    ts as happened, value as amount, 'ch' || cast(user_id % 8 as varchar) as channel, 'sub' || cast(user_id % 3 as varchar) as sub_channel, cast(json_extract_string(props, '$.k') as bigint) % 20 as coupon from events)
"""
_DEAL = "filter (where kind = 'deal')"


def activities(t):
    e = F.col("event_type")
    kind = (
        F.when(e == "signup", M.REGISTER).when(e == "view", M.CERTIFY).when(e == "click", M.BIND).when(e == "purchase", M.DEAL).otherwise(M.WITHDRAW)
    )
    return t.events.select(
        F.col("user_id").cast("string").alias("member_no"), kind.alias("kind"), F.col("ts").alias("at"), F.col("value").alias("amount"),
        F.concat(F.lit("ch"), (F.col("user_id") % 8).cast("string")).alias("channel"),
        F.concat(F.lit("sub"), (F.col("user_id") % 3).cast("string")).alias("sub_channel"),
        (F.get_json_object("props", "$.k").cast("bigint") % 20).alias("coupon"))


def _r(*names, digits=2):
    return [F.round(n, digits).alias(n) for n in names]


@query(
    "mon_1_day_totals",
    ACT + f"""select cast(date_diff('day', cast(happened as date), date '2024-01-20') as integer) as time_key, case date_diff('day', cast(happened as date), date '2024-01-20') when 0 then 'today' when 1 then 'yesterday' else 'day before' end as time_name,
    count(*) filter (where kind = 'register') as register_count, count(*) {_DEAL} as deal_count, round(sum(amount) {_DEAL}, 2) as deal_amount
    from act where cast(happened as date) between date '2024-01-18' and date '2024-01-20' group by 1, 2""",
)
def _(t):
    return M.day_totals(activities(t), REF).select("time_key", "time_name", "register_count", "deal_count", *_r("deal_amount"))


@query(
    "mon_2_hour_curve",
    ACT + """select cast(hour(happened) as integer) as hour, round(sum(amount) filter (where cast(happened as date) = date '2024-01-20'), 2) as today_hour, round(sum(amount) filter (where cast(happened as date) = date '2024-01-19'), 2) as yesterday_hour
    from act where kind = 'deal' and cast(happened as date) between date '2024-01-19' and date '2024-01-20' group by 1""",
)
def _(t):
    return M.hour_curve(activities(t), REF).select("hour", *_r("today_hour", "yesterday_hour"))


def _month(end: str) -> str:
    return f"""select count(*) filter (where kind = 'register') as register_nums, count(*) filter (where kind = 'certify') as realname_nums, count(*) filter (where kind = 'bind') as bind_nums,
    count(*) {_DEAL} as trans_nums, round(sum(amount) {_DEAL}, 2) as trans_values,
    (select count(*) from (select member_no from act where kind = 'deal' group by 1 having cast(min(happened) as date) between date '2024-01-01' and date '{end}')) as new_trans_nums,
    (select round(sum(amount), 2) from act where kind = 'deal' and cast(happened as date) <= date '{end}' and member_no in (select member_no from act where kind = 'deal' group by 1 having cast(min(happened) as date) between date '2024-01-01' and date '{end}')) as new_trans_values
    from act where cast(happened as date) between date '2024-01-01' and date '{end}'"""


@query("mon_3_month_figures", ACT + f"select 'to date' as span, * from ({_month('2024-01-20')}) union all select 'whole', * from ({_month('2024-01-31')})")
def _(t):
    a = M.month_figures(activities(t), REF).withColumn("span", F.lit("to date"))
    b = M.month_figures(activities(t), REF, whole=True).withColumn("span", F.lit("whole"))
    rows = a.unionByName(b)
    return rows.select("span", "register_nums", "realname_nums", "bind_nums", "trans_nums", "new_trans_nums", *_r("trans_values", "new_trans_values"))


@query(
    "mon_4_coupon_use",
    ACT + """select case when grouping(k) = 1 then 'TOTAL' else k end as coupon_kind, case when grouping(c) = 1 then 'TOTAL' else c end as coupon, count(distinct member_no) as coupon_users, count(*) as coupon_orders,
    round(sum(amount), 2) as coupon_order_values, round(sum(amount * 0.03), 2) as coupon_profit_values from (select *, case when coupon % 2 = 0 then 'cash' else 'rate' end as k, cast(coupon as varchar) as c from act where kind = 'deal') group by rollup (k, c)""",
)
def _(t):
    rows = M.coupon_use(activities(t), F.when(F.col("coupon") % 2 == 0, "cash").otherwise("rate"), F.col("amount") * 0.03)
    return rows.select("coupon_kind", "coupon", "coupon_users", "coupon_orders", *_r("coupon_order_values", "coupon_profit_values"))


@query("mon_5_withdrawals", ACT + """select case when grouping(d) = 1 then 'TOTAL' else d end as day, count(*) as n, round(sum(amount), 2) as amount from (select *, cast(cast(happened as date) as varchar) as d from act where kind = 'withdraw' and cast(happened as date) between date '2024-01-01' and date '2024-01-31') group by rollup (d)""")
def _(t):
    return M.withdrawals(activities(t), REF).select("day", "n", *_r("amount"))


@query(
    "mon_6_channels",
    ACT + f"""select case when grouping(channel) = 1 then 'TOTAL' else channel end as channel, case when grouping(sub_channel) = 1 then 'TOTAL' else sub_channel end as sub_channel,
    count(*) filter (where kind = 'register') as register_count, count(*) {_DEAL} as deal_count, round(coalesce(sum(amount) {_DEAL}, 0), 2) as deal_amount from act group by rollup (act.channel, act.sub_channel)""",
)
def _(t):
    return M.channel_counts(activities(t)).select("channel", "sub_channel", "register_count", "deal_count", *_r("deal_amount"))


@query(
    "mon_7_amount_ranges",
    """select case when l_extendedprice < 1000 then '<1000' when l_extendedprice < 10000 then '1000-10000' when l_extendedprice < 50000 then '10000-50000' else '>=50000' end as amount_range,
    count(*) as n, round(sum(l_extendedprice), 2) as amount from lineitem group by 1""",
)
def _(t):
    return M.amount_ranges(t.lineitem, "l_extendedprice", [1000, 10000, 50000]).select("amount_range", "n", *_r("amount"))


@query("mon_8_product_sums", "select p_name, count(*) as n, round(sum(l_extendedprice), 2) as amount from lineitem join part on l_partkey = p_partkey group by 1")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return M.product_sums(rows, "p_name", "l_extendedprice").select("p_name", "n", *_r("amount"))


_TERMS = (3, 6, 9, 12, 18, 24)


@query(
    "mon_9_hour_bands",
    "with e as (select cast(floor(hour(ts) / 6) as integer) as hour_type, [3, 6, 9, 12, 18, 24][user_id % 6 + 1] as term, value from events where event_type = 'purchase') select hour_type, "
    + ", ".join(f"round(coalesce(sum(value) filter (where term = {m}), 0), 2) as m_{m}_values" for m in _TERMS) + " from e group by 1",
)
def _(t):
    term = F.element_at(F.array(*[F.lit(m) for m in _TERMS]), (F.col("user_id") % 6).cast("int") + 1)
    rows = t.events.filter(F.col("event_type") == "purchase").withColumn("term", term)
    return M.hour_bands(rows, "ts", "term", "value").select("hour_type", *_r(*[f"m_{m}_values" for m in _TERMS]))


_SEVEN = ACT + "select channel, " + ", ".join(
    f"round(sum(case when date_diff('day', cast(happened as date), date '2024-01-20') = {k} then amount else 0 end), 2) as trans_amt_sub{k}d" for k in range(1, 8)
) + " from act where kind = 'deal' and cast(happened as date) between date '2024-01-13' and date '2024-01-19' group by 1"


def _seven(t):
    return M.last_seven_days(activities(t).filter(F.col("kind") == M.DEAL), "channel", "at", "amount", REF)


@query("mon_10_last_seven_days", _SEVEN)
def _(t):
    return _seven(t).select("channel", *_r(*[f"trans_amt_sub{k}d" for k in range(1, 8)]))


@query(
    "mon_11_factor_correlation",
    """select 'l_quantity' as factor, round(corr(l_quantity, l_extendedprice), 6) as variable_corr from lineitem union all select 'l_discount', round(corr(l_discount, l_extendedprice), 6) from lineitem
    union all select 'l_tax', round(corr(l_tax, l_extendedprice), 6) from lineitem""",
)
def _(t):
    rows = M.factor_correlation(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return rows.select("factor", F.round("variable_corr", 6).alias("variable_corr"))


_DAILY = "daily as (select o_orderpriority as series, cast(o_orderdate as date) as d, sum(o_totalprice) as amt from orders group by 1, 2)"


def _daily(t):
    return M.daily_trend(t.orders.withColumnRenamed("o_orderpriority", "series"), ["series"], "o_orderdate", "o_totalprice")


def _day(c="trans_date"):
    return F.col(c).cast("string").alias(c)


@query("mon_12_daily_trend", f"with {_DAILY} select series, cast(d as varchar) as trans_date, round(amt, 2) as trans_amount, round(avg(amt) over (partition by series order by d rows between 6 preceding and current row), 2) as mv_trans_amount from daily")
def _(t):
    return _daily(t).select("series", _day(), *_r("trans_amount", "mv_trans_amount"))


_MASKED = """daily as (select channel as series, cast(happened as date) as d, sum(case when kind = 'deal' and amount > 60 then amount else 0 end) as amt from act group by 1, 2),
    mv as (select series, d, amt, max(amt) over (partition by series order by d rows between 1 preceding and current row) * (amt > 0)::int as mv from daily)"""


@query(
    "mon_13_masked_trend",
    ACT.rstrip() + ", " + _MASKED + """ select series, cast(d as varchar) as trans_date, round(case when mv = 0 and coalesce(lag(mv) over (partition by series order by d), 0) = 0 then null else mv end, 2) as mv_trans_amount from mv""",
)
def _(t):
    from pyspark.sql import Window

    amount = F.when((F.col("kind") == M.DEAL) & (F.col("amount") > 60), F.col("amount")).otherwise(0.0)
    daily = activities(t).groupBy(F.col("channel").alias("series"), F.to_date("at").alias("trans_date")).agg(F.sum(amount).alias("trans_amount"))
    w = Window.partitionBy("series").orderBy("trans_date").rowsBetween(-1, 0)
    daily = daily.withColumn("mv_trans_amount", F.max("trans_amount").over(w) * (F.col("trans_amount") > 0).cast("int"))
    return M.masked_trend(daily, ["series"]).select("series", _day(), *_r("mv_trans_amount"))


@query(
    "mon_14_signals",
    f"with w as ({_SEVEN.replace('with act', 'with recursive act')}), m as (select *, (trans_amt_sub1d + trans_amt_sub2d + trans_amt_sub3d + trans_amt_sub4d + trans_amt_sub5d + trans_amt_sub6d + trans_amt_sub7d) / 7 as mean from w), "
    + "s as (select *, sqrt((" + " + ".join(f"power(trans_amt_sub{k}d - mean, 2)" for k in range(1, 8)) + ") / 7) as sd from m) "
    + "select channel, case when trans_amt_sub1d >= mean - sd then 'green' when trans_amt_sub1d >= mean - 2 * sd then 'yellow' else 'red' end as signal from s",
)
def _(t):
    return M.signals(_seven(t), "channel").select("channel", "signal")


@query(
    "mon_15_actual_and_predicted",
    f"""with {_DAILY}, x as (select *, date_diff('day', date '1970-01-01', d)::double as x from daily), f as (select series, regr_slope(amt, x) as b, regr_intercept(amt, x) as a from x group by 1)
    select series, cast(d as varchar) as trans_date, round(amt, 2) as trans_amount, round(a + b * x, 2) as pre_amount from x join f using (series)""",
)
def _(t):
    return M.actual_and_predicted(_daily(t), ["series"]).select("series", _day(), *_r("trans_amount", "pre_amount"))


@query(
    "mon_16_channel_funnel",
    ACT.rstrip() + """, c as (select channel, count(distinct member_no) filter (where kind = 'register') as reg_cnt, count(distinct member_no) filter (where kind = 'certify') as cert_cnt,
      count(distinct member_no) filter (where kind = 'bind') as card_cnt, count(distinct member_no) filter (where kind = 'deal') as trans_cnt from act group by 1)
    select *, round(cert_cnt / nullif(reg_cnt, 0), 6) as reg_cert_rate, round(card_cnt / nullif(cert_cnt, 0), 6) as cert_card_rate, round(trans_cnt / nullif(card_cnt, 0), 6) as card_trans_rate, round(trans_cnt / nullif(reg_cnt, 0), 6) as reg_trans_rate from c""",
)
def _(t):
    return M.channel_funnel(activities(t)).select(
        "channel", "reg_cnt", "cert_cnt", "card_cnt", "trans_cnt", *_r("reg_cert_rate", "cert_card_rate", "card_trans_rate", "reg_trans_rate", digits=6))


@query("mon_17_sorted", "select c_custkey, c_acctbal from customer order by c_acctbal desc")
def _(t):
    return M.sorted_by(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", ascending=False)


_MEASURES = ["members", "balance", "orders", "amount"]


def _channels(t):
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    rows = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("channel")).agg(
        F.count(F.lit(1)).cast("double").alias("members"), F.avg("c_acctbal").alias("balance"), F.avg("n").alias("orders"), F.avg("s").alias("amount"))


def _clusters_sql(k: int, rounds: int) -> str:
    """Farthest-first centres and a fixed number of rounds, one table after the other."""
    z = lambda m: f"coalesce(({m} - avg({m}) over ()) / stddev_samp({m}) over (), 0)"
    gap = lambda a, b: " + ".join(f"({a}.{m} - {b}.{m}) * ({a}.{m} - {b}.{m})" for m in _MEASURES)
    parts = [
        """channels as materialized (select 'nation' || c_nationkey as channel, count(*)::double as members, avg(c_acctbal) as balance, avg(n) as orders, avg(s) as amount from customer
        left join (select o_custkey, count(*) as n, sum(o_totalprice) as s from orders group by 1) on c_custkey = o_custkey group by 1)""",
        "z as materialized (select channel, " + ", ".join(f"{z(m)} as {m}" for m in _MEASURES) + " from channels)",
        "s0 as materialized (select 0 as label, * exclude (channel) from z order by " + " + ".join(f"{m} * {m}" for m in _MEASURES) + " desc, channel limit 1)",
    ]
    for i in range(1, k):
        parts.append(f"""s{i} as materialized (select * from s{i - 1} union all (select {i}, {', '.join(f'z.{m}' for m in _MEASURES)} from z, s{i - 1} s group by all
            order by (select min({gap('y', 's')}) from z y, s{i - 1} s where y.channel = any_value(z.channel)) desc, any_value(z.channel) limit 1))""")
    before = f"s{k - 1}"
    for r in range(rounds + 1):
        parts.append(f"l{r} as materialized (select z.*, arg_min(label, (d, label)) as clus_label, min(d) as d from z join (select channel, label, {gap('z', 'c')} as d from z, {before} c) g using (channel) group by all)"
                     .replace("select z.*, arg_min", f"select channel, {', '.join(_MEASURES)}, arg_min"))
        if r < rounds:
            parts.append(f"c{r} as materialized (select b.label, " + ", ".join(f"coalesce(m.{m}, b.{m}) as {m}" for m in _MEASURES) + f" from {before} b left join (select clus_label as label, "
                         + ", ".join(f"avg({m}) as {m}" for m in _MEASURES) + f" from l{r} group by 1) m using (label))")
            before = f"c{r}"
    return "with " + ", ".join(parts) + f""" select channel, clus_label::integer as clus_label, count(*) over (partition by clus_label) as channel_count,
        first(channel) over (partition by clus_label order by d, channel) as cent_channel from l{rounds}"""


@query("mon_18_channel_clusters", _clusters_sql(4, 12))
def _(t):
    return M.channel_clusters(_channels(t), "channel", _MEASURES, 4, 12).select("channel", "clus_label", "channel_count", "cent_channel")


@query(
    "mon_19_cluster_profile",
    """select c_mktsegment as clus_label, round(avg(c_acctbal), 4) as avg_balance, round(avg(n), 6) as avg_orders, round(avg(s), 3) as avg_amount from customer
    left join (select o_custkey, count(*) as n, sum(o_totalprice) as s from orders group by 1) on c_custkey = o_custkey group by 1""",
)
def _(t):
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("amount"))
    rows = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_mktsegment").alias("clus_label"), F.col("c_acctbal").alias("balance"), "orders", "amount")
    out = M.cluster_profile(rows, "clus_label", ["balance", "orders", "amount"])
    return out.select("clus_label", *_r("avg_balance", digits=4), *_r("avg_orders", digits=6), *_r("avg_amount", digits=3))
