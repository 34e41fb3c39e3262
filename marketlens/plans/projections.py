"""Registered projection queries (PRJ rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import figures as G
from marketlens.plans import standins as S
from marketlens.plans.effect import _TABLES, STEPS
from marketlens.registry import query


@query("prj_1_term_days", S.cte("products") + "select id, date_diff('day', inception_date, due_date) as invest_days from products")
def _(t):
    return S.products(t).select("id", G.term_days("due_date", "inception_date").alias("invest_days"))


@query(
    "prj_2_coupon_flags",
    """select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 25 in (1,2,3) then 1 else 0 end as is_coupon_trans,
    case when l_partkey % 25 = l_suppkey % 25 then 1 else 0 end as coupon_trans_eq_issue from lineitem""",
)
def _(t):
    rows = t.lineitem.withColumn("used", F.col("l_partkey") % 25).withColumn("issued", F.col("l_suppkey") % 25)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *G.coupon_flags("used", "issued", (1, 2, 3)))


def _enriched(t):
    u = S.uses(t).withColumnRenamed("activity_coupon_id", "used")
    x = S.trades(t).join(u, F.col("business_order_item_no") == F.col("order_no")).join(S.products(t).withColumnRenamed("id", "product_id"), "product_id")
    x = x.join(S.coupons(t).withColumnRenamed("id", "used"), "used").join(
        S.rules(t).select(F.col("id").alias("rule_id"), "satisfied_amount", "raise_interest_rates"), "rule_id")
    return x


@query(
    "prj_3_rate_subsidy",
    S.cte("trades", "uses", "products", "coupons", "rules") + """, x as (
    select t.business_order_item_no, c.name, cast(c.max_allowance_amount as double) as cap,
      cast(t.fund_trans_amount as double) * (cast(r.raise_interest_rates as double) / 10000) * date_diff('day', p.inception_date, p.due_date) / 365 as v
    from trades t join uses u on u.order_no = t.business_order_item_no join products p on p.id = t.product_id
      join coupons c on c.id = u.activity_coupon_id join rules r on r.id = c.rule_id)
    select business_order_item_no, round(case when name like '%加息券%' and v <= cap then coalesce(v, 0) when name like '%加息券%' and v > cap then cap else 0 end, 4) as add_rate_amt from x""",
)
def _(t):
    days = G.term_days("due_date", "inception_date")
    amount = G.rate_subsidy(F.col("name"), F.col("fund_trans_amount"), F.col("raise_interest_rates"), days, F.col("max_allowance_amount"))
    return _enriched(t).select("business_order_item_no", F.round(amount, 4).alias("add_rate_amt"))


@query(
    "prj_4_percent_text",
    """select n_nationkey, coalesce(cast(cast(100.0::double * sum((c_acctbal > 5000)::int) / nullif(sum((c_acctbal > 0)::int) - 1, 0) as decimal(10,4)) as varchar) || '%', '0') as rich_share
    from nation left join customer on c_nationkey = n_nationkey group by n_nationkey""",
)
def _(t):
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(
        F.sum((F.col("c_acctbal") > 5000).cast("int")).alias("a"), (F.sum((F.col("c_acctbal") > 0).cast("int")) - 1).alias("b"))
    return rows.select("n_nationkey", G.percent_text(F.col("a"), F.col("b")).alias("rich_share"))


@query(
    "prj_5_coupon_label",
    S.cte("coupons", "rules") + """select c.id, case when name like '%现金券%' then '满' || cast(cast(satisfied_amount as int) as varchar) || '减' || cast(cast(discount_amount as int) as varchar)
    when name like '%加息券%' then '加息' || cast(cast(raise_interest_rates as double) / 100 as varchar) || '%' end as label from coupons c join rules r on c.rule_id = r.id""",
)
def _(t):
    r = S.rules(t).withColumnRenamed("id", "rule_id")
    label = G.coupon_label(F.col("name"), F.col("satisfied_amount"), F.col("discount_amount"), F.col("raise_interest_rates"))
    return S.coupons(t).join(r, "rule_id").select("id", label.alias("label"))


@query(
    "prj_6_costs",
    """with g as (select case when grouping(o_orderpriority) = 1 then 'TOTAL' else o_orderpriority end as coupon,
      case when grouping(year(o_orderdate)) = 1 then 'TOTAL' else cast(year(o_orderdate) as varchar) end as day, count(distinct o_custkey) as people,
      round(sum(o_totalprice) / 1000, 2) as deduction from orders group by rollup (o_orderpriority, year(o_orderdate)))
    select coupon, day, people, deduction, round(case when coupon = 'TOTAL' and day = 'TOTAL' then people * 0.032::double else 0 end, 0) as sms_cost,
      round(deduction + case when coupon = 'TOTAL' and day = 'TOTAL' then people * 0.032::double else 0 end, 4) as marketing_cost from g""",
)
def _(t):
    rows = t.orders.withColumn("y", F.year("o_orderdate")).rollup("o_orderpriority", "y").agg(
        F.grouping("o_orderpriority").alias("g1"), F.grouping("y").alias("g2"), F.count_distinct("o_custkey").alias("people"),
        F.round(F.sum("o_totalprice") / 1000, 2).alias("deduction"))
    rows = rows.select(
        F.when(F.col("g1") == 1, G.TOTAL).otherwise(F.col("o_orderpriority")).alias("coupon"),
        F.when(F.col("g2") == 1, G.TOTAL).otherwise(F.col("y").cast("string")).alias("day"), "people", "deduction")
    sms = G.sms_cost(F.col("coupon"), F.col("day"), F.col("people"))
    return rows.select("*", F.round(sms, 0).alias("sms_cost"), F.round(F.col("deduction") + sms, 4).alias("marketing_cost"))


@query("prj_7_display_rounding", "select o_orderkey, round(o_totalprice, 0) as o_totalprice from orders")
def _(t):
    return t.orders.select("o_orderkey", *G.rounded(["o_totalprice"]))


@query("prj_8_labels", """select member_no as "会员号", mobile as "手机号", score_tag_result as "评分" from (""" + S.SQL["members"] + ")")
def _(t):
    return S.members(t).select(*G.labelled({"member_no": "会员号", "mobile": "手机号", "score_tag_result": "评分"}))
