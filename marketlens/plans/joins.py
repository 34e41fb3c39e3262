"""Registered join queries (JN rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import figures as G
from marketlens.functions import predicates as P
from marketlens.operators import audience as A
from marketlens.operators import deal as D
from marketlens.operators import effect as E
from marketlens.operators import runs as R
from marketlens.operators.joins import matched_counts, salted_join
from marketlens.plans import standins as S
from marketlens.plans.deal import STEPS as DEAL_STEPS
from marketlens.plans.deal import deal
from marketlens.plans.runs import RANKS_SQL, USERS_SQL, ranks, users
from marketlens.registry import query



def N(): return F.count(F.lit(1)).alias("n")


@query("jn_1_fact_to_audience", S.cte("members", "issues") + "select i.activity_coupon_id, m.device_type, count(*) as n from issues i join members m on i.user_id = m.member_no group by all")
def _(t):
    rows = S.issues(t).join(S.members(t).withColumnRenamed("member_no", "user_id"), "user_id")
    return rows.groupBy("activity_coupon_id", "device_type").agg(N())


@query(
    "jn_2_after_first_issue",
    S.cte("issues", "trades") + """, f as (select user_id, min(create_time) as first_time from issues group by user_id)
    select member_no, count(*) as n, cast(sum(fund_trans_amount) as double) as amount from trades join f on member_no = user_id and trans_time >= first_time group by member_no""",
)
def _(t):
    first = S.issues(t).groupBy(F.col("user_id").alias("member_no")).agg(F.min("create_time").alias("first_time"))
    rows = salted_join(S.trades(t), first, ["member_no"], ["business_order_item_no"], condition=F.col("trans_time") >= F.col("first_time"))
    return rows.groupBy("member_no").agg(N(), F.sum("fund_trans_amount").cast("double").alias("amount"))


@query(
    "jn_3_outer_chain",
    S.cte("trades", "uses", "coupons", "rules") + """select coalesce(c.name, 'none') as name, count(*) as n, count(r.id) as ruled, cast(sum(u.deduction_amt) as double) as deduction
    from trades t left join uses u on u.order_no = t.business_order_item_no left join coupons c on c.id = u.activity_coupon_id left join rules r on r.id = c.rule_id group by all""",
)
def _(t):
    u = S.uses(t).withColumnRenamed("order_no", "business_order_item_no")
    c = S.coupons(t).withColumnRenamed("id", "activity_coupon_id")
    r = S.rules(t).select(F.col("id").alias("rule_id"), "satisfied_amount")
    rows = S.trades(t).join(u, "business_order_item_no", "left").join(c, "activity_coupon_id", "left").join(r, "rule_id", "left")
    return rows.groupBy(F.coalesce("name", F.lit("none")).alias("name")).agg(
        N(), F.count("satisfied_amount").alias("ruled"), F.sum("deduction_amt").cast("double").alias("deduction"))


@query("jn_4_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(t):
    buyers = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("member_no"))
    return A.drop_members(t.customer.select(F.col("c_custkey").alias("member_no")), buyers).withColumnRenamed("member_no", "c_custkey")


@query("jn_5_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(t):
    buyers = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("member_no"))
    return A.keep_members(t.customer.select(F.col("c_custkey").alias("member_no")), buyers).withColumnRenamed("member_no", "c_custkey")


@query(
    "jn_6_two_keys_outer",
    """with a as (select o_orderpriority as p, cast(o_orderdate as date) as d, count(*) as n from orders group by all),
    b as (select o_orderpriority as p, cast(o_orderdate as date) as d, sum(o_totalprice) as amt from orders where o_orderstatus = 'F' group by all)
    select a.p as coupon, cast(a.d as varchar) as day, n, round(amt, 2) as amt from a left join b on a.p = b.p and a.d = b.d""",
)
def _(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("coupon"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_totalprice")
    keys = ["coupon", "day"]
    b = rows.filter(F.col("o_orderstatus") == "F").groupBy(*keys).agg(F.round(F.sum("o_totalprice"), 2).alias("amt"))
    return rows.groupBy(*keys).agg(N()).join(b, keys, "left").select("coupon", F.col("day").cast("string").alias("day"), "n", "amt")


@query(
    "jn_7_member_day",
    S.cte("trades") + """, d as (select distinct member_no, cast(trans_time as date) as day from trades where fund_trans_type = 2)
    select t.member_no, cast(d.day as varchar) as day, count(*) as n from trades t join d on d.member_no = t.member_no and d.day = cast(t.trans_time as date)
    where t.fund_trans_type = 1 group by all""",
)
def _(t):
    rows = S.trades(t).withColumn("day", F.to_date("trans_time"))
    # Both sides meet as one row per member and day.
    kinds = rows.groupBy("member_no", "day").agg(
        F.count_if(F.col("fund_trans_type") == 1).alias("n"), F.count_if(F.col("fund_trans_type") == 2).alias("other"))
    return kinds.filter((F.col("n") > 0) & (F.col("other") > 0)).select("member_no", F.col("day").cast("string").alias("day"), "n")


@query(
    "jn_8_one_row_totals",
    """select 'TOTAL' as k, (select count(*) from orders) as orders, (select count(*) from lineitem) as items, (select round(sum(l_extendedprice), 2) from lineitem) as amount,
    (select count(distinct c_nationkey) from customer) as nations""",
)
def _(t):
    li = t.lineitem.agg(F.struct(N(), F.round(F.sum("l_extendedprice"), 2).alias("amount"))).scalar()
    c = t.customer.agg(F.count_distinct("c_nationkey")).scalar()
    return t.orders.agg(N()).select(
        F.lit(G.TOTAL).alias("k"), F.col("n").alias("orders"), li["n"].alias("items"), li["amount"].alias("amount"), c.alias("nations"))


@query(
    "jn_9_equal_counts",
    S.cte("issues", "trades") + """select a.user_id as member_no, a.n as left_cnt, b.n as right_cnt from (select user_id, count(*) as n from issues group by 1) a
    join (select member_no, count(*) as n from trades group by 1) b on a.user_id = b.member_no where a.n = b.n""",
)
def _(t):
    return matched_counts(S.issues(t).withColumnRenamed("user_id", "member_no"), S.trades(t), "member_no")


@query(
    "jn_10_rank_theta",
    f"""with u as ({USERS_SQL}), k as ({RANKS_SQL}) select u.name, k.rank from u join k on u.rid = k.id
    where k.rank >= (select max(k2.rank) from u u2 join k k2 on u2.rid = k2.id where u2.name = 'user3')""",
)
def _(t):
    return R.visible_users(users(t), ranks(t), "user3")


@query("jn_11_users_and_ranks", f"with u as ({USERS_SQL}), k as ({RANKS_SQL}) select u.name, k.rank from u join k on u.rid = k.id")
def _(t):
    return users(t).join(ranks(t).select(F.col("id").alias("rid"), "rank"), "rid").select("name", "rank")


@query(
    "jn_12_fund_chain",
    S.cte("members", "trades", "products", "alterations", "fund_details", **DEAL_STEPS)
    + """select p.product_name, count(*) as n, cast(sum(f.expect_profit_amount) as double) as profit from uuids u join fund_details f using (fund_detail_uuid)
    join products p on p.id = f.product_id group by 1""",
)
def _(t):
    d = deal(t)
    names = d.products.select(F.col("id").alias("product_id"), "product_name")
    rows = D.traded_details(d).join(d.details, "fund_detail_uuid").join(names, "product_id")
    return rows.groupBy("product_name").agg(N(), F.sum("expect_profit_amount").cast("double").alias("profit"))
