"""Campaign tables derived from the driver tables, in Spark and in SQL.

The operators take any DataFrame with the campaign columns; this module is the only
place where driver columns are mapped to them. ``cte(...)`` gives the same mapping as
SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlens.tables import Tables

# Days from the order period to the event period: issues are moved back into the order period.
ISSUE_SHIFT_DAYS = 9861
COUPONS = 25


def members(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.col("c_custkey").cast("string").alias("member_no"),
        F.concat(F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("mobile"),
        F.when(F.col("c_nationkey") % 2 == 0, "1").otherwise("0").alias("named"),
        F.concat(F.lit("cid"), F.col("c_nationkey").cast("string")).alias("device_cid"),
        F.col("c_mktsegment").alias("device_type"),
        F.floor("c_acctbal").cast("int").alias("score_tag_result"),
        F.when(F.col("c_nationkey") % 3 == 0, "男").when(F.col("c_nationkey") % 3 == 1, "女").alias("sex"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") % 5).cast("int").alias("risk_level"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("reg_date"),
        F.concat_ws(",", (F.col("c_custkey") % 7).cast("string"), (10 + F.col("c_nationkey") % 4).cast("string"))
        .alias("white_list_group"),
    )


def issues(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type").isin("view", "click"))
    return e.select(
        F.col("user_id").cast("string").alias("user_id"),
        (F.get_json_object("props", "$.k").cast("bigint") % COUPONS).alias("activity_coupon_id"),
        (F.col("ts") - F.expr(f"interval {ISSUE_SHIFT_DAYS} days")).alias("create_time"),
    )


def _item_no():
    return F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))


def trades(t: Tables) -> DataFrame:
    o, li = t.orders, t.lineitem
    status = (
        F.when(F.col("o_orderstatus") == "F", 6)
        .when(F.col("o_orderstatus") == "O", 9)
        .when(F.col("l_returnflag") == "A", 11)
        .when(F.col("l_returnflag") == "R", 8)
        .otherwise(3)
    )
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_custkey").cast("string").alias("member_no"),
        F.col("l_partkey").alias("product_id"),
        _item_no().alias("business_order_item_no"),
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("fund_trans_order_no"),
        status.alias("status"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("fund_trans_type"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("trans_time"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("fund_trans_amount"),
        (F.col("l_discount") * 100).cast("decimal(18,2)").alias("discount_amount"),
    )


def uses(t: Tables) -> DataFrame:
    return t.lineitem.filter(F.col("l_discount") >= 0.045).select(
        _item_no().alias("order_no"),
        (F.col("l_partkey") % COUPONS).alias("activity_coupon_id"),
        F.col("l_quantity").cast("decimal(18,2)").alias("deduction_amt"),
    )


def coupons(t: Tables) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint") - 1
    ids = t.part.select(number.alias("id")).distinct()
    return ids.select(
        "id",
        F.concat(F.when(F.col("id") % 2 == 0, "新手现金券").otherwise("新手加息券"), F.col("id").cast("string")).alias("name"),
        (F.col("id") + 100).alias("rule_id"),
        F.when(F.col("id") != 7, F.col("id") * 5).cast("decimal(18,2)").alias("max_allowance_amount"),
    )


def rules(t: Tables) -> DataFrame:
    ids = t.part.select((F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint") - 1).alias("n")).distinct()
    return ids.select(
        (F.col("n") + 100).alias("id"),
        (F.col("n") * 1000 + 500).cast("decimal(18,2)").alias("satisfied_amount"),
        (F.col("n") * 10 + 5).cast("decimal(18,2)").alias("discount_amount"),
        (F.col("n") * 10 + 50).cast("decimal(10,2)").alias("raise_interest_rates"),
    )


def products(t: Tables) -> DataFrame:
    begin = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int"))
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("product_name"),
        (F.col("p_size") / 10).cast("decimal(10,4)").alias("display_rate"),
        begin.alias("inception_date"),
        F.date_add(begin, F.col("p_size") * 30).alias("due_date"),
    )


def current_products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.date_add(F.lit("1997-01-01").cast("date"), F.col("p_size") * 7).alias("due_date"),
    )


def alterations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("ftc_order_no"),
        F.concat_ws("-", F.lit("u"), F.col("l_orderkey"), F.col("l_suppkey")).alias("fund_detail_uuid"),
    )


def fund_details(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("-", F.lit("u"), F.col("l_orderkey"), F.col("l_suppkey")).alias("fund_detail_uuid"),
        F.col("l_partkey").alias("product_id"),
        (F.col("l_tax") * 1000).cast("decimal(18,2)").alias("expect_bonus_amount"),
        (F.col("l_quantity") * 10).cast("decimal(18,2)").alias("expect_profit_amount"),
    )


SQL = {
    "members": """select cast(c_custkey as varchar) as member_no,
        '138' || lpad(cast(c_custkey as varchar), 8, '0') as mobile,
        case when c_nationkey % 2 = 0 then '1' else '0' end as named,
        'cid' || cast(c_nationkey as varchar) as device_cid, c_mktsegment as device_type,
        cast(floor(c_acctbal) as integer) as score_tag_result,
        case c_nationkey % 3 when 0 then '男' when 1 then '女' end as sex, c_acctbal as balance,
        case when c_nationkey > 2 then c_nationkey % 5 end as risk_level,
        date '2019-01-01' + cast(c_custkey % 1000 as integer) as reg_date,
        cast(c_custkey % 7 as varchar) || ',' || cast(10 + c_nationkey % 4 as varchar) as white_list_group
        from customer""",
    "issues": f"""select cast(user_id as varchar) as user_id,
        cast(json_extract_string(props, '$.k') as bigint) % {COUPONS} as activity_coupon_id,
        ts - interval {ISSUE_SHIFT_DAYS} days as create_time
        from events where event_type in ('view', 'click')""",
    "trades": """select cast(o_custkey as varchar) as member_no, l_partkey as product_id,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey) as business_order_item_no,
        't' || cast(l_orderkey as varchar) as fund_trans_order_no,
        case when o_orderstatus = 'F' then 6 when o_orderstatus = 'O' then 9
             when l_returnflag = 'A' then 11 when l_returnflag = 'R' then 8 else 3 end as status,
        case when l_linestatus = 'O' then 1 else 2 end as fund_trans_type,
        o_orderdate + to_hours(l_linenumber) as trans_time,
        cast(l_extendedprice as decimal(18,2)) as fund_trans_amount,
        cast(l_discount * 100 as decimal(18,2)) as discount_amount
        from orders join lineitem on o_orderkey = l_orderkey""",
    "uses": f"""select concat_ws('-', l_orderkey, l_linenumber, l_partkey) as order_no,
        l_partkey % {COUPONS} as activity_coupon_id, cast(l_quantity as decimal(18,2)) as deduction_amt
        from lineitem where l_discount >= 0.045""",
    "coupons": """select id, (case when id % 2 = 0 then '新手现金券' else '新手加息券' end) || cast(id as varchar) as name,
        id + 100 as rule_id, cast(case when id <> 7 then id * 5 end as decimal(18,2)) as max_allowance_amount
        from (select distinct cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) - 1 as id from part)""",
    "rules": """select n + 100 as id, cast(n * 1000 + 500 as decimal(18,2)) as satisfied_amount,
        cast(n * 10 + 5 as decimal(18,2)) as discount_amount, cast(n * 10 + 50 as decimal(10,2)) as raise_interest_rates
        from (select distinct cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) - 1 as n from part)""",
    "products": """select id, product_name, display_rate, inception_date, inception_date + p_size * 30 as due_date
        from (select p_partkey as id, p_name as product_name, cast(p_size / 10.0 as decimal(10,4)) as display_rate,
              date '1996-01-01' + cast(p_partkey % 365 as integer) as inception_date, p_size from part)""",
    "current_products": "select p_partkey as id, date '1997-01-01' + p_size * 7 as due_date from part",
    "alterations": """select 't' || cast(l_orderkey as varchar) as ftc_order_no,
        concat_ws('-', 'u', l_orderkey, l_suppkey) as fund_detail_uuid from lineitem""",
    "fund_details": """select concat_ws('-', 'u', l_orderkey, l_suppkey) as fund_detail_uuid, l_partkey as product_id,
        cast(l_tax * 1000 as decimal(18,2)) as expect_bonus_amount,
        cast(l_quantity * 10 as decimal(18,2)) as expect_profit_amount from lineitem""",
}


def cte(*names: str, **more: str) -> str:
    """WITH clause that defines the stand-in tables ``names`` and further named parts."""
    parts = [f"{n} as ({SQL[n]})" for n in names] + [f"{n} as ({body})" for n, body in more.items()]
    return "with " + ",\n".join(parts) + "\n"
