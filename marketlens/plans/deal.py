"""Registered product deal queries (DEAL rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import audience as A
from marketlens.operators import deal as D
from marketlens.plans import standins as S
from marketlens.plans.segments import one_group
from marketlens.registry import query


def deal(t) -> D.Deal:
    return D.Deal(
        audience=one_group(t, A.Tag(1, ("是",), "named")), trades=S.trades(t), products=S.products(t),
        alterations=S.alterations(t), details=S.fund_details(t), trade_days=[("1996-01-01", "1999-12-31")], words=["widget", "hot"],
    )


_PICK = """t.status in (6,9,11) and cast(t.trans_time as date) between date '1996-01-01' and date '1999-12-31'
    and (p.product_name like '%widget%' or p.product_name like '%hot%')"""
STEPS = {
    "bought": f"""select t.*, p.product_name, p.display_rate, date_diff('day', p.inception_date, p.due_date) as invest_days
        from members a join trades t on t.member_no = a.member_no join products p on p.id = t.product_id where a.named = '1' and {_PICK}""",
    "per_product": """select product_id, product_name, display_rate, invest_days, min(trans_time) as t0, max(trans_time) as t1, count(*) as trans_cnt,
        count(distinct member_no) as trans_usr_cnt, sum(fund_trans_amount) as amt, sum(discount_amount) as disc from bought group by all""",
    "uuids": "select distinct x.fund_detail_uuid, b.member_no from bought b join alterations x on x.ftc_order_no = b.fund_trans_order_no",
    "income": """select f.product_id, p.product_name, sum(f.expect_bonus_amount) as bonus, sum(f.expect_profit_amount) as profit
        from uuids u join fund_details f using (fund_detail_uuid) join products p on p.id = f.product_id group by all""",
}
_SQL = S.cte("members", "trades", "products", "alterations", "fund_details", **STEPS)
_TRADED = """strftime(t0, '%Y-%m-%d %H:%M:%S') as min_trans_time, strftime(t1, '%Y-%m-%d %H:%M:%S') as max_trans_time, trans_cnt, trans_usr_cnt,
    cast(amt as double) as trans_amt, cast(disc as double) as discount_amt"""


def _times():
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("min_trans_time", "max_trans_time")]


def _amount(c):
    return F.round(F.col(c).cast("double"), 2).alias(c)


@query("deal_1_product_trades", _SQL + f"select product_id, product_name, cast(display_rate as double) as display_rate, invest_days, {_TRADED} from per_product")
def _(t):
    return D.product_trades(deal(t)).select(
        "product_id", "product_name", F.col("display_rate").cast("double").alias("display_rate"), "invest_days", *_times(),
        "trans_cnt", "trans_usr_cnt", _amount("trans_amt"), _amount("discount_amt"),
    )


@query("deal_2_traded_details", _SQL + "select fund_detail_uuid, member_no from uuids")
def _(t):
    return D.traded_details(deal(t))


@query("deal_3_expected_income", _SQL + "select product_id, product_name, cast(bonus as double) as invest_income, cast(profit as double) as invest_addrate from income")
def _(t):
    return D.expected_income(deal(t)).select("product_id", "product_name", _amount("invest_income"), _amount("invest_addrate"))


@query(
    "deal_4_report",
    _SQL + f"""select product_name, cast(display_rate as double) as display_rate, invest_days, {_TRADED}, cast(bonus as double) as invest_income,
    cast(profit as double) as invest_addrate from per_product join income using (product_id, product_name)""",
)
def _(t):
    return D.report(deal(t)).select(
        "product_name", F.col("display_rate").cast("double").alias("display_rate"), "invest_days", *_times(), "trans_cnt", "trans_usr_cnt",
        _amount("trans_amt"), _amount("discount_amt"), _amount("invest_income"), _amount("invest_addrate"),
    )
