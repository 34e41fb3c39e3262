"""Registered effect report queries (EFF rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import audience as A
from marketlens.operators import effect as E
from marketlens.plans import standins as S
from marketlens.plans.segments import one_group
from marketlens.registry import query

IDS = (1, 2, 3, 4, 7, 9)
ISSUE_DAYS = (("1997-01-02", "1997-01-20"),)
TRADE_DAYS = (("1997-01-05", "1999-12-31"),)


def campaign(t) -> E.Campaign:
    return E.Campaign(
        audience=one_group(t, A.Tag(3, ((-1000, 8000),), "balance")), issues=S.issues(t), trades=S.trades(t),
        products=S.products(t), uses=S.uses(t), coupons=S.coupons(t), rules=S.rules(t),
        ids=IDS, issue_days=ISSUE_DAYS, trade_days=TRADE_DAYS,
    )


# The same report in SQL, built from named steps.
STEPS = {
    "audience": "select member_no from members where balance >= -1000 and balance <= 8000",
    "given": """select i.activity_coupon_id as coupon, a.member_no, count(*) as cnt, min(i.create_time) as first_time
        from issues i join audience a on i.user_id = a.member_no
        where i.activity_coupon_id in (1,2,3,4,7,9) and cast(i.create_time as date) between date '1997-01-02' and date '1997-01-20'
        group by all""",
    "interest": """select t.*, p.product_name, date_diff('day', p.inception_date, p.due_date) as invest_days,
        u.activity_coupon_id as used, u.deduction_amt, c.name, c.max_allowance_amount as cap, r.satisfied_amount,
        cast(t.fund_trans_amount as double) * (cast(r.raise_interest_rates as double) / 10000) * date_diff('day', p.inception_date, p.due_date) / 365 as x
        from trades t join products p on p.id = t.product_id left join uses u on u.order_no = t.business_order_item_no
        left join coupons c on c.id = u.activity_coupon_id left join rules r on r.id = c.rule_id
        where t.status in (6,8,9,11) and cast(t.trans_time as date) between date '1997-01-05' and date '1999-12-31'""",
    "traded": """select g.coupon, i.member_no, i.used, cast(i.used in (1,2,3,4,7,9) and i.used is not null as integer) as chosen,
        case when i.used = g.coupon then 1 else 0 end as same_coupon, i.name, i.product_name, i.invest_days, i.trans_time, i.fund_trans_amount as amt,
        i.fund_trans_type as kind, i.satisfied_amount, i.deduction_amt,
        case when i.name like '%加息券%' and i.x is not null and i.cap is not null then least(i.x, cast(i.cap as double)) else 0.0 end as add_rate,
        g.first_time, cast(i.trans_time as date) as day
        from interest i join given g on g.member_no = i.member_no and i.trans_time >= g.first_time""",
    "fixed": "select * from traded where kind = 1",
    "paid": "select * from fixed where chosen = 1 and same_coupon = 1",
    "spend": "select member_no, day, sum(amt) as spend, count(*) as n from (select distinct member_no, trans_time, amt, day from fixed) group by all",
    "people": "select coupon, sum(cnt) as issue_cnt, count(*) as issue_user_cnt from given group by coupon",
}
_TABLES = ("members", "issues", "trades", "uses", "coupons", "rules", "products")


def steps(**more: str) -> str:
    return S.cte(*_TABLES, **STEPS, **more)


def _days(t):
    return E.member_days(E.recipient_trades(campaign(t)))


def _text(name):
    return F.col(name).cast("string").alias(name)


def _double(name):
    return F.round(F.col(name).cast("double"), 4).alias(name)


@query(
    "eff_1_issued",
    steps() + "select coupon as activity_coupon_id, member_no, cast(cnt as bigint) as cnt, strftime(first_time, '%Y-%m-%d %H:%M:%S') as create_time from given",
)
def _(t):
    rows = E.issued(campaign(t))
    return rows.select("activity_coupon_id", "member_no", "cnt", F.date_format("create_time", "yyyy-MM-dd HH:mm:ss").alias("create_time"))


@query(
    "eff_2_recipient_trades",
    steps() + """select member_no, used as trans_coupon_id, coupon as issue_coupon_id, chosen as is_coupon_trans, same_coupon as coupon_trans_eq_issue,
    name, product_name, invest_days, strftime(trans_time, '%Y-%m-%d %H:%M:%S') as trans_time, cast(amt as double) as fund_trans_amount, kind as fund_trans_type,
    cast(satisfied_amount as double) as satisfied_amount, cast(deduction_amt as double) as deduction_amt, round(add_rate, 4) as add_rate_amt from traded""",
)
def _(t):
    rows = E.recipient_trades(campaign(t))
    return rows.select(
        "member_no", "trans_coupon_id", "issue_coupon_id", "is_coupon_trans", "coupon_trans_eq_issue", "name", "product_name",
        "invest_days", F.date_format("trans_time", "yyyy-MM-dd HH:mm:ss").alias("trans_time"), _double("fund_trans_amount"),
        "fund_trans_type", _double("satisfied_amount"), _double("deduction_amt"), _double("add_rate_amt"),
    )


@query("eff_3_issue_totals", steps() + "select coupon as activity_coupon_id, cast(issue_cnt as bigint) as issue_cnt, issue_user_cnt from people")
def _(t):
    return E.issue_totals(E.issued(campaign(t)))


@query(
    "eff_4_investment",
    steps() + """select coupon as activity_coupon_id, cast(day as varchar) as trans_date, cast(sum(amt) as double) as trans_amt,
    count(distinct member_no) as trans_user_cnt from fixed group by coupon, day""",
)
def _(t):
    return E.investment(_days(t)).select("activity_coupon_id", _text("trans_date"), _double("trans_amt"), "trans_user_cnt")


_PAID = """cast(sum(amt) as double) as coupon_trans_amt, count(distinct member_no) as coupon_trans_user_cnt, count(*) as coupon_trans_cnt,
    cast(sum(deduction_amt) as double) as coupon_deduction_amt, round(sum(add_rate), 4) as coupon_add_rate_amt"""


@query("eff_5_paid_investment", steps() + f"select used as activity_coupon_id, cast(day as varchar) as trans_date, {_PAID} from paid group by used, day")
def _(t):
    return E.paid_investment(_days(t)).select(
        "activity_coupon_id", _text("trans_date"), _double("coupon_trans_amt"), "coupon_trans_user_cnt", "coupon_trans_cnt",
        _double("coupon_deduction_amt"), _double("coupon_add_rate_amt"),
    )


_SPEND_DAY = """select u.used as coupon, u.day, sum(s.n) as n, count(distinct u.member_no) as people, sum(s.spend) as amt
    from (select distinct used, member_no, day from paid) u join spend s on s.member_no = u.member_no and s.day = u.day group by u.used, u.day"""


@query(
    "eff_6_coupon_user_spend",
    steps(spend_day=_SPEND_DAY) + """select coupon as activity_coupon_id, cast(day as varchar) as trans_date, cast(n as bigint) as coupon_trans_cnt_all,
    people as coupon_trans_user_cnt_all, cast(amt as double) as coupon_trans_amt_all from spend_day""",
)
def _(t):
    return E.coupon_user_spend(_days(t)).select(
        "activity_coupon_id", _text("trans_date"), "coupon_trans_cnt_all", "coupon_trans_user_cnt_all", _double("coupon_trans_amt_all")
    )


_LEVELS = {
    "invest_all": "select coupon, cast(day as varchar) as day, grouping(day) as whole, sum(amt) as amt, count(distinct member_no) as people from fixed group by grouping sets ((coupon, day), (coupon))",
    "paid_all": f"select used as coupon, cast(day as varchar) as day, grouping(day) as whole, {_PAID} from paid group by grouping sets ((used, day), (used))",
    "spend_day": _SPEND_DAY,
    "spend_all": "select coupon, cast(day as varchar) as day, grouping(day) as whole, sum(amt) as amt from spend_day group by grouping sets ((coupon, day), (coupon))",
    "lines": """select cast(p.coupon as varchar) as coupon, i.day, p.issue_cnt, p.issue_user_cnt, i.amt, i.people, c.coupon_trans_amt, c.coupon_trans_user_cnt,
        c.coupon_trans_cnt, c.coupon_deduction_amt, c.coupon_add_rate_amt, s.amt as spend
        from people p left join (select * from invest_all where whole = 0) i on i.coupon = p.coupon
        left join paid_all c on c.coupon = i.coupon and c.day = i.day and c.whole = 0
        left join spend_all s on s.coupon = i.coupon and s.day = i.day and s.whole = 0""",
    "sums": """select cast(p.coupon as varchar) as coupon, 'TOTAL' as day, p.issue_cnt, p.issue_user_cnt, i.amt, i.people, c.coupon_trans_amt, c.coupon_trans_user_cnt,
        c.coupon_trans_cnt, c.coupon_deduction_amt, c.coupon_add_rate_amt, s.amt as spend
        from people p left join (select * from invest_all where whole = 1) i on i.coupon = p.coupon
        left join (select * from paid_all where whole = 1) c on c.coupon = p.coupon
        left join (select * from spend_all where whole = 1) s on s.coupon = p.coupon""",
    "grand": f"""select 'TOTAL' as coupon, 'TOTAL' as day, (select sum(cnt) from given) as issue_cnt, (select count(distinct member_no) from given) as issue_user_cnt,
        (select sum(spend) from spend) as amt, (select count(distinct member_no) from spend) as people, x.*,
        (select sum(s.spend) from (select distinct member_no, day from paid) u join spend s on s.member_no = u.member_no and s.day = u.day) as spend
        from (select {_PAID} from paid) x""",
    "stacked": "select * from lines union all select * from sums union all select * from grand",
}
_LEVEL_COLUMNS = """coupon as activity_coupon_id, day as trans_date, cast(issue_cnt as bigint) as issue_cnt, issue_user_cnt, cast(amt as double) as trans_amt,
    people as trans_user_cnt, coupon_trans_amt, coupon_trans_user_cnt, coupon_trans_cnt, coupon_deduction_amt, coupon_add_rate_amt,
    cast(spend as double) as coupon_trans_amt_all"""


def _level(frame):
    return frame.select(
        "activity_coupon_id", "trans_date", "issue_cnt", "issue_user_cnt", _double("trans_amt"), "trans_user_cnt",
        _double("coupon_trans_amt"), "coupon_trans_user_cnt", "coupon_trans_cnt", _double("coupon_deduction_amt"),
        _double("coupon_add_rate_amt"), _double("coupon_trans_amt_all"),
    )


@query("eff_7_per_coupon", steps(**_LEVELS) + f"select {_LEVEL_COLUMNS} from sums")
def _(t):
    c = campaign(t)
    given = E.issued(c)
    return _level(E.per_coupon(given, E.member_days(E.recipient_trades(c, given))))


@query("eff_8_grand_total", steps(**_LEVELS) + f"select {_LEVEL_COLUMNS} from grand")
def _(t):
    c = campaign(t)
    given = E.issued(c)
    return _level(E.grand_total(given, E.member_days(E.recipient_trades(c, given))))


@query("eff_9_stacked_levels", steps(**_LEVELS) + f"select {_LEVEL_COLUMNS} from stacked")
def _(t):
    c = campaign(t)
    given = E.issued(c)
    return _level(E.levels(given, E.member_days(E.recipient_trades(c, given))))


_MARKET = """select case when grouping(cast(trans_time as date)) = 1 then 'TOTAL' else cast(cast(trans_time as date) as varchar) end as day, sum(fund_trans_amount) as amt
    from trades where status in (6,9,11) and fund_trans_type = 1 and cast(trans_time as date) between date '1997-01-05' and date '1999-12-31'
    group by rollup (cast(trans_time as date))"""


@query("eff_10_market_totals", S.cte("trades") + f"select day as trans_date, cast(amt as double) as market_amt from ({_MARKET})")
def _(t):
    return E.market(campaign(t)).select("trans_date", _double("market_amt"))


@query(
    "eff_11_report",
    steps(**_LEVELS, market=_MARKET, label="""select cast(c.id as varchar) as id, case when c.name like '%现金券%' then '满' || cast(cast(r.satisfied_amount as integer) as varchar) || '减' || cast(cast(r.discount_amount as integer) as varchar)
        when c.name like '%加息券%' then '加息' || cast(cast(r.raise_interest_rates as double) / 100 as varchar) || '%' end as label from coupons c join rules r on c.rule_id = r.id""")
    + """select coupon as activity_coupon_id, coalesce(l.label, '') as coupon_name, issue_user_cnt, cast(issue_cnt as bigint) as issue_cnt, s.day as trans_date,
    cast(coalesce(s.amt, 0) as double) as trans_amt, coalesce(people, 0) as trans_user_cnt, coalesce(coupon_trans_amt, 0) as coupon_trans_amt,
    coalesce(coupon_trans_user_cnt, 0) as coupon_trans_user_cnt,
    coalesce(cast(cast(cast(coupon_trans_user_cnt as double) / issue_user_cnt * 100 as decimal(10,4)) as varchar) || '%', '0') as coupon_trans_rate,
    coalesce(coupon_trans_cnt, 0) as coupon_trans_cnt,
    coalesce(cast(cast(cast(coupon_trans_cnt as double) / cast(issue_cnt as double) * 100 as decimal(10,4)) as varchar) || '%', '0') as coupon_use_rate,
    coalesce(coupon_deduction_amt, 0) as coupon_deduction_amt, coalesce(round(coupon_add_rate_amt, 2), 0) as coupon_add_rate_amt,
    round(coupon_deduction_amt + coupon_add_rate_amt, 2) as coupon_cost,
    round(case when coupon = 'TOTAL' and s.day = 'TOTAL' then issue_user_cnt * 0.032::double else 0 end, 0) as sms_cost,
    coalesce(round(coupon_deduction_amt + coupon_add_rate_amt + case when coupon = 'TOTAL' and s.day = 'TOTAL' then issue_user_cnt * 0.032::double else 0 end, 4), 0) as marketing_cost,
    cast(coalesce(round(spend, 0), 0) as bigint) as coupon_trans_amt_all, cast(coalesce(round(m.amt, 0), 0) as bigint) as trans_amt_all,
    coalesce(cast(cast(cast(spend as double) / cast(m.amt as double) * 100 as decimal(10,4)) as varchar) || '%', '0') as coupon_trans_all_rate
    from stacked s left join market m on m.day = s.day left join label l on l.id = s.coupon""",
)
def _(t):
    return E.report(campaign(t)).withColumn("marketing_cost", F.round("marketing_cost", 4))
