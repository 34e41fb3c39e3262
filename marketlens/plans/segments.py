"""Registered audience queries (SEG rows)."""

from __future__ import annotations

from marketlens.operators import audience as A
from marketlens.plans import standins as S
from marketlens.registry import query
from marketlens.tables import Tables

COLS = ", ".join(A.AUDIENCE_COLUMNS)
SIX = ", ".join(f"m.{c}" for c in A.AUDIENCE_COLUMNS)


def warehouse(t: Tables) -> A.Warehouse:
    return A.Warehouse(
        members=S.members(t), issues=S.issues(t), uses=S.uses(t), trades=S.trades(t), products=S.products(t),
        current_products=S.current_products(t), first_current_product=24,
    )


def one_group(t: Tables, *tags: A.Tag):
    return A.audience(warehouse(t), [A.Group(list(tags))])


IDS = (1, 2, 3, 5, 8)
ISSUE_DAYS = (("1997-01-03", "1997-01-12"), ("1997-01-20", "1997-01-20"))
TRADE_DAYS = (("1996-06-01", "1997-12-31"), ("1999-01-01", "1999-03-31"))
DUE_DAYS = (("1998-01-01", "1998-02-15"),)
WORDS = ("red", "gizmo")
_ids = "activity_coupon_id in (1,2,3,5,8)"
_issue_days = """(cast(create_time as date) between date '1997-01-03' and date '1997-01-12'
    or cast(create_time as date) between date '1997-01-20' and date '1997-01-20')"""
_trade_days = """(cast(trans_time as date) between date '1996-06-01' and date '1997-12-31'
    or cast(trans_time as date) between date '1999-01-01' and date '1999-03-31')"""
_issued = f"select user_id from issues where {_ids} and {_issue_days}"
_used_all = f"""select a.user_id from
    (select user_id, count(*) as cnt from issues where activity_coupon_id in (1,4) group by user_id) a join
    (select t.member_no, count(*) as cnt from trades t join uses u on t.business_order_item_no = u.order_no
     where t.status in (6,9,11) and t.fund_trans_type = 1 and u.activity_coupon_id in (1,4) and {_trade_days}
     group by t.member_no) b on a.user_id = b.member_no where a.cnt = b.cnt"""
_bought = f"""select t.member_no from trades t join products p on t.product_id = p.id
    where t.status in (6,9,11) and t.fund_trans_type = 1 and {_trade_days}
    and (p.product_name like '%red%' or p.product_name like '%gizmo%')"""
_white = """select member_no from (select member_no, unnest(string_split(white_list_group, ',')) as g from members
    where white_list_group <> '') where g in ('3', '12')"""
_due = """select t.member_no from trades t join products p on t.product_id = p.id where t.status in (6,9,11)
    and t.fund_trans_type = 1 and p.due_date between date '1998-01-01' and date '1998-02-15'"""
_cdue = """select t.member_no from trades t join current_products p on t.product_id = p.id
    where t.status in (6,8,9,11) and t.fund_trans_type = 2 and product_id >= 24
    and p.due_date between date '1997-03-01' and date '1997-03-20'"""


def _sql(kind: str, inner: str, *tables: str) -> str:
    return S.cte("members", *tables) + f"select {SIX} from members m where m.member_no {kind} ({inner})"


@query("seg_1_not_issued", _sql("not in", _issued, "issues"))
def _(t):
    return one_group(t, A.Tag(5, IDS), A.Tag(6, ISSUE_DAYS))


@query("seg_2_issued", _sql("in", _issued, "issues"))
def _(t):
    return one_group(t, A.Tag(7, IDS), A.Tag(8, ISSUE_DAYS))


@query("seg_3_not_used_all_issued", _sql("not in", _used_all, "issues", "trades", "uses"))
def _(t):
    return one_group(t, A.Tag(9, (1, 4)), A.Tag(10, TRADE_DAYS))


@query("seg_4_used_all_issued", _sql("in", _used_all, "issues", "trades", "uses"))
def _(t):
    return one_group(t, A.Tag(11, (1, 4)), A.Tag(12, TRADE_DAYS))


@query("seg_5_not_bought", _sql("not in", _bought, "trades", "products"))
def _(t):
    return one_group(t, A.Tag(13, WORDS), A.Tag(14, TRADE_DAYS))


@query("seg_6_bought", _sql("in", _bought, "trades", "products"))
def _(t):
    return one_group(t, A.Tag(15, WORDS), A.Tag(16, TRADE_DAYS))


@query("seg_7_white_listed", _sql("in", _white))
def _(t):
    return one_group(t, A.Tag(17, ("3", "12")))


@query("seg_8_not_white_listed", _sql("not in", _white))
def _(t):
    return one_group(t, A.Tag(18, ("3", "12")))


@query(
    "seg_9_best_by_score",
    S.cte("members") + f"select {SIX} from members m order by score_tag_result desc, md5(member_no), member_no limit 100",
)
def _(t):
    return one_group(t, A.Tag(19, ("100",)))


@query("seg_10_fixed_term_due", _sql("in", _due, "trades", "products"))
def _(t):
    return one_group(t, A.Tag(20, DUE_DAYS))


@query("seg_11_current_due", _sql("in", _cdue, "trades", "current_products"))
def _(t):
    return one_group(t, A.Tag(21, (("1997-03-01", "1997-03-20"),)))


@query(
    "seg_12_groups_united",
    S.cte("members") + f"""select distinct {COLS} from (
      select * from members where balance between 1000 and 3000
      union all select * from members where device_type in ('BUILDING', 'MACHINERY')
      union all select * from members where named = '1' and balance >= 5000 and balance <= 5500)""",
)
def _(t):
    groups = [
        A.Group([A.Tag(3, ((1000, 3000),), "balance")]),
        A.Group([A.Tag(2, ("BUILDING,MACHINERY",), "device_type")]),
        A.Group([A.Tag(1, ("是",), "named"), A.Tag(3, ((5000, 5500),), "balance")]),
    ]
    return A.audience(warehouse(t), groups)


_EARLIER = dict(
    first="select member_no from members where balance between 0 and 4000",
    second="select member_no from members where device_type = 'FURNITURE'",
)


def _earlier(t):
    first = one_group(t, A.Tag(3, ((0, 4000),), "balance"))
    second = one_group(t, A.Tag(2, ("FURNITURE",), "device_type"))
    return [first, second]


@query(
    "seg_13_without_earlier",
    S.cte("members", **_EARLIER) + f"""select {SIX} from members m where named = '1' and member_no not in
    (select member_no from first union all select member_no from second)""",
)
def _(t):
    return A.audience(warehouse(t), [A.Group([A.Tag(1, ("是",), "named")])], excluded=_earlier(t))


@query(
    "seg_14_within_earlier",
    S.cte("members", **_EARLIER) + f"""select {SIX} from members m where named = '1' and member_no in
    (select member_no from first union all select member_no from second)""",
)
def _(t):
    return A.audience(warehouse(t), [A.Group([A.Tag(1, ("是",), "named")])], included=_earlier(t))


@query(
    "seg_15_whole_definition",
    S.cte("members", "issues", "trades", "products", "uses", **_EARLIER) + f"""
    select distinct {COLS} from (
      select {SIX} from members m
      where (((sex in ('男') or sex is null) and balance between 500 and 9000) or risk_level is null)
        and member_no in ({_issued}) and member_no not in ({_used_all})
      union all
      select {SIX} from members m
      where reg_date between date '2019-02-01' and date '2020-06-30' and member_no in ({_bought}))
    where member_no not in (select member_no from second) and member_no in (select member_no from first)""",
)
def _(t):
    groups = [
        A.Group([
            A.Tag(1, ("男", "未知"), "sex"), A.Tag(3, ((500, 9000),), "balance"), A.Tag(0, (), "risk_level"),
            A.Tag(7, IDS), A.Tag(8, ISSUE_DAYS), A.Tag(9, (1, 4)), A.Tag(10, TRADE_DAYS),
        ]),
        A.Group([A.Tag(4, (("2019-02-01", "2020-06-30"),), "reg_date"), A.Tag(15, WORDS), A.Tag(16, TRADE_DAYS)]),
    ]
    first, second = _earlier(t)
    return A.audience(warehouse(t), groups, excluded=[second], included=[first])
