"""Effect report of a coupon campaign.

The row-level join of issues, trades, uses, coupons and rules is computed once and reduced
to a table of coupons, members and days. All levels of the report - per coupon and day,
per coupon, grand total - come from one aggregate by grouping sets over that much smaller
table, first per member and then over the members, so that people are counted once in
every level. The fact tables are read once per report.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from marketlens.functions import figures as G
from marketlens.functions import predicates as P
from marketlens.operators.audience import FIXED_TERM, SETTLED, SETTLED_OR_PENDING
from marketlens.operators.joins import salted_join
from marketlens.operators.scratch import scratch_table

TOTAL = G.TOTAL


def N(): return F.count(F.lit(1))


@dataclass
class Campaign:
    audience: DataFrame
    issues: DataFrame
    trades: DataFrame
    products: DataFrame
    uses: DataFrame
    coupons: DataFrame
    rules: DataFrame
    ids: Sequence[int]
    issue_days: Sequence[tuple]
    trade_days: Sequence[tuple]


def issued(c: Campaign) -> DataFrame:
    """Pieces and first issue time per coupon and member of the audience."""
    rows = c.issues.filter(F.col("activity_coupon_id").isin(*c.ids) & P.in_date_ranges("create_time", c.issue_days))
    counts = rows.groupBy("activity_coupon_id", F.col("user_id").alias("member_no")).agg(
        N().alias("cnt"), F.min("create_time").alias("create_time")
    )
    # Audience rows repeat the issues: one count per audience row of the member.
    people = c.audience.groupBy("member_no").agg(N().alias("_times"))
    joined = counts.join(people, "member_no")
    rows = joined.select("activity_coupon_id", "member_no", (F.col("cnt") * F.col("_times")).alias("cnt"), "create_time")
    return scratch_table(rows, "issued")


def recipient_trades(c: Campaign, given: DataFrame | None = None) -> DataFrame:
    """Trades of recipients at or after the first issue, with coupon, product and subsidy.

    A trade appears once per coupon issued to its member. Trades of other members are
    dropped first; coupons and rules are joined to the uses, so trades without a coupon
    never meet on a null key; the issues, which repeat the trades, come last.
    """
    given = issued(c) if given is None else given
    settled = c.trades.filter(F.col("status").isin(*SETTLED_OR_PENDING) & P.in_date_ranges("trans_time", c.trade_days))
    t = settled.join(given.select("member_no").distinct(), "member_no", "left_semi")
    p = c.products.select(F.col("id").alias("product_id"), "product_name", "inception_date", "due_date")
    u = c.uses.select(
        F.col("order_no").alias("business_order_item_no"), F.col("activity_coupon_id").alias("trans_coupon_id"), "deduction_amt"
    )
    e = c.coupons.select(F.col("id").alias("trans_coupon_id"), "name", "rule_id", "max_allowance_amount")
    r = c.rules.select(F.col("id").alias("rule_id"), "satisfied_amount", "raise_interest_rates")
    used = u.join(e, "trans_coupon_id", "left").join(r, "rule_id", "left")
    rows = t.join(p, "product_id").join(used, "business_order_item_no", "left")
    first = given.select("member_no", F.col("activity_coupon_id").alias("issue_coupon_id"), "create_time")
    joined = salted_join(
        rows, first, ["member_no"], ["business_order_item_no"], condition=F.col("trans_time") >= F.col("create_time"), counted=settled
    )
    days = G.term_days("due_date", "inception_date")
    return joined.select(
        "member_no", "trans_coupon_id", "issue_coupon_id",
        *G.coupon_flags("trans_coupon_id", "issue_coupon_id", c.ids),
        "name", "product_name", days.alias("invest_days"), "trans_time", "fund_trans_amount", "fund_trans_type",
        "satisfied_amount", "deduction_amt",
        G.rate_subsidy(
            F.col("name"), F.col("fund_trans_amount"), F.col("raise_interest_rates"), days, F.col("max_allowance_amount")
        ).alias("add_rate_amt"),
        "create_time",
    )


def member_days(trades: DataFrame) -> DataFrame:
    """Trades per coupon, member and day, beside all that the member spent that day.

    ``spend`` and ``spend_n`` leave out repeats of a trade under several coupons. ``first``
    marks one row of every member and day, a coupon-paid one if there is any.
    """
    rows = trades.filter(F.col("fund_trans_type") == FIXED_TERM)
    paid = (F.col("is_coupon_trans") == 1) & (F.col("coupon_trans_eq_issue") == 1)
    # One pass over the joined trades feeds both parts.
    base = rows.groupBy("member_no", "trans_time", "fund_trans_amount", "issue_coupon_id").agg(
        N().alias("n"), F.count_if(paid).alias("paid_n"),
        F.sum(F.when(paid, F.col("deduction_amt"))).alias("deduction"),
        F.sum(F.when(paid, F.col("add_rate_amt"))).alias("add_rate"),
    )
    base = scratch_table(base, "trades")
    day = F.to_date("trans_time").alias("trans_date")
    coupon_days = base.groupBy(F.col("issue_coupon_id").alias("activity_coupon_id"), "member_no", day).agg(
        F.sum(F.col("fund_trans_amount") * F.col("n")).alias("amt"),
        F.sum("paid_n").alias("paid_n"),
        F.sum(F.when(F.col("paid_n") > 0, F.col("fund_trans_amount") * F.col("paid_n"))).alias("paid_amt"),
        F.sum("deduction").alias("deduction"),
        F.sum("add_rate").alias("add_rate"),
    )
    spend_days = (
        base.select("member_no", "trans_time", "fund_trans_amount").distinct()
        .groupBy("member_no", day).agg(F.sum("fund_trans_amount").alias("spend"), N().alias("spend_n"))
    )
    # at most one row for each coupon of the campaign
    of_day = Window.partitionBy("member_no", "trans_date").orderBy(F.desc(F.col("paid_n") > 0), "activity_coupon_id")
    rows = coupon_days.join(spend_days, ["member_no", "trans_date"]).withColumn("first", F.row_number().over(of_day) == 1)
    return scratch_table(rows, "member-days")


def issue_totals(given: DataFrame) -> DataFrame:
    return given.groupBy("activity_coupon_id").agg(F.sum("cnt").alias("issue_cnt"), N().alias("issue_user_cnt"))


def _invested():
    return F.sum("amt").alias("trans_amt"), F.count_distinct("member_no").alias("trans_user_cnt")


def _paid_figures():
    return (
        F.sum("paid_amt").alias("coupon_trans_amt"),
        F.count_distinct("member_no").alias("coupon_trans_user_cnt"),
        F.sum("paid_n").alias("coupon_trans_cnt"),
        F.sum("deduction").alias("coupon_deduction_amt"),
        F.sum("add_rate").alias("coupon_add_rate_amt"),
    )


def investment(days: DataFrame) -> DataFrame:
    """Invested amount and people per coupon and day."""
    return days.groupBy("activity_coupon_id", "trans_date").agg(*_invested())


def paid_investment(days: DataFrame) -> DataFrame:
    """Coupon-paid figures per coupon and day."""
    paid = days.filter(F.col("paid_n") > 0)
    return paid.groupBy("activity_coupon_id", "trans_date").agg(*_paid_figures())


def coupon_user_spend(days: DataFrame) -> DataFrame:
    """All spend of coupon users on the day they paid with a coupon, per coupon and day."""
    return days.filter(F.col("paid_n") > 0).groupBy("activity_coupon_id", "trans_date").agg(
        F.sum("spend_n").alias("coupon_trans_cnt_all"), F.count_distinct("member_no").alias("coupon_trans_user_cnt_all"),
        F.sum("spend").alias("coupon_trans_amt_all"),
    )


FIGURES = (
    "issue_cnt", "issue_user_cnt", "trans_amt", "trans_user_cnt", "coupon_trans_amt", "coupon_trans_user_cnt",
    "coupon_trans_cnt", "coupon_deduction_amt", "coupon_add_rate_amt", "coupon_trans_amt_all",
)
#: Levels: per coupon and day, per coupon, over all.
COUPON_DAY, COUPON, ALL = 0, 1, 3


def levels(given: DataFrame, days: DataFrame, only: Sequence[int] = (COUPON_DAY, COUPON, ALL)) -> DataFrame:
    """The levels stacked; keys are text in every level, a coupon without trades keeps one row with a null day.

    Issues and trades are rows of one table. It is summed per member in each level, and
    then over the members, which counts people once whatever their coupons and days.
    """
    paid = F.col("paid_n") > 0
    trades = days.select(
        "activity_coupon_id", "trans_date", "member_no", "amt", "paid_n", "paid_amt", "deduction", "add_rate",
        F.when(paid, F.col("spend")).alias("user_spend"), F.when(F.col("first"), F.col("spend")).alias("whole_spend"),
        F.when(F.col("first") & paid, F.col("spend")).alias("whole_user_spend"), F.lit(True).alias("traded"),
    )
    rows = trades.unionByName(given.select("activity_coupon_id", "member_no", F.col("cnt").alias("issued")), allowMissingColumns=True)
    nobody = given.sparkSession.range(1).select(F.lit(None).cast(given.schema["member_no"].dataType).alias("member_no"))
    rows = rows.unionByName(nobody, allowMissingColumns=True)  # so that the level over all always has its row
    key, day, member = F.col("activity_coupon_id"), F.col("trans_date"), F.col("member_no")
    sums = ("issued", "amt", "paid_n", "paid_amt", "deduction", "add_rate", "user_spend", "whole_spend", "whole_user_spend")
    each = rows.groupingSets([[key, day, member], [key, member], [member]], key, day, member).agg(
        (2 * F.grouping(key) + F.grouping(day)).cast("int").alias("_level"), F.max("traded").alias("traded"), *[F.sum(c).alias(c) for c in sums])
    whole = F.col("_level") == ALL
    people = lambda test: F.count_if(test)
    summed = each.groupBy("_level", key, day).agg(
        F.sum("issued").alias("issue_cnt"), people(F.col("issued").isNotNull()).alias("issue_user_cnt"), F.sum("amt").alias("amt"), people(F.col("traded")).alias("people"),
        F.sum("paid_amt").alias("coupon_trans_amt"), people(paid).alias("payers"), F.sum("paid_n").alias("paid_n"), F.sum("deduction").alias("coupon_deduction_amt"),
        F.sum("add_rate").alias("coupon_add_rate_amt"), *[F.sum(c).alias(c) for c in sums[6:]],
    )
    # a few rows for each coupon: its issues go to its days, and its row without a day goes where it has days
    of_coupon = Window.partitionBy(key, F.col("_level") == ALL)
    beside = lambda c: F.max(F.when(F.col("_level") == COUPON, F.col(c))).over(of_coupon)
    placed = summed.withColumns({"_issue_cnt": beside("issue_cnt"), "_issue_user_cnt": beside("issue_user_cnt"), "_people": beside("people")})
    placed = placed.filter(F.col("_level").isin(*only) & (whole | key.isNotNull()) & ~((F.col("_level") == COUPON_DAY) & day.isNull() & (F.col("_people") > 0)))
    some = lambda c, n: F.when(whole | (F.col(n) > 0), F.col(c))
    return placed.select(
        F.when(whole, TOTAL).otherwise(key.cast("string")).alias("activity_coupon_id"), F.when(F.col("_level") == COUPON_DAY, day.cast("string")).otherwise(TOTAL).alias("trans_date"),
        F.when(whole, F.col("issue_cnt")).otherwise(F.col("_issue_cnt")).alias("issue_cnt"), F.when(whole, F.col("issue_user_cnt")).otherwise(F.col("_issue_user_cnt")).alias("issue_user_cnt"),
        F.when(whole, F.col("whole_spend")).otherwise(F.col("amt")).alias("trans_amt"), some("people", "people").alias("trans_user_cnt"),
        "coupon_trans_amt", some("payers", "payers").alias("coupon_trans_user_cnt"), some("paid_n", "payers").alias("coupon_trans_cnt"), "coupon_deduction_amt", "coupon_add_rate_amt",
        F.when(whole, F.col("whole_user_spend")).otherwise(F.col("user_spend")).alias("coupon_trans_amt_all"),
    )


def per_coupon_day(given: DataFrame, days: DataFrame) -> DataFrame:
    """A coupon without trades keeps one row with a null day."""
    return levels(given, days, [COUPON_DAY])


def per_coupon(given: DataFrame, days: DataFrame) -> DataFrame:
    """Totals over all days: distinct people do not add up over days."""
    return levels(given, days, [COUPON])


def grand_total(given: DataFrame, days: DataFrame) -> DataFrame:
    """One row over all coupons; repeats of one trade under several coupons count once."""
    return levels(given, days, [ALL])


def market(c: Campaign) -> DataFrame:
    """Market totals per day, with one row for the whole window."""
    rows = c.trades.filter(
        F.col("status").isin(*SETTLED) & (F.col("fund_trans_type") == FIXED_TERM) & P.in_date_ranges("trans_time", c.trade_days)
    )
    by_day = rows.withColumn("day", F.to_date("trans_time").cast("string")).rollup("day")
    return by_day.agg(F.grouping("day").alias("_g"), F.sum("fund_trans_amount").alias("market_amt")).select(
        F.when(F.col("_g") == 1, TOTAL).otherwise(F.col("day")).alias("trans_date"), "market_amt"
    )


def labels(c: Campaign) -> DataFrame:
    e = c.coupons.select("id", "name", "rule_id")
    r = c.rules.select(F.col("id").alias("rule_id"), "satisfied_amount", "discount_amount", "raise_interest_rates")
    label = G.coupon_label(F.col("name"), F.col("satisfied_amount"), F.col("discount_amount"), F.col("raise_interest_rates"))
    return e.join(r, "rule_id").select(F.col("id").cast("string").alias("activity_coupon_id"), label.alias("coupon_name"))


def report(c: Campaign) -> DataFrame:
    """The effect report, ordered by day and coupon."""
    given = issued(c)
    days = member_days(recipient_trades(c, given))
    rows = levels(given, days).join(market(c), "trans_date", "left").join(labels(c), "activity_coupon_id", "left")
    coupon, day = F.col("activity_coupon_id"), F.col("trans_date")
    zero = F.lit(0)
    as_double = lambda name: F.coalesce(F.col(name), zero).cast("double").alias(name)
    count = lambda name: F.coalesce(F.col(name), zero).alias(name)
    deduction, add_rate = F.col("coupon_deduction_amt").cast("double"), F.col("coupon_add_rate_amt")
    sms = G.sms_cost(coupon, day, F.col("issue_user_cnt"))
    whole = lambda name: F.coalesce(F.col(name).cast("decimal(20,0)"), zero).cast("bigint")
    return rows.select(
        coupon, F.coalesce("coupon_name", F.lit("")).alias("coupon_name"), count("issue_user_cnt"), count("issue_cnt"), day,
        as_double("trans_amt"), count("trans_user_cnt"), as_double("coupon_trans_amt"), count("coupon_trans_user_cnt"),
        G.percent_text(F.col("coupon_trans_user_cnt"), F.col("issue_user_cnt")).alias("coupon_trans_rate"),
        count("coupon_trans_cnt"),
        G.percent_text(F.col("coupon_trans_cnt"), F.col("issue_cnt")).alias("coupon_use_rate"),
        as_double("coupon_deduction_amt"),
        F.coalesce(F.round(add_rate, 2), zero).alias("coupon_add_rate_amt"),
        F.round(deduction + add_rate, 2).alias("coupon_cost"),
        F.round(sms, 0).alias("sms_cost"),
        F.coalesce(F.round(deduction + add_rate + sms, 4), zero).alias("marketing_cost"),
        whole("coupon_trans_amt_all").alias("coupon_trans_amt_all"),
        whole("market_amt").alias("trans_amt_all"),
        G.percent_text(F.col("coupon_trans_amt_all"), F.col("market_amt")).alias("coupon_trans_all_rate"),
    ).orderBy("trans_date", "activity_coupon_id")
