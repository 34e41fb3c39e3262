"""Figures of the campaign reports as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Words in coupon names and the price of one text message.
CASH_COUPON, RATE_COUPON = "现金券", "加息券"
SMS_PRICE = 0.032
TOTAL = "TOTAL"


def term_days(due: str | Column, inception: str | Column) -> Column:
    return F.datediff(due, inception)


def coupon_flags(used: str, issued: str, coupons: Sequence[int]) -> list[Column]:
    """Traded with one of the chosen coupons; traded with the coupon that was issued."""
    return [
        F.when(F.col(used).isin(*coupons), 1).otherwise(0).alias("is_coupon_trans"),
        F.when(F.col(used) == F.col(issued), 1).otherwise(0).alias("coupon_trans_eq_issue"),
    ]


def rate_subsidy(name: Column, amount: Column, rate: Column, days: Column, cap: Column) -> Column:
    """Interest paid by a rate coupon, at most the cap; 0 where product or cap is null."""
    interest = amount.cast("double") * (rate.cast("double") / 10000) * days / 365
    cap = cap.cast("double")
    granted = F.contains(name, F.lit(RATE_COUPON)) & interest.isNotNull() & cap.isNotNull()
    return F.when(granted, F.least(interest, cap)).otherwise(F.lit(0.0))


def percent_text(part: Column, whole: Column) -> Column:
    """``12.3457%``; '0' where the share is undefined."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.concat(share.cast("decimal(10,4)").cast("string"), F.lit("%")), F.lit("0"))


def coupon_label(name: Column, satisfied: Column, discount: Column, rate: Column) -> Column:
    """Full-A-minus-B for cash coupons, plus-rate for rate coupons."""
    cash = F.concat(F.lit("满"), satisfied.cast("int").cast("string"), F.lit("减"), discount.cast("int").cast("string"))
    plus = F.concat(F.lit("加息"), (rate.cast("double") / 100).cast("string"), F.lit("%"))
    return F.when(F.contains(name, F.lit(CASH_COUPON)), cash).when(F.contains(name, F.lit(RATE_COUPON)), plus)


def sms_cost(coupon: Column, day: Column, people: Column) -> Column:
    """Messages are counted once, on the grand total row."""
    return F.when((coupon == TOTAL) & (day == TOTAL), people * F.lit(SMS_PRICE)).otherwise(F.lit(0.0))


def rounded(columns: Sequence[str], digits: int = 0) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def labelled(labels: dict[str, str]) -> list[Column]:
    """Chosen columns under their labels."""
    return [F.col(c).alias(label) for c, label in labels.items()]
