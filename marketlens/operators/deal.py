"""Effect report of product deals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marketlens.functions import figures as G
from marketlens.functions import predicates as P
from marketlens.operators.audience import SETTLED
from marketlens.operators.joins import salted_join
from marketlens.operators.scratch import scratch_table


@dataclass
class Deal:
    audience: DataFrame
    trades: DataFrame
    products: DataFrame
    alterations: DataFrame
    details: DataFrame
    trade_days: Sequence[tuple]
    words: Sequence[str] = ()


def audience_trades(d: Deal) -> DataFrame:
    """Settled trades of the audience in the window, of products whose name holds one of the words.

    A member listed more than once in the audience repeats the trades, as in a plain join.
    """
    rows = d.trades.filter(F.col("status").isin(*SETTLED) & P.in_date_ranges("trans_time", d.trade_days))
    products = d.products.filter(P.contains_any("product_name", d.words)) if d.words else d.products
    named = products.select(
        F.col("id").alias("product_id"), "product_name", "display_rate", G.term_days("due_date", "inception_date").alias("invest_days")
    )
    people = d.audience.groupBy("member_no").agg(F.count(F.lit(1)).alias("_times"))
    return salted_join(rows.join(named, "product_id"), people, ["member_no"], ["business_order_item_no"], counted=rows)


def product_trades(d: Deal, trades: DataFrame | None = None) -> DataFrame:
    """Times, orders, people and amounts per product, rate and term."""
    keys = ["product_id", "product_name", "display_rate", "invest_days"]
    return (audience_trades(d) if trades is None else trades).groupBy(*keys).agg(
        F.min("trans_time").alias("min_trans_time"),
        F.max("trans_time").alias("max_trans_time"),
        F.sum("_times").alias("trans_cnt"),
        F.count_distinct("member_no").alias("trans_usr_cnt"),
        F.sum(F.col("fund_trans_amount") * F.col("_times")).alias("trans_amt"),
        F.sum(F.col("discount_amount") * F.col("_times")).alias("discount_amt"),
    )


def traded_details(d: Deal, trades: DataFrame | None = None) -> DataFrame:
    """Distinct (fund detail, member) of those trades; orders are made distinct before the join."""
    orders = (audience_trades(d) if trades is None else trades).select("fund_trans_order_no", "member_no").distinct()
    altered = d.alterations.select(F.col("ftc_order_no").alias("fund_trans_order_no"), "fund_detail_uuid")
    return orders.join(altered, "fund_trans_order_no").select("fund_detail_uuid", "member_no").distinct()


def expected_income(d: Deal, trades: DataFrame | None = None) -> DataFrame:
    """Expected bonus and profit per product of the fund details.

    Details are summed per (detail, product) first, members are counted per detail; the
    product of both sums equals the sum over the joined rows.
    """
    members = traded_details(d, trades).groupBy("fund_detail_uuid").agg(F.count(F.lit(1)).alias("_members"))
    amounts = d.details.groupBy("fund_detail_uuid", "product_id").agg(
        F.sum("expect_bonus_amount").alias("bonus"), F.sum("expect_profit_amount").alias("profit")
    )
    names = d.products.select(F.col("id").alias("product_id"), "product_name")
    rows = members.join(amounts, "fund_detail_uuid").join(names, "product_id")
    return rows.groupBy("product_id", "product_name").agg(
        F.sum(F.col("bonus") * F.col("_members")).alias("invest_income"),
        F.sum(F.col("profit") * F.col("_members")).alias("invest_addrate"),
    )


def report(d: Deal) -> DataFrame:
    trades = scratch_table(audience_trades(d), "audience-trades")  # read and joined once for both parts
    income = expected_income(d, trades).select("product_id", "invest_income", "invest_addrate")
    return product_trades(d, trades).join(income, "product_id")
