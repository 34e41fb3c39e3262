"""Dashboard and monitoring row sets over a table of activities.

``activities`` has one row per activity: member_no, kind (register, certify, bind,
deal, withdraw), at (timestamp), amount, channel, sub_channel, coupon.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlens.functions.predicates import in_date_ranges
from marketlens.operators.scratch import scratch_table

TOTAL = "TOTAL"
REGISTER, CERTIFY, BIND, DEAL, WITHDRAW = "register", "certify", "bind", "deal", "withdraw"


def N(): return F.count(F.lit(1))


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _amount(kind: str) -> Column:
    return F.sum(F.when(_is(kind), F.col("amount")).otherwise(0.0))


def day_totals(activities: DataFrame, ref: dt.date) -> DataFrame:
    """Registrations, deals and amount of the reference day and the two days before."""
    rows = activities.filter(in_date_ranges("at", [(ref - dt.timedelta(days=2), ref)]))
    back = F.datediff(F.lit(ref), "at")
    return rows.groupBy(back.alias("time_key")).agg(
        F.count_if(_is(REGISTER)).alias("register_count"), F.count_if(_is(DEAL)).alias("deal_count"), _amount(DEAL).alias("deal_amount")
    ).withColumn("time_name", F.element_at(F.array(F.lit("today"), F.lit("yesterday"), F.lit("day before")), F.col("time_key") + 1))


def hour_curve(activities: DataFrame, ref: dt.date) -> DataFrame:
    """Deal amount per hour, the reference day beside the day before."""
    rows = activities.filter(_is(DEAL) & in_date_ranges("at", [(ref - dt.timedelta(days=1), ref)]))
    today = F.to_date("at") == F.lit(ref)
    return rows.groupBy(F.hour("at").alias("hour")).agg(
        F.sum(F.when(today, F.col("amount"))).alias("today_hour"), F.sum(F.when(~today, F.col("amount"))).alias("yesterday_hour")
    )


def month_window(ref: dt.date, whole: bool = False) -> tuple[dt.date, dt.date]:
    """First day of the month up to the reference day, or up to the month's end."""
    first = ref.replace(day=1)
    last = (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
    return first, last if whole else min(ref, last)


def month_figures(activities: DataFrame, ref: dt.date, whole: bool = False) -> DataFrame:
    """Month key figures; new deals are those of members whose first deal falls in the window."""
    window = month_window(ref, whole)
    rows = activities.filter(in_date_ranges("at", [window]))
    deals = activities.filter(_is(DEAL))
    inside = in_date_ranges("at", [window])
    per_member = deals.groupBy("member_no").agg(
        F.min("at").alias("at"), F.sum(F.when(inside, F.col("amount"))).alias("value"), F.count_if(inside).alias("deals")
    )
    new = per_member.filter(in_date_ranges("at", [window])).agg(F.struct(N().alias("n"), F.sum("value").alias("value"))).scalar()
    return rows.agg(
        F.count_if(_is(REGISTER)).alias("register_nums"), F.count_if(_is(CERTIFY)).alias("realname_nums"), F.count_if(_is(BIND)).alias("bind_nums"),
        F.count_if(_is(DEAL)).alias("trans_nums"), _amount(DEAL).alias("trans_values"),
    ).select("*", new["n"].alias("new_trans_nums"), new["value"].alias("new_trans_values"))


def coupon_use(activities: DataFrame, coupon_kind: Column, profit: Column) -> DataFrame:
    """Users, orders, value and profit per coupon, with a total per kind and over all.

    One exchange: members are reduced per coupon first, distinct people are counted on that.
    """
    rows = activities.filter(_is(DEAL)).select(coupon_kind.alias("coupon_kind"), F.col("coupon").cast("string").alias("coupon"), "member_no", "amount", profit.alias("profit"))
    reduced = rows.groupBy("coupon_kind", "coupon", "member_no").agg(N().alias("n"), F.sum("amount").alias("amount"), F.sum("profit").alias("profit"))
    return reduced.rollup("coupon_kind", "coupon").agg(
        F.grouping("coupon_kind").alias("_a"), F.grouping("coupon").alias("_b"), F.count_distinct("member_no").alias("coupon_users"),
        F.sum("n").alias("coupon_orders"), F.sum("amount").alias("coupon_order_values"), F.sum("profit").alias("coupon_profit_values"),
    ).select(_total("coupon_kind", "_a"), _total("coupon", "_b"), "coupon_users", "coupon_orders", "coupon_order_values", "coupon_profit_values")


def _total(name: str, flag: str) -> Column:
    return F.when(F.col(flag) == 1, TOTAL).otherwise(F.col(name)).alias(name)


def withdrawals(activities: DataFrame, ref: dt.date) -> DataFrame:
    """Withdrawals per day of the month, with the sum of the month."""
    rows = activities.filter(_is(WITHDRAW) & in_date_ranges("at", [month_window(ref, whole=True)]))
    by_day = rows.withColumn("day", F.to_date("at").cast("string")).rollup("day")
    return by_day.agg(F.grouping("day").alias("_g"), N().alias("n"), F.sum("amount").alias("amount")).select(_total("day", "_g"), "n", "amount")


def channel_counts(activities: DataFrame) -> DataFrame:
    """Registrations and deals per channel and sub-channel, with totals."""
    return activities.rollup("channel", "sub_channel").agg(
        F.grouping("channel").alias("_a"), F.grouping("sub_channel").alias("_b"),
        F.count_if(_is(REGISTER)).alias("register_count"), F.count_if(_is(DEAL)).alias("deal_count"), _amount(DEAL).alias("deal_amount"),
    ).select(_total("channel", "_a"), _total("sub_channel", "_b"), "register_count", "deal_count", "deal_amount")


def amount_ranges(df: DataFrame, amount: str, edges: Sequence[float]) -> DataFrame:
    """Rows and sum per amount range [edge, next edge)."""
    x = F.col(amount)
    label = F.when(x < edges[0], f"<{edges[0]:g}")
    for low, high in zip(edges, edges[1:]):
        label = label.when(x < high, f"{low:g}-{high:g}")
    return df.groupBy(label.otherwise(f">={edges[-1]:g}").alias("amount_range")).agg(N().alias("n"), F.sum(x).alias("amount"))


def product_sums(df: DataFrame, product: str, amount: str) -> DataFrame:
    return df.groupBy(product).agg(N().alias("n"), F.sum(amount).alias("amount"))


def hour_bands(df: DataFrame, at: str, term: str, amount: str, terms: Sequence[int] = (3, 6, 9, 12, 18, 24)) -> DataFrame:
    """Amount per six-hour band, one column per product term in months."""
    band = F.floor(F.hour(at) / 6).cast("int").alias("hour_type")
    wide = df.groupBy(band).pivot(term, list(terms)).agg(F.sum(amount))
    return wide.select("hour_type", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"m_{m}_values") for m in terms])


def last_seven_days(df: DataFrame, group: str, at: str, amount: str, ref: dt.date) -> DataFrame:
    """One row per group, the seven days before the reference day side by side."""
    rows = df.filter(in_date_ranges(at, [(ref - dt.timedelta(days=7), ref - dt.timedelta(days=1))]))
    back = F.datediff(F.lit(ref), at)
    return rows.groupBy(group).agg(*[F.sum(F.when(back == k, F.col(amount)).otherwise(0.0)).alias(f"trans_amt_sub{k}d") for k in range(1, 8)])


def factor_correlation(df: DataFrame, target: str, factors: Sequence[str]) -> DataFrame:
    """Correlation of every factor with the target, from one pass."""
    wide = df.agg(*[F.corr(f, target).alias(f) for f in factors])
    return wide.unpivot([], list(factors), "factor", "variable_corr")


def daily_trend(df: DataFrame, series: Sequence[str], at: str, amount: str, days: int = 7) -> DataFrame:
    """Daily sums with their moving average. The window runs over days, not over rows of the table."""
    daily = df.groupBy(*series, F.to_date(at).alias("trans_date")).agg(F.sum(amount).alias("trans_amount"))
    w = Window.partitionBy(*series).orderBy("trans_date").rowsBetween(1 - days, 0)
    return daily.withColumn("mv_trans_amount", F.avg("trans_amount").over(w))


def masked_trend(daily: DataFrame, series: Sequence[str]) -> DataFrame:
    """A zero trend value is hidden on the first row, or when the row before is zero too."""
    w = Window.partitionBy(*series).orderBy("trans_date")
    before = F.coalesce(F.lag("mv_trans_amount").over(w), F.lit(0.0))
    hidden = (F.col("mv_trans_amount") == 0) & (before == 0)
    return daily.withColumn("mv_trans_amount", F.when(~hidden, F.col("mv_trans_amount")))


def signals(wide: DataFrame, group: str, k: float = 1.0) -> DataFrame:
    """Green, yellow or red: the last day against mean and k deviations of the seven days."""
    days = [F.col(f"trans_amt_sub{i}d") for i in range(1, 8)]
    mean = sum(days[1:], days[0]) / 7
    spread = F.sqrt(sum([(d - mean) * (d - mean) for d in days[1:]], (days[0] - mean) * (days[0] - mean)) / 7)
    last = days[0]
    signal = F.when(last >= mean - k * spread, "green").when(last >= mean - 2 * k * spread, "yellow").otherwise("red")
    return wide.withColumn("signal", signal)


def actual_and_predicted(daily: DataFrame, series: Sequence[str]) -> DataFrame:
    """Daily amounts beside the line fitted through them."""
    day = F.datediff("trans_date", F.lit(dt.date(1970, 1, 1))).cast("double")
    rows = daily.withColumn("_x", day)
    line = rows.groupBy(*series).agg(F.regr_slope("trans_amount", "_x").alias("_b"), F.regr_intercept("trans_amount", "_x").alias("_a"))
    joined = rows.join(line, list(series))
    return joined.withColumn("pre_amount", F.col("_a") + F.col("_b") * F.col("_x")).drop("_a", "_b", "_x")


def channel_funnel(activities: DataFrame) -> DataFrame:
    """Members registered, certified, with card and trading per channel, and the rates between the steps.

    Members are reduced to flags first; the counts are then plain sums.
    """
    flags = activities.groupBy("channel", "member_no").agg(*[F.max(_is(k).cast("int")).alias(k) for k in (REGISTER, CERTIFY, BIND, DEAL)])
    reg, cert, card, trans = [F.sum(c) for c in (REGISTER, CERTIFY, BIND, DEAL)]
    counts = flags.groupBy("channel").agg(reg.alias("reg_cnt"), cert.alias("cert_cnt"), card.alias("card_cnt"), trans.alias("trans_cnt"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return counts.select(
        "*", rate("cert_cnt", "reg_cnt").alias("reg_cert_rate"), rate("card_cnt", "cert_cnt").alias("cert_card_rate"),
        rate("trans_cnt", "card_cnt").alias("card_trans_rate"), rate("trans_cnt", "reg_cnt").alias("reg_trans_rate"),
    )


def sorted_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    c = F.col(column).cast("double")
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def channel_clusters(df: DataFrame, channel: str, measures: Sequence[str], k: int, rounds: int = 12) -> DataFrame:
    """Label per channel, size of its cluster and the channel nearest to the centre.

    Measures are standardised (a missing one counts as the mean). The first centre is the
    channel farthest from the mean, each further one the channel farthest from all centres
    so far; labels follow that order. Then channels go to the nearest centre and centres to
    the mean of their channels, until no centre moves or the rounds are over. Ties go to
    the smaller label or channel; a cluster without channels keeps its centre. Only the k
    centres reach the driver.
    """
    figures = df.agg(F.struct(*[F.avg(m).alias(f"a_{m}") for m in measures], *[F.stddev_samp(m).alias(f"s_{m}") for m in measures]).alias("f")).first().f
    scaled = [F.coalesce(F.try_divide(F.col(m) - F.lit(figures[f"a_{m}"]), F.lit(figures[f"s_{m}"])), F.lit(0.0)) for m in measures]
    rows = scratch_table(df.select(channel, *measures, F.array(*scaled).alias("_z")), "channels")

    def distance(centre: Sequence[float]) -> Column:
        return sum(((F.get("_z", F.lit(i)) - F.lit(float(v))) * (F.get("_z", F.lit(i)) - F.lit(float(v))) for i, v in enumerate(centre)), F.lit(0.0))

    centres: list[list[float]] = []
    for _ in range(k):
        gaps = [distance(c) for c in centres or [[0.0] * len(measures)]]
        far = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        found = rows.agg(F.min_by("_z", F.struct(-far, channel)).alias("z"), F.max(far).alias("d")).first()
        if found.z is None or (centres and found.d == 0):
            break  # fewer distinct channels than clusters
        centres.append(list(found.z))
    if not centres:
        return df.select(channel, F.lit(0).alias("clus_label"), *measures, F.lit(0).cast("bigint").alias("channel_count"), F.col(channel).alias("cent_channel"))

    def labelled() -> DataFrame:
        nearest = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("label")) for i, c in enumerate(centres)]))
        return rows.withColumn("_near", nearest).select(channel, F.col("_near.label").alias("clus_label"), *measures, "_z", F.col("_near.d").alias("_d"))

    for _ in range(rounds):
        means = labelled().groupBy("clus_label").agg(F.array(*[F.avg(F.get("_z", F.lit(i))) for i in range(len(measures))]).alias("z")).collect()
        moved = [next((list(r.z) for r in means if r.clus_label == i), c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    final = labelled().drop("_z")
    sizes = final.groupBy("clus_label").agg(N().alias("channel_count"), F.min_by(channel, F.struct("_d", channel)).alias("cent_channel"))
    return final.drop("_d").join(sizes, "clus_label")


def cluster_profile(df: DataFrame, label: str, measures: Sequence[str]) -> DataFrame:
    """Mean of every measure per cluster label."""
    return df.groupBy(label).agg(*[F.avg(m).alias(f"avg_{m}") for m in measures])
