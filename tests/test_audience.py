import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import audience as A
from marketlens.operators import effect as E


def members(spark):
    rows = [
        ("1", "m1", "1", "c", "ios", 5, "男", 10.0), ("2", "m2", "0", "c", "ios", 9, None, 20.0), ("3", "m3", "1", "c", "web", 7, "女", None),
        ("4", "m4", None, "c", "web", 1, "女", 40.0),
    ]
    return spark.createDataFrame(
        rows, "member_no string, mobile string, named string, device_cid string, device_type string, score_tag_result int, sex string, balance double")


def chosen(frame):
    return sorted(r["member_no"] for r in frame.collect())


def pick(spark, *tags):
    return chosen(A.audience(A.Warehouse(members(spark)), [A.Group(list(tags))]))


def test_null_term_passes_by_every_other_term(spark):
    assert pick(spark, A.Tag(1, ("是",), "named"), A.Tag(3, ((0, 15),), "balance"), A.Tag(0, (), "balance")) == ["1", "3"]


def test_group_of_null_terms_only(spark):
    assert pick(spark, A.Tag(0, (), "balance")) == ["3"]


def test_unknown_sex(spark):
    assert pick(spark, A.Tag(1, ("未知",), "sex")) == ["2"]
    assert pick(spark, A.Tag(1, ("男", "未知"), "sex"), A.Tag(2, ("ios",), "device_type")) == ["1", "2"]
    # Alone, the null term stands beside the other terms; with other sexes it stays inside them.
    assert pick(spark, A.Tag(1, ("未知",), "sex"), A.Tag(2, ("web",), "device_type")) == ["2", "3", "4"]


def test_best_by_score_and_semi_plus_anti_is_whole(spark):
    assert pick(spark, A.Tag(19, ("2",))) == ["2", "3"]
    some = members(spark).filter("balance > 15")
    kept, dropped = A.keep_members(members(spark), some), A.drop_members(members(spark), some)
    assert chosen(kept) == ["2", "4"] and chosen(dropped) == ["1", "3"]


def campaign(spark):
    t = lambda text: dt.datetime.fromisoformat(text)
    audience = spark.createDataFrame([("1",), ("2",), ("3",)], "member_no string")
    issues = spark.createDataFrame([
        ("1", 1, t("2024-01-01 10:00")), ("1", 2, t("2024-01-01 11:00")), ("2", 2, t("2024-01-02 09:00")), ("3", 3, t("2024-01-02 09:00")), ("9", 1, t("2024-01-02 09:00")),
    ], "user_id string, activity_coupon_id bigint, create_time timestamp")
    d = lambda v: v
    trades = spark.createDataFrame([
        ("1", 1, "a", "A", 6, 1, t("2024-01-03 10:00"), d(1000)), ("1", 1, "b", "B", 6, 1, t("2024-01-03 10:00"), d(1000)),
        ("2", 1, "c", "C", 8, 1, t("2024-01-03 12:00"), d(500)), ("2", 1, "d", "D", 9, 1, t("2024-01-01 12:00"), d(700)), ("2", 1, "e", "E", 9, 2, t("2024-01-04 12:00"), d(50)),
    ], "member_no string, product_id bigint, business_order_item_no string, fund_trans_order_no string, status int, fund_trans_type int, trans_time timestamp, a int")
    trades = trades.withColumn("fund_trans_amount", F.col("a").cast("decimal(18,2)")).drop("a").withColumn("discount_amount", F.lit(0).cast("decimal(18,2)"))
    products = spark.createDataFrame([(1, "p", dt.date(2024, 1, 1), dt.date(2024, 12, 31))], "id bigint, product_name string, inception_date date, due_date date")
    uses = spark.createDataFrame([("a", 2, 10), ("c", 2, 5)], "order_no string, activity_coupon_id bigint, d int").select("order_no", "activity_coupon_id", F.col("d").cast("decimal(18,2)").alias("deduction_amt"))
    coupons = spark.createDataFrame([(1, "现金券", 1, 1.0), (2, "加息券", 2, 3.0), (3, "加息券", 2, None)], "id bigint, name string, rule_id bigint, max_allowance_amount double")
    rules = spark.createDataFrame([(1, 100.0, 10.0, 0.0), (2, 0.0, 0.0, 100.0)], "id bigint, satisfied_amount double, discount_amount double, raise_interest_rates double")
    return E.Campaign(audience, issues, trades, products, uses, coupons, rules, (1, 2, 3), [("2024-01-01", "2024-01-05")], [("2024-01-01", "2024-01-31")])


def test_effect_report_edges(spark):
    rows = {(r["activity_coupon_id"], r["trans_date"]): r for r in E.report(campaign(spark)).collect()}
    day = "2024-01-03"
    # Two equal trades at one second count twice per coupon, once in the grand total.
    assert rows[("1", day)]["trans_amt"] == 2000 and rows[("2", day)]["trans_amt"] == 2500
    assert rows[("TOTAL", "TOTAL")]["trans_amt"] == 1500 and rows[("TOTAL", "TOTAL")]["trans_user_cnt"] == 2
    # The cap of the rate coupon: 1000 * 1% * 365 / 365 = 10 is cut to 3; 5 is cut to 3 as well.
    assert rows[("2", day)]["coupon_add_rate_amt"] == 6.0 and rows[("2", day)]["coupon_deduction_amt"] == 15
    assert rows[("2", day)]["coupon_trans_cnt"] == 2 and rows[("2", day)]["coupon_use_rate"] == "100.0000%"
    # A coupon without trades keeps a row without a day.
    assert rows[("3", None)]["trans_amt"] == 0 and rows[("3", None)]["issue_user_cnt"] == 1
    # The trade before the first issue is out; the market total has settled states only.
    assert rows[("2", "TOTAL")]["trans_amt"] == 2500 and rows[("TOTAL", "TOTAL")]["trans_amt_all"] == 2700
    assert rows[("TOTAL", "TOTAL")]["sms_cost"] == 0.0 and rows[("TOTAL", "TOTAL")]["issue_user_cnt"] == 3


def test_effect_report_of_nothing(spark):
    c = campaign(spark)
    c.issues = c.issues.limit(0)
    rows = E.report(c).collect()
    assert [(r["activity_coupon_id"], r["trans_date"], r["issue_cnt"], r["trans_amt"]) for r in rows] == [("TOTAL", "TOTAL", 0, 0.0)]
    c = campaign(spark)
    c.trades = c.trades.limit(0)
    rows = {(r["activity_coupon_id"], r["trans_date"]): r["issue_user_cnt"] for r in E.report(c).collect()}
    assert rows == {("1", None): 1, ("2", None): 2, ("3", None): 1, ("1", "TOTAL"): 1, ("2", "TOTAL"): 2, ("3", "TOTAL"): 1, ("TOTAL", "TOTAL"): 3}
