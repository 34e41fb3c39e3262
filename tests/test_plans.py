"""Plans: pushed filters, pruned columns, no pair-wise joins, no row-wise Python in the hot path."""

import contextlib
import io

from marketlens.operators import listfilter
from marketlens.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        catalogue.queries()[name](spark, FOLDER).explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "src_5_read_filter")
    assert "GreaterThanOrEqual(l_shipdate" in text and "EqualTo(l_returnflag,R)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text
    assert "GreaterThanOrEqual(o_orderdate" in plan(spark, "flt_5_date_ranges")


def test_no_pair_wise_joins_and_no_python_rows(spark):
    for name in ("seg_15_whole_definition", "eff_11_report", "deal_4_report", "look_3_lookup", "win_1_rank", "agg_25_percentile", "mon_16_channel_funnel"):
        text = plan(spark, name)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in text, (name, bad)


def test_top_rows_are_limited_before_the_shuffle(spark):
    assert "TakeOrderedAndProject" in plan(spark, "cat_1_visible_newest")


def test_group_edges_sort_no_rows(spark):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = listfilter.group_edges(rows, "l_extendedprice", 10, True, ["l_returnflag"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") == 1 and "WindowGroupLimit" not in text  # of the counted values


def test_group_figures_need_no_shuffle_of_the_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("agg_30_avedev", "win_3_standardize", "trd_5_polynomial", "flt_17_top_and_bottom"):
            assert "SortMergeJoin" not in plan(spark, name) and "ShuffledHashJoin" not in plan(spark, name), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_date_groups_reach_the_scan(spark):
    assert "GreaterThanOrEqual(ts" in plan(spark, "flt_12_date_groups")


def test_all_orders_take_two_scans(spark):
    from marketlens.operators import trend

    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = trend.best_fit(rows, "l_extendedprice", "l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") <= 2
    assert plan(spark, "trd_6_best_fit").count("Scan parquet") <= 4  # the figures of the groups are a written table, each node is listed twice


def test_report_levels_are_one_aggregate(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = catalogue.queries()["eff_11_report"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange ") <= 16 and text.count("Expand") == 2  # the levels, and the market by day
        assert "Join" not in catalogue.queries()["eff_9_stacked_levels"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
