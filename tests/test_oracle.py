"""Registered queries against their SQL on the smallest tables.

By default one or more queries of every family; MARKETLENS_ALL=1 runs all of them.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import compare, duck  # noqa: E402

from marketlens.plans import catalogue  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CHOSEN = """src_3_delimited src_7_markup_items src_12_normalised_values src_13_serial_dates snk_1_saved_audience snk_5_split_output snk_7_quoted_lines
flt_1_missing flt_13_custom_rules flt_15_relative_dates flt_17_top_and_bottom flt_19_validation_report prj_3_rate_subsidy prj_6_costs jn_2_after_first_issue jn_7_member_day
jn_12_fund_chain seg_3_not_used_all_issued seg_6_bought seg_9_best_by_score seg_15_whole_definition eff_6_coupon_user_spend eff_8_grand_total eff_11_report deal_4_report
cat_1_visible_newest cat_4_latest_effects cat_9_model_tree mon_3_month_figures mon_4_coupon_use mon_13_masked_trend mon_16_channel_funnel trd_1_linear_by_order trd_5_polynomial
trd_6_best_fit text_1_convert text_5_sentence agg_9_subtotal agg_24_mode agg_25_percentile agg_27_trimmean agg_41_kurt agg_52_linest agg_56_ztest db_1_dsum db_12_dget win_1_rank
win_2_percentrank look_1_vlookup look_3_lookup look_4_match look_8_offset look_9_matrix_product log_13_istext txt_8_text txt_26_substitute_second dt_5_datedif dt_7_yearfrac
dt_8_networkdays dt_9_workday dt_17_weeknum math_20_ceiling math_30_mod math_41_convert_table fin_4_irr fin_5_xirr fin_9_ppmt fin_20_db fin_21_ddb str_1_hourly_totals""".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
NAMES = [n for n in QUERIES if n in ORACLES] if os.environ.get("MARKETLENS_ALL") else CHOSEN


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    verdict, _, _, note = compare(spark, con, name, FOLDER, QUERIES, ORACLES)
    assert verdict == "ok", note or verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
