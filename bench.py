"""Headline queries, timed: one warm-up run, then the median of three (or BENCH_RUNS).

Prints one JSON line. Results are written to the noop sink, so all columns of all rows
are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from marketlens.plans import catalogue
from marketlens.operators.scratch import clear_scratch
from marketlens.session import local_session

HEADLINE = (
    "seg_6_bought", "seg_15_whole_definition", "flt_17_top_and_bottom", "eff_2_recipient_trades", "eff_11_report", "deal_4_report",
    "cat_4_latest_effects", "agg_1_sum", "agg_25_percentile", "win_1_rank", "look_1_vlookup", "look_3_lookup", "mon_12_daily_trend",
    "mon_16_channel_funnel", "trd_5_polynomial", "trd_6_best_fit", "fin_5_xirr", "fin_8_ipmt", "dt_8_networkdays", "text_3_permalink",
    "src_7_markup_items", "snk_5_split_output",
)


def timed(build, spark, folder) -> float:
    start = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, app="marketlens-bench")
    queries = catalogue.queries()
    seconds = {}
    for name in HEADLINE:
        timed(queries[name], spark, folder)
        seconds[name] = round(statistics.median(timed(queries[name], spark, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
