"""Registered ranking queries (WIN rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import ordered as O
from marketlens.operators import places as P
from marketlens.registry import query


@query(
    "win_1_rank",
    """select o_orderkey, rank() over (order by o_orderdate desc) as rank_all, rank() over (partition by o_orderstatus order by o_orderdate) as rank_in_status from orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    rows = P.ranked(rows, "o_orderdate", name="rank_all")
    rows = P.ranked(rows, "o_orderdate", ["o_orderstatus"], descending=False, name="rank_in_status")
    return rows.select("o_orderkey", "rank_all", "rank_in_status")


@query(
    "win_2_percentrank",
    """with o as (select o_orderstatus, o_orderkey, o_totalprice from orders),
    near as (select o_orderstatus, max(o_totalprice) filter (where o_totalprice <= 250000.5) as lo, min(o_totalprice) filter (where o_totalprice >= 250000.5) as hi,
      count(*) filter (where o_totalprice <= 250000.5) as n, count(*) as total from o group by 1)
    select o_orderkey, round(percent_rank() over (partition by o_orderstatus order by o_totalprice), 3) as percent_rank,
      round((n - 1 + (250000.5 - lo) / (hi - lo)) / (total - 1), 3) as probe_rank from o join near using (o_orderstatus)""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    probe = O.percent_rank_of(rows, "o_totalprice", 250000.5, ["o_orderstatus"], name="probe_rank")
    placed = P.percent_ranked(rows, "o_totalprice", ["o_orderstatus"])
    return placed.join(probe, "o_orderstatus").select("o_orderkey", "percent_rank", "probe_rank")


@query(
    "win_3_standardize",
    """select l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) over (partition by l_returnflag)) / stddev_samp(l_quantity) over (partition by l_returnflag), 6) as z_in_flag,
    round((l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over (), 6) as z from lineitem""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    rows = O.standardized(O.standardized(rows, "l_quantity", ["l_returnflag"], "z_in_flag"), "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("z_in_flag", 6).alias("z_in_flag"), F.round("z", 6).alias("z"))
