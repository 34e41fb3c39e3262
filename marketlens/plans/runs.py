"""Registered catalog queries (CAT rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import runs as R
from marketlens.registry import query

# Catalog stand-ins: runs are orders, effects are line items, downloads are events.
RUNS_SQL = """select o_orderkey as id, 'run ' || o_orderpriority as name, 'user' || cast(o_custkey % 6 as varchar) as submitter,
    o_orderdate as create_time, case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end as task_status,
    o_orderdate + to_days(cast(o_custkey % 30 as integer)) as start_time, cast(o_orderkey % 5 = 0 as integer) as recycle from orders"""
EFFECTS_SQL = """select l_orderkey as prom_id, case when l_returnflag = 'N' then 'deal' else 'coupon' end as type,
    l_partkey * 10 + l_linenumber as id, l_shipdate as query_time, cast(l_quantity as bigint) as cnt from lineitem"""
DOWNLOADS_SQL = """select event_id as id, 'user' || cast(user_id % 6 as varchar) as "user", ts as time,
    case when event_type in ('view', 'purchase') then 1 else 0 end as status from events"""


def runs(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("run "), F.col("o_orderpriority")).alias("name"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 6).cast("string")).alias("submitter"),
        F.col("o_orderdate").alias("create_time"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("task_status"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_custkey") % 30).cast("int"))).alias("start_time"),
        (F.col("o_orderkey") % 5 == 0).cast("int").alias("recycle"),
    )


def effects(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("prom_id"),
        F.when(F.col("l_returnflag") == "N", "deal").otherwise("coupon").alias("type"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").alias("query_time"),
        F.col("l_quantity").cast("bigint").alias("cnt"),
    )


def downloads(t):
    return t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("user"), (F.col("user_id") % 6).cast("string")).alias("user"),
        F.col("ts").alias("time"),
        F.when(F.col("event_type").isin("view", "purchase"), 1).otherwise(0).alias("status"),
    )


def users(t):
    """Suppliers act as user accounts, nations as their ranks."""
    s = t.supplier
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("user"), F.col("s_suppkey").cast("string")).alias("name"),
        F.col("s_nationkey").alias("rid"),
    )


def ranks(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("rank"))


USERS_SQL = "select s_suppkey as id, 'user' || cast(s_suppkey as varchar) as name, s_nationkey as rid from supplier"
RANKS_SQL = "select n_nationkey as id, n_regionkey as rank from nation"
_ALL = f"with runs as ({RUNS_SQL}), effects as ({EFFECTS_SQL}), downloads as ({DOWNLOADS_SQL}), users as ({USERS_SQL}), ranks as ({RANKS_SQL})\n"
_VISIBLE = """select * from runs where recycle = 0 and submitter in (select u.name from users u join ranks r on u.rid = r.id
    where r.rank >= (select max(r2.rank) from users u2 join ranks r2 on u2.rid = r2.id where u2.name = 'user3'))"""
_DAY = "strftime(create_time, '%Y-%m-%d')"


@query("cat_1_visible_newest", _ALL + f"select id, submitter, {_DAY} as day from ({_VISIBLE}) order by create_time desc, id limit 200")
def _(t):
    shown = R.visible_runs(runs(t), users(t), ranks(t), "user3")
    return R.newest(shown, 200).select("id", "submitter", F.date_format("create_time", "yyyy-MM-dd").alias("day"))


@query("cat_2_page", _ALL + f"select id, name, {_DAY} as day from runs where recycle = 0 order by create_time desc, id limit 20 offset 40")
def _(t):
    return R.page(R.active(runs(t)), 40).select("id", "name", F.date_format("create_time", "yyyy-MM-dd").alias("day"))


@query("cat_3_one_run", _ALL + "select id, name, submitter from runs where id = 42")
def _(t):
    return runs(t).filter(F.col("id") == 42).select("id", "name", "submitter")


@query(
    "cat_4_latest_effects",
    _ALL + """select prom_id, type, id, strftime(query_time, '%Y-%m-%d') as day, cnt from
    (select *, row_number() over (partition by prom_id, type order by query_time desc, id desc, cnt desc) as n from effects) where n = 1""",
)
def _(t):
    rows = R.latest_effects(effects(t))
    return rows.select("prom_id", "type", "id", F.date_format("query_time", "yyyy-MM-dd").alias("day"), "cnt")


@query("cat_5_unfetched_downloads", _ALL + """select id, "user" from downloads where "user" = 'user2' and status = 1 order by time desc, id limit 50""")
def _(t):
    return R.unfetched(downloads(t), "user2", 50).select("id", "user")


@query("cat_6_due_runs", _ALL + "select id, submitter from runs where recycle = 0 and task_status = 0 and start_time < timestamp '1996-05-05 00:00:00'")
def _(t):
    return R.due(runs(t), dt.datetime(1996, 5, 5)).select("id", "submitter")


def menu(t):
    p = t.part
    return p.select(
        F.col("p_type").alias("t1"), F.col("p_brand").alias("t2"), F.col("p_name").alias("t3"),
        F.concat(F.lit("field_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("t4"),
        F.lit("bigtable").alias("t5"), F.lit("1").alias("type"),
    )


@query(
    "cat_7_tag_tree",
    """with m as (select distinct p_type as t1, p_brand as t2, p_name as t3, 'field_' || replace(p_name, ' ', '_') as t4 from part),
    b as (select t1, t2, string_agg(t3 || ':' || t4, ';' order by t3, t4) as leaves from m group by t1, t2)
    select t1, string_agg(t2 || '{' || leaves || '}', '|' order by t2) as tree from b group by t1""",
)
def _(t):
    tree = R.nested_tree(menu(t), ["t1", "t2", "t3"], ["t4", "t5", "type"])
    leaf = lambda x: F.concat_ws(":", x["t3"], x["t4"])
    branch = lambda x: F.concat(x["t2"], F.lit("{"), F.array_join(F.transform(x["children"], leaf), ";"), F.lit("}"))
    return tree.select("t1", F.array_join(F.transform("children", branch), "|").alias("tree"))


@query(
    "cat_7_tree_edges",
    """with m as (select distinct p_type as t1, p_brand as t2, p_name as t3, 'field_' || replace(p_name, ' ', '_') as t4 from part)
    select 1 as level, '' as parent, t1 as node, count(*) as leaves from m group by t1
    union all select 2, t1, t2, count(*) from m group by t1, t2
    union all select 3, t1 || '/' || t2, t3, count(*) from m group by t1, t2, t3
    union all select 4, t1 || '/' || t2 || '/' || t3, t4, count(*) from m group by t1, t2, t3, t4""",
)
def _(t):
    return R.tree_edges(menu(t), ["t1", "t2", "t3", "t4"])


@query("cat_8_whole_listing", "select p_type as t1, p_brand as t2, p_name as t3 from part")
def _(t):
    return menu(t).select("t1", "t2", "t3")


@query(
    "cat_9_model_tree",
    """with m as (select distinct r_name as node1, n_name as node2, c_mktsegment as node3, 'seg_' || lower(c_mktsegment) as node4, 'v' || cast(n_regionkey as varchar) as value
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    c as (select node1, node2, node3, string_agg(replace(node4, '_', chr(10)) || '=' || value, ';' order by node4, value) as l from m group by 1, 2, 3),
    b as (select node1, node2, string_agg(node3 || '(' || l || ')', ',' order by node3) as l from c group by 1, 2)
    select node1, string_agg(node2 || '[' || l || ']', '|' order by node2) as tree from b group by 1""",
)
def _(t):
    c, n, r = t.customer, t.nation, t.region
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("node1"), F.col("n_name").alias("node2"), F.col("c_mktsegment").alias("node3"),
        F.concat(F.lit("seg_"), F.lower("c_mktsegment")).alias("node4"),
        F.concat(F.lit("v"), F.col("n_regionkey").cast("string")).alias("value"),
    )
    tree = R.nested_tree(rows, ["node1", "node2", "node3", "node4"], ["value"])
    leaf = lambda x: F.concat(F.replace(x["node4"], F.lit("_"), F.lit("\n")), F.lit("="), x["value"])
    low = lambda x: F.concat(x["node3"], F.lit("("), F.array_join(F.transform(x["children"], leaf), ";"), F.lit(")"))
    mid = lambda x: F.concat(x["node2"], F.lit("["), F.array_join(F.transform(x["children"], low), ","), F.lit("]"))
    return tree.select("node1", F.array_join(F.transform("children", mid), "|").alias("tree"))


@query(
    "cat_9_tree_edges",
    """with m as (select distinct p_type, p_brand, p_name from part)
    select 1 as level, '' as parent, p_type as node, count(*) as leaves from m group by p_type
    union all select 2, p_type, p_brand, count(*) from m group by p_type, p_brand
    union all select 3, p_type || '/' || p_brand, p_name, count(*) from m group by p_type, p_brand, p_name""",
)
def _(t):
    return R.tree_edges(t.part, ["p_type", "p_brand", "p_name"])
