"""Registered lookup queries (LOOK rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import lookup as L
from marketlens.operators import ordered as O
from marketlens.operators import places as P
from marketlens.registry import query


@query(
    "look_1_vlookup",
    """with first as (select lower(p_name) as k, arg_min(p_brand, p_partkey) as brand from part group by 1),
    probes as (select p_partkey, upper(p_name) as name, p_retailprice * 100 as price from part)
    select p_partkey, f.brand as exact, a.o_orderkey as approximate from probes p left join first f on f.k = lower(p.name)
    asof left join (select o_totalprice, min(o_orderkey) as o_orderkey from orders group by 1) a on p.price >= a.o_totalprice""",
)
def _(t):
    probes = t.part.select("p_partkey", F.upper("p_name").alias("name"), (F.col("p_retailprice") * 100).alias("price"))
    rows = L.vlookup_exact(probes, "name", t.part, "p_name", "p_brand", "p_partkey", "exact")
    rows = P.asof(rows, "price", t.orders, "o_totalprice", "o_orderkey", name="approximate")
    return rows.select("p_partkey", "exact", "approximate")


@query(
    "look_2_hlookup",
    """with line as (unpivot (select sum(o_totalprice) filter (where o_orderstatus = 'F') as f, sum(o_totalprice) filter (where o_orderstatus = 'O') as o,
      sum(o_totalprice) filter (where o_orderstatus = 'P') as p from orders) on f, o, p into name k value v)
    select o_orderkey, round(v, 2) as found from orders left join line on lower(o_orderstatus) = k""",
)
def _(t):
    wide = t.orders.groupBy(F.lit(1).alias("row")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))
    return L.hlookup(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", wide, ["F", "O", "P"], F.col("row") == 1).select("o_orderkey", "found")


@query(
    "look_3_lookup",
    """with k as (select o_custkey, o_orderdate, min(o_orderkey) as o_orderkey from orders group by 1, 2),
    e as (select event_id, user_id, ts - interval 9500 days as at from events)
    select event_id, k.o_orderkey as last_order from e asof left join k on e.user_id = k.o_custkey and e.at >= k.o_orderdate""",
)
def _(t):
    probes = t.events.select("event_id", F.col("user_id").alias("o_custkey"), (F.col("ts") - F.expr("interval 9500 days")).alias("at"))
    return P.asof(probes, "at", t.orders, "o_orderdate", "o_orderkey", ["o_custkey"], "last_order").select("event_id", "last_order")


@query(
    "look_4_match",
    """with k as (select p_retailprice as v, min(p_partkey) as place from part group by 1), probes as (select c_custkey, 900 + c_acctbal / 90 as x from customer)
    select c_custkey, a.place as below, b.place as above, c.place as equal_name from probes p asof left join k a on p.x >= a.v
    asof left join k b on p.x <= b.v left join (select lower(p_name) as w, min(p_partkey) as place from part group by 1) c on c.w = case when c_custkey % 2 = 0 then 'red widget' else 'none' end""",
)
def _(t):
    probes = t.customer.select(
        "c_custkey", (900 + F.col("c_acctbal") / 90).alias("x"), F.when(F.col("c_custkey") % 2 == 0, "Red Widget").otherwise("none").alias("word"))
    rows = L.match(probes, "x", t.part, "p_retailprice", "p_partkey", 1, "below")
    rows = L.match(rows, "x", t.part, "p_retailprice", "p_partkey", -1, "above")
    rows = L.match(rows, "word", t.part, "p_name", "p_partkey", 0, "equal_name")
    return rows.select("c_custkey", "below", "above", "equal_name")


@query(
    "look_5_index",
    "select * from (select o_orderkey as value, row_number() over (order by o_totalprice desc, o_orderkey) as n from orders) where n in (1, 500, 7000)",
)
def _(t):
    placed = O.numbered(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], name="n")
    rows = [L.index_value(placed, "n", n, "o_orderkey").withColumn("n", F.lit(n).cast("bigint")) for n in (1, 500, 7000)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("look_6_choose", "select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then l_returnflag when 2 then l_linestatus when 3 then 'three' end as chosen from lineitem")
def _(t):
    chosen = L.choose(F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit("three"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", chosen.alias("chosen"))


@query(
    "look_7_transpose",
    """with w as (select o_orderstatus as s, cast(count(*) as double) as orders, round(sum(o_totalprice), 2) as amount, max(o_totalprice) as largest from orders group by 1),
    u as (unpivot w on orders, amount, largest into name field value v) select field, max(v) filter (where s = 'F') as "F", max(v) filter (where s = 'O') as "O", max(v) filter (where s = 'P') as "P" from u group by field""",
)
def _(t):
    wide = t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.max("o_totalprice").alias("largest"))
    return L.transpose(wide, "o_orderstatus", ["orders", "amount", "largest"], ["F", "O", "P"])


@query(
    "look_8_offset",
    """select o_orderkey, lag(o_totalprice, 1) over (partition by o_orderstatus order by o_orderdate, o_orderkey) as earlier, lead(o_totalprice, 2) over (order by o_orderdate, o_orderkey) as later from orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    rows = P.shifted(rows, "o_totalprice", -1, ["o_orderdate", "o_orderkey"], ["o_orderstatus"], "earlier")
    return P.shifted(rows, "o_totalprice", 2, ["o_orderdate", "o_orderkey"], name="later").select("o_orderkey", "earlier", "later")


@query(
    "look_9_matrix_product",
    """with a as (select o_custkey as i, l_partkey % 50 as j, sum(l_quantity) as v from orders join lineitem on o_orderkey = l_orderkey group by all),
    b as (select p_partkey % 50 as i, p_size as j, sum(p_retailprice) as v from part group by all)
    select a.i, b.j, round(sum(a.v * b.v), 2) as v from a join b on a.j = b.i group by all""",
)
def _(t):
    a = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(
        F.col("o_custkey").alias("i"), (F.col("l_partkey") % 50).alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = t.part.groupBy((F.col("p_partkey") % 50).alias("i"), F.col("p_size").alias("j")).agg(F.sum("p_retailprice").alias("v"))
    return L.matrix_product(a, b).select("i", "j", F.round("v", 2).alias("v"))
