"""Registered logic and type test queries (LOG rows) over line items with mixed cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import logic as L
from marketlens.functions.criteria import number
from marketlens.plans.aggregates import D, M, MIXED_SQL
from marketlens.plans.aggregates import X as Q
from marketlens.registry import add, query

ID = ["l_orderkey", "l_linenumber", "l_partkey"]
IDS = ", ".join(ID)
MN = f"try_cast(({MIXED_SQL}) as double)"
LOGICAL = f"coalesce(upper({MIXED_SQL}) in ('TRUE', 'FALSE'), false)"
TEXT = f"(({MIXED_SQL}) is not null and {MN} is null and not {LOGICAL})"


def row(name: str, column, sql: str, flag: bool = True) -> None:
    text = f"cast({sql} as integer)" if flag else sql

    def run(t):
        value = column().cast("int") if flag else column()
        return t.lineitem.select(*ID, value.alias("value"))

    add(name, run, f"select {IDS}, {text} as value from lineitem")


row("log_1_and", lambda: L.and_all(Q() > 10, D() < 0.05, F.col("l_returnflag") == "A"), "(l_quantity > 10 and l_discount < 0.05 and l_returnflag = 'A')")
row("log_2_or", lambda: L.or_any(Q() > 40, D() < 0.02), "(l_quantity > 40 or l_discount < 0.02)")
row("log_3_not", lambda: L.not_(Q() > 10), "(not l_quantity > 10)")
row("log_4_if", lambda: L.if_(Q() > 25, F.lit("many"), F.lit("few")), "case when l_quantity > 25 then 'many' else 'few' end", False)
row("log_5_iferror", lambda: L.iferror(number(M()), -1.0), f"coalesce({MN}, -1.0::double)", False)
row("log_6_isblank", lambda: L.isblank(M()), f"(({MIXED_SQL}) is null)")
row("log_7_iserr", lambda: L.iserr(M(), number(M())), f"(({MIXED_SQL}) is not null and {MN} is null)")
row("log_8_iserror", lambda: L.iserror(M(), F.try_divide(Q(), F.col("l_linenumber") - 1)), f"(({MIXED_SQL}) is not null and l_linenumber = 1)")
row("log_10_iseven", lambda: L.iseven(Q()), "(floor(l_quantity) % 2 = 0)")
row("log_11_isodd", lambda: L.isodd(Q()), "(floor(l_quantity) % 2 = 1)")
row("log_12_isnumber", lambda: L.isnumber(M()), f"({MN} is not null)")
row("log_13_istext", lambda: L.istext(M()), TEXT)
row("log_14_isnontext", lambda: L.isnontext(M()), f"(not {TEXT})")
row("log_15_islogical", lambda: L.islogical(M()), LOGICAL)
row("log_16_n", lambda: L.n(M()), f"case when upper({MIXED_SQL}) = 'TRUE' then 1.0::double when upper({MIXED_SQL}) = 'FALSE' then 0.0::double else coalesce({MN}, 0.0::double) end", False)
row("log_17_delta", lambda: L.delta(Q(), 25), "(l_quantity = 25)")
row("log_18_gestep", lambda: L.gestep(Q(), 25), "(l_quantity >= 25)")


@query("log_1_2_over_rows", "select l_returnflag, cast(bool_and(l_quantity > 0) as integer) as every_row, cast(bool_or(l_quantity > 49) as integer) as some_row from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(L.all_rows(Q() > 0).cast("int").alias("every_row"), L.any_row(Q() > 49).cast("int").alias("some_row"))


@query("log_9_isna", "select c_custkey, cast(k is null as integer) as missing from customer left join (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT') on c_custkey = k")
def _(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k")).distinct()
    return t.customer.join(urgent, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", L.isna(F.col("k")).cast("int").alias("missing"))
