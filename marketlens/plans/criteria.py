"""Registered criteria-table aggregates (DB rows) over the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import aggregates as A
from marketlens.functions.criteria import criteria_table
from marketlens.registry import add

# OR within a column, AND across the columns.
CRITERIA = [
    {"p_type": "economy", "p_size": ">=10", "p_brand": "<>Brand#7"},
    {"p_type": "Promo"},
]
WHERE = "(upper(p_type) = 'ECONOMY' or upper(p_type) = 'PROMO') and p_size >= 10 and upper(p_brand) <> 'BRAND#7'"


def X(): return F.col("p_retailprice")


def db(name: str, column, sql: str, digits: int = 6) -> None:
    def run(t):
        return t.part.filter(criteria_table(CRITERIA)).agg(F.round(column().cast("double"), digits).alias("value"))

    add(name, run, f"select round(cast({sql} as double), {digits}) as value from part where {WHERE}")


db("db_1_dsum", lambda: A.sum_(X()), "sum(p_retailprice)", 3)
db("db_2_daverage", lambda: A.average(X()), "avg(p_retailprice)")
db("db_3_dcount", lambda: A.count(F.col("p_size")), "count(p_size)")
db("db_4_dcounta", lambda: F.count_if(F.col("p_name").isNotNull() & (F.col("p_name") != "")), "count(*) filter (where p_name <> '')")
db("db_5_dmax", lambda: A.max_(X()), "max(p_retailprice)")
db("db_6_dmin", lambda: A.min_(X()), "min(p_retailprice)")
db("db_7_dproduct", lambda: A.product(1 + F.col("p_size") / 100000), "product(1 + p_size / 100000.0)")
db("db_8_dstdev", lambda: A.stdev(X()), "stddev_samp(p_retailprice)")
db("db_9_dstdevp", lambda: A.stdevp(X()), "stddev_pop(p_retailprice)")
db("db_10_dvar", lambda: A.var(X()), "var_samp(p_retailprice)")
db("db_11_dvarp", lambda: A.varp(X()), "var_pop(p_retailprice)")


def dget(df, column: str, criteria):
    """The single matching value; null where none or more than one row matches."""
    return df.filter(criteria_table(criteria)).agg(F.when(F.count(F.lit(1)) == 1, F.first(column)).alias("value"))


add(
    "db_12_dget",
    lambda t: dget(t.part, "p_name", [{"p_retailprice": "=950.3", "p_partkey": "<1000"}]).withColumn("case", F.lit("one"))
    .unionByName(dget(t.part, "p_name", [{"p_type": "small"}]).withColumn("case", F.lit("many"))),
    """select case when count(*) = 1 then max(p_name) end as value, 'one' as "case" from part where p_retailprice = 950.3 and p_partkey < 1000
    union all select case when count(*) = 1 then max(p_name) end, 'many' from part where upper(p_type) = 'SMALL'""",
)
