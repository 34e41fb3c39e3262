"""Registered number function queries (MATH rows) over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import maths as M
from marketlens.functions.units import unit_table
from marketlens.registry import add, query

# u in [-0.95, 0.95], v in [-120, 120], p positive.


def U(): return (F.col("o_orderkey") % 191 - 95) / 100
def V(): return (F.col("o_custkey") % 241 - 120) + F.col("o_orderkey") % 8 / 8
def P(): return F.col("o_totalprice")


SU = "((o_orderkey % 191 - 95) / 100.0::double)"
SV = "((o_custkey % 241 - 120) + o_orderkey % 8 / 8.0::double)"
SP = "o_totalprice"


def row(name, column, sql, digits=8):
    add(name, lambda t: t.orders.select("o_orderkey", F.round(column().cast("double"), digits).alias("value")),
        f"select o_orderkey, round(cast({sql} as double), {digits}) as value from orders")


row("math_1_acos", lambda: M.acos(U()), f"acos({SU})")
row("math_2_acosh", lambda: M.acosh(1 + F.abs(V())), f"acosh(1 + abs({SV}))")
row("math_3_asin", lambda: M.asin(U()), f"asin({SU})")
row("math_4_asinh", lambda: M.asinh(U()), f"asinh({SU})")
row("math_5_atan", lambda: M.atan(V()), f"atan({SV})")
row("math_6_atanh", lambda: M.atanh(U()), f"atanh({SU})")
row("math_7_cos", lambda: M.cos(V()), f"cos({SV})")
row("math_8_cosh", lambda: M.cosh(U()), f"cosh({SU})")
row("math_9_exp", lambda: M.exp(U()), f"exp({SU})")
row("math_10_sin", lambda: M.sin(V()), f"sin({SV})")
row("math_11_sinh", lambda: M.sinh(U()), f"sinh({SU})")
row("math_12_sqrt", lambda: M.sqrt(P()), f"sqrt({SP})", 6)
row("math_13_tan", lambda: M.tan(U()), f"tan({SU})")
row("math_14_tanh", lambda: M.tanh(V()), f"tanh({SV})")
row("math_15_abs", lambda: M.abs_(V()), f"abs({SV})")
row("math_16_degrees", lambda: M.degrees(U()), f"degrees({SU})")
row("math_17_radians", lambda: M.radians(V()), f"radians({SV})")
row("math_18_log10", lambda: M.log10(P()), f"log10({SP})")
row("math_19_atan2", lambda: M.atan2(U(), V()), f"case when {SU} <> 0 or {SV} <> 0 then atan2({SV}, {SU}) end")
row("math_20_ceiling", lambda: M.ceiling(V(), 2.5), f"case when sign({SV}) = 1 then ceil({SV} / 2.5::double) * 2.5 end")
row("math_21_floor", lambda: M.floor(V(), -4.0), f"case when sign({SV}) = -1 then floor({SV} / -4.0::double) * -4.0 end")
row("math_22_int", lambda: M.int_(V()), f"floor({SV})")
row("math_23_trunc", lambda: M.trunc(V(), 1), f"trunc(abs({SV}) * 10) * sign({SV}) / 10")
row("math_24_round", lambda: M.round_(V(), 2), f"round({SV}, 2)")
row("math_25_roundup", lambda: M.roundup(V(), 1), f"sign({SV}) * ceil(abs({SV}) * 10) / 10")
row("math_26_rounddown", lambda: M.rounddown(V(), 0), f"sign({SV}) * floor(abs({SV}))")
row("math_27_mround", lambda: M.mround(V(), 5.0), f"case when sign({SV}) = 1 then round({SV} / 5, 0) * 5 end")
row("math_28_even", lambda: M.even(V()), f"sign({SV}) * ceil(abs({SV}) / 2) * 2")
row("math_29_odd", lambda: M.odd(V()), f"case when {SV} = 0 then 1 else sign({SV}) * (ceil(abs({SV})) + case when ceil(abs({SV})) % 2 = 0 then 1 else 0 end) end")
row("math_30_mod", lambda: M.mod(V(), -7), f"{SV} - (-7) * floor({SV} / -7)")
row("math_31_quotient", lambda: M.quotient(V(), 7), f"trunc({SV} / 7)")
row("math_32_power", lambda: M.power(1 + F.abs(U()), 2.5), f"power(1 + abs({SU}), 2.5::double)")
row("math_33_ln", lambda: M.ln(P()), f"ln({SP})")
row("math_34_log", lambda: M.log(P(), 3), f"ln({SP}) / ln(3)")
row("math_35_sign", lambda: M.sign(V()), f"sign({SV})")
row("math_36_pi", lambda: M.pi() * U(), f"pi() * {SU}")
row("math_37_sqrtpi", lambda: M.sqrtpi(P()), f"sqrt(pi() * {SP})", 5)
row("math_38_fact", lambda: M.fact(F.col("o_orderkey") % 16), "cast(factorial(cast(o_orderkey % 16 as integer)) as double)")


@query("math_39_rand", "select count(*) as n, count(*) as inside from orders")
def _(t):
    r = t.orders.select(M.rand(7).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("inside"))


@query("math_40_randbetween", "select count(*) as n, count(*) as inside from orders")
def _(t):
    r = t.orders.select(M.randbetween(3, 9, 7).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r").between(3, 9)).alias("inside"))


# Digits from a column.
D, SD = lambda: (F.col("o_orderkey") % 3).cast("int"), "power(10::double, o_orderkey % 3)"
row("math_17_roundup_by_column", lambda: M.roundup(P(), D()), f"ceil(o_totalprice * {SD}) / {SD}", 4)
row("math_18_rounddown_by_column", lambda: M.rounddown(P(), D()), f"floor(o_totalprice * {SD}) / {SD}", 4)
row("math_16_round_by_column", lambda: M.round_(P(), D()), f"round(o_totalprice * {SD}) / {SD}", 4)


row("math_41_convert", lambda: M.convert(P(), "lbm", "kg"), f"{SP} * 4.5359230974881148e2 / 1e3", 5)
row("math_41_convert_temperature", lambda: M.convert(V(), "F", "C"), f"({SV} - 32) / 1.8", 6)


@query(
    "math_41_convert_table",
    """with u(a, f, b, g) as (values ('mi', 1.609344e3::double, 'km', 1e3::double), ('ft', 0.3048::double, 'in', 0.0254::double), ('hr', 1 / 8766.0::double, 'mn', 1 / 525960.0::double), ('gal', 768::double, 'l', 1 / 4.9299940840071e-03::double))
    select o_orderkey, a, b, round(o_totalprice * f / g, 4) as converted from orders join u on a = case o_orderkey % 5 when 0 then 'mi' when 1 then 'ft' when 2 then 'hr' when 3 then 'gal' end
    union all select o_orderkey, 'kg', 'm', null from orders where o_orderkey % 5 = 4""",
)
def _(t):
    k = F.col("o_orderkey") % 5
    pick = lambda names: F.when(k == 0, names[0]).when(k == 1, names[1]).when(k == 2, names[2]).when(k == 3, names[3]).otherwise(names[4])
    rows = t.orders.select("o_orderkey", "o_totalprice", pick(["mi", "ft", "hr", "gal", "kg"]).alias("a"), pick(["km", "in", "mn", "l", "m"]).alias("b"))
    out = M.convert_table(rows, "o_totalprice", "a", "b", unit_table(t.spark))
    return out.select("o_orderkey", "a", "b", F.round("converted", 4).alias("converted"))
