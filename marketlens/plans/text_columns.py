"""Registered text function queries (TXT rows) over parts and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text as X
from marketlens.registry import add



def NAME(): return F.col("p_name")
def TEXT(): return F.col("text")
def PRICE(): return F.round(F.col("o_totalprice") - 200000, 2)


def part(name, column, sql):
    add(name, lambda t: t.part.select("p_partkey", column().alias("value")), f"select p_partkey, {sql} as value from part")


def doc(name, column, sql):
    add(name, lambda t: t.documents.select("doc_id", column().alias("value")), f"select doc_id, {sql} as value from documents")


def order(name, column, sql):
    add(name, lambda t: t.orders.select("o_orderkey", column().alias("value")), f"select o_orderkey, {sql} as value from orders")


_V = "round(o_totalprice - 200000, 2)"
part("txt_1_char", lambda: X.char(F.col("p_partkey") + 33), "chr(cast(p_partkey + 33 as integer))")
doc("txt_2_code", lambda: X.code(TEXT()).cast("int"), "case when length(text) > 0 then unicode(text) end")
doc("txt_3_clean", lambda: F.length(X.clean(TEXT())), "length(regexp_replace(text, '[\\x00-\\x1F]', '', 'g'))")
doc("txt_4_trim", lambda: X.trim(TEXT()), "regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '^[ \\t\\n\\r\\x00\\x0B]+|[ \\t\\n\\r\\x00\\x0B]+$', '', 'g')")
part("txt_5_concatenate", lambda: X.concatenate(F.col("p_brand"), F.lit("-"), F.col("p_size")), "p_brand || '-' || cast(p_size as varchar)")
order("txt_6_dollar", lambda: X.dollar(PRICE()), f"'$' || format('{{:,.2f}}', round({_V}, 2))")
order("txt_7_fixed", lambda: X.concatenate(X.fixed(PRICE(), 1), F.lit("|"), X.fixed(PRICE(), 0, True)), f"format('{{:,.1f}}', round({_V}, 1)) || '|' || format('{{:.0f}}', round({_V}, 0))")
order(
    "txt_8_text",
    lambda: X.concatenate(X.text_of_date(F.col("o_orderdate"), "yyyy/mm/dd hh:mm"), F.lit("|"), X.text_of_number(F.col("o_totalprice"), "#,##0.0"), F.lit("|"), X.text_of_number(F.col("o_custkey") / 1000, "0%")),
    "strftime(o_orderdate, '%Y/%m/%d %H:%M') || '|' || format('{:,.1f}', round(o_totalprice, 1)) || '|' || format('{:.0f}', round(o_custkey / 1000 * 100, 0)) || '%'",
)
doc("txt_9_find", lambda: X.find("th", TEXT(), 3), "case when instr(substr(text, 3), 'th') > 0 then instr(substr(text, 3), 'th') + 2 end")
doc("txt_10_findb", lambda: X.find("re", TEXT()), "nullif(instr(text, 're'), 0)")
doc("txt_11_search", lambda: X.search("THE", TEXT()), "nullif(instr(lower(text), 'the'), 0)")
doc("txt_12_searchb", lambda: X.search("La", TEXT()), "nullif(instr(lower(text), 'la'), 0)")
doc("txt_13_left", lambda: X.left(TEXT(), 12), "left(text, 12)")
doc("txt_14_leftb", lambda: X.left(TEXT(), 1), "left(text, 1)")
doc("txt_15_mid", lambda: X.mid(TEXT(), 4, 9), "substr(text, 4, 9)")
doc("txt_16_midb", lambda: X.mid(TEXT(), 6), "substr(text, 6)")
doc("txt_17_right", lambda: X.right(TEXT(), 10), "right(text, 10)")
doc("txt_18_rightb", lambda: X.right(TEXT(), 3), "right(text, 3)")
doc("txt_19_len", lambda: X.length(TEXT()), "length(text)")
part("txt_20_lenb", lambda: X.length(NAME()), "length(p_name)")
doc("txt_21_lower", lambda: X.lower(TEXT()), "lower(text)")
# DuckDB keeps the sharp s as one capital letter.
doc("txt_22_upper", lambda: X.upper(TEXT()), "upper(replace(text, 'ß', 'ss'))")
part(
    "txt_23_proper", lambda: X.proper(X.concatenate(NAME(), F.lit("-X1 "), F.col("p_type"))),
    "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '-X1 ' || upper(left(p_type, 1)) || lower(substr(p_type, 2))",
)
part("txt_24_replace", lambda: X.replace(NAME(), 2, 3, "__"), "left(p_name, 1) || '__' || substr(p_name, 5)")
part("txt_25_replaceb", lambda: X.replace(NAME(), 1, 1, "Z"), "'Z' || substr(p_name, 2)")
doc("txt_26_substitute", lambda: X.substitute(TEXT(), "th", "TH"), "replace(text, 'th', 'TH')")
doc(
    "txt_26_substitute_second", lambda: X.substitute(TEXT(), "an", "<AN>", 2),
    """case when len(string_split(text, 'an')) > 2 then array_to_string(string_split(text, 'an')[1:2], 'an') || '<AN>' || array_to_string(string_split(text, 'an')[3:], 'an') else text end""",
)
part(
    "txt_26_substitute_of_columns", lambda: X.substitute(NAME(), F.substr(NAME(), F.lit(2), F.lit(1)), F.col("p_brand"), F.col("p_size") % 3),
    """case when p_size % 3 = 0 then replace(p_name, p_name[2], p_brand)
      when p_size % 3 = 1 then p_name[:strpos(p_name, p_name[2]) - 1] || p_brand || p_name[strpos(p_name, p_name[2]) + 1:]
      when strpos(p_name[strpos(p_name, p_name[2]) + 1:], p_name[2]) = 0 then p_name
      else p_name[:strpos(p_name, p_name[2]) + strpos(p_name[strpos(p_name, p_name[2]) + 1:], p_name[2]) - 1] || p_brand
        || p_name[strpos(p_name, p_name[2]) + strpos(p_name[strpos(p_name, p_name[2]) + 1:], p_name[2]) + 1:] end""",
)
part("txt_27_rept", lambda: X.rept(NAME(), 3), "repeat(p_name, 3)")
part("txt_28_t", lambda: X.t(F.when(F.col("p_size") % 2 == 0, NAME()).otherwise(F.col("p_size").cast("string"))), "case when p_size % 2 = 0 then p_name else '' end")


# Arguments from columns: the part's own size says where and how much.
_A, _B = "cast(p_size % 7 as integer)", "cast(1 + p_size % 3 as integer)"


def A(): return (F.col("p_size") % 7).cast("int")
def B(): return (1 + F.col("p_size") % 3).cast("int")


part("txt_10_left_by_column", lambda: X.left(NAME(), A()), f"left(p_name, {_A})")
part("txt_12_right_by_column", lambda: X.right(NAME(), A()), f"right(p_name, {_A})")
part("txt_11_mid_by_column", lambda: X.mid(NAME(), B(), A()), f"substr(p_name, {_B}, {_A})")
part("txt_24_replace_by_column", lambda: X.replace(NAME(), B(), A(), F.lit("-")), f"substr(p_name, 1, {_B} - 1) || '-' || substr(p_name, {_B} + {_A})")
part("txt_27_rept_by_column", lambda: X.rept(F.lit("ab"), A()), f"repeat('ab', {_A})")
