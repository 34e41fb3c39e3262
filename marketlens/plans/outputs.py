"""Registered sink queries (SNK rows): write, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators.audience import AUDIENCE_COLUMNS
from marketlens.plans import standins as S
from marketlens.plans.scans import fresh
from marketlens.registry import query
from marketlens.sinks import audience, files
from marketlens.sources import marks
from marketlens.sources.delimited import read_delimited

_SIX = ", ".join(AUDIENCE_COLUMNS)
_TEXT = "member_no string, mobile string, named string, device_cid string, device_type string, score_tag_result int"


@query("snk_1_saved_audience", S.cte("members") + f"select {_SIX} from members where balance > 2000")
def _(t):
    path = fresh(t, "audience")
    audience.save_audience(S.members(t).filter(F.col("balance") > 2000), path)
    return t.spark.read.schema(_TEXT).parquet(path)


@query("snk_2_count_of_the_write", S.cte("members") + "select count(*) as counted, count(*) as stored from members where balance > 2000")
def _(t):
    path = fresh(t, "audience")
    n = audience.save_audience(S.members(t).filter(F.col("balance") > 2000), path)
    return t.spark.read.schema(_TEXT).parquet(path).agg(F.lit(n).cast("bigint").alias("counted"), F.count(F.lit(1)).alias("stored"))


@query("snk_3_tab_export", "select c_custkey as \"编号\", c_mktsegment as \"类别\" from customer")
def _(t):
    path = fresh(t, "tabs")
    files.export_tabs(t.customer, path, {"c_custkey": "编号", "c_mktsegment": "类别"})
    return read_delimited(t.spark, path, "`编号` bigint, `类别` string", delimiter="\t", header=True)


@query("snk_4_comma_export", "select o_orderkey, o_orderpriority || ', \"x\"' as note from orders")
def _(t):
    path = fresh(t, "commas")
    files.export_delimited(t.orders.select("o_orderkey", F.concat("o_orderpriority", F.lit(', "x"')).alias("note")), path)
    return read_delimited(t.spark, path, "o_orderkey bigint, note string", header=True)


@query("snk_5_split_output", "select count(*) as n, 1 as within_limit, count(*) as counted from lineitem")
def _(t):
    path = fresh(t, "split")
    n = files.export_delimited(t.lineitem.select("l_orderkey", "l_quantity"), path, rows_per_file=files.TEST_ROWS)
    rows = read_delimited(t.spark, path, "l_orderkey bigint, l_quantity double", header=True, with_file=True)
    per_file = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("n"), (F.max("n") <= files.TEST_ROWS).cast("int").alias("within_limit"), F.lit(n).cast("bigint").alias("counted"))


@query("snk_6_compressed", "select l_returnflag, count(*) as n, 1 as gz from lineitem group by 1")
def _(t):
    path = fresh(t, "zipped")
    files.export_delimited(t.lineitem.select("l_returnflag", "l_orderkey"), path, compressed=True)
    rows = read_delimited(t.spark, path, "l_returnflag string, l_orderkey bigint", header=True, with_file=True)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min(F.endswith("file_path", F.lit(".gz")).cast("int")).alias("gz"))


@query("snk_7_quoted_lines", "select concat(chr(34), o_orderkey, chr(34), ';', chr(34), 'a ', chr(34), chr(34), o_orderstatus, repeat(chr(34), 3)) as line from orders")
def _(t):
    path = fresh(t, "quoted")
    rows = t.orders.select("o_orderkey", F.concat(F.lit('a "'), F.col("o_orderstatus"), F.lit('"')).alias("note"))
    files.write_csv(rows, path, spreadsheet=True)
    back = t.spark.read.option("lineSep", "\r\n").text(path)
    clean = F.replace("value", F.lit("\ufeff"), F.lit(""))
    return back.select(clean.alias("line")).filter(F.col("line") != "sep=;")


@query("snk_7_heads_of_files", "select count(*) as n_lines, 1 as marks, 1 as heads, 0 as strays from orders")
def _(t):
    """Every file starts with one mark and one ``sep=`` line, and holds no other.

    Lines come without the mark at the start of a file, so that one is tested on the bytes;
    files are as large as the parts of the scan behind them.
    """
    path = fresh(t, "heads")
    files.write_csv(t.orders.select("o_orderkey", "o_orderstatus"), path, spreadsheet=True)
    lines = t.spark.read.option("lineSep", "\r\n").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    count = lambda test: F.sum(test.cast("int"))
    head = F.col("value") == "sep=;"
    each = lines.groupBy("file").agg(count(head).alias("heads"), count(F.contains("value", F.lit("\ufeff"))).alias("strays"), count(~head).alias("n"))
    marked = marks.folder_report(t.spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("had_mark").cast("int").alias("marks"))
    both = each.join(marked, "file", "full")
    all_one = lambda c: F.min((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    return both.agg(F.sum("n").alias("n_lines"), all_one("marks"), all_one("heads"), F.max("strays").cast("int").alias("strays"))


@query("snk_8_preview", """select 'row' as kind, o_orderkey as key from (select * from orders order by o_totalprice desc, o_orderkey limit 200) union all select 'count', count(*) from orders""")
def _(t):
    head, count = files.preview(t.orders, [F.col("o_totalprice").desc(), "o_orderkey"])
    rows = head.select(F.lit("row").alias("kind"), F.col("o_orderkey").alias("key"))
    return rows.unionByName(count.select(F.lit("count").alias("kind"), F.col("count").alias("key")))


@query("snk_9_json_rows", """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as json from nation""")
def _(t):
    return files.json_rows(t.nation)


@query("snk_10_formatted_range", "select o_orderkey, format('{:,.1f}', round(o_totalprice, 1)) as o_totalprice, strftime(o_orderdate, '%d/%m/%Y') as o_orderdate from orders")
def _(t):
    rows = t.orders.select("o_orderkey", F.round("o_totalprice", 1).alias("o_totalprice"), "o_orderdate")
    return files.formatted(rows, {"o_totalprice": 1}, {"o_orderdate": "dd/MM/yyyy"})
