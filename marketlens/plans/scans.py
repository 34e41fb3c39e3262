"""Registered source queries (SRC rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from marketlens.functions import dates as D
from marketlens.operators.scratch import shared_folder
from marketlens.registry import query
from marketlens.sources import catalog, cells, delimited, marks, markup

ID = "o_orderkey bigint, o_orderpriority string, o_totalprice double"


def fresh(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@query("src_1_chosen_columns", "select c_custkey, c_mktsegment from customer")
def _(t):
    return catalog.warehouse_table(t.spark, t.path("customer"), ["c_custkey", "c_mktsegment"])


@query("src_2_catalog_table", "select n_nationkey, n_name, n_regionkey from nation")
def _(t):
    return catalog.catalog_table(t.spark, "nation", folder=t.folder)


@query("src_3_delimited", "select o_orderkey, case when o_orderkey % 9 = 0 then null else o_orderpriority || ' \"q\"; ' || o_orderstatus end as o_orderpriority, o_totalprice from orders")
def _(t):
    path = fresh(t, "delimited")
    note = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.col("o_orderpriority"), F.lit(' "q"; '), F.col("o_orderstatus")))
    t.orders.select("o_orderkey", note.alias("o_orderpriority"), "o_totalprice").write.option("sep", ";").option("escape", '"').option("encoding", "UTF-8").csv(path)
    return delimited.read_delimited(t.spark, path, ID, delimiter=";")


@query("src_4_several_files", """select o_orderstatus as file, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1""")
def _(t):
    path = fresh(t, "several")
    t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").csv(path)
    parts = [f"{path}/o_orderstatus={s}" for s in ("F", "O", "P")]
    rows = delimited.read_delimited(t.spark, parts, ID, with_file=True)
    return rows.groupBy(F.regexp_extract("file_path", "o_orderstatus=(.)", 1).alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("src_5_read_filter", "select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '2001-01-01' and l_returnflag = 'R'")
def _(t):
    return delimited.only(t.lineitem, ["l_orderkey", "l_quantity"], (F.col("l_shipdate") >= "2001-01-01") & (F.col("l_returnflag") == "R"))


@query("src_6_profile", "select 'lineitem' as name, count(*) as total_rows, 11 as total_columns from lineitem union all select 'events', count(*), 6 from events")
def _(t):
    a = delimited.profile(t.lineitem).withColumn("name", F.lit("lineitem"))
    return a.unionByName(delimited.profile(t.events).withColumn("name", F.lit("events")))


_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(
    "src_7_markup_items",
    rf"""with l as (select page_id, unnest(regexp_extract_all(html, '(?is)<[uo]l\b[^>]*>(.*?)</[uo]l>', 1)) as body, generate_subscripts(regexp_extract_all(html, '(?is)<[uo]l\b[^>]*>(.*?)</[uo]l>', 1), 1) as list from pages),
    i as (select page_id, list, unnest(regexp_extract_all(body, '(?is)<li\b[^>]*>(.*?)</li>', 1)) as item, generate_subscripts(regexp_extract_all(body, '(?is)<li\b[^>]*>(.*?)</li>', 1), 1) as row from l)
    select page_id, cast(list as integer) as list, cast(row as integer) as row, {_PLAIN.format('item')} as text from i""",
)
def _(t):
    return markup.list_items(t.pages, "page_id", "html")



@query(
    "src_7_markup_tables",
    """select p_partkey, 1 as "table", r as row, c as col, case when r = 1 and c = 1 then 'Key' when r = 1 then 'Name' when c = 1 then cast(p_partkey as varchar) else p_name || ' & ' || p_brand end as text
    from part, (values (1, 1), (1, 2), (2, 1), (2, 2)) v(r, c)""",
)
def _(t):
    body = F.concat(F.lit('<table class="x"><tr><th>Key</th><th>Name</th></tr><tr><td>'), F.col("p_partkey").cast("string"), F.lit("</td><td><b>"),
                    F.col("p_name"), F.lit("</b> &amp; "), F.col("p_brand"), F.lit("</td></tr></table>"))
    return markup.cells(t.part.select("p_partkey", body.alias("html")), "p_partkey", "html")


@query("src_8_array_to_range", "select vec_id, cast(c as integer) as col, round(cast(embedding[c] as double), 6) as value from embeddings, range(1, 65) r(c) where c <= len(embedding) and embedding[c] is not null")
def _(t):
    rows = catalog.array_to_range(t.embeddings, ["vec_id"], "embedding")
    return rows.select("vec_id", "col", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("src_9_named_range", "select o_orderstatus, count(*) as n from orders where o_totalprice > 100000 group by 1")
def _(t):
    catalog.named_range(t.orders.filter(F.col("o_totalprice") > 100000), "large_orders")
    return t.spark.table("large_orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# The pages as twenty text files, every third one with a mark at its start; cleaned files are read again as bytes.
@query(
    "src_10_byte_order_marks",
    """select page_id % 20 as file, cast(page_id % 20 % 3 = 0 as integer) as had_mark, cast(sum(strlen(coalesce(url, '') || chr(9) || coalesce(html, '')) + 1) as bigint) as bytes,
    md5(string_agg(coalesce(url, '') || chr(9) || coalesce(html, ''), chr(10) order by page_id) || chr(10)) as digest from pages group by 1, 2""",
)
def _(t):
    line = F.concat(F.coalesce("url", F.lit("")), F.lit("\t"), F.coalesce("html", F.lit("")))
    rows = t.pages.select((F.col("page_id") % 20).alias("file"), "page_id", line.alias("value"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("page_id")) == 1
    marked = rows.withColumn("value", F.when(first & (F.col("file") % 3 == 0), F.concat(F.lit("\ufeff"), F.col("value"))).otherwise(F.col("value")))
    raw, clean = fresh(t, "marked"), fresh(t, "unmarked")
    marked.repartition("file").sortWithinPartitions("file", "page_id").select("file", "value").write.partitionBy("file").text(raw)
    number = F.regexp_extract("path", r"file=(\d+)/", 1).cast("bigint")
    report = marks.clean_folder(t.spark, raw, clean).withColumnRenamed("file", "path").select(number.alias("file"), F.col("had_mark").cast("int").alias("had_mark"), "bytes")
    again = marks.folder_report(t.spark, clean).filter(~F.col("had_mark")).select(number.alias("file"), F.md5("content").alias("digest"))
    return report.join(again, "file")


# Messy cells made from order keys and prices: ten notations in turn.
MESSY = """case o_orderkey % 12 when 0 then cast(o_custkey as varchar) when 1 then '-' || cast(o_custkey as varchar) || '.5' when 2 then cast(o_custkey as varchar) || '/8' when 3 then '1 ' || cast(o_custkey as varchar) || '/4'
    when 4 then cast(o_custkey as varchar) || '%' when 5 then '$' || cast(o_custkey as varchar) || '.25' when 6 then '9:' || lpad(cast(o_custkey % 60 as varchar), 2, '0') when 7 then '#DIV/0!' when 8 then '' when 9 then null when 10 then 'true' else o_orderpriority end"""


def _messy(t):
    k, c = F.col("o_orderkey") % 12, F.col("o_custkey").cast("string")
    s = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    minute = F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0")
    forms = [c, s("-", c, ".5"), s(c, "/8"), s("1 ", c, "/4"), s(c, "%"), s("$", c, ".25"), s("9:", minute), F.lit("#DIV/0!"), F.lit(""), F.lit(None).cast("string"), F.lit("true"), F.col("o_orderpriority")]
    column = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        column = column.when(k == i, form)
    return t.orders.select("o_orderkey", column.alias("cell"))


@query(
    "src_11_value_types",
    "select o_orderkey, case o_orderkey % 12 when 0 then 'n' when 1 then 'n' when 7 then 'e' when 9 then 'null' when 10 then 'b' else 's' end as type from orders",
)
def _(t):
    return _messy(t).select("o_orderkey", cells.value_type(F.col("cell")).alias("type"))


@query(
    "src_12_normalised_values",
    f"""select o_orderkey, {MESSY} as cell, round(case o_orderkey % 12 when 0 then o_custkey when 1 then -(o_custkey + 0.5) when 2 then o_custkey / 8 when 3 then 1 + o_custkey / 4 when 4 then o_custkey / 100 when 5 then o_custkey + 0.25
      when 6 then (9 * 60 + o_custkey % 60) / 1440 when 10 then 1 end::double, 8) as num from orders""",
)
def _(t):
    return _messy(t).select("o_orderkey", "cell", F.round(cells.normalised(F.col("cell")), 8).alias("num"))


@query(
    "src_13_serial_dates",
    """select event_id, round(date_diff('day', date '1970-01-01', cast(ts as date)) + 25569 + (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400.0::double, 8) as serial,
    strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as back from events""",
)
def _(t):
    serial = D.timestamp_to_serial(F.col("ts"))
    return t.events.select("event_id", F.round(serial, 8).alias("serial"), F.date_format(D.serial_to_timestamp(serial), "yyyy-MM-dd HH:mm:ss").alias("back"))


@query(
    "src_14_embedded_rows",
    """select page_id, r as row, case when r = 1 then cast(page_id as varchar) else 'a, "b" [c]' end as first_field, case when r = 1 then 'len ' || cast(length(html) as varchar) else url end as second_field,
    case when r = 1 then '7' else '[1,2]' end as third_field from pages, (values (1), (2)) v(r) where html is not null and url is not null""",
)
def _(t):
    # in the middle of the page, behind another literal
    cut = F.floor(F.length("html") / 2).cast("int")
    literal = F.concat(
        F.lit('<script>var other = [[1]]; appsTableData = [ ["'), F.col("page_id").cast("string"), F.lit('", "len '), F.length("html").cast("string"),
        F.lit('", 7 ],\n ["a, \\"b\\" [c]", \''), F.col("url"), F.lit("', [1,2]] ]; tail = [[1]]</script>"))
    body = F.concat(F.left("html", cut), literal, F.substring("html", cut + 1, F.length("html")))
    rows = markup.embedded_rows(t.pages.select("page_id", body.alias("text")), "page_id", "text", "appsTableData")
    return rows.select("page_id", "row", *[F.get("fields", F.lit(i)).alias(f"{n}_field") for i, n in enumerate(("first", "second", "third"))])
