import datetime as dt

from pyspark.sql import functions as F

from marketlens.sinks import audience, files
from marketlens.sources import catalog, cells, delimited, marks, markup
from marketlens.streaming.hourly import hourly_totals, run_available


def test_delimited_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿1;\"x \"\"q\"\"; y\"\n2;\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes('3;"p \\"q\\" r"\n'.encode())
    rows = delimited.read_delimited(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "id int, s string", delimiter=";", with_file=True).collect()
    assert sorted((r["id"], r["s"], r["file_path"][-5:]) for r in rows if r["s"]) == [(1, 'x "q"; y', "a.csv"), (3, 'p "q" r', "b.csv")]
    assert [r["id"] for r in rows if r["s"] is None] == [2]
    (tmp_path / "g.csv").write_bytes("1,é\n".encode("iso-8859-1"))
    assert delimited.read_delimited(spark, str(tmp_path / "g.csv"), "id int, s string", encoding="ISO-8859-1").first()["s"] == "é"
    assert delimited.profile(delimited.only(spark.range(9), ["id"], F.col("id") > 3)).first().asDict() == {"total_rows": 5, "total_columns": 1}


def test_byte_order_marks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "with.txt").write_bytes(b"\xef\xbb\xbfabc")
    (tmp_path / "sub" / "without.txt").write_bytes(b"abc")
    rows = {r["path"].rsplit("/", 1)[1]: (r["had_mark"], bytes(r["content"])) for r in marks.folder_report(spark, str(tmp_path)).collect()}
    assert rows == {"with.txt": (True, b"abc"), "without.txt": (False, b"abc")}


def test_markup(spark):
    good = "<table><tr><th>K</th><td>a &amp; <b>b</b></td></tr><tr><td>1</td></tr></table>"
    bad = "<table><tr><td>x<td>y<tr><td>z</table>"
    pages = spark.createDataFrame([(1, good), (2, bad)], "id int, html string")
    found = sorted(tuple(r) for r in markup.cells(pages.filter("id = 1"), "id", "html").collect())
    assert found == [(1, 1, 1, 1, "K"), (1, 1, 1, 2, "a & b"), (1, 1, 2, 1, "1")]
    lenient = sorted(tuple(r) for r in markup.lenient_cells(pages, "id", "html").collect())
    assert lenient == found + [(2, 1, 1, 1, "x"), (2, 1, 1, 2, "y"), (2, 1, 2, 1, "z")]


def test_cells(spark):
    texts = ["12", "-1.5", "1e3", "3/4", "-1 1/2", "12.5%", "$1,234.50", "9:45", "#N/A", "=A1", "TRUE", "abc", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", *cells.typed(F.col("c")))
    got = {r["c"]: (r["type"], r["num"]) for r in df.collect()}
    assert got["12"] == ("n", 12.0) and got["3/4"] == ("n", 0.75) and got["-1 1/2"] == ("n", -1.5) and got["12.5%"] == ("n", 0.125)
    assert got["$1,234.50"] == ("n", 1234.5) and got["9:45"] == ("n", 0.40625) and got["1e3"] == ("n", 1000.0)
    assert got["#N/A"][0] == "e" and got["=A1"][0] == "f" and got["TRUE"] == ("b", 1.0) and got["abc"] == ("s", None) and got[None][0] == "null"


def test_ranges(spark):
    assert [tuple(r) for r in catalog.rows_to_range(spark, [(1, "-"), (2, "x")], "a int, b string", null_value="-").collect()] == [(1, None), (2, "x")]
    catalog.named_range(spark.range(3), "three")
    assert catalog.warehouse_table(spark, "three", ["id"]).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string").alias("member_no"), *[F.lit("v").alias(c) for c in ("mobile", "named", "device_cid", "device_type")], F.col("id").alias("score_tag_result"))
    assert audience.save_audience(df, str(tmp_path / "aud")) == 25
    assert spark.read.parquet(str(tmp_path / "aud")).dtypes[-1] == ("score_tag_result", "int")
    assert files.export_delimited(df.coalesce(1), str(tmp_path / "out"), rows_per_file=10) == 25
    assert len(list((tmp_path / "out").glob("*.csv"))) == 3
    files.write_csv(df.select("member_no").coalesce(1), str(tmp_path / "sheet"), spreadsheet=True)
    text = next((tmp_path / "sheet").glob("*.txt")).read_bytes()
    assert text.startswith(b'\xef\xbb\xbfsep=;\r\n"0"\r\n"1"\r\n')
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "4")
    try:
        files.write_csv(df.select("member_no").repartition(3), str(tmp_path / "sheets"), spreadsheet=True)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    heads = [f.read_bytes() for f in (tmp_path / "sheets").glob("*.txt")]
    assert len(heads) == 3 and all(x.startswith(b"\xef\xbb\xbfsep=;\r\n") and x.count(b"\xef\xbb\xbf") == 1 for x in heads)


def test_stream_drops_late_rows_and_restarts(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "at timestamp, amount double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run_available(hourly_totals(spark.readStream.schema(schema).parquet(source)), out, check)

    arrive([(at(8, 5), 1.0), (at(8, 50), 2.0), (at(9, 10), 4.0), (at(11), 8.0)])
    arrive([(at(8, 30), 100.0), (at(9, 50), 200.0), (at(10, 30), 16.0), (at(14), 32.0)])
    got = {r["hour"].hour: (r["n"], r["amount"]) for r in spark.read.parquet(out).collect()}
    assert got == {8: (2, 3.0), 9: (1, 4.0), 10: (1, 16.0), 11: (1, 8.0)}


def test_literals_in_pages():
    from marketlens.sources.markup import literal_rows

    page = """<p>x[1]</p> myrows = [[9]]; rows = [ ["a, b", 'c"]', 3 ], [], ["",], [ "\\"q\\"", [1,[2,"]"]], x y ] ]; rows = [[8]]"""
    assert literal_rows(page, "rows") == [["a, b", 'c"]', "3"], [], ["", ""], ['"q"', '[1,[2,"]"]]', "x y"]]
    assert literal_rows("rows = [[1, 2", "rows") == [] and literal_rows("no", "rows") == [] and literal_rows("rows=[]", "rows") == []


def test_marks_are_taken_off_files(spark, tmp_path):
    from marketlens.sources import marks

    mark = b"\xef\xbb\xbf"
    files = {"a.txt": mark + b"x\xff\x00\n", "deep/b.bin": b"\x00\x01" + mark, "deep/c'd.txt": mark, "two.txt": mark + mark + b"y"}
    for name, content in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    report = {r.file: (r.had_mark, r.bytes) for r in marks.clean_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out").collect()}
    cleaned = {name: content.removeprefix(mark) for name, content in files.items()}
    assert report == {name: (files[name] != cleaned[name], len(cleaned[name])) for name in files}
    assert {name: (tmp_path / "out" / name).read_bytes() for name in files} == cleaned
    assert all((tmp_path / "in" / name).read_bytes() == content for name, content in files.items())
