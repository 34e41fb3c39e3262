import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.functions import aggregates as A
from marketlens.functions import dates as D
from marketlens.functions import finance as N
from marketlens.functions import maths as M
from marketlens.functions import text as X
from marketlens.functions import transliterate as Z
from marketlens.functions.criteria import criteria_table
from marketlens.operators import cashflow as C


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_maths_edges(spark):
    v = lambda c: value(spark, c)
    lit = lambda x: F.lit(float(x))
    assert v(M.mod(lit(-7), 3)) == 2 and v(M.mod(lit(-6), 3)) == 0 and v(M.mod(lit(7), -3)) == -2 and v(M.mod(lit(7), 0)) is None
    assert v(M.ceiling(lit(-2.5), -2.0)) == -4 and v(M.ceiling(lit(2.5), -2.0)) is None and v(M.floor(lit(-2.5), -2.0)) == -2
    assert v(M.even(lit(-1.5))) == -2 and v(M.odd(lit(0))) == 1 and v(M.odd(lit(2))) == 3 and v(M.odd(lit(-2))) == -3
    assert v(M.roundup(lit(-3.14), 1)) == -3.2 and v(M.trunc(lit(-3.19), 1)) == -3.1 and v(M.quotient(lit(-7), 2)) == -3 and v(M.quotient(lit(7), 0)) == 0
    assert v(M.fact(F.lit(0))) == 1 and v(M.fact(F.lit(5))) == 120 and v(M.fact(F.lit(-1))) is None
    assert v(M.convert(lit(1), "mi", "km")) == pytest.approx(1.609344) and v(M.convert(lit(212), "F", "C")) == pytest.approx(100) and v(M.convert(lit(1), "kg", "m")) is None


def test_workdays_match_a_calendar(spark):
    free = [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 9), dt.date(2024, 1, 13)]
    works = lambda d: d.weekday() < 5 and d not in free
    starts = [dt.date(2023, 12, 20) + dt.timedelta(days=i) for i in range(40)]
    df = spark.createDataFrame([(d,) for d in starts], "d date")
    steps = [-11, -5, -1, 0, 1, 2, 3, 5, 6, 12]
    for row in df.select("d", *[D.workday(F.col("d"), n, free).alias(f"n{n}") for n in steps], D.networkdays(F.col("d"), F.lit(dt.date(2024, 1, 10)), free).alias("net")).collect():
        for n in steps:
            day, left = row["d"], abs(n)
            while left:
                day += dt.timedelta(days=1 if n > 0 else -1)
                left -= works(day)
            assert row[f"n{n}"] == day, (row["d"], n)
        a, b = sorted([row["d"], dt.date(2024, 1, 10)])
        count = sum(works(a + dt.timedelta(days=i)) for i in range((b - a).days + 1))
        assert row["net"] == (count if row["d"] <= dt.date(2024, 1, 10) else -count)


def test_dates(spark):
    day = lambda s: F.lit(dt.date.fromisoformat(s))
    v = lambda c: value(spark, c)
    assert v(D.date(F.lit(2024), F.lit(14), F.lit(-1))) == dt.date(2025, 1, 30) and v(D.date(F.lit(108), F.lit(1), F.lit(2))) == dt.date(2008, 1, 2)
    assert v(D.datedif(day("2024-01-31"), day("2024-02-29"), "M")) == 0 and v(D.datedif(day("2024-03-01"), day("2024-03-01"))) is None
    # A year that starts on a Sunday counts its Monday weeks from 2 January; 1 January is week 0.
    assert v(D.weeknum(day("2023-01-01"))) == 1 and v(D.weeknum(day("2023-01-08"))) == 2
    assert v(D.weeknum(day("2023-01-01"), 2)) == 0 and v(D.weeknum(day("2023-01-02"), 2)) == 1 and v(D.weeknum(day("2024-01-08"), 2)) == 2
    assert v(D.eomonth(day("2024-01-31"), 1)) == dt.date(2024, 2, 29) and v(D.days360(day("2024-02-29"), day("2024-03-31"))) == 30
    assert v(D.datevalue(F.lit("3-Feb-2024"))) == dt.date(2024, 2, 3) and v(D.datevalue(F.lit("x"))) is None
    assert v(F.date_format(D.serial_to_timestamp(F.lit(59.0)), "yyyy-MM-dd")) == "1900-02-28"
    assert v(F.date_format(D.serial_to_timestamp(F.lit(61.5)), "yyyy-MM-dd HH")) == "1900-03-01 12"
    assert v(F.date_format(D.serial_to_timestamp(F.lit(0.0 + 366), 1904), "yyyy-MM-dd")) == "1905-01-01"


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(X.proper(F.lit("o'neil mary-ann 2nd"))) == "O'neil Mary-Ann 2nd" and v(X.trim(F.lit("\t a   b  "))) == "a b"
    assert v(X.substitute(F.lit("a.b.c.d"), ".", "-", 2)) == "a.b-c.d" and v(X.substitute(F.lit("a.b"), ".", "-", 5)) == "a.b"
    assert v(X.find("z", F.lit("abc"))) is None and v(X.search("B", F.lit("abc"))) == 2 and v(X.mid(F.lit("abcdef"), 3, 2)) == "cd" and v(X.left(F.lit("a"), -1)) is None
    assert v(X.dollar(F.lit(-1234.5))) == "$-1,234.50" and v(X.text_of_number(F.lit(0.256), "0.0%")) == "25.6%" and v(X.char(F.lit(0x4E2D))) == "中" and v(X.code(F.lit("中国"))) == 0x4E2D
    assert X.date_pattern("yyyy-mm-dd hh:mm:ss") == "yyyy-MM-dd HH:mm:ss" and X.date_pattern("d/m/yy h:mm am/pm") == "d/M/yy h:mm a"


def test_transliteration(spark):
    parts = [{"重庆": "\tchóng\tqìng", "带着": "\tdài\tzhe"}, {"重": "\tzhòng", "庆": "\tqìng", "单": "\tdān", "希": "\txī", "望": "\twàng", "绿": "\tlǜ"}]
    v = lambda c: value(spark, c)
    text = F.lit("带着希望去重庆，Go重")
    assert v(Z.convert(text, parts)) == ["dai", "zhe", "xi", "wang", "chong", "qing", "Go", "zhong"]
    assert v(Z.convert(F.lit("重庆绿"), parts, "ascii")) == ["chong2", "qing4", "lv4"] and v(Z.convert(F.lit("绿"), parts, "unicode")) == ["lǜ"]
    assert v(Z.name(F.lit("单希"), parts, [("单于", "\tchán\tyú"), ("单", "\tshàn")])) == ["shan", "xi"]
    assert v(Z.permalink(F.lit("希望"), parts, "_")) == "xi_wang" and v(Z.abbr(text, parts, "-")) == "d-z-x-w-c-q-G-z"
    assert v(Z.sentence(F.lit("希望，重庆！"), parts, True)) == "xī wàng, chóng qìng!" and v(Z.sentence(F.lit("希望。"), parts)) == "xi wang."


def test_char_beyond_the_code_points(spark):
    codes = [-1, 0, 65, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFEFF, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 1_200_033, 2**40, None]
    rows = spark.createDataFrame([(c,) for c in codes], "c long").select("c", X.char(F.col("c")).alias("v"))
    valid = lambda c: c is not None and 0 <= c <= 0x10FFFF and not 0xD800 <= c <= 0xDFFF
    assert {r.c: r.v for r in rows.collect()} == {c: chr(c) if valid(c) else None for c in codes}


def test_few_phrases_are_read_without_python(spark, monkeypatch):
    import random

    from marketlens.plans import catalogue

    random.seed(3)
    parts = [{"ab": "\tā", "abc": "x\n", "b": "", "😀c": "é", "-]": "^", "\\E": "c"}, {}, {"^": "a.", "é": "bb", "x": "\tx"}]
    texts = ["".join(random.choice(["a", "b", "c", "-", "]", "é", "😀", "\\", "E", " ", "\t", "\n", "^", "中"]) for _ in range(random.randrange(60))) for _ in range(300)] + [None, "", "abc" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    native = rows.select("i", Z.romanize(F.col("text"), parts).alias("w"))
    assert "EvalPython" not in native._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.w for r in native.collect()}
    monkeypatch.setattr(Z, "FEW_PHRASES", 0)
    assert got == {r.i: r.w for r in rows.select("i", Z.romanize(F.col("text"), parts).alias("w")).collect()}
    monkeypatch.undo()
    for name in ("text_1_convert", "text_1_tone_numbers"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan
    words = spark.createDataFrame([(w,) for w in ["lüē", "lüè", "ü", "abc", "", "Xiǎoā", None]], "w string").select(Z.numbered_tones(F.col("w")).alias("v"))
    assert [r.v for r in words.collect()] == ["lue1", "lue4", "ü", "abc", "", "Xiaoa13", None]


def test_dictionary_of_a_table(spark):
    from marketlens.operators import dictionary as D

    table = [(1, "望", "\twàng"), (0, "希望", "\txī\twàng"), (0, "希", "\txī"), (0, "希", "\tzz"), (0, "cat", "\tdog"), (0, "ca", "x."), (0, "a-b", None), (1, "dog", "cow"), (0, "", "y"), (0, None, "y"), (2, "]", "\tb"), (2, "^", "\tc")]
    phrases = spark.createDataFrame(table, "part int, phrase string, reading string")
    parts = [{"希望": "\txī\twàng", "希": "\txī", "cat": "\tdog", "ca": "x.", "a-b": ""}, {"望": "\twàng", "dog": "cow"}, {"]": "\tb", "^": "\tc"}]
    texts = ["希望希 cat caca-b 望] 希望", None, "", "none", "cat " * 3000 + "concat", "望望希望。cacat", "cat"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, text string, piece string").repartition(3)
    got = {r.i: r.romanized for r in D.romanize(rows, "text", phrases, [("no", "\tyes")]).collect()}
    want = {r.i: r.w for r in rows.select("i", Z.romanize(F.col("text"), parts, [("no", "\tyes")]).alias("w")).collect()}
    assert got == want and got[1] is None
    assert D.romanize(rows, "text", phrases.limit(0)).count() == 7 and D.romanize(rows.limit(0), "text", phrases).count() == 0


def test_dictionary_sent_to_tasks_or_joined(spark, monkeypatch):
    import random

    from marketlens.operators import dictionary as D

    random.seed(4)
    table = [(0, "ab", "\tcé"), (0, "abc", "-b"), (0, "a", "ab"), (0, "é", "x\t"), (1, "cé", "ā"), (1, "b-", "no"), (1, "bx", None), (1, "x", "c"), (None, "-]", "a"), (2, "ac", "^")]
    phrases = spark.createDataFrame(table, "part int, phrase string, reading string")
    parts = [{p: r or "" for n, p, r in table if n == part} for part in (None, 0, 1, 2)]
    texts = ["".join(random.choice("aabbccé-]x z.") for _ in range(random.randrange(50))) for _ in range(300)] + [None, "", "abcab" * 4000, "z" * 100]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    want = {r.i: r.w for r in rows.select("i", Z.romanize(F.col("text"), parts).alias("w")).collect()}
    held = D.romanize(rows, "text", phrases)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Join" not in plan  # no text is moved
    assert {r.i: r.romanized for r in held.collect()} == want
    monkeypatch.setattr(D, "KEPT_PIECES", 3)
    assert {r.i: r.romanized for r in D.romanize(rows, "text", phrases).collect()} == want
    for limit in ("HELD_PHRASES", "HELD_CHARACTERS"):
        monkeypatch.setattr(D, limit, 5)
        joined = D.romanize(rows, "text", phrases)
        assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
        assert {r.i: r.romanized for r in joined.collect()} == want
        monkeypatch.undo()


def test_long_runs_between_words(spark):
    v = lambda c: value(spark, c)
    run = F.repeat(F.lit("é.«= \t€"), 30_000)
    text = F.concat(F.lit("ab"), run, F.lit("cd"))
    assert v(Z.slug(text)) == "abe-" + "e-" * 29_999 + "cd" and v(Z.tokens(text)) == ["abe", *["e"] * 29_999, "cd"]
    assert v(Z.slug(F.concat(F.lit("ab"), F.repeat(F.lit("«= €"), 30_000), F.lit("cd")), "_")) == "ab_cd"
    assert v(Z.prepare(F.repeat(F.lit("€=€"), 30_000))) == "" and v(Z.readable(F.repeat(F.lit("«="), 30_000))) == ""


def test_schedules(spark):
    loans = spark.createDataFrame([(1, 0.01, 12, 1000.0), (2, 0.0, 4, 100.0)], "id int, r double, n int, pv double")
    rows = C.schedule(loans, "n")
    r, n, pv, per = (F.col(c) for c in ("r", "n", "pv", "period"))
    for due in (0, 1):
        paid = rows.groupBy("id").agg(F.sum(N.ppmt(r, per, n, pv, 0.0, due)).alias("s"), F.first("pv").alias("pv")).collect()
        assert all(row["s"] == pytest.approx(-row["pv"]) for row in paid)
    used = rows.filter("id = 1").agg(F.sum(N.syd(pv, F.lit(100.0), n, per)), F.sum(N.sln(pv, F.lit(100.0), n)), F.max(N.ddb(pv, F.lit(100.0), n, per))).first()
    assert used[0] == pytest.approx(900) and used[1] == pytest.approx(900) and used[2] == pytest.approx(1000 / 6)
    pay = N.pmt(F.lit(0.01), F.lit(12), F.lit(1000.0))
    assert value(spark, N.nper(F.lit(0.01), pay, F.lit(1000.0))) == pytest.approx(12)
    assert value(spark, N.pv(F.lit(0.01), F.lit(12), pay)) == pytest.approx(1000) and value(spark, N.fv(F.lit(0.01), F.lit(12), pay, F.lit(1000.0))) == pytest.approx(0, abs=1e-9)


def test_aggregates_of_small_and_mixed_groups(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "TRUE"), ("a", ""), ("a", None), ("b", "4")], "g string, c string")
    c = F.col("c")
    got = {r["g"]: r for r in df.groupBy("g").agg(A.averagea(c).alias("avga"), A.count(c).alias("n"), A.counta(c).alias("na"), A.countblank(c).alias("nb"), A.countif(c, "X").alias("x"), A.skew(A.as_number_a(c)).alias("sk")).collect()}
    assert got["a"]["avga"] == pytest.approx(2 / 3) and (got["a"]["n"], got["a"]["na"], got["a"]["nb"], got["a"]["x"]) == (1, 4, 2, 1)
    assert got["b"]["sk"] is None
    people = spark.createDataFrame([("Ann", 30), ("bob", 40), ("ANN", 50), (None, 60)], "name string, age int")
    assert people.filter(criteria_table([{"name": "ann", "age": ">35"}, {"age": "<20"}])).count() == 1
    assert people.filter(criteria_table([{"name": "<>ann"}])).count() == 1 and people.filter(criteria_table([{"name": "="}])).count() == 1


def test_substitute_and_workday_take_columns(spark):
    rows = [("a.b.c", ".", "-", 2.9), ("aaa", "aa", "x", 2.0), ("abc", "z", "x", 1.0), ("abc", "", "x", 0.0), ("abc", "", "x", 1.0), ("abc", "b", "", 1.0), (None, "b", "x", 0.0), ("abc", None, "x", 0.0),
            ("abc", "b", "x", None), ("abc", "b", "x", -1.0), ("\u6f22\U0001f642\u6f22", "\u6f22", "k", 2.0), ("a\\Eb", "\\E", "+", 1.0), ("", "a", "b", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, old string, new string, n double")
    got = [r["v"] for r in df.select("i", X.substitute(F.col("x"), F.col("old"), F.col("new"), F.col("n")).alias("v")).orderBy("i").collect()]
    assert got == ["a.b-c", "ax", "abc", "abc", "abc", "ac", None, None, None, "abc", "\u6f22\U0001f642k", "a+b", ""]
    free = [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    starts = [dt.date(2023, 12, 25) + dt.timedelta(days=i) for i in range(25)]
    df = spark.createDataFrame([(d, float(n)) for d in starts for n in (-9, -2, -1, 0, 1, 4, 8)] + [(None, 1.0), (starts[0], None)], "d date, n double")
    same = df.select("n", D.workday(F.col("d"), F.col("n"), free).alias("v"), *[D.workday(F.col("d"), n, free).alias(f"n{n}") for n in (-9, -2, -1, 0, 1, 4, 8)])
    for row in same.collect():
        assert row["v"] == (None if row["n"] is None else row[f"n{int(row['n'])}"])
    assert value(spark, D.workday(F.lit(dt.date(2024, 1, 2)), F.lit(1.7))) == dt.date(2024, 1, 3)
