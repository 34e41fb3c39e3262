import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import cashflow as C
from marketlens.operators import listfilter as L
from marketlens.operators import lookup as K
from marketlens.operators import monitoring as M
from marketlens.operators import ordered as O
from marketlens.operators import runs as R
from marketlens.operators import selection as S
from marketlens.operators import trend as T
from marketlens.operators.joins import frequent_keys, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in group a, a third of all rows with one value."""
    random.seed(3)
    rows = [("a" if i % 3 else "b", 7.0 if i % 3 == 1 else float(random.randint(0, 400)), i) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, x double, i int").repartition(5), rows


def test_ordered_statistics_match_brute_force(skewed):
    df, rows = skewed
    groups = {g: sorted(x for h, x, _ in rows if h == g) for g in "ab"}
    got = {r["g"]: r["value"] for r in S.percentile(df, "x", 0.3, ["g"]).collect()}
    assert got == pytest.approx({g: float(np.percentile(v, 30)) for g, v in groups.items()})
    assert {r["g"]: r["value"] for r in S.kth_largest(df, "x", 9, ["g"]).collect()} == {g: v[-9] for g, v in groups.items()}
    places = sorted((r["position"], r["x"], r["i"]) for r in O.numbered(df, ["x", "i"]).collect())
    assert [p[0] for p in places] == list(range(1, 3001)) and [p[1:] for p in places] == sorted((x, i) for _, x, i in rows)


def test_small_groups(spark):
    df = spark.createDataFrame([("e", None), ("o", 4.0), ("t", 1.0), ("t", 2.0), ("m", 3.0), ("m", 3.0), ("m", 5.0), ("m", 5.0)], "g string, x double")
    assert {r["g"]: r["value"] for r in O.mode(df, "x", ["g"]).collect()} == {"o": None, "t": None, "m": 3.0}
    assert {r["g"]: r["value"] for r in S.median(df, "x", ["g"]).collect()} == {"o": 4.0, "t": 1.5, "m": 4.0}


def test_salted_join_copies_frequent_keys_only(spark):
    rows = [("hot" if i % 10 else f"m{i % 7}", i) for i in range(5000)] + [(None, 1)]  # one member holds 90%
    facts = spark.createDataFrame(rows, "g string, i int").repartition(4)
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("m0", 3), ("none", 4), (None, 5)], "g string, n int")
    assert [tuple(r) for r in frequent_keys(facts, ["g"], 1000)[0].collect()] == [("hot", 5)]
    assert frequent_keys(facts, ["g"], 5000) is None
    plain = sorted(facts.join(side, "g").select("i", "n").collect())
    joined = salted_join(facts, side, ["g"], ["i"], rows_per_part=1000)
    assert sorted(joined.select("i", "n").collect()) == plain and joined.columns == ["g", "i", "n"]
    assert sorted(salted_join(facts, side, ["g"], ["i"]).select("i", "n").collect()) == plain
    assert "_salt" not in salted_join(facts, side, ["g"], ["i"])._jdf.queryExecution().optimizedPlan().toString()
    kept = salted_join(facts, side, ["g"], ["i"], "left", rows_per_part=1000)
    assert kept.count() == facts.join(side, "g", "left").count()
    some = salted_join(facts, side, ["g"], ["i"], condition=F.col("n") < F.col("i"), rows_per_part=1000, counted=facts.select("g"))
    assert some.count() == facts.join(side, "g").filter("n < i").count()


def test_list_filters(spark):
    df = spark.createDataFrame([("Abc", 5.0), ("a*c", 0.0), ("", -3.0), (None, 9.0), ("xyz", 9.0)], "s string, x double")
    texts = lambda f: [r["s"] for r in f.collect()]
    assert texts(df.filter(L.custom(F.col("s"), [("=", "a?C")]))) == ["Abc", "a*c"]
    assert texts(df.filter(L.custom(F.col("s"), [("=", "a~*c")]))) == ["a*c"]
    assert texts(df.filter(L.custom(F.col("s"), [("=", "")]))) == ["", None]
    assert texts(df.filter(L.in_values(F.col("s"), ["xyz"], blanks=True))) == ["", None, "xyz"]
    assert sorted(r["x"] for r in L.top_n(df, "x", 2).collect()) == [9.0, 9.0]
    assert sorted(r["x"] for r in L.top_n(df, "x", 2, top=False).collect()) == [-3.0, 0.0, 5.0]
    assert L.relative_range("nextWeek", dt.date(2024, 1, 6)) == (dt.date(2024, 1, 7), dt.date(2024, 1, 14))
    assert L.relative_range("lastQuarter", dt.date(2024, 2, 29)) == (dt.date(2023, 10, 1), dt.date(2024, 1, 1))
    bad = L.rejects(df, {"short": L.validation_rule("textLength", "s", "lessThan", 3), "positive": L.validation_rule("decimal", "x", "greaterThan", 0)})
    assert sorted((r["x"], tuple(r["broken_rules"])) for r in bad.collect()) == [(-3.0, ("positive",)), (0.0, ("short", "positive")), (5.0, ("short",)), (9.0, ("short",))]


def test_cash_flows(spark):
    flows = spark.createDataFrame([(1, 1, -1000.0), (1, 2, 600.0), (1, 3, 600.0), (2, 1, -100.0), (2, 2, 50.0), (3, 1, 5.0)], "id int, p int, v double")
    got = {r["id"]: r["irr"] for r in C.irr(flows, ["id"], "p", "v").collect()}
    assert got[1] == pytest.approx(0.130662386, abs=1e-8) and got[2] == pytest.approx(-0.5) and got[3] is None
    assert {r["id"]: r["npv"] for r in C.npv(flows, ["id"], "p", "v", 0.1).collect()}[1] == pytest.approx(-1000 / 1.1 + 600 / 1.21 + 600 / 1.331)


@pytest.mark.parametrize("top", [True, False])
def test_nth_value_of_groups(spark, top):
    random.seed(9)
    groups = {"a": [float(random.randrange(400)) for _ in range(3000)], "same": [2.0] * 900, "few": [1.0, 5.0, 3.0], None: [0.0, 0.0, 4.0, 9.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("blank", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for n in (1, 3, 40):
        want = []
        for g, xs in groups.items():
            edge = sorted((x for x in xs if x), reverse=top)[: n][-1]
            want += [(g, x) for x in xs if (x >= edge if top else x <= edge)]
        assert sorted(map(tuple, L.top_n(frame, "x", n, top, ["g"]).collect()), key=str) == sorted(want, key=str)


def test_polynomial_matches_numpy(spark):
    random.seed(2)
    xs = [float(i) for i in range(40)]
    ys = [2 - x + 0.3 * x**2 - 0.01 * x**3 + random.random() for x in xs]
    row = T.polynomial(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), "y", "x", 3).first()
    assert row["coefficients"] == pytest.approx(list(np.polyfit(xs, ys, 3)[::-1]), rel=1e-6)
    fitted = np.polyval(np.polyfit(xs, ys, 3), xs)
    assert row["r2"] == pytest.approx(1 - np.sum((np.array(ys) - fitted) ** 2) / np.sum((np.array(ys) - statistics.mean(ys)) ** 2))
    best = T.best_fit(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), "y", "x", orders=(2, 3)).first()
    assert best["kind"] == "polynomial_3"


def test_polynomials_of_all_orders(spark):
    rng = np.random.default_rng(4)
    wide = np.sort(rng.lognormal(3, 1.5, 60)) + 1e4  # far from 0 and skewed
    rows = [("wide", float(x), float(y)) for x, y in zip(wide, np.sin(wide / 90) + rng.normal(0, 0.1, 60))]
    rows += [("four", float(x), float(x * x)) for x in (1, 2, 3, 5)] + [("same", 7.0, float(i)) for i in range(9)] + [("few x", float(i % 3), float(i)) for i in range(30)]
    rows += [("wide", None, 5.0), ("wide", 5.0, None), ("none", None, None), (None, 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.g, r.order): r for r in T.polynomials(frame, "y", "x", keys=["g"]).collect()}
    assert {k for k in got if k[0] != "wide"} == {("four", 2), ("four", 3), ("few x", 2)}
    ys = np.array([r[2] for r in rows[:60]])
    for order in range(2, 7):
        best = np.polynomial.Polynomial.fit(wide, ys, order)
        r = got["wide", order]
        assert r.r2 == pytest.approx(1 - ((ys - best(wide)) ** 2).sum() / ((ys - ys.mean()) ** 2).sum(), abs=1e-9)
    assert got["four", 2].coefficients == pytest.approx([0, 0, 1], abs=1e-9) and got["four", 2].r2 == pytest.approx(1)
    kinds = {r.g: r.kind for r in T.best_fit(frame, "y", "x", ["g"]).collect()}
    assert kinds["wide"] == "polynomial_6" and "same" not in kinds and "none" not in kinds


def test_fits_through_the_origin(spark):
    xs, ys = [1.0, 2.0, 4.0], [3.0, 5.0, 9.0]
    frame = spark.createDataFrame([*zip(xs, ys), (None, 4.0), (9.0, None)], "x double, y double")
    fits = {r.kind: r for r in T.all_fits(frame, "y", "x", const=False).collect()}
    x, y = np.array(xs), np.array(ys)
    for kind, u, v in (("linear", x, y), ("logarithmic", np.log(x), y), ("exponential", x, np.log(y)), ("power", np.log(x), np.log(y))):
        slope = (u * v).sum() / (u * u).sum()
        assert fits[kind].slope == pytest.approx(np.exp(slope) if kind == "exponential" else slope) and fits[kind].intercept == (1 if kind in ("exponential", "power") else 0)
        assert fits[kind].r2 == pytest.approx(1 - ((v - slope * u) ** 2).sum() / (v * v).sum())
    at = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    assert [r.fitted for r in T.fitted(frame, "y", "x", at, kind="exponential", const=False).orderBy("x").collect()] == pytest.approx([1.0, fits["exponential"].slope ** 10])
    curve = T.best_fit(frame, "y", "x", orders=(2,), const=False).first()
    assert curve.kind == "polynomial_2" and curve.r2 == pytest.approx(1)


def test_runs_and_trees(spark):
    e = spark.createDataFrame([(1, "coupon", 5, 10), (1, "coupon", 9, 11), (1, "deal", 2, 12), (2, "deal", 1, 13)], "prom_id int, type string, query_time int, id int")
    assert sorted(r["id"] for r in R.latest_effects(e).collect()) == [11, 12, 13]
    tree = R.nested_tree(spark.createDataFrame([("a", "x", "l1"), ("a", "x", "l2"), ("a", "y", "l3"), ("a", "x", "l1")], "t1 string, t2 string, t3 string"), ["t1", "t2", "t3"], [])
    assert [(b["t2"], [leaf["t3"] for leaf in b["children"]]) for b in tree.first()["children"]] == [("x", ["l1", "l2"]), ("y", ["l3"])]
    wide = spark.range(5).select(F.lit("a").alias("t1"), F.col("id").alias("t2"))
    assert len(R.nested_tree(wide, ["t1", "t2"], [], most=5).first()["children"]) == 5
    with pytest.raises(ValueError):
        R.nested_tree(wide, ["t1", "t2"], [], most=4)
    assert R.nested_tree(wide.limit(0), ["t1", "t2"], []).count() == 0


def test_masked_trend_and_clusters(spark):
    rows = [("s", dt.date(2024, 1, d), v) for d, v in enumerate([0.0, 0.0, 5.0, 0.0, 0.0], 1)]
    masked = M.masked_trend(spark.createDataFrame(rows, "series string, trans_date date, mv_trans_amount double"), ["series"])
    assert [r["mv_trans_amount"] for r in masked.orderBy("trans_date").collect()] == [None, None, 5.0, 0.0, None]
    points = spark.createDataFrame([("a", 0.0), ("b", 0.1), ("c", 0.2), ("d", 9.0), ("e", 9.1)], "channel string, m double")
    got = {r["channel"]: (r["channel_count"], r["cent_channel"]) for r in M.channel_clusters(points, "channel", ["m"], 2).collect()}
    assert got["a"] == got["b"] == (3, "b") and got["d"][0] == 2
    order = [r["m"] for r in M.sorted_by(points, "m", ascending=False).collect()]
    assert order == sorted(order, reverse=True)


def test_many_flow_times_by_passes(spark, monkeypatch):
    """Investments with many times are solved by sums over rows, with the same rates."""
    import random

    from marketlens.operators import cashflow

    rng, rows = random.Random(4), []
    for key in range(6):
        rows += [(key, i, -1000.0 if i == 0 else rng.uniform(0, 400)) for i in range(rng.randint(3, 30))]
    rows += [(99, 0, -5.0), (99, 1, -1.0)]
    flows = spark.createDataFrame(rows, "k int, i int, v double")
    listed = {r.k: r.irr for r in cashflow.irr(flows, ["k"], "i", "v").collect()}
    monkeypatch.setattr(cashflow, "LISTED_TIMES", 10)
    passes = {r.k: r.irr for r in cashflow.irr(flows, ["k"], "i", "v").collect()}
    assert listed.keys() == passes.keys() and listed[99] is None and passes[99] is None
    assert all(listed[k] is None or abs(listed[k] - passes[k]) < 1e-9 * (1 + abs(listed[k])) for k in listed)
    monkeypatch.setattr(cashflow, "LISTED_TIMES", 1)
    assert {r.k: r.irr for r in cashflow.irr(flows, ["k"], "i", "v").collect()}[99] is None


def test_passes_bear_late_flows_of_both_signs(spark, monkeypatch):
    """More than 10,000 times: the sums don't overflow, and lists and passes find the same rate."""
    from marketlens.operators import cashflow

    rows = []
    for i in range(12_000):
        rows.append((1, i, -100.0 if i == 0 else (1.0, -0.9)[(i - 1) % 2]))  # just above 0
        rows.append((2, i, -1000.0 if i == 0 else (1.0, -0.95)[(i - 1) % 2]))  # below 0
        rows.append((3, i, -1.0 if i == 0 else 7.0))  # far above the guess
        rows.append((4, i, 1.0 if i % 2 else 2.0))  # one sign
        rows.append((5, i, 0.0 if i > 400 or i < 3 else -90.0 if i == 3 else (1.0, -0.7)[i % 2]))  # zeros at both ends
        rows.append((6, i, None if i == 7 else (-5.0, 6.0)[i % 2]))
    flows = spark.createDataFrame(rows, "k int, i int, v double").repartition(8).cache()
    passes = {r.k: r.irr for r in cashflow.irr(flows, ["k"], "i", "v").collect()}
    monkeypatch.setattr(cashflow, "LISTED_TIMES", 20_000)
    listed = {r.k: r.irr for r in cashflow.irr(flows, ["k"], "i", "v").collect()}
    flows.unpersist()
    assert passes.keys() == listed.keys() == {1, 2, 3, 4, 5, 6}
    assert passes[4] is listed[4] is None and passes[6] is listed[6] is None
    for k in (1, 2, 3, 5):
        assert passes[k] == pytest.approx(listed[k], rel=1e-7, abs=1e-10), k
    assert 0 < passes[1] < 0.001 and -0.01 < passes[2] < 0 and passes[3] == pytest.approx(7.0)


def test_matrix_product_of_a_narrow_inner_index(spark):
    random.seed(8)
    left = [(i, k, float(random.randrange(9))) for i in range(300) for k in (0, 1)] + [(5, 7, 2.0), (6, None, 1.0)]
    right = [(k, j, float(random.randrange(9))) for k in (0, 1) for j in range(40)] + [(7, 3, 4.0), (8, 1, 1.0), (None, 2, 1.0)]
    want = {}
    for i, k, a in left:
        for h, j, b in right:
            if k is not None and k == h:
                want[i, j] = want.get((i, j), 0.0) + a * b
    frames = [spark.createDataFrame(rows, "i int, j int, v double").repartition(4) for rows in (left, right)]
    for block in (25, 10_000):
        assert {(r.i, r.j): r.v for r in K.matrix_product(*frames, block).collect()} == want


def test_matrix_product_moves_no_products(spark, monkeypatch):
    random.seed(9)
    left = [(random.choice([None, 1, 1, 1, i]), k, float(random.randrange(9))) for i in range(60) for k in range(5) for _ in range(2)] + [(5, 70, 2.0), (6, None, 1.0)]
    right = [(k, j, float(random.randrange(9))) for k in range(5) for j in (*range(7), None)] + [(None, 2, 1.0), (71, 3, 1.0)]
    want = {}
    for i, k, a in left:
        for h, j, b in right:
            if k is not None and k == h:
                want[i, j] = want.get((i, j), 0.0) + a * b
    long, short = (spark.createDataFrame(rows, "i int, j int, v double").repartition(4) for rows in (left, right))
    turned = [df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") for df in (short, long)]
    plain = K.matrix_product(long, short)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if " Exchange " in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0] and "Join" not in plan[: plan.index("BroadcastHashJoin")]
    assert {(r.i, r.j): r.v for r in plain.collect()} == want
    for per_part in (16_000_000, 40):  # with 40, the rows of index 1 and of null are spread
        monkeypatch.setattr(K, "PRODUCTS_PER_PART", per_part)
        for few in (0, 50, 10_000):
            assert {(r.i, r.j): r.v for r in K.matrix_product(long, short, 25, few).collect()} == want
            assert {(r.j, r.i): r.v for r in K.matrix_product(*turned, 25, few).collect()} == want
