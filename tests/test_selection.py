import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest

from marketlens.operators import selection as S
from marketlens.plans import catalogue


def expected(rows, places):
    """Value, smaller and equal values at each place, by sorting; NaN is the largest."""
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    rank = lambda x: (isinstance(x, float) and math.isnan(x), x)
    out = {}
    for g, xs in groups.items():
        xs.sort(key=lambda x: (1, 0) if rank(x)[0] else (0, x))
        for i, place in enumerate(places(len(xs))):
            if 0 <= place < len(xs):
                v = xs[place]
                same = [rank(x)[0] if rank(v)[0] else x == v for x in xs]
                out[g, i] = (str(v), same.index(True), sum(same))
            else:
                out[g, i] = (None, None, None)
    return out


def got(frame, column, places, wanted, keys=("g",)):
    rows = S.at_places(frame, column, places, list(keys)).collect()
    plain = lambda v: None if v is None else str(v)
    return {(r["g"] if keys else None, i): (plain(r[f"value{i}"]), r[f"before{i}"], r[f"equal{i}"]) for r in rows for i in range(wanted)}


VALUES = {
    "double": lambda r: [r.uniform(-5, 5) for _ in range(300)] + [0.0] * 200 + [2.0**i for i in range(-1070, 1024, 7)] + [-(3.0**i) for i in range(300)] + [math.inf, -math.inf, math.nan, math.nan, 1.7e308, -1.7e308],
    "bigint": lambda r: [2**60 + r.randrange(3000) for _ in range(400)] + [r.randrange(50) for _ in range(300)] + [-(2**63), 2**63 - 1],
    "decimal(20,4)": lambda r: [Decimal(r.randrange(10**6)) / 100 for _ in range(400)],
    "date": lambda r: [dt.date(1990, 1, 1) + dt.timedelta(r.randrange(9000)) for _ in range(500)],
    "timestamp_ntz": lambda r: [dt.datetime(1990, 1, 1) + dt.timedelta(microseconds=r.randrange(10**15)) for _ in range(500)],
}


@pytest.mark.parametrize("kind, few", [*((k, 10_000) for k in VALUES), ("double", 1)])
def test_places_of_any_values(spark, kind, few, monkeypatch):
    r = random.Random(7)
    rows = [(g, x) for g in ("a", None) for x in VALUES[kind](r)] + [("a", None), ("empty", None), ("one", VALUES[kind](r)[0])]
    if kind.startswith("decimal"):
        rows = [(g, None if x is None else x.quantize(Decimal("0.0001"))) for g, x in rows]
    r.shuffle(rows)
    monkeypatch.setattr(S, "BINS", 64)
    monkeypatch.setattr(S, "LAST_ROWS", 40)
    monkeypatch.setattr(S, "FEW_GROUPS", few)
    frame = spark.createDataFrame(rows, f"g string, x {kind}").repartition(4)
    want = lambda n: [n // 2, n - 3, 2]
    assert got(frame, "x", lambda n: [S.F.floor(n / 2), n - 3, S.F.lit(2)], 3) == expected(rows, want)


def test_places_without_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "LAST_ROWS", 50)
    rows = [(None, float(i % 1000) ** 3) for i in range(5000)] + [(None, None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    assert got(frame, "x", lambda n: [S.F.lit(0), n - 1, S.F.lit(2500)], 3, ()) == expected(rows, lambda n: [0, n - 1, 2500])
    assert S.at_places(frame.limit(0), "x", lambda n: [n - 1]).collect() == [] and S.at_places(frame.limit(0), "x", lambda n: [n - 1], ["g"]).collect() == []


def test_percentiles_and_means(spark, monkeypatch):
    monkeypatch.setattr(S, "LAST_ROWS", 30)
    rng = np.random.default_rng(3)
    groups = {"skewed": rng.lognormal(0, 4, 3001), "same": np.full(500, 7.0), "two": np.array([1.0, 2.0]), "one": np.array([-3.0]), "copies": rng.integers(0, 4, 800).astype(float)}
    frame = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None)], "g string, x double").repartition(3)
    for p in (0, 0.3, 1):
        assert {r.g: r.value for r in S.percentile(frame, "x", p, ["g"]).collect()} == pytest.approx({g: np.quantile(xs, p) for g, xs in groups.items()}, rel=1e-12)
    for share in (0.2, 1):
        want = {}
        for g, xs in groups.items():
            cut = math.floor(len(xs) * share / 2)
            kept = np.sort(xs)[cut : len(xs) - cut]
            want[g] = pytest.approx(kept.mean(), rel=1e-12) if len(kept) else None
        assert {r.g: r.value for r in S.trimmed_mean(frame, "x", share, ["g"]).collect()} == want
    assert S.kth_smallest(frame, "x", 3, ["g"]).filter("g in ('two', 'one')").select("value").collect() == [(None,), (None,)]
    assert S.median(frame, "x").first().value == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_text_has_no_places(spark):
    with pytest.raises(TypeError):
        S.at_places(spark.createDataFrame([("a",)], "x string"), "x", lambda n: [n - 1])


def test_no_sort_of_the_rows(spark):
    for name in ("agg_23_median", "agg_25_percentile", "agg_26_quartile", "agg_27_trimmean", "agg_28_large", "agg_29_small", "flt_17_top_and_bottom"):
        text = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in text and "SortMergeJoin" not in text, name
