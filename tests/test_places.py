import bisect
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import lookup as K
from marketlens.operators import places as P
from marketlens.plans import catalogue


@pytest.fixture(scope="module")
def rows():
    """A group with most rows, a value with a third of them, nulls in keys and values."""
    r = random.Random(5)
    out = [("big" if i % 10 < 7 else r.choice(["a", "b", None]), None if i % 50 == 0 else 7.0 if i % 3 == 0 else float(r.randrange(300)), i) for i in range(4000)]
    return out + [("one", 1.0, 4000), ("blank", None, 4001), ("same", 2.0, 4002), ("same", 2.0, 4003)]


@pytest.fixture
def frame(spark, rows):
    """Small ranges stay apart, so that groups and values are cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, "g string, x double, i int").repartition(6)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def groups(rows):
    out = {}
    for g, x, _ in rows:
        if x is not None:
            out.setdefault(g, []).append(x)
    return out


@pytest.mark.parametrize("descending", [True, False])
def test_ranks(frame, rows, descending):
    by = groups(rows)
    got = {r.i: r["rank"] for r in P.ranked(frame, "x", ["g"], descending).collect()}
    assert got == {i: None if x is None else 1 + sum((v > x) if descending else (v < x) for v in by[g]) for g, x, i in rows}
    whole = [x for xs in by.values() for x in xs]
    got = {r.i: r["rank"] for r in P.ranked(frame, "x", descending=descending).collect()}
    assert got == {i: None if x is None else 1 + sum((v > x) if descending else (v < x) for v in whole) for g, x, i in rows}


def test_percent_ranks(frame, rows):
    by = groups(rows)
    got = {r.i: r.percent_rank for r in P.percent_ranked(frame, "x", ["g"]).collect()}
    for g, x, i in rows:
        want = None if x is None or len(by[g]) == 1 else sum(v < x for v in by[g]) / (len(by[g]) - 1)
        assert (got[i] is None) if want is None else got[i] == pytest.approx(want, abs=0.00050001), (g, x, i, got[i], want)
    assert P.percent_ranked(frame.limit(0), "x").count() == 0


@pytest.mark.parametrize("by", [1, -2, 900, 0])
def test_shifted_rows(frame, rows, by):
    for keys in (["g"], []):
        lists = {}
        for g, x, i in sorted(rows, key=lambda r: r[2]):
            lists.setdefault(g if keys else 0, []).append((i, x))
        want = {i: (xs[n + by][1] if 0 <= n + by < len(xs) else None) for xs in lists.values() for n, (i, _) in enumerate(xs)}
        assert {r.i: r.shifted for r in P.shifted(frame, "x", by, ["i"], keys).collect()} == want


def test_nearest_keys(spark, frame, rows):
    r = random.Random(6)
    table = [(r.choice(["big", "a", None]), float(r.randrange(320)) + r.choice([0, 0.5]), r.randrange(1000)) for _ in range(200)] + [("b", None, 1), ("big", 7.0, -1), ("big", 7.0, -2)]
    lookup = spark.createDataFrame(table, "g string, k double, v int")
    smallest = {}
    for g, k, v in table:
        if k is not None:
            smallest[g, k] = min(v, smallest.get((g, k), v))
    for forward in (False, True):
        got = {r.i: (r.g, r.x, r.found) for r in P.asof(frame, "x", lookup, "k", "v", ["g"], forward=forward).collect()}
        assert len(got) == len(rows)
        for g, x, i in rows:
            keys = sorted(k for h, k in smallest if h == g)
            at = None
            if x is not None and keys:
                place = bisect.bisect_left(keys, x) if forward else bisect.bisect_right(keys, x) - 1
                at = keys[place] if 0 <= place < len(keys) else None
            assert got[i] == (g, x, None if at is None else smallest[g, at])
    assert K.match(frame, "x", lookup, "k", "v", 1).filter("position is not null").count() == sum(x is not None and x >= min(k for _, k in smallest) for _, x, _ in rows)


def test_rows_are_not_joined_on_values(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("win_1_rank", "look_3_lookup", "look_8_offset"):
            text = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" not in text
            for line in text.splitlines():  # what is sorted for a join are ends of ranges
                assert "SortMergeJoin" not in line or "_part" in line, (name, line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
