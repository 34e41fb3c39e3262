import math

import numpy as np

from marketlens.llm import topk as K


def brute(rows, every, k):
    """Every query's k best, by plain sums of whole numbers."""
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(usable) if b != a and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_smallest_table(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert rows_of(K.query(spark, folder)) == brute(rows, 50, 5)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(0, rows[0][1]), (50, rows[3][1]), (None, rows[1][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (203, [math.inf] * 6)]
    rows += [(300, [1.0, 2.0]), (301, [0.5, -1.0]), (350, [7.0]), (400, [])]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int, rank int").repartition(5)
    got = rows_of(K.search(frame, every=50, k=5))
    assert got == brute(rows, 50, 5)
    assert K.search(frame.limit(0)).count() == 0


def test_large_components_are_exact():
    q, v = np.array([[2**40, 3, -5]]), np.array([[2**20, 7, 2**30], [1, 1, 1]])
    assert sum(K.local_scores(q, v, 2)).tolist() == [[2**60 + 21 - 5 * 2**30, 2**40 - 2]]


def test_cutoff_is_safe_and_prunes():
    rng = np.random.default_rng(4)
    q, v = rng.integers(-100, 100, (20, 16)), rng.integers(-100, 100, (400, 16))
    scores, own = K.local_scores(q, v), np.zeros((20, 400), bool)
    bounds, least = K.gathered(scores, own, 5)
    exact = np.sort(q @ v.T, axis=1)[:, ::-1][:, :5]
    assert (bounds[:, 4] <= exact[:, 4]).all()
    for i, _, values in K.resolved(scores, own, np.arange(400), bounds[:, 4], least, 5):
        assert values.tolist() == exact[i].tolist()


def test_the_driver_sends_no_vectors(spark, folder, monkeypatch):
    """Copies of the queries were estimated as one copy and went to all tasks through the driver."""
    plans, write = [], K.scratch_table

    def written(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write(frame, name)

    monkeypatch.setattr(K, "scratch_table", written)
    plans.append(K.query(spark, folder)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5 and not any("Broadcast" in p for p in plans)


def test_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 5)]) for i in range(300)] + [(300 + i, [0.5, 0.25]) for i in range(40)] + [(10 * i, [3.0] * 9) for i in range(3)]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<float>").repartition(7)
    monkeypatch.setattr(K, "CELL_PAIRS", 200)
    monkeypatch.setattr(K, "HELD_BYTES", 2000)
    seen, cells = [], K._cells

    def several(candidates, queries, parts):
        seen.append(parts)
        return cells(candidates, queries, parts)

    monkeypatch.setattr(K, "_cells", several)
    assert rows_of(K.search(frame, every=10, k=4)) == brute(rows, 10, 4)
    assert min(seen[0]) > 1 and seen[0] == seen[1]


def test_grid_takes_few_copies():
    assert K.grid(0, 0, 0, 8) == (1, 1)
    assert K.grid(500, 10, 2000, 8) == (1, 1)
    for n in (10**6, 10**7, 10**9):
        a, b = K.grid(n, n // 50, n, 8)
        assert a * b >= 32 and a + b / 50 <= K.COPIES + 1 + n / K.HELD_BYTES


def test_narrow_vectors_are_exact():
    rng = np.random.default_rng(7)
    for top, kind in ((127, np.int8), (2**15 - 1, np.int16), (2**31 - 1, np.int32), (2**40, np.int64)):
        data = rng.integers(-top, top, (6, 4), endpoint=True)
        data[0, 0], data[1, 0] = top, -top - 1
        ids = np.arange(6)
        row = K._packed([(ids, ids, data)], [0], 4).to_pylist()[0]
        assert len(row["vectors"]) == 24 * np.dtype(kind).itemsize
        back = K._parse(row)[2]
        assert back.tolist() == data.tolist()
        if top < 2**30:
            assert (sum(K.local_scores(back[:2], back)) == data[:2] @ data.T).all()


def test_cutoff_counts_a_vector_once_and_collects_little():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    v[7] = 3 * v[0]  # the best of every slice for the first query
    scores, own = K.local_scores(v[:20], v), np.zeros((20, 2000), bool)
    own[np.arange(20), np.arange(20)] = True
    bounds, least = K.gathered(scores, own, 5)
    exact = np.sort(np.where(own, K.NONE, v[:20] @ v.T), axis=1)[:, ::-1][:, :5]
    assert (bounds <= exact).all() and bounds[0, 0] == exact[0, 0] > bounds[0, 1]
    assert K.collected(scores, own, bounds[:, 4], least).mean() < 0.75
    found = {i: values.tolist() for i, _, values in K.resolved(scores, own, np.arange(2000), bounds[:, 4], least, 5)}
    assert found == dict(enumerate(exact.tolist()))


def test_fewer_candidates_than_k():
    v = np.array([[1, 2], [3, -4], [5, 6]])
    scores, own = K.local_scores(v[:1], v, 2), np.array([[True, False, False]])
    bounds, least = K.gathered(scores, own, 5)
    assert bounds.tolist() == [[17, -5, *[K.NONE] * 3]]
    assert [x.tolist() for _, *two in K.resolved(scores, own, np.arange(3), bounds[:, 4], least, 5) for x in two] == [[2, 1], [17, -5]]


def test_floor_lets_the_best_through():
    rng = np.random.default_rng(9)
    for n in (6, 100, 384, 2000, 2048):
        s = rng.integers(-50_000, 50_000, (30, n))
        s[3], s[4, : n // 2] = 7, 9
        floor = K._floor(s, 6)
        assert (floor[:, 0] <= np.sort(s, axis=1)[:, -6]).all()
        assert ((s >= floor).sum(axis=1)[5:] < 40).all()
