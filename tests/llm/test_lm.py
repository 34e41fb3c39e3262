import collections
import math
import zlib

import numpy as np

from marketlens.llm import lm as L


def words(text):
    return (text or "").encode().lower().split()


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def base(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            counts.update([*words(text), "end"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        tokens = [*words(text), "end"]
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((doc_id, held(doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, score))
    return out


def order(row):
    return tuple((x is not None, x if x is not None else 0) for x in row[:5])


def compare(frame, rows):
    got = sorted((tuple(r) for r in frame.collect()), key=order)
    want = sorted(base(rows), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g in {g[:5]: g for g in got}.values():
        assert any(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) for w in want if w[:5] == g[:5])
    return got


def test_smallest_table(spark, folder, documents, monkeypatch):
    rows = [(i, t) for i, t, _ in documents]
    plain = compare(L.query(spark, folder), rows)
    out = [g for g in plain if g[1]]
    assert sum(g[6] for g in out) > sum(g[5] for g in out)  # better than the plain model on texts it has not seen
    monkeypatch.setattr(L, "LISTED", 60)  # most counts come by the join
    for a, b in zip(plain, compare(L.query(spark, folder), rows)):
        assert math.isclose(a[6], b[6], rel_tol=1e-6)


def test_odd_rows(spark, odd, nothing):
    got = compare(L.score(odd), [(r.doc_id, r.text) for r in odd.collect()])
    assert all(math.isfinite(g[6]) and g[6] <= 0 for g in got)
    assert L.score(nothing).count() == 0
    compare(L.score(odd.filter("doc_id is null")), [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is None])  # nothing to learn from


def test_probabilities_are_normalised_and_learned():
    counts = np.zeros((L.CLASSES**2, L.CLASSES))
    counts[3 * L.CLASSES + 4, 5], counts[3 * L.CLASSES + 4, 6], counts[7 * L.CLASSES + 8, 9] = 900, 100, 1000
    table = L.train(counts).log_probabilities()
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert abs(10 ** table[3 * L.CLASSES + 4, 5] - 0.9) < 0.1 and 10 ** table[7 * L.CLASSES + 8, 9] > 0.85
