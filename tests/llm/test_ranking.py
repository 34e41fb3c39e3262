import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from marketlens.llm import k2_treap as T, ranking as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


def brute(docs, items, k):
    """Every item's best documents from all scores."""
    held = [(i, Counter(found), len(found)) for i, t in docs if (found := plainly(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(plainly(text))}
        scores = []
        for i, c, size in held:
            m = 50 + (50 * size * n) // total
            if (s := sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)) > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def test_smallest_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(R.query(spark, folder)) == brute(docs, items, 50)


ITEMS = [(1, "the fox, the house"), (1, "the fox, the house"), (2, None), (3, " ,;"), (4, "unheard-of"), (None, "WORD1 word2 one"), (5, "日本語 naïve café x"), (6, "river river bank"), (7, " ".join(f"word{i}" for i in range(3000)))]


@pytest.mark.parametrize("batch", [100_000, 700])
def test_odd_rows(spark, odd, batch, monkeypatch):
    monkeypatch.setattr(R, "BATCH_TERMS", batch)
    monkeypatch.setattr(R, "BLOCK_DOCUMENTS", 3)
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = spark.createDataFrame([(*x, "y", 1) for x in ITEMS], "item_id bigint, text string, term string, rank int")
    # equal rows of a document and of an item may stand in any order, their results are equal
    assert found(R.search(odd, items, 3)) == brute(docs, ITEMS, 3)


def test_empty_tables(spark, nothing, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert R.search(nothing, items).count() == 0 and R.search(odd, items.limit(0)).count() == 0
    assert R.search(odd.filter("doc_id = 5"), items).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_terms(text):
    assert [t.decode() for t in R.terms(text)] == plainly(text)


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 70), st.integers(0, 40)), st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.dictionaries(st.integers(0, 70), st.integers(1, 30_000), min_size=1, max_size=8), st.integers(1, 9), st.integers(1, 5))
def test_search_in_a_treap(cells, asked, k, width):
    kept, T.WIDTH = T.WIDTH, width
    try:
        rows, columns = (np.array(x) for x in zip(*cells))
        treap = T.Treap(*T.build(rows, columns, np.array(list(cells.values()))))
        got = treap.best(np.array(list(asked)), np.array(list(asked.values())), k)
    finally:
        T.WIDTH = kept
    sums = Counter()
    for (r, c), v in cells.items():
        sums[c] += v * asked.get(r, 0)
    ordered = sorted((s for s in sums.values() if s > 0), reverse=True)
    least = ordered[min(k, len(ordered)) - 1] if ordered else 1
    assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted((c, s) for c, s in sums.items() if s >= max(1, least))


def test_search_leaves_most_columns_out():
    rng = np.random.default_rng(1)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, 4000, 60_000), rng.integers(0, 4000, 60_000), rng.integers(200_000, 800_000, 60_000))}
    rows, columns = (np.array(x) for x in zip(*cells))
    treap, looked = T.Treap(*T.build(rows, columns, np.array(list(cells.values())))), []
    treap.best(rng.integers(0, 4000, 20), np.full(20, 1000), 5, looked=looked)
    assert sum(looked) < 1500  # of 8,191 ranges
