import collections
import random

import pytest

from marketlens.llm import jaccard as J, signature_tree as S
from marketlens.llm.graphs import components


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, k=4):
    w = words_of(text)
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """rows (doc_id, text) -> list of (doc_id, n_shingles, component_id) in row order, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def as_counter(rows):
    return collections.Counter(tuple(r) for r in rows)


def near_copies(seed):
    """Families whose members differ by a few words, so that similarities lie on both sides of the limit."""
    rng, rows = random.Random(seed), []
    for family in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(12):
        rows.append((len(rows) + 1, passage + " " + " ".join(f"own{i}_{j}" for j in range(i * 2))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_near_copies(spark, chunk, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "OFTEN", 2)
    rows = near_copies(chunk)
    got = J.link(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert as_counter(got) == as_counter(brute(rows))


def test_smallest_table(spark, folder, documents):
    assert as_counter(J.query(spark, folder).collect()) == as_counter(brute([(i, t) for i, t, _ in documents]))


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = J.link(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert as_counter(got) == as_counter(brute(rows))
    assert J.link(nothing).count() == 0
    kept = J.one_of_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i or 0)) == [1, 4, 5, 6, 7, 8, 10, 11, None]


def test_tree_finds_all_groups_and_bounds_are_safe():
    rng = random.Random(1)
    for _ in range(40):
        sets = []
        for _ in range(rng.randint(1, 8)):
            base = {rng.randrange(10**9) for _ in range(rng.randint(1, 150))}
            for _ in range(rng.randint(1, 12)):
                sets.append({x if rng.random() > 0.06 else rng.randrange(10**9) for x in base})

        def bitmap(s):
            width, out = S.width_of(len(s)), 0
            for x in s:
                out |= 1 << (x * 2654435761 >> 7) % width
            return out

        def alike(i, j):
            return 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])

        search = S.connect([len(s) for s in sets], [bitmap(s) for s in sets], 85, alike)
        plain = S.Forest(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if alike(i, j):
                    plain.join(i, j)
        assert [search.forest.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]


def test_near_copies_need_few_comparisons():
    calls = []
    sets = [set(range(300)) | {1000 + i} for i in range(2000)]
    bitmaps = []
    for s in sets:
        bits = 0
        for x in s:
            bits |= 1 << x * 2654435761 % S.width_of(len(s))
        bitmaps.append(bits)
    S.connect([301] * 2000, bitmaps, 85, lambda i, j: calls.append(1) or True)
    assert len(calls) == 1999


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in up if any(a != b and i in (a, b) for a, b in edges)}
