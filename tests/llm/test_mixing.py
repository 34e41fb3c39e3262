import hashlib
import math
import re
from collections import defaultdict

from marketlens.llm import mixing as M


def brute(rows):
    """rows (doc_id, text, source) -> list of (doc_id, size, source_size, target, taken), from a plain sort."""
    by_source, done = defaultdict(list), []
    for doc_id, text, source in rows:
        text = text or ""
        size, symbols = len(re.findall(r"[^\x20\x09-\x0D]+", text)), sum(c in M.SYMBOLS for c in text)
        u = (int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{text}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        by_source[source].append((-math.log(u) / ((1.0 + size) / (1.0 + size + symbols)), (doc_id is not None, doc_id or 0), size, doc_id))
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(r[2] for r in by_source[s]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (budget - 2.0 * sum(sizes[s] for s in full)) / rest if rest else 0
        above = {s for s in names if weight[s] * level > 2.0 * sizes[s]} | full
        if above == full:
            break
        full = above
    for s in names:
        target = 2.0 * sizes[s] if s in full else weight[s] * level
        epochs = math.floor(target / sizes[s]) if sizes[s] else 0
        left, upto, cut = target - epochs * sizes[s], 0, None
        rows_of = sorted(by_source[s])
        groups = defaultdict(int)
        for r in rows_of:
            groups[r[:3]] += r[2]
        for key, total in groups.items():
            if upto + total <= left or upto <= left and upto + total - left <= left - upto:
                cut = key
            upto += total
        done += [(r[3], r[2], sizes[s], target, (epochs + (cut is not None and r[:3] <= cut)) * r[2]) for r in rows_of]
    return done


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def compare(frame, rows):
    got = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in frame.collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, want))
    assert all(g[4] <= 2 * g[1] for g in got)


def test_smallest_table(spark, folder, documents):
    compare(M.query(spark, folder), documents)


def test_odd_rows(spark, odd, nothing):
    compare(M.mix(odd), [(r.doc_id, r.text, r.source) for r in odd.collect()])
    assert M.mix(nothing).count() == 0
    mixed = M.mixed_documents(odd)
    assert mixed.columns == odd.columns
    counts = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    copies = defaultdict(int)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in M.mix(odd).collect():
        copies[r.doc_id] += r.copies
    for doc_id, seen in texts.items():
        assert sum(counts.get((doc_id, t), 0) for t in seen) == copies[doc_id]
