import collections
import math
import re

import regex
import xxhash

from marketlens.llm import quality as Q


def signed_and(parts, buckets):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed & buckets - 1


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    counts = collections.Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def grams(text, buckets):
    tokens = regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]+", text or "")
    ones = [signed_and([t], buckets) for t in tokens]
    return ones + [signed_and(tokens[i : i + 2], buckets) for i in range(len(tokens))]


def brute(rows, good, buckets=Q.BUCKETS):
    raw, target = collections.Counter(), collections.Counter()
    each = [grams(t, buckets) for _, t in rows]
    for (doc_id, _), g in zip(rows, each):
        raw.update(g)
        if doc_id in good:
            target.update(g)
    r, t = sum(raw.values()), sum(target.values())
    out = []
    for (doc_id, text), g in zip(rows, each):
        score = sum(math.log((target[b] + 1) / (t + buckets)) - math.log((raw[b] + 1) / (r + buckets)) for b in g) / len(g) if g and t else 0.0
        m = measures(text)
        out.append((doc_id, *m, not m[5] and score >= Q.THRESHOLD, score))
    return out


def compare(rows, want):
    def order(r):
        return tuple((x is not None, x or 0) for x in r[:7])

    got = sorted(([r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.score] for r in rows), key=order)
    want = sorted(want, key=order)
    assert [g[:8] for g in got] == [list(w[:8]) for w in want]
    assert all(math.isclose(g[8], w[8], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


def test_smallest_table(spark, folder, documents):
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1}
    rows = [(i, t) for i, t, _ in documents]
    got = Q.query(spark, folder).collect()
    compare(got, brute(rows, good))
    kept = {r.doc_id: r.kept for r in got}
    failed = {r.doc_id: r.base_failed for r in got}
    assert all(kept[r.doc_id] for r in labels if r.quality == 1 and not failed[r.doc_id])
    assert not any(kept[r.doc_id] for r in labels if r.quality == 0)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0), (7, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    compare(Q.judge(odd, labels).collect(), brute(rows, {1, 99}))
    compare(Q.judge(odd, labels.limit(0)).collect(), brute(rows, set()))
    assert Q.judge(nothing, labels).count() == 0


def test_repeated_words(spark):
    texts = ["a b c a b c a b c", "a a a a", "a b", "", "x y z q x y z", "a b a b a", "p q r s t p q r u v p q r"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_repeat_words for r in Q.with_measures(rows).collect()}
    assert got == {i: measures(t)[4] for i, t in enumerate(texts)}


def test_main_path_has_no_python(spark, folder):
    plan = Q.query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
