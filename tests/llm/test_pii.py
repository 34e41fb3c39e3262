import hashlib
import random
import re

from marketlens.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    found = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], P.KINDS.index(s[2])))


def test_base_spans():
    random.seed(3)
    for letters in ("ab1.@+-5 2", "0123456789 -+().", "4111 1111-@a.b"):
        for _ in range(4000):
            text = "".join(random.choice(letters) for _ in range(random.randint(1, 40)))
            assert P.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for piece in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@a" * 150_000, "+1" * 150_000, "a.b@" * 80_000):
        P.base_spans(piece)


def brute_best(bounds, segments, weights):
    """Best path by trying all, over the bounded segments."""
    best = {len(bounds) - 1: (0.0, ())}
    for i in range(len(bounds) - 2, -1, -1):
        options = [best[i + 1]]
        for a, b, on in segments:
            if a == i:
                scores = weights[:, on].sum(axis=1) - P.MARGIN
                for kind, s in enumerate(scores):
                    if s > 0:
                        options.append((s + best[b][0], ((bounds[a], bounds[b], P.KINDS[kind]), *best[b][1])))
        best[i] = max(options, key=lambda x: x[0])
    return best[0]


def test_field(spark, folder, documents, odd, nothing):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights = P.train(docs)
    for _, text, _ in documents:
        for start, end in P.windows(text):
            bounds, segments = P.candidates(text, start, end)
            value, _ = brute_best(bounds, segments, weights)
            chosen = [s for s in P.field_spans(text, weights) if start <= s[0] < end]
            scored = sum(weights[P.KINDS.index(k), P.features(text, s, e)].sum() - P.MARGIN for s, e, k in chosen)
            assert abs(scored - value) < 1e-6
    clean = "no personal data here, only words 12 and 2024-01-02 10:30"
    assert P.all_spans(clean, weights) == [] and P.all_spans(None, weights) == []
    rows = {r.doc_id: r for r in P.query(spark, folder).collect()}
    hits = 0
    for doc_id, text, _ in documents:
        base, row = plain(text), rows[doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[2] == k for s in base) for k in P.KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for s, e, k in base) <= set(filter(None, row.spans.split(",")))
        hits += len(base)
    assert hits
    found = P.find(odd, weights)
    assert found.count() == odd.count()
    assert P.find(nothing, weights).count() == 0 and not P.train(nothing).any()
    cleaned = P.redact(odd, weights)
    assert cleaned.columns == odd.columns and [r.text for r in cleaned.collect() if r.doc_id == 10] == ["<email> <phone> <|endoftext|> ok"]


def test_training_learns_the_patterns_and_national_phones():
    samples = [f"word {'abc'[i % 3]} +1 (90{i % 10}) 555-1{i:03d} text 10.20.3{i % 10}.4{i % 9} mail{i}@host{i}.example.com end 453201511283036{i % 10}" for i in range(60)]
    weights = P.fit(P.labelled_windows(samples))
    got = P.field_spans("call (912) 555-0199 or mail me@some.example.org from 10.2.3.4 now", weights)
    assert [k for _, _, k in got] == ["phone", "email", "ip"]


def test_training_windows_of_each_kind_and_phones_of_other_forms(spark):
    """Phones of another written form among far more dates, prices and page numbers."""
    rng = random.Random(5)
    fill = " ".join(["word"] * 40)
    rows = [f"{fill} paid {rng.randint(10, 9999)}.{rng.randint(0, 99):02d} on 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} page {i} {fill}" for i in range(3000)]
    rows += [f"{fill} ring +49 {rng.randint(30, 999)} {rng.randint(1000000, 99999999)} or not {i} {fill}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string").repartition(8)
    chosen = P.training_windows(docs)
    phones = [x for x in chosen if any(k == "phone" for _, _, k in P.base_spans(x))]
    assert len(phones) >= 40 and len(chosen) <= P.SAMPLE and any(not P.base_spans(x) for x in chosen)
    weights = P.fit(P.labelled_windows(chosen))
    for number in ("(912) 555-0199", "912-555-0199", "030 12345678", "06 12 34 56 78"):
        text = f"please ring {number} now"
        assert P.field_spans(text, weights) == [(12, 12 + len(number), "phone")], number
    for text in ("on 2024-01-02 10:30 and 01.02.2024 03.04.2024", "cost 1 234 567 890 in total, 1234567890 units", "years 1998-2004 and pages 112 113 114 115"):
        assert P.field_spans(text, weights) == [], text
