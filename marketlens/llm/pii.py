"""Personal data: plain patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole segments. A segment is a run of tokens (digit runs, letter runs,
single other signs) of at most ``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters; its
features look at the span as a whole: how many digits, the check digit, dotted groups,
the shape of the grouping, the characters just outside. Tokens outside entities are
segments of their own with score 0. Weights are fitted here by maximum likelihood (the
partition sum and the expected features come from the forward and backward sums over
segments), and decoding is the same recursion with the maximum, so boundaries and types
are chosen together.

Every entity holds a digit or ``@``, so the recursion runs only near those characters:
elsewhere all segments are single tokens of score 0 and the sum falls apart.

Training text is a bounded sample of all documents: at most ``SAMPLE`` windows around
digits and ``@``, in equal parts those with the smallest hash among the windows that hold
a span of each kind and among those that hold none, so no kind is missed where other
digits are common. Their spans by the plain patterns are the labels; the digits of every
phone number, in whatever form it is written, are learned again without ``+`` and country
code in several national groupings, and as dates, plain numbers and amounts, which the
field leaves alone. Decoding covers whole texts.

Defined results: a null text counts as empty and has no spans; positions are code points,
the end is exclusive; spans of the field that touch a span of the patterns are dropped;
without any training window the field adds nothing; rows, repeated rows and other
columns are kept, ``spans`` is replaced if there is one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS = 24, 80
SAMPLE = 600
#: A span of the field needs this log-odds against leaving its tokens outside.
MARGIN = 2.0

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
_ANCHOR = re.compile(r"[0-9@]")
_WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WHOLE_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}")
_CARD_SHAPE = re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5}")
_DATE = re.compile(r"[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}(?![0-9])|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9])")
_THOUSANDS = re.compile(r"[1-9][0-9]{0,2}(?:[ .][0-9]{3})+")
_LOOSE_SHAPE = re.compile(r"(?:\(0?[0-9]{2,4}\)|0[0-9]{1,4})[ ./-]?[0-9]{2,8}(?:[ .-][0-9]{2,5}){0,4}")
_NUMBERS = re.compile(r"[0-9 ()./+-]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Check digit: every second digit from the right is doubled and its digits are added."""
    doubled = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(doubled[v] for v in values[1::2])) % 10 == 0


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, by start, then kind."""
    found: list[Span] = []
    if not _ANCHOR.search(text):
        return found
    free = 0
    for m in _AT.finditer(text):  # the local part is read leftwards from the sign, so long runs are read once
        start = m.start()
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, m.start())
    for m in _IP.finditer(text):
        if all(map(_at_most_255, m.group().split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def windows(text: str, around: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Stretches of the text near digits and ``@``, widened to token ends."""
    start = end = -1
    for m in _ANCHOR.finditer(text):
        if start >= 0 and m.start() - around <= end:
            end = m.end() + around
            continue
        if start >= 0:
            yield _widened(text, start, end)
        start, end = max(0, m.start() - around), m.end() + around
    if start >= 0:
        yield _widened(text, start, end)


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    end = min(end, len(text))
    while start > 0 and text[start - 1].isalnum() and text[start].isalnum():
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    return start, end


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the whole-span features that hold."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    numeric = bool(_NUMBERS.fullmatch(span))
    ip = bool(_WHOLE_IP.fullmatch(span)) and all(map(_at_most_255, span.split(".")))
    holds = (
        True,
        span.count("@") == 1,
        bool(_WHOLE_EMAIL.fullmatch(span)),
        ip,
        span[0] == "+",
        numeric and 10 <= n <= 15,
        numeric and 14 <= n <= 19,
        numeric and 14 <= n <= 19 and luhn(digits),
        bool(_PHONE_SHAPE.fullmatch(span)),
        bool(_CARD_SHAPE.fullmatch(span)),
        numeric,
        not numeric and "@" not in span and not ip,
        before.isalnum(),
        after.isalnum(),
        bool(before) and before in "@.+-_%(",
        bool(after) and after in "@_-%)" or after == "." and text[end + 1 : end + 2].isalnum(),
        span.count("(") != span.count(")"),
        not (span[0].isalnum() or span[0] in "+(" and len(span) > 1) or not span[-1].isalnum(),
        "@" not in span and not ip and n < 10,
        n > 19,
        before == " " and text[start - 2 : start - 1].isdigit(),
        after == " " and text[end + 1 : end + 2].isdigit(),
        bool(_DATE.match(span)),
        span.isdigit(),
        bool(_THOUSANDS.fullmatch(span)),
        span[0] in "0(",
        bool(_LOOSE_SHAPE.fullmatch(span)),
    )
    return [i for i, x in enumerate(holds) if x]


N_FEATURES = 27


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token bounds of a window, and its segments ``(first token, end token, features)``.

    Only segments that some type can take are listed: with ``@``, or with three dots or
    at least eight digits.
    """
    bounds = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
    segments = []
    for i in range(len(bounds) - 1):
        head = text[bounds[i]]
        if not (head.isalnum() or head in "+(._%-"):
            continue
        digits = dots = 0
        at = False
        for j in range(i + 1, min(len(bounds), i + MAX_TOKENS + 1)):
            token = text[bounds[j - 1] : bounds[j]]
            if bounds[j] - bounds[i] > MAX_CHARS or token == "\n":
                break
            digits += len(token) if token[0] in "0123456789" else 0
            dots += token == "."
            at |= token == "@"
            if token[0].isalnum() and (at or digits >= 8 or dots >= 3 and digits >= 4):
                segments.append((i, j, features(text, bounds[i], bounds[j])))
    return bounds, segments


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(labelled: list[tuple[str, list[Span]]], rounds: int = 50, rate: float = 0.5, prior: float = 0.01) -> np.ndarray:
    """Weights (kind, feature) of the highest penalised likelihood, by adaptive gradient steps."""
    weights, seen = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    prepared = []
    for text, spans in labelled:
        bounds, segments = candidates(text, 0, len(text))
        place = {b: i for i, b in enumerate(bounds)}
        gold = {(place[s], place[e]): KINDS.index(k) for s, e, k in spans if s in place and e in place}
        if segments:
            design = np.zeros((len(segments), N_FEATURES))
            for row, (_, _, on) in enumerate(segments):
                design[row, on] = 1
            truth = np.zeros((len(segments), len(KINDS)))
            for row, (i, j, _) in enumerate(segments):
                if (i, j) in gold:
                    truth[row, gold[i, j]] = 1
            prepared.append((len(bounds) - 1, [(i, j) for i, j, _ in segments], design, truth))
    for _ in range(rounds):
        slope = -prior * weights
        for n, segments, design, truth in prepared:
            scores = design @ weights.T
            slope += (truth - _expected(n, segments, scores)).T @ design
        slope /= max(1, len(prepared))
        seen += slope**2
        weights += rate * slope / np.sqrt(seen)
    return weights


def _expected(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of every (segment, kind), by the forward and backward sums."""
    top = scores.max(axis=1)
    total = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for row, (i, j) in enumerate(segments):
        ending[j].append(row)
        starting[i].append(row)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = forward[j - 1] if not ending[j] else _log_sum([forward[j - 1], *(forward[segments[r][0]] + total[r] for r in ending[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = backward[i + 1] if not starting[i] else _log_sum([backward[i + 1], *(backward[segments[r][1]] + total[r] for r in starting[i])])
    outside = np.array([forward[i] + backward[j] for i, j in segments]) - forward[n]
    return np.exp(np.minimum(outside[:, None] + scores, 0))


def field_spans(text: str, weights: np.ndarray) -> list[Span]:
    """Spans on the best path of segments of the whole text."""
    found: list[Span] = []
    for start, end in windows(text):
        bounds, segments = candidates(text, start, end)
        ending: dict[int, list[tuple[int, float, int]]] = {}
        for i, j, on in segments:
            scores = weights[:, on].sum(axis=1)
            kind = int(scores.argmax())
            if scores[kind] > MARGIN:
                ending.setdefault(j, []).append((i, float(scores[kind]) - MARGIN, kind))
        if not ending:
            continue
        best, step = [0.0], [None]
        for j in range(1, len(bounds)):
            value, back = best[-1], None
            for i, score, kind in ending.get(j, ()):
                if best[i] + score > value:
                    value, back = best[i] + score, (i, kind)
            best.append(value)
            step.append(back)
        j, path = len(bounds) - 1, []
        while j:
            if step[j]:
                i, kind = step[j]
                path.append((bounds[i], bounds[j], KINDS[kind]))
                j = i
            else:
                j -= 1
        found += path[::-1]
    return found


def all_spans(text: str | None, weights: np.ndarray) -> list[tuple[int, int, str, bool]]:
    """Spans of the patterns (marked) and those the field adds, by start, then kind."""
    if not text or not _ANCHOR.search(text):
        return []
    base = base_spans(text)
    taken = sorted((s, e) for s, e, _ in base)
    added, at, reach = [], 0, -1
    for s, e, kind in field_spans(text, weights):
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s and (at == 0 or taken[at - 1][0] < s or taken[at - 1][1] <= s):
            added.append((s, e, kind, False))
    spans = [(*s, True) for s in base] + added
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPAN = "array<struct<start:bigint,end:bigint,kind:string,base:boolean>>"


def training_windows(docs: DataFrame, limit: int = SAMPLE, text: str = "text") -> list[str]:
    """At most ``limit`` different windows of all documents: those with the smallest hash for each kind, and of those without any."""
    share = max(1, limit // (len(KINDS) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, int]] = [{} for _ in range(len(KINDS) + 1)]
        highest = [1 << 64] * len(held)  # hashes from here on can't be among the smallest
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for s, e in windows(x):
                    window = x[s:e]
                    h = xxhash.xxh64_intdigest(window.encode(errors="surrogatepass"))
                    if e - s > 6 * MAX_CHARS or h >= max(highest):
                        continue
                    for k in {KINDS.index(kind) for _, _, kind in base_spans(window)} or {len(KINDS)}:
                        if h < highest[k]:
                            held[k][window] = h
                            if len(held[k]) >= 4 * share:
                                held[k] = dict(sorted(held[k].items(), key=lambda o: (o[1], o[0]))[:share])
                                highest[k] = max(held[k].values()) + 1
        rows = [(k, h - (1 << 63), w) for k, some in enumerate(held) for w, h in sorted(some.items(), key=lambda o: (o[1], o[0]))[:share]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["kind", "hash", "window"])

    some = docs.filter(F.col(text).rlike("[0-9@]")).select(text).mapInArrow(run, "kind int, hash bigint, window string")
    # at most `share` rows a kind and task are left
    least = some.groupBy("kind", "hash", "window").agg(F.lit(1).alias("_one")).drop("_one")
    least = scratch_table(least, "training-windows")
    chosen = [r.window for k in range(len(KINDS) + 1) for r in least.filter(F.col("kind") == k).orderBy("hash", "window").limit(share).collect()]
    return list(dict.fromkeys(chosen))


_DIGITS = re.compile(r"[0-9]+")
#: Sizes of the groups of a national number, after its leading 0 if it has one; the last takes the other digits.
_HOME = (("({}) {}-{}", 3, 3), ("{}-{}-{}", 3, 3), ("{}.{}.{}", 3, 3), ("{} {} {}", 3, 3), ("0{} {}", 3), ("0{}/{}", 2), ("0{} {} {} {} {}", 1, 2, 2, 2), ("({}) {} {}", 2, 4), ("0{}-{}-{}", 2, 4))
_NO_PHONE = ("2{0}-1{1}-0{2} 1{1}:3{2}", "0{1}.0{2}.2{0} 1{1}.0{2}.2{0}", "{3}", "{4}")


def national(phone: str) -> tuple[str, str]:
    """Digits of a phone number with ``+`` after its country code, and how they are written there."""
    digits = "".join(_DIGITS.findall(phone))
    first = _DIGITS.search(phone).group()
    code = len(first) if len(first) <= 3 and len(digits) - len(first) >= 7 else min(3, max(1, len(digits) - 10))
    at = left = 0
    while left < code:
        left += phone[at].isdigit()
        at += 1
    return digits[code:], phone[at:].lstrip(" .-)")


def at_home(digits: str, form: tuple) -> str:
    """The digits in a national form."""
    groups, at = [], 0
    for size in form[1:]:
        groups.append(digits[at : at + size])
        at += size
    return form[0].format(*groups, digits[at:])


def no_phone(digits: str, form: str) -> str:
    """The digits as a date with time, a plain number or an amount with groups of thousands."""
    amount = re.sub(r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " ", digits.lstrip("0") or "0")
    return form.format(digits[:3], digits[3], digits[-1], digits, amount)


def _rewritten(text: str, written: list[tuple[int, int, str]]) -> tuple[str, list[Span]]:
    """The text with spans replaced, and where the new spans are."""
    out, at, size, spans = [], 0, 0, []
    for start, end, new in written:
        if start < at:
            continue
        out += [text[at:start], new]
        size += start - at
        spans.append((size, size + len(new), "phone"))
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


def labelled_windows(samples: list[str]) -> list[tuple[str, list[Span]]]:
    """Windows with the pattern spans as labels; phones also in national forms, and as dates, numbers and amounts, which are no phones."""
    labelled = [(x, base_spans(x)) for x in samples]
    turn = 0
    for x, spans in list(labelled):
        phones = [(s, e, *national(x[s:e])) for s, e, kind in spans if kind == "phone"]
        if not phones:
            continue
        # as written after the country code, the most common form, and one of the others in turn
        other = _HOME[1 + turn % (len(_HOME) - 1)]
        for write in (lambda d, own: own, lambda d, own: at_home(d, _HOME[0]), lambda d, own: at_home(d, other)):
            changed, new = _rewritten(x, [(s, e, write(d, own)) for s, e, d, own in phones])
            base = base_spans(changed)
            labelled.append((changed, base + [n for n in new if not changed[n[0] : n[1]].isdigit() and all(e <= n[0] or n[1] <= s for s, e, _ in base)]))
        for form in _NO_PHONE:
            changed, _ = _rewritten(x, [(s, e, no_phone(d, form)) for s, e, d, _ in phones])
            labelled.append((changed, base_spans(changed)))
        turn += 1
    return labelled


def train(docs: DataFrame, limit: int = SAMPLE, text: str = "text") -> np.ndarray:
    return fit(labelled_windows(training_windows(docs, limit, text)))


def find(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Adds ``spans``: start, end (exclusive), kind, and whether the plain patterns found it."""
    kept = [f for f in docs.schema.fields if f.name != "spans"]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("spans", T._parse_datatype_string(SPAN))])
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind", "base"), s)) for s in all_spans(x, weights)] for x in batch.column(batch.schema.names.index(text)).to_pylist()]
            columns = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, shape)], names=[*names, "spans"])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one."""
    names = docs.columns

    def cleaned(x: str | None) -> str | None:
        spans = all_spans(x, weights)
        if not spans:
            return x
        out, at = [], 0
        for start, end, kind, _ in spans:
            if start >= at:
                out += [x[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, x[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index(text)
            yield batch.set_column(place, text, pa.array(map(cleaned, batch.column(place).to_pylist()), pa.string()))

    return docs.select(*names).mapInArrow(run, docs.schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents.select("doc_id", "text")
    found = find(docs, train(docs))
    line = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.expr(line.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(line.format("spans")).alias("spans"),
    )
