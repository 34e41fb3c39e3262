"""Scores of a log-bilinear language model trained by noise-contrastive estimation.

Words are grouped in ``CLASSES`` classes: the most frequent words of the corpus have one
each, the others share classes by a hash of their ending, and the end of a text is a
class. The model predicts the class of a token from the classes of the two before it:
its score is the product of the sum of two context vectors with the class's vector, plus
a bias. It is trained to tell the corpus from noise drawn by class frequency; the
statistics it needs, how often each class follows each pair, are counted over the whole
corpus, so the noise term enters by its expectation and training is deterministic.
Probabilities are normalised over all classes by batched matrix products.

Within its class a word has the probability ``(c - d) / N`` with its corpus count c, the
class's tokens N, and a discount d from the words seen once and twice. What the discount
frees is the probability of an unseen word of that class, so the probabilities of all
seen words and the unseen words of each class sum to one.

Counts of the most frequent ``LISTED`` words (of at most ``LONGEST`` bytes) go to every
worker; the counts of all other words are joined, so every token gets its exact count.

Defined results: a null text counts as empty and consists of its end; a null id counts as
an empty text when rows are held out; repeated rows are scored each; with nothing to
learn from, the model is uniform over the classes and every word is unseen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables

CLASSES, OWN = 128, 47
ENDING = 3
LISTED, LONGEST = 500_000, 48
WIDTH, NOISE, ROUNDS, RATE = 24, 5, 200, 0.05
_FLUSH = 500_000


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z as a-z; ``bytes.split`` knows exactly the six separators."""
    return (text or "").encode().lower().split()


def ending_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-ENDING:]) % (CLASSES - 1 - OWN)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: counts over the texts that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_out(doc_id):
                    counts.update(words_of(text))
                    if len(counts) >= _FLUSH:
                        yield told()
                        counts.clear()
        if counts:
            yield told()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def class_counts(docs: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """How often each class (last axis) follows each pair of classes, over the texts that are learned from."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES**3, np.int64)
        known = dict(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_out(doc_id):
                    np.add.at(seen, _triples(_classes(words_of(text), known, shared.value)), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["triple", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "triple bigint, n bigint").groupBy("triple").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most CLASSES ** 3 rows
    out = np.zeros(CLASSES**3)
    out[table.column("triple").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(CLASSES**2, CLASSES)


def _classes(words: list[bytes], known: dict[bytes, int], own: dict[bytes, int]) -> np.ndarray:
    """Classes of the words, then the end; ``known`` remembers them."""
    get = known.get
    out = []
    for w in words:
        c = get(w)
        if c is None:
            if len(known) >= _FLUSH:
                known.clear()
                known.update(own)
            c = known[w] = ending_class(w)
        out.append(c)
    out.append(0)
    return np.array(out, np.int64)


def _triples(classes: np.ndarray) -> np.ndarray:
    """Numbers of (class two before, class before, class); a text is preceded by ends."""
    before = np.concatenate([[0, 0], classes])
    return (before[:-2] * CLASSES + before[1:-1]) * CLASSES + classes


class Model:
    def __init__(self, near: np.ndarray, far: np.ndarray, words: np.ndarray, bias: np.ndarray):
        self.near, self.far, self.words, self.bias = near, far, words, bias

    def log_probabilities(self, batch: int = 4096) -> np.ndarray:
        """log10 of the normalised probability of every class after every pair of classes."""
        out = np.empty((CLASSES**2, CLASSES), np.float32)
        for start in range(0, CLASSES**2, batch):
            pair = np.arange(start, min(start + batch, CLASSES**2))
            scores = (self.far[pair // CLASSES] + self.near[pair % CLASSES]) @ self.words.T + self.bias
            scores -= scores.max(axis=1, keepdims=True)
            scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
            out[pair] = scores / np.log(10)
        return out


def train(counts: np.ndarray, width: int = WIDTH, noise: int = NOISE, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Noise-contrastive estimation with ``noise`` expected noise classes for every token."""
    total = counts.sum()
    if not total:
        return Model(np.zeros((CLASSES, width)), np.zeros((CLASSES, width)), np.zeros((CLASSES, width)), np.zeros(CLASSES))
    rows = np.flatnonzero(counts.sum(axis=1))
    seen = (counts[rows] / total).astype(np.float32)
    share = counts.sum(axis=0) + 1.0
    share = (share / share.sum()).astype(np.float32)
    drawn = noise * seen.sum(axis=1, keepdims=True) * share
    offset = np.log(noise * share)
    far, near = rows // CLASSES, rows % CLASSES
    random = np.random.default_rng(0)
    parts = [random.normal(0, 0.1, (CLASSES, width)).astype(np.float32) for _ in range(3)] + [np.log(share)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    far_rows, near_rows = np.zeros((CLASSES, len(rows)), np.float32), np.zeros((CLASSES, len(rows)), np.float32)
    far_rows[far, np.arange(len(rows))] = near_rows[near, np.arange(len(rows))] = 1
    for step in range(1, rounds + 1):
        context = parts[1][far] + parts[0][near]
        real = 1 / (1 + np.exp(offset - context @ parts[2].T - parts[3]))
        slope = seen * (1 - real) - drawn * real
        by_context = slope @ parts[2]
        slopes = [near_rows @ by_context, far_rows @ by_context, slope.T @ context, slope.sum(axis=0)]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            parts[i] += rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    return Model(*parts)


class Corpus:
    """What is counted over the texts that are learned from."""

    def __init__(self, docs: DataFrame):
        self.counts = scratch_table(word_counts(docs), "word-counts")
        ids = docs.select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).alias("learned"))
        self.texts = ids.filter("learned").count()
        listed = self._frequent().toArrow()
        self.listed = dict(zip(listed.column("word").to_pylist(), listed.column("c").to_pylist()))
        self.own = {w: 1 + i for i, w in enumerate(sorted(self.listed, key=lambda w: (-self.listed[w], w))[:OWN])}
        kind = F.lit(1 + OWN) + F.crc32(F.substring("word", -ENDING, ENDING)) % (CLASSES - 1 - OWN)
        for w, c in self.own.items():
            kind = F.when(F.col("word") == F.lit(bytearray(w)), c).otherwise(kind)
        once, twice = F.sum((F.col("c") == 1).cast("bigint")), F.sum((F.col("c") == 2).cast("bigint"))
        rows = self.counts.groupBy(kind.cast("int").alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), once.alias("once"), twice.alias("twice")).collect()
        self.tokens_of, self.words_of = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in rows:
            self.tokens_of[r["class"]], self.words_of[r["class"]] = r["n"], r["v"]
        single, double = sum(r["once"] for r in rows), sum(r["twice"] for r in rows)
        self.discount = min(0.9, max(0.1, single / (single + 2 * double))) if single else 0.5
        self.tokens = int(self.tokens_of.sum()) + self.texts
        self.words = int(self.words_of.sum()) + (self.texts > 0)

    def _frequent(self) -> DataFrame:
        """At most LISTED words: those with counts above a limit taken from a histogram of counts, so nothing is sorted as a whole."""
        step = F.floor(64 * F.log2("c")).cast("int")
        short = self.counts.filter(F.octet_length("word") <= LONGEST).withColumn("step", step)
        taken, least = 0, None
        for r in sorted(short.groupBy("step").count().collect(), reverse=True):  # a few thousand steps at most
            taken += r["count"]
            if taken > LISTED:
                break
            least = r["step"]
        return short.filter(F.lit(False) if least is None else F.col("step") >= least).select("word", "c")

    def base(self, c):
        """log10 of the plain probability of a token with count c."""
        return np.log10((np.asarray(c) + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def unseen(self) -> np.ndarray:
        """log10 of the probability of an unseen word within each class."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.tokens_of > 0, np.log10(np.maximum(self.discount * self.words_of, 1e-300) / np.maximum(self.tokens_of, 1)), 0.0)


_worker: dict[int, tuple] = {}


def _loaded(shared) -> tuple:
    """Tables of this worker: places, classes and summands of the listed words, and the class probabilities."""
    key, listed, own, base, tokens_of, discount, model = shared.value
    if key not in _worker:
        _worker.clear()
        place = {w: i for i, w in enumerate(listed)}
        classes = np.array([own.get(w) or ending_class(w) for w in listed], np.int64)
        counts = np.array(list(listed.values()), float)
        within = np.log10((counts - discount) / tokens_of[classes]) if len(counts) else counts
        for w, c in own.items():
            within[place[w]] = np.log10((listed[w] - discount) / tokens_of[c])
        _worker[key] = (place, classes, base, within, model.log_probabilities())
    return _worker[key]


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    corpus = Corpus(docs)
    model = train(class_counts(docs, corpus.own))
    key = zlib.crc32(repr((corpus.tokens, corpus.words, docs.sparkSession.sparkContext.applicationId, id(corpus))).encode())
    listed_base = corpus.base(list(corpus.listed.values()))
    shared = docs.sparkSession.sparkContext.broadcast((key, corpus.listed, corpus.own, listed_base, corpus.tokens_of, corpus.discount, model))
    end_base, end_known = float(corpus.base(corpus.texts)), int(corpus.texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, classes, base, within, table = _loaded(shared)
        table = table.reshape(-1)
        get = place.get
        names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())]))]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some, rows = batch.slice(start, 1000), []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    words = words_of(text)
                    at = np.array([get(w, -1) for w in words], np.int64)
                    other = np.flatnonzero(at < 0)
                    kind = np.zeros(len(words) + 1, np.int64)
                    if len(words):
                        if len(place):
                            kind[:-1] = classes[at]
                        kind[other] = [ending_class(words[i]) for i in other]
                    rare = Counter(words[i] for i in other)
                    listed = at[at >= 0]
                    rows.append((
                        doc_id, held_out(doc_id), len(words) + 1, len(listed) + end_known, float(base[listed].sum()) + end_base,
                        float(table[_triples(kind)].sum(dtype=np.float64)) + float(within[listed].sum()), [{"word": w, "n": n, "class": ending_class(w)} for w, n in rare.items()],
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, rare array<struct<word:binary,n:bigint,class:int>>"
    parts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
    parts = scratch_table(parts.withColumn("row", F.monotonically_increasing_id()), "scored")

    def at_class(values: np.ndarray):
        return F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("class"))

    rare = parts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n", "x.class")
    counted = rare.join(corpus.counts, "word", "left")
    within = F.when(F.col("c").isNotNull(), F.log10((F.col("c") - corpus.discount) / at_class(corpus.tokens_of))).otherwise(at_class(corpus.unseen()))
    plain = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / (corpus.tokens + 0.1 * (corpus.words + 1)))
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * plain).alias("b"), F.sum(F.col("n") * within).alias("s")
    )
    done = parts.drop("rare").join(sums, "row", "left")
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return score(Tables(spark, folder).documents)
