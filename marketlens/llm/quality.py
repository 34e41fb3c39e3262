"""Quality rules: importance weights of hashed n-grams, in DataFrame functions only.

A document's tokens (runs of letters, digits and ``_``, and runs of other signs) and its
pairs of neighbouring tokens are hashed to ``buckets`` buckets. Two multinomials are
counted over the buckets: one over all documents, one over trusted documents. The score
of a document is the mean over its n-grams of ``ln(trusted share / raw share)``, and
every document with a score of ``threshold`` or more is kept: there is no random draw.

The trusted documents are those that labels call good, at most ``trusted_limit`` of
them, taken in the order of a hash of their id; the limit is what bounds the broadcast
of ids. The raw side counts all documents. Both counts are one row per bucket.

Beside the score there are plain measures of the words (runs without white space), the
lines and the symbols of a text, with a rule on length and repetition.

Defined results: a null text counts as empty and fails the length rule, as every text
below 50 words does; an id that several rows or labels share is trusted if any of its
labels says so; a null id is not trusted; without trusted documents every score is 0, so
only the plain rule decides; columns of the input with the name of a result are
replaced. Windows of three words are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlens.tables import Tables

#: Characters that separate words, as a part of patterns.
BLANKS = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 1 << 14
#: Documents with a lower mean log ratio are rejected. Text like the trusted documents lies
#: near 0 or above; -0.4 means n-grams that are on average two thirds as likely there.
THRESHOLD = -0.4
TRUSTED_LIMIT = 50_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: str, name: str, body: str) -> str:
    """SQL text that computes ``value`` once and uses it by name, also inside other lambdas.

    Without it the optimizer may put the computation of a column inside a lambda, for
    instance when it pushes a filter down, and do it again for every element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def repeated_words(name: str) -> Column:
    """Words that lie in a three-word window found twice or more, from an array column of words."""
    windows = "transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))"
    placed = let("sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))", "s",
                 "sort_array(transform(filter(s, (a, j) -> a.x = get(s, j + 1).x OR a.x = get(s, j - 1).x), a -> a.i))")
    covered = f"aggregate({placed}, struct(0L AS n, -3 AS last), (c, p) -> struct(c.n + least(3, p - c.last) AS n, p AS last), c -> c.n)"
    counted = let(windows, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {covered} END")
    return F.expr(let(name, "w", f"CASE WHEN size(w) < 3 THEN 0L ELSE {counted} END"))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the plain measures and ``base_failed``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    first = docs.drop(*MEASURES, "base_failed").withColumns({"_words": words(body), "_lines": lines})
    return first.select(
        *[c for c in first.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words("_words").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"), F.lit(1))


def _bucket(*parts: str, buckets: int) -> str:
    return f"cast(xxhash64({', '.join(parts)}) & {buckets - 1} AS int)"


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``bucket, raw, target``: n-grams of all and of trusted documents in every bucket that has any."""
    flagged = docs.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_tokens")).join(F.broadcast(trusted), F.col("_key") == F.col("_trusted"), "left")
    ones, pairs = _bucket("x", buckets=buckets), _bucket("x", "get(k, i + 1)", buckets=buckets)
    grams = flagged.select(
        F.col("_trusted").isNotNull().cast("bigint").alias("_target"),
        F.explode(F.expr(let("_tokens", "k", f"concat(transform(k, x -> {ones}), transform(k, (x, i) -> {pairs}))"))).alias("bucket"),
    )
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = 1.0) -> DataFrame:
    """One row with the array of ``ln(trusted share / raw share)`` by bucket, smoothed by ``prior`` per bucket."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    rows = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "target", "raw"))).alias("rows"), F.sum("target").alias("t"), F.sum("raw").alias("r"))
    room = prior * buckets
    ratio = f"transform(rows, x -> CASE WHEN t = 0 THEN 0D ELSE ln((x.target + {prior}D) / (t + {room}D)) - ln((x.raw + {prior}D) / (r + {room}D)) END)"
    return rows.select(F.expr(ratio).alias("ratios"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT, key: str = "doc_id") -> DataFrame:
    good = labels.filter((F.col("quality") == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_trusted")).distinct()
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(limit)


def with_score(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``score``, the mean log ratio of the n-grams of each text; 0 for a text without any."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    ratios = log_ratios(bucket_counts(docs, trusted, buckets, text, key), buckets).scalar()
    with_tokens = docs.withColumns({"_tokens": tokens(F.col(text)), "_ratios": ratios})
    ones, pairs = _bucket("x", buckets=buckets), _bucket("x", "get(k, i + 1)", buckets=buckets)
    total = f"aggregate(transform(k, (x, i) -> get(_ratios, {ones}) + get(_ratios, {pairs})), 0D, (a, x) -> a + x)"
    mean = F.expr(let("_tokens", "k", f"CASE WHEN size(k) = 0 THEN 0D ELSE {total} / (2 * size(k)) END"))
    return with_tokens.withColumn("score", mean).drop("_tokens", "_ratios")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Adds the measures, ``base_failed``, ``score`` and ``kept`` to every document."""
    scored = with_measures(with_score(docs, trusted_ids(labels, limit), buckets))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def query(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    judged = judge(t.documents.select("doc_id", "text"), t.labels)
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", "score")
