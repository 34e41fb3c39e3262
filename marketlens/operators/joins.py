"""Join helpers for large fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.operators.ordered import few_or_written

#: Rows of one key that one task may hold; keys with more are spread.
ROWS_PER_PART = 1_000_000


def frequent_keys(facts: DataFrame, on: Sequence[str], rows_per_part: int = ROWS_PER_PART) -> tuple[DataFrame, bool] | None:
    """Keys with more rows than one task may hold and ``_parts``, the tasks their rows are spread over.

    There are at most as many as the table has parts of that size. None where no key is
    frequent; the flag says whether they are few enough to be sent to all rows.
    """
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_part)
    parts = counts.select(*on, F.ceil(F.col("_rows") / rows_per_part).cast("int").alias("_parts"))
    found, few = few_or_written(parts.dropna(subset=list(on)), "frequent-keys")
    return None if few and found.isEmpty() else (found, few)


def salted_join(
    facts: DataFrame, groups: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner",
    condition: Column | None = None, rows_per_part: int = ROWS_PER_PART, counted: DataFrame | None = None,
) -> DataFrame:
    """Join of a fact table with a table of few rows per key, safe for very frequent keys.

    Keys are counted first (in ``counted``, a cheaper table with the same keys, if given).
    The rows of a frequent key are spread over parts, in proportion to their number, by a
    hash of the ``spread`` columns, and only the few rows that the other side has for such
    a key are repeated. Without frequent keys this is the plain join. The result always
    equals the plain join; no row is lost.
    """
    if condition is not None and how != "inner":
        raise ValueError("a condition is for inner joins only")
    found = frequent_keys(facts if counted is None else counted, on, rows_per_part)
    if found is None:
        joined = facts.join(groups, list(on), how)
    else:
        frequent = F.broadcast(found[0]) if found[1] else found[0]
        left = facts.join(frequent, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int"))
        right = groups.join(frequent, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        joined = left.drop("_parts").join(right.drop("_parts"), [*on, "_salt"], how).drop("_salt")
    return joined if condition is None else joined.filter(condition)


def matched_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts agree on both sides; each side is aggregated before the join."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_cnt"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_cnt"))
    return a.join(b, key).filter(F.col("left_cnt") == F.col("right_cnt"))
