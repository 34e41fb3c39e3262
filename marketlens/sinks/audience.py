"""Saving an audience and counting it in the same job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

# Fixed value: the columns of a saved audience.
AUDIENCE_SCHEMA = {
    "member_no": "string", "mobile": "string", "named": "string", "device_cid": "string", "device_type": "string", "score_tag_result": "int",
}


def fixed_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in AUDIENCE_SCHEMA.items()])


def save_audience(df: DataFrame, target: str) -> int:
    """Replace the table (or, for a path, the parquet files) by the audience; returns its row count."""
    seen = Observation("audience")
    rows = fixed_columns(df).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("overwrite")
    writer.parquet(target) if "/" in target else writer.saveAsTable(target)
    return seen.get["rows"]
