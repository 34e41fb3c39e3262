"""Hourly live totals as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.operators.scratch import shared_folder


def hourly_totals(events: DataFrame, at: str = "at", amount: str = "amount", delay: str = "1 hour") -> DataFrame:
    """Count and sum per hour; rows later than ``delay`` behind the newest are dropped.

    Works on a stream (append mode: an hour appears once the watermark passed its end)
    and on a plain DataFrame.
    """
    return (
        events.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
        .select(F.col("w.start").alias("hour"), "n", "amount")
    )


def run_available(totals: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> None:
    """Process what is there, append finished hours to ``path`` and stop. A restart goes on from the checkpoint.

    Waits as long as it takes, or ``timeout`` seconds where one is given.
    """
    query = (
        totals.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not finish in time")


def live_hours(spark: SparkSession, events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One run over an event stream, read back as a table."""
    base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/live-{uuid.uuid4().hex[:12]}"
    totals = hourly_totals(events, delay=delay)
    run_available(totals, f"{base}/hours", f"{base}/checkpoint")
    return spark.read.schema(totals.schema).parquet(f"{base}/hours")
