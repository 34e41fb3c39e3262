"""Registered stream query (STR row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.registry import query
from marketlens.streaming.hourly import live_hours
from marketlens.tables import SCHEMAS


@query(
    "str_1_hourly_totals",
    """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n, round(sum(value), 2) as amount from events where event_type = 'purchase'
    group by date_trunc('hour', ts) having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events where event_type = 'purchase') - interval 1 hour""",
)
def _(t):
    stream = t.spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    deals = stream.filter(F.col("event_type") == "purchase").select(F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("amount"))
    return live_hours(t.spark, deals).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", F.round("amount", 2).alias("amount"))
