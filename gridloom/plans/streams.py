"""The streaming roll-up, as a stream over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.plans.standins import Tables
from gridloom.sources.shared import shared_dir
from gridloom.streaming.rollup import run_once, windowed_rollup


@query("stream_daily_rollup", sql="SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2 HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def daily(t: Tables):
    """Every day that the watermark has closed when the input ends."""
    source = t.read("events")
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(source.schema).parquet(f"{t.dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    run_once(windowed_rollup(stream, "ts", ["event_type"], ["value"], []), f"{base}/out", f"{base}/state")
    return t.spark.read.parquet(f"{base}/out").select("event_type", "start", F.round("value", 4).alias("value"), "n")
