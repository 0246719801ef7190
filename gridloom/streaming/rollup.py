"""An incremental monthly or daily roll-up on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rollup(stream: DataFrame, time: str, keys: list[str], flux: list[str], state: list[str], every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums of flux and means of state columns per key and window; records later than ``late`` are left out by the watermark.

    The state is one row per key and open window; works on batch tables too.
    """
    w = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = w.groupBy(*keys, F.window(time, every).alias("_w")).agg(*[F.sum(c).alias(c) for c in flux], *[F.avg(c).alias(c) for c in state], F.count(F.lit(1)).alias("n"))
    return out.withColumn("start", F.col("_w.start")).drop("_w")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the watermark has closed to Parquet, all available input, then stop; restarts go on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
