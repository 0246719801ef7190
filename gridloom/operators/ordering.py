"""Sorting, top-k and sampling (K1-K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sort_report(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """K1: (column, ascending) keys, nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


def top_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """K2."""
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(n)


def top_per_group(df: DataFrame, group: str, by: str, k: int, tie: str) -> DataFrame:
    """K3: the k rows with the smallest ``by`` of each group; Spark prunes to k rows per group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(by).asc_nulls_last(), tie))).where(F.col("rank") <= k)


def worst_of(df: DataFrame, group: str, by: str, name: str) -> DataFrame:
    """K4: name of the largest value of each group, least name on ties."""
    return df.groupBy(group).agg(F.min_by(name, F.struct((-F.col(by)).alias("v"), F.col(name).alias("n"))).alias("worst"), F.max(by).alias("value"))


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """K5: n rows without replacement, the same for the same seed: those with the least digest of id and seed."""
    return df.orderBy(F.md5(F.concat_ws("/", F.col(row_id).cast("string"), F.lit(str(seed)))), row_id).limit(n)


def first_stations(df: DataFrame, n: int, key: str = "station_id") -> DataFrame:
    """K6: rows of the first n stations in order."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")
