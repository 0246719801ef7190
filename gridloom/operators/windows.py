"""Window operators over station series and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import materialize


def series(key: str = "station_id", time: str = "time"):
    return Window.partitionBy(key).orderBy(time)


def lag_features(columns: list[str], lags: list[int], key: str = "station_id", time: str = "time") -> dict[str, Column]:
    """Positional lags; gaps are not filled."""
    return {f"{c}_lag{k}": F.lag(c, k).over(series(key, time)) for c in columns for k in lags}


def trailing_means(columns: list[str], spans: list[int], key: str = "station_id", time: str = "time") -> dict[str, Column]:
    """Means of the k rows before the current one; nulls skipped."""
    return {f"{c}_rmean{k}": F.avg(c).over(series(key, time).rowsBetween(-k, -1)) for c in columns for k in spans}


def back_fill(column: str, key: str, order: str) -> Column:
    """The next known value."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(column: str, key: str, order: str) -> Column:
    """The last known value."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def change_flag(column: str, key: str, order: str) -> Column:
    """1 where the value differs from the previous row's, both known."""
    before = F.lag(column).over(Window.partitionBy(key).orderBy(order))
    return F.when(F.col(column).isNotNull() & before.isNotNull() & (F.col(column) != before), 1).otherwise(0)


def average_rank(column: str, parts: list[str]) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*parts)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*parts, column))
    return F.rank().over(w.orderBy(column)) + (ties - 1) / 2


def holm(df: DataFrame, p: str, parts: list[str], order: list[str]) -> DataFrame:
    """Step-down adjusted p values; a null p counts as 1."""
    q = F.coalesce(F.col(p), F.lit(1.0))
    w = Window.partitionBy(*parts)
    rank = F.row_number().over(w.orderBy(q, *order))
    step = df.withColumns({"_m": F.count(F.lit(1)).over(w), "_r": rank})
    step = step.withColumn("_a", F.least((F.col("_m") - F.col("_r") + 1) * q, F.lit(1.0)))
    return step.withColumn("p_holm", F.max("_a").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).drop("_m", "_r", "_a")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def snap_months(df: DataFrame, key: str, time: str) -> DataFrame:
    """The k-th stamp of a key becomes its first month plus k; ``mismatch`` where that is another month."""
    w = Window.partitionBy(key)
    k = F.row_number().over(w.orderBy(time)) - 1
    month = F.add_months(F.trunc(F.min(time).over(w), "MM"), k)
    return df.withColumn("month", month).withColumn("mismatch", F.col("month") != F.trunc(F.col(time), "MM"))


def central_difference(column: str, line: str, position: str) -> Column:
    """Half the difference of the neighbours, one-sided at an edge, null next to a null or without neighbours.

    A neighbour is the row one position away; where the table has none, there is an edge.
    """
    w = Window.partitionBy(line).orderBy(position)
    has_before = F.coalesce(F.col(position) - F.lag(position).over(w) == 1, F.lit(False))
    has_after = F.coalesce(F.lead(position).over(w) - F.col(position) == 1, F.lit(False))
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    return (
        F.when(has_before & has_after, (after - before) / 2)
        .when(has_after, after - F.col(column))
        .when(has_before, F.col(column) - before)
    )


def value_positions(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """(parts, column, _count, _before): rows with each value, and rows of the same parts with a smaller one.

    Equal values are counted first; the distinct ones are dealt to range partitions, numbered within
    each, and shifted by the sums of the partitions before, one row per partition and part. No task
    holds more than its range, however few parts there are. Nulls come first.
    """
    counts = df.groupBy(*parts, column).agg(F.count(F.lit(1)).alias("_count"))
    dealt = materialize(counts.repartitionByRange(*parts, column).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*parts, "_range").agg(F.sum("_count").alias("_s"))
    shift = sums.select(*[F.col(p).alias(f"_s_{p}") for p in parts], F.col("_range").alias("_s_range"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_shift"))
    same = F.col("_range") == F.col("_s_range")
    for p in parts:
        same = same & F.col(p).eqNullSafe(F.col(f"_s_{p}"))
    within = Window.partitionBy("_range", *parts).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("_count").over(within), F.lit(0))).join(shift, same)
    return placed.select(*parts, column, "_count", (F.col("_in") + F.col("_shift")).alias("_before"))


def empirical_cdf(df: DataFrame, column: str, parts: list[str], tie: str) -> DataFrame:
    """Df with ``cdf``, position / count in ascending order (nulls first), ties in the order of ``tie``.

    Positions come from range partitions; no class is sorted in one task. Rows equal in all of these share the last position.
    The rows are written once: made twice, sums of doubles may differ in their last bit and miss their own position.
    """
    df = materialize(df, "ranked")
    key = F.struct(F.col(column).alias("v"), F.col(tie).alias("t"))
    place = value_positions(df.select(*parts, key.alias("_key")), "_key", parts)
    total = place.groupBy(*parts).agg(F.sum("_count").alias("_total")).withColumnsRenamed({p: f"_t_{p}" for p in parts})
    place = place.select(*[F.col(p).alias(f"_p_{p}") for p in parts], F.col("_key").alias("_k"), (F.col("_before") + F.col("_count")).alias("_at"))
    same, all_ = key.eqNullSafe(F.col("_k")), F.lit(True)
    for p in parts:
        same, all_ = same & F.col(p).eqNullSafe(F.col(f"_p_{p}")), all_ & F.col(p).eqNullSafe(F.col(f"_t_{p}"))
    return df.join(place, same).join(total, all_).select(*df.columns, (F.col("_at") / F.col("_total")).alias("cdf"))


def stride_sample(df: DataFrame, keys: list[str], step: int, most: int) -> DataFrame:
    """Every ``step``-th key in order, ``most`` at most; null keys are left out."""
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    place = value_positions(known.select(F.struct(*keys).alias("_key")).distinct(), "_key", [])
    picked = place.where((F.col("_before") % step == 0) & (F.col("_before") < step * most)).select("_key.*")
    return df.join(picked, keys, "left_semi")
