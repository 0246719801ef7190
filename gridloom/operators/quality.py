"""Quality control of extractions and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import group_name, month_end, null_count
from gridloom.operators.aggregates import _matched, quantiles

OUTCOMES = ["home", "rescued", "nearest_global", "no_valid", "dropped"]


def provenance_summary(provenance: DataFrame) -> DataFrame:
    """Q1: outcomes, shares and distances of each dataset."""
    total = F.count(F.lit(1))
    counts = provenance.groupBy("dataset").agg(
        total.alias("n_stations"),
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES],
        (F.count_if(F.col("rescued")) * 100.0 / total).alias("pct_rescued"),
        (F.count_if(F.col("outcome").isin("no_valid", "dropped")) * 100.0 / total).alias("pct_without_cell"),
        F.max("dist_km").alias("dist_km_max"), F.max(F.when(F.col("rescued"), F.col("dist_km"))).alias("rescue_km_max"),
    )
    both = provenance.select("dataset", F.lit("dist_km").alias("_kind"), "dist_km").unionByName(provenance.where("rescued").select("dataset", F.lit("rescue_km").alias("_kind"), "dist_km"))
    spread = quantiles(both, "dist_km", [0.5, 0.95], ["dataset", "_kind"])
    own, far = F.col("_kind") == "dist_km", F.col("_kind") == "rescue_km"
    spread = spread.groupBy("dataset").agg(F.max(F.when(own, F.col("p50"))).alias("dist_km_median"), F.max(F.when(own, F.col("p95"))).alias("dist_km_p95"), F.max(F.when(far, F.col("p50"))).alias("rescue_km_median"))
    return _matched(counts, spread, ["dataset"], "left")


def flagged(provenance: DataFrame) -> DataFrame:
    """Q2: stations whose cell is not the home cell."""
    return provenance.where("outcome <> 'home'").orderBy("dataset", "station_id")


def _by_dataset(columns: list[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for c in columns:
        found.setdefault(group_name(c), []).append(c)
    return found


def static_completeness(store: DataFrame, key: str = "station_id") -> DataFrame:
    """Q3: per dataset: variables, affected stations, all-missing stations, missing percent, worst variable.

    One aggregation over the rows as they are; only its single row is turned into one per dataset.
    """
    sets = _by_dataset([c for c in store.columns if c != key])
    if not sets:
        return store.sparkSession.createDataFrame([], "dataset string, n_variables int, n_affected long, n_all_missing long, pct_missing double, worst string")
    aggs = []
    for d, cols in sets.items():
        n = null_count(cols)
        worst = F.array_min(F.array(*[F.struct((-F.count_if(F.col(c).isNull())).alias("m"), F.lit(c).alias("c")) for c in cols]))
        aggs.append(F.struct(F.lit(d).alias("dataset"), F.lit(len(cols)).alias("n_variables"), F.count_if(n > 0).alias("n_affected"), F.count_if(n == len(cols)).alias("n_all_missing"), F.try_divide(F.sum(n) * 100.0, F.count(F.lit(1)) * len(cols)).alias("pct_missing"), worst["c"].alias("worst")))
    return store.agg(F.array(*aggs).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 0").select(F.inline("a"))


def dynamic_completeness(store: DataFrame, coverage: DataFrame, key: str = "station_id", time: str = "time", skip: list[str] | None = None) -> DataFrame:
    """Q4: completeness within each dataset's coverage, months inclusive. coverage: dataset, first, last (months as dates).

    A station is all-missing when any one column is null throughout, affected when any value is null.
    """
    sets = _by_dataset([c for c in store.columns if c not in (key, time, *(skip or []))])
    spans = coverage.groupBy().agg(*[f(F.when(F.col("dataset") == d, F.col(c))).alias(f"_{c}_{i}") for i, d in enumerate(sets) for f, c in ((F.min, "first"), (F.max, "last"))])
    df = store.join(F.broadcast(spans))  # one row
    per = []
    for i, (d, cols) in enumerate(sets.items()):
        inside = (F.col(time) >= F.col(f"_first_{i}")) & (F.col(time) <= month_end(F.col(f"_last_{i}")))
        n = F.count_if(inside)
        m = [F.count_if(inside & F.col(c).isNull()) for c in cols]
        per.append(F.struct(F.lit(d).alias("dataset"), (n * len(cols)).alias("n"), sum(m[1:], m[0]).alias("m"), (F.greatest(*m, F.lit(0)) == n).alias("gone")))
    st = df.groupBy(key).agg(F.array(*per).alias("a")).select(F.inline("a")).where("n > 0")
    return st.groupBy("dataset").agg(F.count_if(F.col("m") > 0).alias("n_affected"), F.count_if("gone").alias("n_all_missing"), (F.sum("m") * 100.0 / F.sum("n")).alias("pct_missing"))


def qc_table(completeness: DataFrame, summary: DataFrame, config: DataFrame) -> DataFrame:
    """Completeness with provenance (or "polygon join") and settings; distances in metres, ordered by the settings."""
    j = completeness.join(summary.select("dataset", "n_rescued", "dist_km_median", "dist_km_max"), "dataset", "left").join(config, "dataset", "left")
    j = j.withColumn("method", F.when(F.col("dist_km_median").isNull() & F.col("n_rescued").isNull(), "polygon join").otherwise("nearest cell"))
    return j.withColumns({"dist_m_median": F.round(F.col("dist_km_median") * 1000, 1), "dist_m_max": F.round(F.col("dist_km_max") * 1000, 1)}).drop("dist_km_median", "dist_km_max").orderBy(F.col("position").asc_nulls_last(), "dataset")


def loss_reasons(stations: DataFrame, without_cell: DataFrame, incomplete: DataFrame, key: str = "station_id") -> DataFrame:
    """Q6: stations by reason: no priority dataset, incomplete static features, both, none."""
    f = stations.select(key).distinct().join(without_cell.select(key).distinct().withColumn("_a", F.lit(1)), key, "left").join(incomplete.select(key).distinct().withColumn("_b", F.lit(1)), key, "left")
    why = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "no_priority_dataset").when(F.col("_b").isNotNull(), "incomplete_static").otherwise("complete")
    return f.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def feature_nulls(store: DataFrame, key: str = "station_id") -> DataFrame:
    """Q7: nulls per feature with its dataset and variable, from one aggregation."""
    cols = [c for c in store.columns if c != key]
    aggs = [F.struct(F.lit(group_name(c)).alias("dataset"), F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count(F.lit(1)).alias("n_rows"), F.lit(c.split("__")[-1]).alias("variable")) for c in cols]
    return store.agg(F.array(*aggs).alias("a")).select(F.inline("a")).where("n_rows > 0").orderBy(F.desc("n_null"), "column")


def affected_datasets(nulls: DataFrame) -> DataFrame:
    """Q7: features with nulls and nulls in all of each dataset."""
    return nulls.where("n_null > 0").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_features"), F.sum("n_null").alias("n_null"), F.max("n_null").alias("most"))


def station_null_histogram(store: DataFrame, key: str = "station_id") -> DataFrame:
    """Q8: stations by number of null features."""
    n = null_count([c for c in store.columns if c != key])
    return store.select(key, n.alias("n_null")).groupBy("n_null").agg(F.count(F.lit(1)).alias("n_stations"))


def station_null_summary(store: DataFrame, key: str = "station_id") -> DataFrame:
    """Q8: complete stations, median and largest number of null features."""
    n = null_count([c for c in store.columns if c != key])
    return store.select(n.alias("n")).agg(F.count_if(F.col("n") == 0).alias("n_complete"), F.median("n").alias("median_null"), F.max("n").alias("max_null"))
