"""Feature stores and model matrices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import category_text, months_since_change, round_code
from gridloom.operators.aggregates import scaler
from gridloom.operators.conform import date_split, with_min_history
from gridloom.operators.joins import kept_keys, on_spine, with_static
from gridloom.operators.spatial import Axes, choose_cells, gather
from gridloom.operators.windows import back_fill as next_known
from gridloom.operators.windows import lag_features, trailing_means

# Lag and trailing-mean lengths of monthly and weekly series.
LAGS = {"monthly": [1, 2, 3, 6, 12], "weekly": [1, 2, 4, 8, 13, 26, 52]}
MEANS = {"monthly": [3, 6, 12], "weekly": [4, 13, 26, 52]}

#: Named transforms of datasets.
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str):
    """Register a transform under a name that dataset specifications use."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in TRANSFORMS:
            raise ValueError(f"transform {name} is registered twice")
        TRANSFORMS[name] = f
        return f

    return add


@dataclass(frozen=True)
class Spec:
    """One dataset of a store: its variables and how it is sampled."""

    key: str
    temporal: str
    variables: tuple[str, ...]
    radius_km: float = 0.0
    on_no_valid: str = "keep_nan"
    categorical: tuple[str, ...] = ()
    transform: str | None = None

    def __post_init__(self):
        if self.temporal not in ("static", "monthly", "yearly") or self.on_no_valid not in ("keep_nan", "skip_well", "nearest_global"):
            raise ValueError(f"{self.key}: {self.temporal}, {self.on_no_valid}")


def manifest(specs: list[Spec]) -> list[Spec]:
    """Specifications with unique keys and known transforms."""
    keys = [s.key for s in specs]
    if len(set(keys)) < len(keys):
        raise ValueError("keys are not unique")
    if unknown := [s.transform for s in specs if s.transform and s.transform not in TRANSFORMS]:
        raise ValueError(f"unknown transforms {unknown}")
    return specs


def sample_dataset(stations: DataFrame, grid: DataFrame, axes: Axes, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """G1 and J8 for one dataset: its columns <key>__<variable>, and the provenance rows.

    The cell is chosen once per station, by the first variable (first time step) of the grid.
    """
    times = ["time"] if "time" in grid.columns else []
    reference = grid.where(F.col(spec.variables[0]).isNotNull())
    if times:
        start = grid.agg(F.min("time").alias("_t"))
        reference = reference.join(F.broadcast(start), F.col("time") == F.col("_t"))
    chosen = choose_cells(stations, reference.select("lat_idx", "lon_idx").distinct(), axes, spec.radius_km, spec.on_no_valid)
    values = gather(chosen, grid, list(spec.variables), times)
    named = values.select("station_id", *times, *[(round_code(F.col(v)) if v in spec.categorical else F.col(v)).alias(f"{spec.key}__{v}") for v in spec.variables])
    provenance = chosen.select("station_id", F.lit(spec.key).alias("dataset"), "dist_km", "rescued", "outcome", "keep")
    return named, provenance


def static_store(stations: DataFrame, datasets: list[DataFrame], basins: DataFrame | None = None) -> DataFrame:
    """Station columns, the sampled columns of every static dataset and the zone attributes."""
    parts = [*datasets, *([basins] if basins is not None else [])]
    return reduce(lambda a, b: a.join(b, "station_id", "left"), parts, stations)


def dynamic_store(spine: DataFrame, monthly: list[DataFrame], yearly: list[DataFrame] | None = None, zones: list[DataFrame] | None = None) -> DataFrame:
    """The stations' months with every feature joined, null outside its coverage; all joins share one partitioning by station and month."""
    return on_spine(spine, [*monthly, *(yearly or []), *(zones or [])])


@transform("landcover_changes")
def landcover_features(annual: DataFrame, months: DataFrame, first: int, last: int, back_fill: bool = True, forward_fill: bool = False, key: str = "station_id") -> DataFrame:
    """Class, previous class, changed, stable and months since the change for each station month.

    annual: key, year, code; months: key, time. A scaffold of all years of record and months is
    filled backwards (and forwards on demand); changes within the record decide ``stable``.
    """
    span = months.groupBy(key).agg(F.min(F.year("time")).alias("a"), F.max(F.year("time")).alias("z"))
    years = span.select(key, F.explode(F.sequence(F.least("a", F.lit(first)), F.greatest("z", F.lit(last)))).alias("year"))
    w = Window.partitionBy(key).orderBy("year")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    y = years.join(annual.select(key, "year", F.col("code").alias("_c")), [key, "year"], "left")
    if back_fill:
        y = y.withColumn("_c", next_known("_c", key, "year"))
    if forward_fill:
        y = y.withColumn("_c", F.last("_c", ignorenulls=True).over(before))
    y = y.withColumn("_p", F.lag("_c").over(w))
    if back_fill:
        y = y.withColumn("_p", next_known("_p", key, "year"))
    y = y.withColumn("_x", F.coalesce(F.col("_c") != F.col("_p"), F.lit(False)).cast("int"))
    y = y.withColumns({"_l": F.last(F.when(F.col("_x") == 1, F.col("year")), ignorenulls=True).over(before), "_s": F.sum(F.when(F.col("year").between(first, last), F.col("_x")).otherwise(0)).over(Window.partitionBy(key))})
    m = months.select(key, "time").withColumn("year", F.year("time")).join(y, [key, "year"], "left")
    return m.select(
        key, "time", round_code(F.col("_c")).alias("lcc"), round_code(F.col("_p")).alias("lcc_previous"), F.coalesce("_x", F.lit(0)).alias("lcc_changed"),
        (F.col("_s") == 0).cast("int").alias("lcc_stable"), months_since_change(F.col("year"), F.month("time"), F.col("_l")).alias("months_since_change"),
    )


def build_report(stations: DataFrame, spine: DataFrame) -> DataFrame:
    """Months, first and last month and status of each station."""
    n = spine.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_months"), F.min("time").alias("t_min"), F.max("time").alias("t_max"))
    out = stations.select("station_id").join(n, "station_id", "left").withColumn("n_months", F.coalesce("n_months", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_months") > 0, "OK").otherwise("NO_SERIES"))


def feature_matrix(series: DataFrame, lagged: list[str], passed: list[str], static: DataFrame | None, categorical: list[str], profile: str = "monthly", keep: list[str] | None = None) -> DataFrame:
    """E5: lag and trailing-mean columns, passed columns, static columns; names sanitised, categories as text, numbers as float.

    All windows share the partitioning by station, so the series is shuffled once.
    """
    made = lag_features(lagged, LAGS[profile]) | trailing_means(lagged, MEANS[profile])
    df = series.select("station_id", "time", *(keep or []), *dict.fromkeys([*passed, *lagged]), *[c.alias(n) for n, c in made.items()])
    if static is not None:
        df = with_static(df, static)
    fixed = {"station_id", "time", *(keep or [])}
    cols = []
    for c in df.columns:
        if c in fixed:
            cols.append(F.col(c))
        else:
            name = "".join(x if x.isascii() and (x.isalnum() or x == "_") else "_" for x in c)
            cols.append((category_text(F.col(c)) if c in categorical else F.col(c).cast("float")).alias(name))
    return df.select(*cols)


def temporal_dataset(series: DataFrame, target: str, stop_start: str, test_start: str, least: int = 16, stations: DataFrame | None = None) -> DataFrame:
    """Z-scored target (scaled by rows before the test) and split; stations with too short a history are left out.

    ``series`` is already cut to the time hull, since lags see hull rows only.
    """
    df = series if stations is None else series.join(stations.select("station_id"), "station_id", "left_semi")
    before = F.col("time") < F.lit(test_start).cast("date")
    df = with_min_history(df, "station_id", least, before)
    df = df.join(scaler(df, target, before), "station_id")
    return df.withColumn("z", (F.col(target) - F.col("mean")) / F.col("std")).withColumn("split", date_split(F.col("time"), stop_start, test_start))


def spatial_dataset(series: DataFrame, target: str, folds: DataFrame, static: DataFrame, in_reference: Column, factor: float = 100.0, least: int = 16, least_reference: int = 12) -> tuple[DataFrame, DataFrame]:
    """Anomaly from the reference mean in converted units, fold per station; and stations per reason of being dropped."""
    n = series.groupBy("station_id").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(in_reference, F.col(target))).alias("_r"), F.avg(F.when(in_reference, F.col(target))).alias("ref_mean"))
    kept = kept_keys(series, {"no_static": static, "no_fold": folds, "short": n.where(F.col("_n") >= least), "no_reference": n.where(F.col("_r") >= least_reference)})
    ok = kept.where("dropped_for is null").select("station_id").join(n.select("station_id", "ref_mean"), "station_id").join(folds.select("station_id", "fold"), "station_id")
    out = series.join(ok, "station_id").withColumn("anomaly", (F.col(target) - F.col("ref_mean")) * factor)
    return out, kept.groupBy(F.coalesce("dropped_for", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def valid_stations(provenance: DataFrame | None, series: DataFrame | None = None, column: str | None = None) -> DataFrame:
    """Stations whose outcome has a cell; without provenance those with any value in the hull."""
    if provenance is not None:
        return provenance.where(~F.col("outcome").isin("dropped", "no_valid")).select("station_id").distinct()
    return series.groupBy("station_id").agg(F.count(column).alias("_n")).where("_n > 0").select("station_id")


def balanced_folds(stations: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups into k folds, largest first, each into the smallest fold (lowest on ties); equal groups in key order.

    Only one row per group (key and size) meets in the greedy step, an ``aggregate`` over the sorted
    array; station rows stay distributed.
    """
    sizes = stations.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    row = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g"))))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("load"), F.array().cast(f"array<struct<g:{dict(stations.dtypes)[group]},fold:int>>").alias("put"))

    def put(s: Column, x: Column) -> Column:
        f = F.array_position(s["load"], F.array_min(s["load"])).cast("int") - 1
        load = F.transform(s["load"], lambda v, i: F.when(i == f, v - x["m"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(s["put"], F.array(F.struct(x["g"].alias("g"), f.alias("fold")))).alias("put"))

    folds = sizes.agg(row.alias("a")).select(F.explode(F.aggregate("a", zero, put)["put"]).alias("x")).select(F.col("x.g").alias(group), F.col("x.fold").alias("fold"))
    return stations.join(folds, group)


def fold_balance(folds: DataFrame) -> DataFrame:
    """Stations per fold and their spread."""
    n = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per fold
    return n.withColumn("spread", F.max("n").over(w) - F.min("n").over(w))


def schema_export(matrix: DataFrame, fixed: list[str]) -> DataFrame:
    """Position, name and kind of each feature, and its sorted categories."""
    cats = [c for c, t in matrix.dtypes if t == "string" and c not in fixed]
    feats = [(i, c, "category" if c in cats else "float") for i, c in enumerate(x for x in matrix.columns if x not in fixed)]
    sets = matrix.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cats], F.lit(0).alias("_one"))
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(k).alias("kind"), (F.col(c) if k == "category" else F.lit(None).cast("array<string>")).alias("categories")) for i, c, k in feats])
    return sets.select(F.inline(rows))


