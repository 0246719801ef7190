"""Aggregations (A1-A27): roll-ups, zonal means, quantiles, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import days_since_epoch, month_start
from gridloom.operators.joins import same_core
from gridloom.operators.windows import value_positions
from gridloom.sources.shared import materialize


def monthly_rollup(weekly: DataFrame, target: str, flux: list[str], drop: list[str] | None = None, key: str = "station_id", time: str = "week") -> DataFrame:
    """A1: months by a record's own date; flux columns are summed (null when all are), others averaged, months without target removed."""
    others = [c for c in weekly.columns if c not in (key, time, *flux, *(drop or []))]
    month = weekly.withColumn("time", month_start(F.col(time)))
    out = month.groupBy(key, "time").agg(*[F.sum(c).alias(c) for c in flux], *[F.avg(c).alias(c) for c in others])
    return out.where(F.col(target).isNotNull()).withColumn("time_days", days_since_epoch(F.col("time")))


def valid_cells(cells: DataFrame, variables: list[str], time: str, shared: bool = True, key: str = "cell_id") -> DataFrame:
    """A2: the validity mask of the first time step: cells valid in all variables, or per variable (columns ok_<variable>)."""
    first = cells.agg(F.min(time).alias("_t"))
    at = cells.join(F.broadcast(first), F.col(time) == F.col("_t")).drop("_t")
    flags = {f"ok_{v}": F.col(v).isNotNull() for v in variables}
    if shared:
        every = F.lit(True)
        for v in variables:
            every = every & F.col(v).isNotNull()
        flags = dict.fromkeys(flags, every)
    return at.withColumns(flags).select(key, *flags)


def zonal_means(cells: DataFrame, mask: DataFrame, variables: list[str], zone: str = "zone_id", time: str = "time", area: str = "area_m2", key: str = "cell_id") -> DataFrame:
    """Area-weighted mean per zone and time over the cells of the fixed mask; a masked cell that is null later makes the mean null."""
    joined = cells.join(mask, key)
    aggs = []
    for v in variables:
        ok = F.col(f"ok_{v}")
        weight = F.sum(F.when(ok, F.col(area)))
        hole = F.max(F.when(ok, F.col(v).isNull().cast("int")))
        aggs.append(F.when(F.coalesce(hole, F.lit(0)) == 0, F.try_divide(F.sum(F.when(ok, F.col(v) * F.col(area))), weight)).alias(v))
    return joined.groupBy(zone, time).agg(*aggs)


def zone_products(cells: DataFrame, products: dict[str, list[str]], levels: list[str], time: str = "time", area: str = "area_m2", key: str = "cell_id") -> DataFrame:
    """(product, variable, level, zone_id, time, mean) of all products at all levels of zones, from one pass over the cells.

    Each cell has a set of bits, one per variable, for what is valid at the first time step; a product's mask are the
    cells with all of its variables' bits. The levels are grouping sets of one aggregation, whose columns are the products'
    variables; they become rows afterwards, when there are only zones and times. A masked cell that is null later makes the
    mean null; a zone without masked cells has null; cells without a zone at a level are no part of that level.
    """
    names = sorted({v for vs in products.values() for v in vs})
    bit = {v: 1 << i for i, v in enumerate(names)}
    first = cells.agg(F.min(time).alias("_t"))
    bits = sum((F.when(F.col(v).isNotNull(), F.lit(bit[v])).otherwise(0) for v in names), F.lit(0)).cast("long")
    mask = cells.join(F.broadcast(first), F.col(time) == F.col("_t")).groupBy(key).agg(F.bit_and(bits).alias("_bits"))
    joined = cells.join(mask, key)
    aggs, rows = [], []
    for p, vs in products.items():
        need = F.lit(sum(bit[v] for v in vs)).cast("long")
        ok = F.col("_bits").bitwiseAND(need) == need
        for v in vs:
            weight, hole = F.sum(F.when(ok, F.col(area))), F.max(F.when(ok, F.col(v).isNull().cast("int")))
            mean = F.when(F.coalesce(hole, F.lit(0)) == 0, F.try_divide(F.sum(F.when(ok, F.col(v) * F.col(area))), weight))
            aggs.append(mean.alias(f"_m{len(aggs)}"))
            rows.append(F.struct(F.lit(p).alias("product"), F.lit(v).alias("variable"), F.col(f"_m{len(rows)}").alias("mean")))
    sets = joined.groupingSets([[F.col(level), F.col(time)] for level in levels], *levels, time).agg(F.grouping_id().alias("_set"), *aggs)
    # grouping_id has a bit for each column that a set lacks, the first column's highest
    full = (1 << (len(levels) + 1)) - 1
    level = F.create_map(*[F.lit(x) for i, n in enumerate(levels) for x in (full - (1 << (len(levels) - i)) - 1, n)])
    named = sets.withColumn("level", level[F.col("_set").cast("int")])
    zone = F.coalesce(*[F.when(F.col("level") == n, F.col(n)) for n in levels])
    return named.withColumn("zone_id", zone).where("zone_id is not null").select("level", "zone_id", F.col(time).alias("time"), F.inline(F.array(*rows))).select("product", "variable", "level", "zone_id", "time", "mean")


def zone_coverage(cells: DataFrame, valid: Column, zone: str = "zone_id", area: str = "area_m2") -> DataFrame:
    """A3 and A4: area, covered area, coverage fraction, cells and valid cells of each zone."""
    total, covered = F.sum(area), F.coalesce(F.sum(F.when(valid, F.col(area))), F.lit(0.0))
    return cells.groupBy(zone).agg(total.alias("area_m2"), covered.alias("covered_m2"), F.try_divide(covered, total).alias("coverage"), F.count(F.lit(1)).alias("n_cells"), F.count_if(valid).alias("n_valid"))


def coverage_counts(coverage: DataFrame, full: float = 0.999) -> DataFrame:
    """A3: partly covered and empty zones."""
    return coverage.agg(F.count_if((F.col("coverage") > 0) & (F.col("coverage") < full)).alias("n_partial"), F.count_if(F.col("coverage") == 0).alias("n_empty"))


def long_term_mean(cells: DataFrame, variables: list[str], key: list[str]) -> DataFrame:
    """A5."""
    return cells.groupBy(*key).agg(*[F.avg(v).alias(v) for v in variables])


def variance_decomposition(cells: DataFrame, value: str, area: str = "area_m2", zone: str = "zone_id") -> DataFrame:
    """Weighted total and between-zone variance and the share of the latter; share above 1 is flagged.

    Zone sums are taken first, so only one row per zone reaches the final step; squares are centred
    on the overall mean in a second pass.
    """
    known = cells.where(F.col(value).isNotNull())
    mean = known.agg((F.sum(F.col(value) * F.col(area)) / F.sum(area)).alias("_m"))
    centred = known.join(F.broadcast(mean)).withColumn("_d", F.col(value) - F.col("_m"))
    zones = centred.groupBy(zone).agg(F.sum(area).alias("w"), F.sum(F.col(area) * F.col("_d")).alias("s"), F.sum(F.col(area) * F.col("_d") * F.col("_d")).alias("q"))
    inner = zones.where(F.col(zone).isNotNull())
    total = F.sum("q") / F.sum("w")
    between = F.sum(F.col("s") * F.col("s") / F.col("w")) / F.sum("w")
    return inner.agg(total.alias("total"), between.alias("between")).withColumn("share", F.try_divide("between", "total")).withColumn("suspicious", F.coalesce(F.col("share") > 1, F.lit(False)))


#: Accuracy of the sketches that bracket a quantile: its rank is off by one in so many at most.
SKETCH = 4000


def _matched(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """a joined with b on the keys, where nulls are equal; b's keys go."""
    named = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(named if keys else F.broadcast(named), same, how).drop(*[f"_r_{k}" for k in keys])


def _at_ranks(place: DataFrame, probs: list[float], keys: list[str]) -> DataFrame:
    """The values at the ranks below and above each quantile, from rows (keys, _i or all, _v, _count, _before, _n)."""
    ends = []
    for i, p in enumerate(probs):
        at = (F.col("_n") - 1) * F.lit(float(p))
        mine = F.col("_i") == i if "_i" in place.columns else F.lit(True)
        for tag, k in (("a", F.floor(at)), ("b", F.ceil(at))):
            ends.append(F.max(F.when(mine & (F.col("_before") <= k) & (k < F.col("_before") + F.col("_count")), F.col("_v"))).alias(f"_{tag}{i}"))
    return place.groupBy(*keys).agg(*ends)


def quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values, one column p<percent> each, and their number n.

    Exact ones take two scans: mergeable sketches bracket each rank between two values; the second scan counts what is below
    the bracket and keeps, counted by value, what lies within, some thousandths of a group. Should a rank lie outside
    its bracket, the group's positions come from range partitions instead. exact=False: the sketches alone. Groups
    without any value have nulls.
    """
    keys = keys or []
    names = [f"p{round(p * 100)}" for p in probs]
    if not exact:
        got = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in probs])).alias("_q"), F.count(value).alias("n"))
        return got.select(*keys, "n", *[F.col("_q")[i].alias(c) for i, c in enumerate(names)])
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    off = 2 / SKETCH
    marks = [min(max(x, 0.0), 1.0) for p in probs for x in (p - off, p + off)]
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), SKETCH).alias("_m"))
    met = _matched(rows.where("_v is not null"), sizes, keys, "inner")
    parts = []
    for i, p in enumerate(probs):
        low = F.lit(-math.inf) if p - off <= 0 else F.col("_m")[2 * i]
        high = F.lit(math.nan) if p + off >= 1 else F.col("_m")[2 * i + 1]
        v = F.col("_v")
        parts.append(F.when(v <= high, F.struct(F.lit(i).alias("_i"), F.when(v >= low, v).alias("_v"))))
    kept = met.select(*keys, "_n", F.explode(F.array_compact(F.array(*parts))).alias("_x")).groupBy(*keys, "_n", "_x._i", "_x._v").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    place = kept.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).where("_v is not null")
    found = materialize(_matched(sizes.drop("_m"), _at_ranks(place, probs, keys), keys, "left"), "quantiles")
    missed = found.where(F.expr(" or ".join(f"_{t}{i} is null" for i in range(len(probs)) for t in "ab")) & (F.col("_n") > 0)).select(*keys, "_n")
    if not missed.isEmpty():
        some = _matched(rows.where("_v is not null"), missed.drop("_n").withColumn("_one", F.lit(1)), keys, "inner").drop("_one")
        again = _at_ranks(_matched(value_positions(some, "_v", keys), missed, keys, "inner"), probs, keys)
        rest = _matched(found, missed.drop("_n").withColumn("_one", F.lit(1)), keys, "left").where("_one is null").drop("_one")
        found = rest.unionByName(_matched(missed, again, keys, "left"))
    part = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    return found.select(*keys, F.col("_n").alias("n"), *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (part[i] - F.floor(part[i]))).alias(c) for i, c in enumerate(names)])


def level_summary(zones: DataFrame, value: str, inside: Column, with_station: Column) -> DataFrame:
    """Count, share and quantiles for all zones, those inside the area and those with stations."""
    sets = F.array(F.struct(F.lit("all").alias("s"), F.lit(True).alias("k")), F.struct(F.lit("inside").alias("s"), inside.alias("k")), F.struct(F.lit("with_station").alias("s"), with_station.alias("k")))
    long = zones.withColumn("_x", F.explode(sets)).where("_x.k").withColumn("zone_set", F.col("_x.s"))
    total = zones.agg(F.count(F.lit(1)).alias("_all"))
    return quantiles(long, value, [0.1, 0.5, 0.9], ["zone_set"]).join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def stations_per_zone(zones: DataFrame, stations: DataFrame, zone: str = "zone_id") -> DataFrame:
    """A9."""
    n = stations.groupBy(zone).agg(F.count_distinct("station_id").alias("n_stations"))
    return zones.select(zone).distinct().join(n, zone, "left").withColumn("n_stations", F.coalesce("n_stations", F.lit(0)))


def level_report(zones: DataFrame, stations: DataFrame, fine: int, coarse: int, inside: Column, tolerance: float = 0.05) -> DataFrame:
    """One row per level and set of zones (all, inside, with stations): number, share, quantiles of the area (A8), stations (A9), zones that are one polygon at the other level (J18), mean number of finer zones (J19, the coarse level).

    zones: level, zone_id, core_id, code, area; stations: level, zone_id, station_id. A zone's code begins with that of the coarse zone it lies in.
    """
    n = stations.groupBy("level", "zone_id").agg(F.count_distinct("station_id").alias("n_stations"))
    same = same_core(zones, fine, coarse, tolerance)
    twins = same.select(F.lit(fine).alias("level"), F.col("fine_id").alias("zone_id")).unionByName(same.select(F.lit(coarse).alias("level"), F.col("coarse_id").alias("zone_id"))).distinct()
    length = zones.where(F.col("level") == coarse).agg(F.max(F.length("code")).alias("_l"))
    children = zones.where(F.col("level") == fine).join(F.broadcast(length)).groupBy(F.expr("substring(code, 1, _l)").alias("code")).agg(F.count(F.lit(1)).alias("n_children"))
    full = zones.withColumn("inside", inside).join(n, ["level", "zone_id"], "left").join(twins.withColumn("_twin", F.lit(True)), ["level", "zone_id"], "left")
    full = full.join(children.withColumn("level", F.lit(coarse)), ["level", "code"], "left")
    full = full.withColumn("n_children", F.when(F.col("level") == coarse, F.coalesce("n_children", F.lit(0))))
    sets = F.array(F.struct(F.lit("all").alias("s"), F.lit(True).alias("k")), F.struct(F.lit("inside").alias("s"), F.col("inside").alias("k")), F.struct(F.lit("with_station").alias("s"), (F.col("n_stations") > 0).alias("k")))
    long = full.withColumn("_x", F.explode(sets)).where("_x.k").withColumn("zone_set", F.col("_x.s"))
    total = zones.groupBy("level").agg(F.count(F.lit(1)).alias("_all"))
    counted = long.groupBy("level", "zone_set").agg(F.coalesce(F.sum("n_stations"), F.lit(0)).alias("n_stations"), F.count("_twin").alias("n_same"), F.avg("n_children").alias("mean_children"))
    spread = quantiles(long, "area", [0.1, 0.5, 0.9], ["level", "zone_set"])
    out = spread.join(counted, ["level", "zone_set"]).join(total, "level")
    return out.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def depth_mean(layers: DataFrame, key: list[str], value: str, thickness: str, conversion: float = 1.0) -> DataFrame:
    """A10: thickness-weighted mean over depth layers, in converted units; null when any layer is."""
    mean = F.sum(F.col(value) * F.col(thickness)) / F.sum(thickness) / conversion
    return layers.groupBy(*key).agg(F.when(F.count(F.col(value) * F.col(thickness)) == F.count(F.lit(1)), mean).alias(value))


def block_mean(cells: DataFrame, value: str, factor: int, row: str = "lat_idx", col: str = "lon_idx") -> DataFrame:
    """Mean of factor x factor blocks, nulls left out."""
    return cells.groupBy(F.expr(f"{row} div {factor}").alias(row), F.expr(f"{col} div {factor}").alias(col)).agg(F.avg(value).alias(value))


def block_mode(cells: DataFrame, value: str, factor: int, nodata: list[int], row: str = "lat_idx", col: str = "lon_idx") -> DataFrame:
    """Most frequent class of a block (smallest on ties), nulls and 0 left out, ``nodata`` classes folded to null."""
    known = F.when(F.col(value) != 0, F.col(value))
    out = cells.groupBy(F.expr(f"{row} div {factor}").alias(row), F.expr(f"{col} div {factor}").alias(col)).agg(F.mode(known, True).alias(value))
    return out.withColumn(value, F.when(~F.col(value).isin(nodata), F.col(value))) if nodata else out


def class_distribution(df: DataFrame, code: str, labels: dict[int, str]) -> DataFrame:
    """Count and percent of each class with its label."""
    counts = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per class
    return counts.withColumn("percent", F.col("n") * 100.0 / total).withColumn("label", F.try_element_at(F.create_map(*pairs), F.col(code)))


def class_status(before: DataFrame, code: str, accepted: list[int], documented: list[int]) -> DataFrame:
    """Class histogram with status and the count that is left after cleaning."""
    status = F.when(F.col(code).isin(accepted), "kept").when(F.col(code) == 0, "zero").when(F.col(code).isin(documented), "documented").otherwise("unexpected")
    return before.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n_before")).withColumn("status", status).withColumn("n_after", F.when(F.col("status") == "kept", F.col("n_before")).otherwise(0))


def mask_crosstab(cells: DataFrame, fields: list[str], land: Column) -> DataFrame:
    """Zero, null, land and water combinations of each field; one scan."""
    rows = [F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNull() & land).alias("null_land"), F.count_if(F.col(f).isNull() & ~land).alias("null_water"), F.count_if((F.col(f) == 0) & land).alias("zero_land"), F.count_if((F.col(f) == 0) & ~land).alias("zero_water")) for f in fields]
    return cells.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def mask_disagreements(cells: DataFrame, fields: list[str]) -> DataFrame:
    """Cells where one of two fields is null and the other is not."""
    rows = [F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("n")) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    return cells.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def axis_alignment(axis: DataFrame, reference: DataFrame) -> DataFrame:
    """Size, ends, median step and largest deviation from the reference axis; tables (idx, coord)."""
    step = F.col("coord") - F.lag("coord").over(Window.orderBy("idx"))
    both = axis.withColumn("step", step).join(reference.select("idx", F.col("coord").alias("ref")), "idx", "left")
    return both.agg(F.count(F.lit(1)).alias("size"), F.min_by("coord", "idx").alias("first"), F.max_by("coord", "idx").alias("last"), F.median("step").alias("median_step"), F.max(F.abs(F.col("coord") - F.col("ref"))).alias("max_deviation"))


def profile(df: DataFrame, variables: list[str]) -> DataFrame:
    """N, min, max, mean and finite share of each variable; one scan, one row per variable."""
    rows = [F.struct(F.lit(v).alias("variable"), F.count(v).alias("n"), F.min(v).cast("double").alias("v_min"), F.max(v).cast("double").alias("v_max"), F.avg(v).alias("v_mean"), F.avg((F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).cast("double")).alias("finite_share")) for v in variables]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def null_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and percentage per column."""
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), (F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1))).alias("percent")) for c in columns]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def scaler(df: DataFrame, value: str, before: Column, key: str = "station_id") -> DataFrame:
    """Mean and population deviation before a cut; a zero deviation scales by 1."""
    v = F.when(before, F.col(value))
    std = F.stddev_pop(v)
    return df.groupBy(key).agg(F.avg(v).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))


def anomaly_stats(df: DataFrame, value: str, in_reference: Column, factor: float = 100.0, key: str = "station_id") -> DataFrame:
    """Reference mean and months, and the population deviation of the anomaly in converted units."""
    return df.groupBy(key).agg(F.avg(F.when(in_reference, F.col(value))).alias("ref_mean"), F.count(F.when(in_reference, F.col(value))).alias("n_ref"), (F.stddev_pop(value) * factor).alias("anomaly_std"))


def score_summary(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """A21."""
    known = scores.where(F.col(value).isNotNull())
    sums = known.groupBy(*keys).agg(F.min(value).alias("v_min"), F.avg(value).alias("v_mean"), F.max(value).alias("v_max"))
    mid = quantiles(known, value, [0.5], keys).withColumnRenamed("p50", "v_median")
    return _matched(mid, sums, keys, "inner").select(*keys, "v_min", "v_median", "v_mean", "v_max", "n")


def nse_class(value: Column) -> Column:
    """Class of an efficiency; edges 0, 0.5, 0.65 and 0.75 belong to the lower class."""
    return F.when(value <= 0, "unsatisfactory").when(value <= 0.5, "weak").when(value <= 0.65, "satisfactory").when(value <= 0.75, "good").when(value.isNotNull(), "very good")


def class_bins(scores: DataFrame, value: str = "score", key: str = "experiment") -> DataFrame:
    """Classes as columns."""
    names = ["unsatisfactory", "weak", "satisfactory", "good", "very good"]
    c = nse_class(F.col(value))
    return scores.groupBy(key).agg(*[F.count_if(c == n).alias(n.replace(" ", "_")) for n in names])


def driver_rollup(per_feature: DataFrame, value: str, driver: str = "driver") -> DataFrame:
    """A23."""
    return per_feature.groupBy(driver).agg(F.sum(value).alias("total"), F.max(value).alias("largest"), F.count(F.lit(1)).alias("n_features"))


def category_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted categories of each column."""
    rows = [F.struct(F.lit(c).alias("column"), F.array_sort(F.collect_set(F.col(c).cast("string"))).alias("categories")) for c in columns]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def ensemble(pred: DataFrame, keys: list[str], sim: str = "sim") -> DataFrame:
    """Median, mean and population deviation over members."""
    return pred.groupBy(*keys).agg(F.median(sim).alias("ens_median"), F.avg(sim).alias("ens_mean"), F.stddev_pop(sim).alias("ens_std"))


def cv_summary(scores: DataFrame, metric: str = "metric", fold: str = "fold", value: str = "score") -> DataFrame:
    """Medians per fold, then their mean, sample deviation, min and max."""
    folds = quantiles(scores, value, [0.5], [metric, fold]).withColumnRenamed("p50", "m")
    return folds.groupBy(metric).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.min("m").alias("v_min"), F.max("m").alias("v_max"))


def raster_ratio(zones: DataFrame, n_cells: str, cell_km2: str, area_km2: str, inside: float = 0.9) -> DataFrame:
    """Rasterised area over polygon area and whether the zone lies inside."""
    return zones.withColumn("ratio", F.try_divide(F.col(n_cells) * F.col(cell_km2), F.col(area_km2))).withColumn("inside", F.col("ratio") >= inside)
