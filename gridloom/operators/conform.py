"""Schema and grid conformance: renames, orientation, fills, filters, codes, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import valid_value
from gridloom.operators.windows import value_positions

# Accepted spellings of coordinate names.
COORDINATE_NAMES = {"latitude": "lat", "y": "lat", "longitude": "lon", "x": "lon", "valid_time": "time"}


def rename_coordinates(df: DataFrame) -> DataFrame:
    """P1."""
    return df.withColumnsRenamed({k: v for k, v in COORDINATE_NAMES.items() if k in df.columns and v not in df.columns})


def axis_table(df: DataFrame, coord: str, descending: bool) -> DataFrame:
    """(coord, idx) of an axis; distinct coordinates are numbered by range partitions."""
    axis = df.select(coord).where(F.col(coord).isNotNull()).distinct()
    place = value_positions(axis.select((-F.col(coord) if descending else F.col(coord)).alias("_c")), "_c", [])
    return place.select((-F.col("_c") if descending else F.col("_c")).alias(coord), F.col("_before").cast("int").alias("idx"))


def orient(df: DataFrame) -> DataFrame:
    """lat_idx from north to south and lon_idx from west to east."""
    lat = axis_table(df, "lat", True).withColumnRenamed("idx", "lat_idx")
    lon = axis_table(df, "lon", False).withColumnRenamed("idx", "lon_idx")
    return df.join(lat, "lat").join(lon, "lon")


def orientation_report(df: DataFrame, coord: str, position: str) -> DataFrame:
    """First and last coordinate by stored position, and the direction."""
    ends = df.agg(F.min_by(coord, position).alias("first"), F.max_by(coord, position).alias("last"))
    return ends.withColumn("direction", F.when(F.col("first") < F.col("last"), "ascending").otherwise("descending"))


def fills_to_null(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    """Each variable's fill value, NaN and infinities become null."""
    return df.withColumns({c: valid_value(F.col(c), f) for c, f in fills.items()})


def fill_report(catalog: DataFrame) -> DataFrame:
    """Variables with a warning for integer ones without a declared fill. catalog: variable, dtype, fill."""
    integer = F.lower("dtype").rlike("^(u?int|short|byte|bigint)")
    return catalog.withColumn("warning", F.when(integer & F.col("fill").isNull(), "integer without fill"))


def missing_metadata(catalog: DataFrame, required: list[str]) -> DataFrame:
    """P5: (variable, key) of required keys that are absent or empty. catalog: variable, key, value."""
    wanted = catalog.select("variable").distinct().withColumn("key", F.explode(F.array(*[F.lit(k) for k in required])))
    return wanted.join(catalog.where("value is not null and trim(value) <> ''"), ["variable", "key"], "left_anti")


def bounds(df: DataFrame, time: str | None = None) -> DataFrame:
    """Bounding box, and first and last time."""
    aggs = [f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(*aggs, *([F.min(time).alias("t_first"), F.max(time).alias("t_last")] if time else []))


def bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Inclusive bounding-box filter, pushed down to the scan."""
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def in_months(time: Column, start: str | None, end: str | None) -> Column:
    """Start month to end month ("YYYY-MM"), the whole end month included."""
    cond = F.lit(True)
    if start:
        cond = cond & (time >= F.lit(f"{start}-01").cast("date"))
    if end:
        cond = cond & (time < F.add_months(F.lit(f"{end}-01").cast("date"), 1))
    return cond


def wrap_longitude(lon: Column) -> Column:
    """Longitudes of a 0..360 axis on -180..180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def wrap_longitudes(df: DataFrame, lon: str = "lon") -> DataFrame:
    """0..360 to -180..180 when the axis goes beyond 180; others stay as they are (so 180 and -180 stay apart)."""
    top = df.agg(F.max(lon).alias("_top"))  # one row
    wrapped = F.when(F.col("_top") > 180, wrap_longitude(F.col(lon))).otherwise(F.col(lon))
    return df.join(F.broadcast(top)).withColumn(lon, wrapped).drop("_top")


def squeeze(df: DataFrame, dim: str) -> DataFrame:
    """P10: keep index 0 of a dimension and drop it."""
    return df.where(F.col(dim) == 0).drop(dim)


def clean_codes(code: Column, accepted: list[int], keep_zero: bool = False) -> Column:
    """Round half to even and keep listed codes; others are null."""
    c = F.rint(code.cast("double")).cast("int")
    return F.when(c.isin([*accepted, *([0] if keep_zero else [])]), c)


def code_report(df: DataFrame, code: str, accepted: list[int]) -> DataFrame:
    """Kept, zero and unexpected codes."""
    c = F.rint(F.col(code).cast("double")).cast("int")
    kept, zero = c.isin(accepted), c == 0
    return df.agg(F.count_if(kept).alias("n_kept"), F.count_if(zero & ~kept).alias("n_zero"), F.count_if(c.isNotNull() & ~kept & ~zero).alias("n_unexpected"))


def scale_units(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Multiply variables by their factor."""
    return df.withColumns({c: F.col(c) * F.lit(float(f)) for c, f in factors.items() if c in df.columns})


def plausibility(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Min, mean, max of each variable and whether it stays in the expected range; one scan, one row per variable."""
    aggs = [F.struct(F.lit(v).alias("variable"), F.min(v).cast("double").alias("v_min"), F.avg(v).alias("v_mean"), F.max(v).cast("double").alias("v_max"), ((F.min(v) >= lo) & (F.max(v) <= hi)).alias("in_range")) for v, (lo, hi) in ranges.items()]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def map_codes(value: Column, codes: dict[str, int]) -> Column:
    """Class text to code, null when unknown."""
    pairs = [x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), value)


def pick_columns(df: DataFrame, wanted: dict[str, list[str]], prefix: str = "", keys: list[str] | None = None) -> DataFrame:
    """Short names for the first listed spelling that is present; absent ones are left out."""
    have = [(short, next((c for c in names if c in df.columns), None)) for short, names in wanted.items()]
    return df.select(*(keys or []), *[F.col(c).alias(prefix + short) for short, c in have if c])


def to_numeric(df: DataFrame, columns: list[str], drop: list[str] | None = None) -> DataFrame:
    """Drop columns, cast others to double with null for what is no number."""
    return df.drop(*(drop or [])).withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns if c in df.columns})


def canonical_id(value: Column, prefix: str = "MW_") -> Column:
    """The prefix is added where it is missing."""
    text = F.trim(value.cast("string"))
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def columns_by_role(meta: DataFrame) -> dict[str, list[str]]:
    """Column names by role, in metadata order. meta: position, column, role; as many rows as a table has columns."""
    rows = meta.select("position", "column", "role").orderBy("position").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.role, []).append(r.column)
    return out


def date_split(time: Column, stop_start: str, test_start: str) -> Column:
    """Train, stop or test."""
    return F.when(time < F.lit(stop_start).cast("date"), "train").when(time < F.lit(test_start).cast("date"), "stop").otherwise("test")


def fold_rotations(df: DataFrame, fold: str, k: int, offset: int = 1) -> DataFrame:
    """P20: every row once per rotation: fold r is test, (r + offset) mod k validation, the rest train."""
    turns = df.withColumn("rotation", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    role = F.when(F.col(fold) == F.col("rotation"), "test").when(F.col(fold) == (F.col("rotation") + offset) % k, "val").otherwise("train")
    return turns.withColumn("role", role)


def with_min_history(df: DataFrame, key: str, least: int, counted: Column | None = None) -> DataFrame:
    """Rows of keys that have ``least`` counted rows (nulls in values included)."""
    enough = df.groupBy(key).agg(F.count_if(counted if counted is not None else F.lit(True)).alias("_n")).where(F.col("_n") >= least)
    return df.join(enough.select(key), key, "left_semi")
