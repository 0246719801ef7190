"""Column functions of the feature store: geometry, dates, names, codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in km, radius of the pixel-area sphere in m, km of one degree.
EARTH_RADIUS_KM = 6371.0088
SPHERE_RADIUS_M = 6371000.0
KM_PER_DEGREE = 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle distance in km of points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def pixel_area_m2(lat: Column, dlat: float, dlon: float) -> Column:
    """area of a cell centred at lat on a sphere."""
    north, south = F.radians(lat + dlat / 2), F.radians(lat - dlat / 2)
    return F.lit(SPHERE_RADIUS_M**2) * F.radians(F.lit(float(dlon))) * F.abs(F.sin(north) - F.sin(south))


def cell_metrics(lat: Column, dlat: float, dlon: float) -> dict[str, Column]:
    """cell height and width in m and area in hectares."""
    metre = KM_PER_DEGREE * 1000
    dy = F.lit(abs(dlat) * metre)
    dx = F.lit(abs(dlon) * metre) * F.cos(F.radians(lat))
    return {"dy_m": dy, "dx_m": dx, "area_ha": dy * dx / 10000}


def auto_radius_km(res_deg: Column) -> Column:
    """search radius of two cells, 3 km at least; 0 without a resolution."""
    return F.when(F.coalesce(res_deg, F.lit(0.0)) > 0, F.round(F.greatest(res_deg * 2 * KM_PER_DEGREE, F.lit(3.0)), 3)).otherwise(0.0)


def month_start(d: Column) -> Column:
    """first day of the month."""
    return F.trunc(d.cast("date"), "MM")


def month_end(d: Column) -> Column:
    """last day of the month."""
    return F.last_day(d.cast("date"))


def days_since_epoch(d: Column) -> Column:
    """days since 1970-01-01."""
    return F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def months_since_change(year: Column, month: Column, change_year: Column) -> Column:
    """months since January of the change year, -1 when there was none."""
    return F.coalesce((year - change_year) * 12 + (month - 1), F.lit(-1)).cast("int")


def decode_seconds(value: Column, units: Column) -> Column:
    """timestamp of an offset whose text is like "seconds since 2002-04-17 00:00:00"."""
    origin = F.to_timestamp(F.regexp_extract(units, r"since\s+(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.timestamp_seconds(F.unix_timestamp(origin) + value.cast("long"))


def sanitize(name: Column) -> Column:
    """F8: characters outside letters, digits and _ become _."""
    return F.regexp_replace(name, "[^0-9A-Za-z_]", "_")


def depth_label(depth: Column) -> Column:
    """shortest decimal text with p for the point and m for minus (0.05 is 0p05, 2.0 is 2)."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", depth.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.replace(F.replace(text, F.lit("."), F.lit("p")), F.lit("-"), F.lit("m"))


def group_name(column: str) -> str:
    """F10 for a column's own name, on the driver."""
    if "__" not in column:
        return "other"
    head = column.split("__")[0]
    return "lcc" if head == "C3S" else head


def feature_group(column: Column) -> Column:
    """dataset of a column name: what stands before "__"; C3S is lcc; other without a prefix."""
    head = F.split_part(column, F.lit("__"), F.lit(1))
    return F.when(~column.contains("__"), F.lit("other")).when(head == "C3S", F.lit("lcc")).otherwise(head)


def prettify(name: Column) -> Column:
    """blanks for underscores, first letter in upper case."""
    text = F.trim(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def base_column(name: Column, known: list[str]) -> Column:
    """column that a lag or trailing-mean feature was made of, else the name itself."""
    cand = F.regexp_replace(name, r"_(lag\d+|rmean\d+)$", "")
    return F.when(cand.isin(known), cand).otherwise(name)


def window_label(name: Column) -> Column:
    """lag3, rmean12 or static."""
    found = F.regexp_extract(name, r"_(lag\d+|rmean\d+)$", 1)
    return F.when(found != "", found).otherwise("static")


def core_basin_id(basin_id: Column) -> Column:
    """digit 1 and digits 4 to 10 of a ten-digit id."""
    text = basin_id.cast("string")
    return F.concat(F.substring(text, 1, 1), F.substring(text, 4, 7)).cast("long")


def category_text(code: Column) -> Column:
    """category as text, "missing" for null."""
    return F.coalesce(code.cast("string"), F.lit("missing"))


def round_code(value: Column) -> Column:
    """F16: integer code rounded half to even."""
    return F.rint(value.cast("double")).cast("int")


def terrain(dz_dx: Column, dz_dy: Column, acc: Column, area_ha: Column) -> dict[str, Column]:
    """slope in degrees, aspect from north (null when flatter than 0.001 degrees), wetness index."""
    slope = F.degrees(F.atan(F.sqrt(dz_dx * dz_dx + dz_dy * dz_dy)))
    aspect = F.when(slope >= 0.001, F.pmod(F.lit(90.0) - F.degrees(F.atan2(-dz_dy, -dz_dx)), F.lit(360.0)))
    wet = F.ln(acc * area_ha / F.tan(F.radians(F.greatest(slope, F.lit(0.1)))))
    return {"slope": slope, "aspect": aspect, "twi": wet}


def skill_score(model: Column, benchmark: Column) -> Column:
    """gain over a benchmark, null when the benchmark is perfect."""
    return F.try_divide(model - benchmark, F.lit(1.0) - benchmark)


def truthy(text: Column) -> Column:
    """whether a text means true."""
    return F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes")


def product_version(year: Column, since: int, new: str, old: str) -> Column:
    """product release by year."""
    return F.when(year >= since, new).otherwise(old)


def valid_value(value: Column, fill: float | None = None) -> Column:
    """Null for the fill value, NaN and infinities."""
    v = value.cast("double")
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok if fill is None else ok & (v != F.lit(float(fill))), v)


def null_count(columns: list[str]) -> Column:
    """Nulls in a row over the given columns."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns], F.lit(0))
