"""Queries over grids, zones and polygons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import aggregates as A
from gridloom.operators import conform as P
from gridloom.operators import joins as J
from gridloom.operators import spatial as G
from gridloom.operators import windows as W
from gridloom.plans.registry import query
from gridloom.plans.series import r6
from gridloom.plans.standins import RES, UNIT, Tables
from gridloom.sources.shared import shared_dir
from gridloom.sources.tables import read_grid, write_clustered_grid

HAV = "2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


@query("p1_rename_coordinates", sql="SELECT s_suppkey, CAST(s_suppkey * 37 % 850 AS DOUBLE) AS lat, CAST(s_suppkey * 91 % 1000 AS DOUBLE) AS lon FROM supplier")
def p1(t: Tables):
    k = F.col("s_suppkey")
    return P.rename_coordinates(t.read("supplier").select("s_suppkey", (k * 37 % 850).cast("double").alias("latitude"), (k * 91 % 1000).cast("double").alias("x")))


@query("p2_orientation", "grid", "SELECT cell_id, CAST(dense_rank() OVER (ORDER BY lat DESC) - 1 AS INTEGER) AS lat_idx, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INTEGER) AS lon_idx FROM grid")
def p2(t: Tables):
    return P.orient(t.grid.select("cell_id", "lat", "lon")).select("cell_id", "lat_idx", "lon_idx")


@query("p2_orientation_report", "grid", "SELECT max(lat) AS first, min(lat) AS last, CASE WHEN max(lat) > min(lat) THEN 'descending' ELSE 'descending' END AS direction FROM grid")
def p2_report(t: Tables):
    return P.orientation_report(t.grid, "lat", "lat_idx")


@query("p3_fill_to_null", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <> 25 THEN l_quantity END AS l_quantity, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem")
def p3(t: Tables):
    li = t.read("lineitem").withColumn("ratio", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_discount", "l_tax")))
    return P.fills_to_null(li, {"l_quantity": 25.0, "ratio": None}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "ratio")


@query("p4_fill_report", sql="SELECT p_name AS variable, CASE WHEN p_size % 2 = 0 THEN 'int16' ELSE 'float32' END AS dtype, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS fill, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'integer without fill' END AS warning FROM part")
def p4(t: Tables):
    c = t.read("part").select(F.col("p_name").alias("variable"), F.when(F.col("p_size") % 2 == 0, "int16").otherwise("float32").alias("dtype"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")).alias("fill"))
    return P.fill_report(c)


@query("p5_missing_metadata", sql="WITH v AS (SELECT p_partkey AS variable, CASE p_partkey % 3 WHEN 0 THEN 'units' WHEN 1 THEN 'long_name' ELSE 'source' END AS key, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS value FROM part), w AS (SELECT variable, unnest(['units', 'long_name']) AS key FROM v) SELECT w.variable, w.key FROM w ANTI JOIN (SELECT * FROM v WHERE value <> '') x ON x.variable = w.variable AND x.key = w.key")
def p5(t: Tables):
    k = F.col("p_partkey") % 3
    c = t.read("part").select(F.col("p_partkey").alias("variable"), F.when(k == 0, "units").when(k == 1, "long_name").otherwise("source").alias("key"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_brand")).alias("value"))
    return P.missing_metadata(c, ["units", "long_name"])


@query("p6_bounds", "grid", "SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM grid WHERE value IS NOT NULL")
def p6(t: Tables):
    return P.bounds(t.grid.where("value is not null"))


@query("p7_bbox", "grid", "SELECT cell_id, value FROM grid WHERE lat BETWEEN 54.9 AND 55.3 AND lon BETWEEN 8 AND 12.5")
def p7(t: Tables):
    return P.bbox(t.grid, 8.0, 54.9, 12.5, 55.3).select("cell_id", "value")


@query("p9_wrap_longitude", sql="WITH x AS (SELECT s_suppkey, CAST(s_suppkey * 91 % 360 AS DOUBLE) AS lon FROM supplier), m AS (SELECT max(lon) AS top FROM x) SELECT s_suppkey, CASE WHEN top > 180 AND lon >= 180 THEN lon - 360 ELSE lon END AS lon FROM x CROSS JOIN m")
def p9(t: Tables):
    return P.wrap_longitudes(t.read("supplier").select("s_suppkey", (F.col("s_suppkey") * 91 % 360).cast("double").alias("lon")))


@query("p9_short_axis_stays", sql="SELECT s_suppkey, CAST(s_suppkey % 361 - 180 AS DOUBLE) AS lon FROM supplier")
def p9_short(t: Tables):
    # an axis from -180 to 180 stays as it is
    return P.wrap_longitudes(t.read("supplier").select("s_suppkey", (F.col("s_suppkey") % 361 - 180).cast("double").alias("lon")))


@query("p10_squeeze", sql="SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber - 1 = 0")
def p10(t: Tables):
    li = t.read("lineitem").withColumn("expver", F.col("l_linenumber") - 1)
    return P.squeeze(li, "expver").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query("p11_clean_codes", sql="SELECT p_partkey, CASE WHEN CAST(round_even(CAST(p_size AS DOUBLE) / 4, 0) AS INTEGER) IN (1, 2, 4, 8) THEN CAST(round_even(CAST(p_size AS DOUBLE) / 4, 0) AS INTEGER) END AS code FROM part")
def p11(t: Tables):
    return t.read("part").select("p_partkey", P.clean_codes(F.col("p_size") / 4, [1, 2, 4, 8]).alias("code"))


@query("p11_code_report", sql="WITH c AS (SELECT CAST(round_even(CAST(p_size AS DOUBLE) / 4, 0) AS INTEGER) AS c FROM part) SELECT count(*) FILTER (WHERE c IN (1, 2, 4, 8)) AS n_kept, count(*) FILTER (WHERE c = 0) AS n_zero, count(*) FILTER (WHERE c NOT IN (0, 1, 2, 4, 8)) AS n_unexpected FROM c")
def p11_report(t: Tables):
    return P.code_report(t.read("part").withColumn("q", F.col("p_size") / 4), "q", [1, 2, 4, 8])


@query("p12_unit_scaling", sql="SELECT p_partkey, round(p_retailprice * 1000, 3) AS p_retailprice FROM part")
def p12(t: Tables):
    return P.scale_units(t.read("part"), {"p_retailprice": 1000.0, "absent": 2.0}).select("p_partkey", F.round("p_retailprice", 3).alias("p_retailprice"))


@query("p13_plausibility", sql="SELECT 'l_quantity' AS variable, min(l_quantity) AS v_min, round(avg(l_quantity), 6) AS v_mean, max(l_quantity) AS v_max, min(l_quantity) >= 0 AND max(l_quantity) <= 100 AS in_range FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount), round(avg(l_discount), 6), max(l_discount), min(l_discount) >= 0.01 AND max(l_discount) <= 1 FROM lineitem")
def p13(t: Tables):
    return P.plausibility(t.read("lineitem"), {"l_quantity": (0, 100), "l_discount": (0.01, 1)}).withColumn("v_mean", F.round("v_mean", 6))


@query("p14_map_codes", sql="SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 11 WHEN '5-LOW' THEN 15 END AS code FROM orders")
def p14(t: Tables):
    return t.read("orders").select("o_orderkey", P.map_codes(F.col("o_orderpriority"), {"1-URGENT": 11, "5-LOW": 15}).alias("code"))


@query("p15_pick_columns", sql="SELECT s_suppkey, s_acctbal AS basin_area, s_nationkey AS basin_coast FROM supplier")
def p15(t: Tables):
    return P.pick_columns(t.read("supplier"), {"area": ["SUB_AREA", "s_acctbal"], "coast": ["s_nationkey", "s_name"], "order": ["ORDER_"]}, "basin_", ["s_suppkey"])


@query("p16_to_numeric", sql="SELECT o_orderkey, TRY_CAST(replace(o_orderpriority, '-LOW', '') AS DOUBLE) AS x FROM orders")
def p16(t: Tables):
    o = t.read("orders").select("o_orderkey", F.replace(F.col("o_orderpriority"), F.lit("-LOW"), F.lit("")).alias("x"), "o_orderstatus")
    return P.to_numeric(o, ["x"], ["o_orderstatus"])


@query("p17_canonical_id", sql="SELECT s_suppkey, 'MW_' || s_suppkey AS id FROM supplier")
def p17(t: Tables):
    k = F.col("s_suppkey").cast("string")
    return t.read("supplier").select("s_suppkey", P.canonical_id(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" MW_"), k)).otherwise(k)).alias("id"))


@query("p18_columns_by_role", sql="SELECT s_suppkey, s_acctbal FROM supplier")
def p18(t: Tables):
    meta = t.read("nation").where("n_nationkey < 2").select(F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") == 0, "s_suppkey").otherwise("s_acctbal").alias("column"), F.when(F.col("n_nationkey") == 0, "id").otherwise("static").alias("role"))
    roles = P.columns_by_role(meta)
    return t.read("supplier").select(*roles["id"], *roles["static"])


_CHOSEN = """, homes AS (SELECT station_id, lat, lon, CAST(greatest(0, least((SELECT max(lat_idx) FROM grid), floor((55.5::DOUBLE - lat) / 0.025::DOUBLE + 0.5))) AS INTEGER) AS y, CAST(greatest(0, least(400, ceil((lon - 5.5::DOUBLE) / 0.025::DOUBLE - 0.5))) AS INTEGER) AS x FROM station),
ok AS (SELECT lat_idx, lon_idx FROM grid WHERE value IS NOT NULL),
h AS (SELECT s.*, o.lat_idx IS NOT NULL AS valid FROM homes s LEFT JOIN ok o ON o.lat_idx = y AND o.lon_idx = x)"""
_CELL = "(55.5::DOUBLE - {y} * 0.025::DOUBLE)", "(5.5::DOUBLE + {x} * 0.025::DOUBLE)"


def _dist(y: str, x: str) -> str:
    return hav("h.lat", "h.lon", _CELL[0].format(y=y), _CELL[1].format(x=x))


def _sampled(radius: float, policy: str) -> str:
    lost = {"skip_well": "'dropped'", "keep_nan": "'no_valid'"}.get(policy)
    sql = _CHOSEN + f""", r AS (SELECT h.station_id, o.lat_idx, o.lon_idx, {_dist('o.lat_idx', 'o.lon_idx')} AS d FROM h JOIN ok o ON abs(o.lat_idx - y) <= 5 AND abs(o.lon_idx - x) <= 5 WHERE NOT valid),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, lat_idx, lon_idx) AS k FROM r WHERE d <= {radius}) WHERE k = 1)"""
    if policy == "nearest_global":
        sql += f""", g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, lat_idx, lon_idx) AS k FROM (SELECT h.station_id, o.lat_idx, o.lon_idx, {_dist('o.lat_idx', 'o.lon_idx')} AS d FROM h CROSS JOIN ok o WHERE NOT valid)) WHERE k = 1)
SELECT h.station_id, CASE WHEN valid THEN y ELSE coalesce(b.lat_idx, g.lat_idx) END AS lat_idx, CASE WHEN valid THEN x ELSE coalesce(b.lon_idx, g.lon_idx) END AS lon_idx, round(CASE WHEN valid THEN {_dist('y', 'x')} ELSE coalesce(b.d, g.d) END, 6) AS dist_km, CASE WHEN valid THEN 'home' WHEN b.d IS NOT NULL THEN 'rescued' ELSE 'nearest_global' END AS outcome, true AS keep FROM h LEFT JOIN b USING (station_id) LEFT JOIN g USING (station_id)"""
        return sql
    return sql + f""" SELECT h.station_id, CASE WHEN valid THEN y ELSE b.lat_idx END AS lat_idx, CASE WHEN valid THEN x ELSE b.lon_idx END AS lon_idx, round(CASE WHEN valid THEN {_dist('y', 'x')} ELSE b.d END, 6) AS dist_km, CASE WHEN valid THEN 'home' WHEN b.d IS NOT NULL THEN 'rescued' ELSE {lost} END AS outcome, {'valid OR b.d IS NOT NULL' if policy == 'skip_well' else 'true'} AS keep FROM h LEFT JOIN b USING (station_id)"""


def chosen_cte(radius: float, policy: str) -> str:
    """The chosen cells, not rounded, as the table ch."""
    sql = _sampled(radius, policy)
    at = sql.rindex(" SELECT h.station_id, CASE WHEN valid")
    return sql[:at] + ", ch AS (" + sql[at + 1 :].replace("round(CASE WHEN valid", "(CASE WHEN valid").replace(", 6) AS dist_km", ") AS dist_km") + ")"


def _choose(t: Tables, radius: float, policy: str):
    got = G.choose_cells(t.station, t.grid.where("value is not null"), t.axes, radius, policy)
    return got.select("station_id", "lat_idx", "lon_idx", *r6("dist_km"), "outcome", "keep")


@query("g1_sample_skip_well", "station grid", _sampled(2.0, "skip_well"))
def g1_skip(t: Tables):
    return _choose(t, 2.0, "skip_well")


@query("g1_sample_keep_nan", "station grid", _sampled(2.5, "keep_nan"))
def g1_keep(t: Tables):
    return _choose(t, 2.5, "keep_nan")


@query("g1_sample_nearest_global", "station grid", _sampled(1.0, "nearest_global"))
def g1_global(t: Tables):
    return _choose(t, 1.0, "nearest_global")


@query("j5_nearest_cell", "station grid", _CHOSEN + " SELECT station_id, y AS lat_idx, x AS lon_idx FROM h")
def j5(t: Tables):
    return t.axes.home(t.station).select("station_id", "lat_idx", "lon_idx")


@query("j5_nearest_irregular", sql="WITH a AS (SELECT CAST(row_number() OVER (ORDER BY p_retailprice) - 1 AS INTEGER) AS idx, p_retailprice AS coord FROM (SELECT DISTINCT p_retailprice FROM part)), b AS (SELECT idx, coord, (coord + lag(coord) OVER (ORDER BY coord)) / 2 AS lo, (coord + lead(coord) OVER (ORDER BY coord)) / 2 AS hi FROM a) SELECT s_suppkey, b.idx FROM supplier JOIN b ON (lo IS NULL OR s_acctbal > lo) AND (hi IS NULL OR s_acctbal <= hi)")
def j5_irregular(t: Tables):
    axis = P.axis_table(t.read("part").select(F.col("p_retailprice").alias("coord")), "coord", False)
    return J.nearest_on_axis(t.read("supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", axis, "idx", 50.0).select("s_suppkey", "idx")


@query("j6_nearest_valid_cell", "station grid", _CHOSEN + f", r AS (SELECT h.station_id, o.lat_idx, o.lon_idx, {_dist('o.lat_idx', 'o.lon_idx')} AS d FROM h JOIN ok o ON abs(o.lat_idx - y) <= 5 AND abs(o.lon_idx - x) <= 5 WHERE NOT valid) SELECT station_id, lat_idx, lon_idx, round(d, 6) AS dist_km FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, lat_idx, lon_idx) AS k FROM r WHERE d <= 3.0) WHERE k = 1")
def j6(t: Tables):
    got = G.choose_cells(t.station, t.grid.where("value is not null"), t.axes, 3.0, "keep_nan")
    return got.where("rescued").select("station_id", "lat_idx", "lon_idx", *r6("dist_km"))


@query("j7_nearest_any_cell", "station grid", _sampled(0.0, "nearest_global"))
def j7(t: Tables):
    return _choose(t, 0.0, "nearest_global")


_GLOBE = f""", h AS (SELECT s.*, greatest(0, least(359, floor((lat - 89.75::DOUBLE) / -0.5::DOUBLE + 0.5::DOUBLE)))::INTEGER AS y, (CAST(ceil((lon + 179.75::DOUBLE) / 0.5::DOUBLE - 0.5::DOUBLE) AS INTEGER) + 720) % 720 AS x FROM globe_station s),
d AS (SELECT h.station_id, g.lat_idx, g.lon_idx, {hav('h.lat', 'h.lon', '(89.75::DOUBLE - 0.5::DOUBLE * g.lat_idx)', '(-179.75::DOUBLE + 0.5::DOUBLE * g.lon_idx)')} AS d, g.lat_idx = y AND g.lon_idx = x AS home FROM h CROSS JOIN globe g),
k AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY home DESC, d, lat_idx, lon_idx) AS k FROM d)
SELECT station_id, lat_idx, lon_idx, round(d, 6) AS dist_km, CASE WHEN home THEN 'home' ELSE 'nearest_global' END AS outcome FROM k WHERE k = 1"""


@query("g1_nearest_on_the_globe", "globe globe_station", _GLOBE)
def g1_globe(t: Tables):
    got = G.choose_cells(t.globe_station, t.globe, t.globe_axes, 0.0, "nearest_global")
    return got.select("station_id", "lat_idx", "lon_idx", *r6("dist_km"), "outcome")


@query("j8_gather_values", "station grid", _CHOSEN + " SELECT h.station_id, g.value, g.code FROM h LEFT JOIN grid g ON g.lat_idx = y AND g.lon_idx = x")
def j8(t: Tables):
    return G.gather(t.axes.home(t.station), t.grid, ["value", "code"])


@query("s6_grid_bbox_scan", "station grid", "SELECT g.cell_id, g.value FROM grid g, (SELECT min(lat) - m AS a, max(lat) + m AS b, min(lon) - m AS c, max(lon) + m AS d FROM station, (SELECT 3.0::DOUBLE / 111.32::DOUBLE + 3 * 0.025::DOUBLE AS m) WHERE zone2 = 1 GROUP BY m) WHERE g.lat BETWEEN a AND b AND g.lon BETWEEN c AND d")
def s6(t: Tables):
    return read_grid(t.grid, ["value"], t.station.where("zone2 = 1"), 3.0, RES, ["cell_id"])


@query("s6_clustered_grid_scan", "station grid", "SELECT g.cell_id, g.value FROM grid g, (SELECT min(lat) - m AS a, max(lat) + m AS b, min(lon) - m AS c, max(lon) + m AS d FROM station, (SELECT 3.0::DOUBLE / 111.32::DOUBLE + 3 * 0.025::DOUBLE AS m) WHERE lat > 54 AND lon < 9 GROUP BY m) WHERE g.lat BETWEEN a AND b AND g.lon BETWEEN c AND d")
def s6_clustered(t: Tables):
    """The grid written in the order of a space-filling key; the stations' box reaches the scan as pushed filters."""
    grid = write_clustered_grid(t.grid.select("cell_id", "lat_idx", "lon_idx", "lat", "lon", "value"), f"{shared_dir(t.spark)}/clustered-{uuid.uuid4().hex}", 1 << 16)
    return read_grid(grid, ["value"], t.station.where("lat > 54 and lon < 9"), 3.0, RES, ["cell_id"])


def _boxes(t: Tables):
    n = t.read("nation").select(F.col("n_nationkey").alias("poly_id"))
    x0, y0 = F.col("poly_id") % 5 * 2 + 5.5, F.expr("poly_id div 5") * 1.7 + 47.0
    corner = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x0 + 2, y0), (x0 + 2, y0 + 1.7), (x0, y0 + 1.7))]
    return n.select("poly_id", F.array(*corner).alias("ring"))


_BOX = ", box AS (SELECT n_nationkey AS poly_id, n_nationkey % 5 * 2 + 5.5::DOUBLE AS x0, n_nationkey // 5 * 1.7::DOUBLE + 47.0::DOUBLE AS y0 FROM nation)"


@query("j4_point_in_polygon", "station", _BOX + " SELECT s.station_id, min(poly_id) AS poly_id FROM station s LEFT JOIN box ON lon BETWEEN x0 AND x0 + 2 AND lat BETWEEN y0 AND y0 + 1.7::DOUBLE GROUP BY 1")
def j4(t: Tables):
    return J.points_in_polygons(t.station, _boxes(t)).select("station_id", "poly_id")


@query("g2_rasterise", "grid", _BOX + " SELECT g.cell_id, coalesce(max(poly_id), 0) AS poly_id FROM grid g LEFT JOIN box ON lon BETWEEN x0 AND x0 + 2 AND lat BETWEEN y0 AND y0 + 1.7::DOUBLE GROUP BY 1")
def g2(t: Tables):
    return G.rasterise(t.grid, _boxes(t)).select("cell_id", "poly_id")


@query("g3_oversampled_mode", "grid", _BOX + """, fi AS (SELECT lat_idx * 5 + a AS r, lon_idx * 5 + b AS c, (55.5::DOUBLE + lat_idx * -0.025::DOUBLE) + ((a + 0.5::DOUBLE) / 5 - 0.5::DOUBLE) * -0.025::DOUBLE AS lat, (5.5::DOUBLE + lon_idx * 0.025::DOUBLE) + ((b + 0.5::DOUBLE) / 5 - 0.5::DOUBLE) * 0.025::DOUBLE AS lon FROM grid CROSS JOIN range(5) x(a) CROSS JOIN range(5) y(b)),
pf AS (SELECT r, c, max(poly_id) AS p FROM fi JOIN box ON lon BETWEEN x0 AND x0 + 2 AND lat BETWEEN y0 AND y0 + 1.7::DOUBLE GROUP BY 1, 2),
nn AS (SELECT r // 5 AS lat_idx, c // 5 AS lon_idx, p, row_number() OVER (PARTITION BY r // 5, c // 5 ORDER BY count(*) DESC, p) AS k FROM pf WHERE p <> 0 GROUP BY 1, 2, 3)
SELECT g.lat_idx, g.lon_idx, CASE WHEN p <> 16 THEN p END AS poly_id FROM grid g LEFT JOIN nn ON nn.lat_idx = g.lat_idx AND nn.lon_idx = g.lon_idx AND k = 1""")
def g3(t: Tables):
    return G.oversampled_mode(t.grid, t.axes, 5, _boxes(t), [16])


@query("g4_grid_generation", "grid", "SELECT CAST(r AS INTEGER) AS lat_idx, CAST(c AS INTEGER) AS lon_idx, round(55.5 - r * 0.025, 6) AS lat, round(5.5 + c * 0.025, 6) AS lon FROM range(0, (SELECT max(lat_idx) + 1 FROM grid)) a(r) CROSS JOIN range(401) b(c)")
def g4(t: Tables):
    return G.make_grid(t.spark, t.axes).select("lat_idx", "lon_idx", *r6("lat", "lon"))


_MASK = ", mask AS (SELECT cell_id, v1 IS NOT NULL AND v2 IS NOT NULL AS ok, v1 IS NOT NULL AS ok1, v2 IS NOT NULL AS ok2 FROM grid_month WHERE time = (SELECT min(time) FROM grid_month))"


def _zonal(ok1: str, ok2: str) -> str:
    def mean(v: str, ok: str) -> str:
        return f"round(CASE WHEN coalesce(max(CASE WHEN {ok} THEN CAST({v} IS NULL AS INTEGER) END), 0) = 0 THEN sum(CASE WHEN {ok} THEN {v} * area_m2 END) / sum(CASE WHEN {ok} THEN area_m2 END) END, 6) AS {v}"

    return _MASK + f" SELECT zone_id, time, {mean('v1', ok1)}, {mean('v2', ok2)} FROM grid_month JOIN mask USING (cell_id) GROUP BY 1, 2"


@query("a2_zonal_means", "grid_month", _zonal("ok", "ok"))
def a2(t: Tables):
    m = A.valid_cells(t.grid_month, ["v1", "v2"], "time")
    return A.zonal_means(t.grid_month, m, ["v1", "v2"]).select("zone_id", "time", *r6("v1", "v2"))


@query("g9_zone_series", "grid_month", _zonal("ok1", "ok2"))
def g9(t: Tables):
    m = A.valid_cells(t.grid_month, ["v1", "v2"], "time", shared=False)
    return A.zonal_means(t.grid_month, m, ["v1", "v2"]).select("zone_id", "time", *r6("v1", "v2"))


PRODUCTS = {"p1": ["v1"], "p2": ["v2"], "both": ["v1", "v2"]}


def _products_sql() -> str:
    parts = []
    for name, vs in PRODUCTS.items():
        ok = {"p1": "ok1", "p2": "ok2", "both": "ok"}[name]
        for v in vs:
            for level, zone in (("zone_id", "zone_id"), ("band", "CAST(zone_id // 100 AS INTEGER)")):
                mean = f"CASE WHEN coalesce(max(CASE WHEN {ok} THEN CAST({v} IS NULL AS INTEGER) END), 0) = 0 THEN sum(CASE WHEN {ok} THEN {v} * area_m2 END) / sum(CASE WHEN {ok} THEN area_m2 END) END"
                parts.append(f"SELECT '{name}' AS product, '{v}' AS variable, '{level}' AS level, {zone} AS zone_id, time, round({mean}, 6) AS mean FROM grid_month JOIN mask USING (cell_id) GROUP BY 4, 5")
    return _MASK + " " + " UNION ALL ".join(parts)


@query("g9_zone_products", "grid_month", _products_sql())
def g9_products(t: Tables):
    cells = t.grid_month.withColumn("band", F.expr("cast(zone_id div 100 as int)"))
    return A.zone_products(cells, PRODUCTS, ["zone_id", "band"]).withColumn("mean", F.round("mean", 6))


_COV = "SELECT zone_id, sum(area_m2) AS a, coalesce(sum(CASE WHEN value IS NOT NULL THEN area_m2 END), 0) AS c, count(*) AS n_cells, count(value) AS n_valid FROM grid GROUP BY 1"


@query("a3_zone_coverage", "grid", f"SELECT zone_id, round(a, 2) AS area_m2, round(c, 2) AS covered_m2, round(c / a, 6) AS coverage, n_cells, n_valid FROM ({_COV})")
def a3(t: Tables):
    return A.zone_coverage(t.grid, F.col("value").isNotNull()).select("zone_id", F.round("area_m2", 2).alias("area_m2"), F.round("covered_m2", 2).alias("covered_m2"), *r6("coverage"), "n_cells", "n_valid")


@query("a3_coverage_counts", "grid", f"SELECT count(*) FILTER (WHERE c > 0 AND c / a < 0.999) AS n_partial, count(*) FILTER (WHERE c = 0) AS n_empty FROM ({_COV})")
def a3_counts(t: Tables):
    return A.coverage_counts(A.zone_coverage(t.grid, F.col("value").isNotNull()))


@query("a4_cells_per_zone", "grid", f"SELECT zone_id, n_cells, n_valid FROM ({_COV})")
def a4(t: Tables):
    return A.zone_coverage(t.grid, F.col("value").isNotNull()).select("zone_id", "n_cells", "n_valid")


@query("a5_long_term_mean", "grid_month", "SELECT cell_id, round(avg(v1), 6) AS v1, round(avg(v2), 6) AS v2 FROM grid_month GROUP BY 1")
def a5(t: Tables):
    return A.long_term_mean(t.grid_month, ["v1", "v2"], ["cell_id"]).select("cell_id", *r6("v1", "v2"))


@query("a6_variance_decomposition", "grid", ", k AS (SELECT zone_id, value / 1000 AS v, area_m2 AS w FROM grid WHERE value IS NOT NULL), m AS (SELECT sum(v * w) / sum(w) AS m FROM k), z AS (SELECT zone_id, sum(v * w) / sum(w) AS zm, sum(w) AS zw FROM k GROUP BY 1), x AS (SELECT (SELECT sum(w * (v - m) * (v - m)) / sum(w) FROM k, m) AS total, (SELECT sum(zw * (zm - m) * (zm - m)) / sum(zw) FROM z, m) AS between) SELECT round(total, 3) AS total, round(between, 3) AS between, round(between / total, 6) AS share, between / total > 1 AS suspicious FROM x")
def a6(t: Tables):
    v = A.variance_decomposition(t.grid.withColumn("value", F.col("value") / 1000), "value")
    return v.select(F.round("total", 3).alias("total"), F.round("between", 3).alias("between"), *r6("share"), "suspicious")


@query("a7_quantiles", sql="SELECT o_orderpriority, count(o_totalprice) AS n, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS p{round(p * 100)}" for p in (0, 0.1, 0.25, 0.5, 0.75, 0.95, 1)) + " FROM orders GROUP BY 1")
def a7(t: Tables):
    ps = [0, 0.1, 0.25, 0.5, 0.75, 0.95, 1]
    q = A.quantiles(t.read("orders"), "o_totalprice", ps, ["o_orderpriority"])
    return q.select("o_orderpriority", "n", *[F.round(f"p{round(p * 100)}", 4).alias(f"p{round(p * 100)}") for p in ps])


@query("a8_level_summary", "grid", f", z AS (SELECT zone_id, n_valid * 1.0::DOUBLE AS v, c / a AS f FROM ({_COV})), x AS (SELECT 'all' AS zone_set, v FROM z UNION ALL SELECT 'inside', v FROM z WHERE f >= 0.9 UNION ALL SELECT 'with_station', v FROM z WHERE zone_id % 3 = 0) SELECT zone_set, count(v) AS n, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90, round(count(v) / CAST((SELECT count(*) FROM z) AS DOUBLE), 6) AS share FROM x GROUP BY 1")
def a8(t: Tables):
    z = A.zone_coverage(t.grid, F.col("value").isNotNull())
    s = A.level_summary(z, "n_valid", F.col("coverage") >= 0.9, F.col("zone_id") % 3 == 0)
    return s.select("zone_set", "n", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")], *r6("share"))


@query("a9_stations_per_zone", "station", "SELECT n_nationkey AS zone_id, count(DISTINCT station_id) AS n_stations FROM nation LEFT JOIN station ON zone1 = n_nationkey GROUP BY 1")
def a9(t: Tables):
    st = t.station.select("station_id", F.col("zone1").alias("zone_id"))
    return A.stations_per_zone(t.read("nation").select(F.col("n_nationkey").alias("zone_id")), st)


@query("a10_depth_mean", sql="SELECT l_orderkey, round(CASE WHEN count(l_discount * l_quantity) = count(*) THEN sum(l_discount * 0.8537613::DOUBLE * l_quantity) / sum(l_quantity) / 10 END, 6) AS l_discount FROM lineitem GROUP BY 1")
def a10(t: Tables):
    return A.depth_mean(t.read("lineitem").withColumn("l_discount", F.col("l_discount") * UNIT), ["l_orderkey"], "l_discount", "l_quantity", 10.0).select("l_orderkey", *r6("l_discount"))


@query("a11_block_mean", "grid", "SELECT lat_idx // 4 AS lat_idx, lon_idx // 4 AS lon_idx, round(avg(value), 4) AS value FROM grid GROUP BY 1, 2")
def a11(t: Tables):
    return A.block_mean(t.grid, "value", 4).withColumn("value", F.round("value", 4))


@query("a12_block_mode", "grid", ", n AS (SELECT lat_idx // 4 AS lat_idx, lon_idx // 4 AS lon_idx, code % 5 AS code, count(*) AS n FROM grid WHERE code % 5 <> 0 GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY n DESC, code) AS k FROM n), b AS (SELECT DISTINCT lat_idx // 4 AS lat_idx, lon_idx // 4 AS lon_idx FROM grid) SELECT b.lat_idx, b.lon_idx, CASE WHEN m.code <> 3 THEN m.code END AS code FROM b LEFT JOIN m ON m.lat_idx = b.lat_idx AND m.lon_idx = b.lon_idx AND k = 1")
def a12(t: Tables):
    return A.block_mode(t.grid.withColumn("code", F.col("code") % 5), "code", 4, [3])


@query("a13_class_distribution", "grid", "SELECT code, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, CASE code WHEN 1 THEN 'urgent' WHEN 5 THEN 'low' END AS label FROM grid GROUP BY 1")
def a13(t: Tables):
    return A.class_distribution(t.grid, "code", {1: "urgent", 5: "low"}).withColumn("percent", F.round("percent", 6))


@query("a14_class_status", sql="SELECT p_size % 8 AS code, count(*) AS n_before, CASE WHEN p_size % 8 IN (1, 2, 3) THEN 'kept' WHEN p_size % 8 = 0 THEN 'zero' WHEN p_size % 8 IN (4, 5) THEN 'documented' ELSE 'unexpected' END AS status, CASE WHEN p_size % 8 IN (1, 2, 3) THEN count(*) ELSE 0 END AS n_after FROM part GROUP BY p_size % 8")
def a14(t: Tables):
    return A.class_status(t.read("part").select((F.col("p_size") % 8).alias("code")), "code", [1, 2, 3], [4, 5])


_FIELDS = ", f AS (SELECT value AS a, CASE WHEN code <> 2 THEN code % 5 END AS b, lon_idx % 3 <> 0 AS land FROM grid)"


def _fields(t: Tables):
    return t.grid.select(F.col("value").alias("a"), F.when(F.col("code") != 2, F.col("code") % 5).alias("b"), (F.col("lon_idx") % 3 != 0).alias("land"))


@query("a15_mask_crosstab", "grid", _FIELDS + " " + " UNION ALL ".join(f"SELECT '{v}' AS field, count(*) FILTER (WHERE {v} IS NULL AND land) AS null_land, count(*) FILTER (WHERE {v} IS NULL AND NOT land) AS null_water, count(*) FILTER (WHERE {v} = 0 AND land) AS zero_land, count(*) FILTER (WHERE {v} = 0 AND NOT land) AS zero_water FROM f" for v in "ab"))
def a15(t: Tables):
    return A.mask_crosstab(_fields(t), ["a", "b"], F.col("land"))


@query("a15_mask_disagreements", "grid", _FIELDS + " SELECT 'a' AS field_a, 'b' AS field_b, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS n FROM f")
def a15_pairs(t: Tables):
    return A.mask_disagreements(_fields(t), ["a", "b"])


@query("a16_axis_alignment", "grid", ", a AS (SELECT lon_idx AS idx, lon + (lon_idx % 7) / 1000.0::DOUBLE AS c, lon AS r FROM (SELECT DISTINCT lon_idx, lon FROM grid)), s AS (SELECT *, c - lag(c) OVER (ORDER BY idx) AS st FROM a) SELECT count(*) AS size, round(min_by(c, idx), 6) AS first, round(max_by(c, idx), 6) AS last, round(median(st), 6) AS median_step, round(max(abs(c - r)), 6) AS max_deviation FROM s")
def a16(t: Tables):
    ref = t.grid.select(F.col("lon_idx").alias("idx"), F.col("lon").alias("coord")).distinct()
    out = A.axis_alignment(ref.withColumn("coord", F.col("coord") + F.col("idx") % 7 / 1000), ref)
    return out.select("size", *r6("first", "last", "median_step", "max_deviation"))


@query("a17_profile", sql=" UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) AS n, min({v}) AS v_min, max({v}) AS v_max, round(avg({v}), 6) AS v_mean, 1.0::DOUBLE AS finite_share FROM lineitem" for v in ("l_quantity", "l_discount", "l_tax")))
def a17(t: Tables):
    return A.profile(t.read("lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("v_mean", F.round("v_mean", 6))


@query("a18_null_columns", "grid_month", " UNION ALL ".join(f"SELECT '{v}' AS \"column\", count(*) - count({v}) AS n_null, round((count(*) - count({v})) * 100.0 / count(*), 6) AS percent FROM grid_month" for v in ("v1", "v2")))
def a18(t: Tables):
    return A.null_columns(t.grid_month, ["v1", "v2"]).withColumn("percent", F.round("percent", 6))


@query("a18_null_rows", "grid_month", "SELECT cell_id, sum(CAST(v1 IS NULL AS INTEGER) + CAST(v2 IS NULL AS INTEGER)) AS n_null FROM grid_month GROUP BY 1")
def a18_rows(t: Tables):
    return t.grid_month.groupBy("cell_id").agg(F.sum(S.null_count(["v1", "v2"])).alias("n_null"))


@query("a24_category_sets", sql="SELECT 'o_orderpriority' AS \"column\", (SELECT array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') FROM orders) AS categories UNION ALL SELECT 'o_orderstatus', (SELECT array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') FROM orders)")
def a24(t: Tables):
    return A.category_sets(t.read("orders"), ["o_orderpriority", "o_orderstatus"]).withColumn("categories", F.array_join("categories", ","))


@query("a27_raster_ratio", "grid", f"SELECT zone_id, round(n_cells * 2.5::DOUBLE / (a / 1000000), 6) AS ratio, n_cells * 2.5::DOUBLE / (a / 1000000) >= 0.9 AS inside FROM ({_COV})")
def a27(t: Tables):
    z = A.zone_coverage(t.grid, F.col("value").isNotNull()).withColumns({"cell_km2": F.lit(2.5), "area_km2": F.col("area_m2") / 1000000})
    return A.raster_ratio(z, "n_cells", "cell_km2", "area_km2").select("zone_id", *r6("ratio"), "inside")


#: Differences of the cells whose positions are one apart, met by position.
_NEXT = "CASE WHEN {b}.cell_id IS NOT NULL AND {a}.cell_id IS NOT NULL THEN ({b}.{v} - {a}.{v}) / 2 WHEN {b}.cell_id IS NOT NULL THEN {b}.{v} - g.{v} WHEN {a}.cell_id IS NOT NULL THEN g.{v} - {a}.{v} END"


@query("w11_central_difference", "grid", f"SELECT g.cell_id, round({_NEXT.format(a='a', b='b', v='value')}, 4) AS dz FROM grid g LEFT JOIN grid a ON a.lat_idx = g.lat_idx AND a.lon_idx = g.lon_idx - 1 LEFT JOIN grid b ON b.lat_idx = g.lat_idx AND b.lon_idx = g.lon_idx + 1")
def w11(t: Tables):
    return t.grid.select("cell_id", F.round(W.central_difference("value", "lat_idx", "lon_idx"), 4).alias("dz"))


@query("j20_grid_neighbours", "grid", "SELECT g.lat_idx, g.lon_idx, CAST(d AS INTEGER) AS direction, g.lat_idx + dr AS n_lat_idx, g.lon_idx + dc AS n_lon_idx FROM grid g CROSS JOIN (VALUES (1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1)) s(d, dr, dc) JOIN grid h ON h.lat_idx = g.lat_idx + dr AND h.lon_idx = g.lon_idx + dc")
def j20(t: Tables):
    return J.grid_neighbours(t.grid)


def _dem(t: Tables):
    h = (F.col("cell_id") * 7919 % 1009).cast("double")
    return t.grid.select("cell_id", "lat_idx", "lon_idx", "lat", h.alias("dem"), (F.col("cell_id") * 31 % 1100).cast("double").alias("acc"), F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("cell_id") * 13 % 8).cast("int") + 1).alias("dir"))


_DEM = ", d AS (SELECT cell_id, lat_idx, lon_idx, lat, CAST(cell_id * 7919 % 1009 AS DOUBLE) AS dem, CAST(cell_id * 31 % 1100 AS DOUBLE) AS acc, CAST(1 << CAST(cell_id * 13 % 8 AS INTEGER) AS INTEGER) AS dir FROM grid)"


@query("g5_terrain", "grid", _DEM + f""", x AS (SELECT g.*, {_NEXT.format(a='a', b='b', v='dem')} / (0.025::DOUBLE * 111320 * cos(radians(g.lat))) AS zx, -{_NEXT.format(a='n', b='s', v='dem')} / (0.025::DOUBLE * 111320) AS zy FROM d g
LEFT JOIN d a ON a.lat_idx = g.lat_idx AND a.lon_idx = g.lon_idx - 1 LEFT JOIN d b ON b.lat_idx = g.lat_idx AND b.lon_idx = g.lon_idx + 1 LEFT JOIN d n ON n.lon_idx = g.lon_idx AND n.lat_idx = g.lat_idx - 1 LEFT JOIN d s ON s.lon_idx = g.lon_idx AND s.lat_idx = g.lat_idx + 1),
s AS (SELECT *, degrees(atan(sqrt(zx * zx + zy * zy))) AS slope FROM x)
SELECT cell_id, round(slope, 6) AS slope, CASE WHEN slope >= 0.001 THEN round(((90 - degrees(atan2(-zy, -zx))) % 360 + 360) % 360, 4) END AS aspect, CASE WHEN acc > 0 THEN round(ln(acc * (0.025::DOUBLE * 111320 * 0.025::DOUBLE * 111320 * cos(radians(lat)) / 10000) / tan(radians(greatest(slope, 0.1)))), 6) END AS twi FROM s""")
def g5(t: Tables):
    d = G.terrain_derivatives(_dem(t), RES, RES)
    return d.select("cell_id", *r6("slope"), F.round("aspect", 4).alias("aspect"), F.when(F.col("acc") > 0, F.round("twi", 6)).alias("twi"))


_STEP = "CASE WHEN dir IN (1, 2, 128) THEN 1 WHEN dir IN (8, 16, 32) THEN -1 ELSE 0 END"
_DOWN = "CASE WHEN dir IN (2, 4, 8) THEN 1 WHEN dir IN (32, 64, 128) THEN -1 ELSE 0 END"


@query("g6_height_above_drainage", "grid", _DEM + f""", e AS (SELECT a.cell_id, n.cell_id AS next FROM d a JOIN d n ON n.lat_idx = a.lat_idx + {_DOWN.replace('dir', 'a.dir')} AND n.lon_idx = a.lon_idx + {_STEP.replace('dir', 'a.dir')} WHERE a.acc < 900),
r(cell_id, spot) AS (SELECT cell_id, cell_id FROM d UNION SELECT r.cell_id, e.next FROM r JOIN e ON e.cell_id = r.spot)
SELECT d.cell_id, CASE WHEN b.dem IS NOT NULL THEN greatest(d.dem - b.dem, 0) END AS hand FROM d LEFT JOIN (SELECT r.cell_id, o.dem FROM r JOIN d o ON o.cell_id = r.spot AND o.acc >= 900) b ON b.cell_id = d.cell_id""")
def g6(t: Tables):
    return G.height_above_drainage(_dem(t), 900.0)


@query("g7_distance_to_class", "grid", None)
def g7(t: Tables):
    rivers = t.grid.withColumn("code", F.when(F.col("cell_id") % 41 == 0, F.col("code")))
    return G.distance_to_class(rivers, [1, 2, 9], RES).withColumn("distance", F.round("distance", 6))


@query("g8_segments_to_cells", "station", None)
def g8(t: Tables):
    s = t.station.select(F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + 0.3).alias("x2"), (F.col("lat") + 0.2).alias("y2"), (F.col("num") % 8 + 3).cast("int").alias("code"))
    return G.segments_to_cells(s, t.axes)


@query("g10_level_report", "grid", f", z AS (SELECT zone_id, c / a AS f, n_valid FROM ({_COV})) SELECT zone_id // 100 AS level, count(*) AS n_zones, count(*) FILTER (WHERE f >= 0.9) AS n_inside, round(avg(n_valid), 6) AS mean_valid FROM z GROUP BY 1")
def g10(t: Tables):
    z = A.zone_coverage(t.grid, F.col("value").isNotNull()).withColumn("level", F.expr("zone_id div 100"))
    return z.groupBy("level").agg(F.count(F.lit(1)).alias("n_zones"), F.count_if(F.col("coverage") >= 0.9).alias("n_inside"), F.round(F.avg("n_valid"), 6).alias("mean_valid"))


@query("f1_haversine", "station", f"SELECT station_id, round({hav('lat', 'lon', '51.0::DOUBLE', '10.0::DOUBLE')}, 6) AS km FROM station")
def f1(t: Tables):
    return t.station.select("station_id", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(51.0), F.lit(10.0)), 6).alias("km"))


@query("f2_pixel_area", "grid", "SELECT cell_id, round(area_m2, 3) AS area_m2 FROM grid")
def f2(t: Tables):
    return t.grid.select("cell_id", F.round("area_m2", 3).alias("area_m2"))


@query("f3_cell_metrics", "grid", "SELECT cell_id, round(0.025::DOUBLE * 111320, 6) AS dy_m, round(0.025::DOUBLE * 111320 * cos(radians(lat)), 6) AS dx_m, round(0.025::DOUBLE * 111320 * 0.025::DOUBLE * 111320 * cos(radians(lat)) / 10000, 6) AS area_ha FROM grid")
def f3(t: Tables):
    return t.grid.select("cell_id", *[F.round(c, 6).alias(n) for n, c in S.cell_metrics(F.col("lat"), RES, RES).items()])


@query("f4_auto_radius", sql="SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE round(greatest(CAST(p_size AS DOUBLE) / 100 * 2 * 111.32, 3.0), 3) END AS radius FROM part")
def f4(t: Tables):
    return t.read("part").select("p_partkey", S.auto_radius_km(F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 100)).alias("radius"))


@query("f5_dates", sql="SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m0, last_day(o_orderdate) AS m1, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders")
def f5(t: Tables):
    d = F.col("o_orderdate")
    return t.read("orders").select("o_orderkey", S.month_start(d).alias("m0"), S.month_end(d).alias("m1"), F.year(d).alias("y"), F.month(d).alias("m"), S.days_since_epoch(d).alias("d"))


@query("f6_months_since_change", sql="SELECT o_orderkey, CAST(coalesce((year(o_orderdate) - CASE WHEN o_custkey % 3 <> 0 THEN 1996 END) * 12 + month(o_orderdate) - 1, -1) AS INTEGER) AS n FROM orders")
def f6(t: Tables):
    return t.read("orders").select("o_orderkey", S.months_since_change(F.year("o_orderdate"), F.month("o_orderdate"), F.when(F.col("o_custkey") % 3 != 0, 1996)).alias("n"))


@query("f7_decode_seconds", sql="SELECT event_id, epoch(TIMESTAMP '2002-04-17' + to_seconds(event_id * 3600)) AS s FROM events")
def f7(t: Tables):
    e = t.read("events").select("event_id", F.unix_timestamp(S.decode_seconds(F.col("event_id") * 3600, F.lit("seconds since 2002-04-17 00:00:00"))).cast("double").alias("s"))
    return e


@query("f8_sanitize", sql="SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name, '[^0-9A-Za-z_]', '_', 'g') AS name FROM part")
def f8(t: Tables):
    return t.read("part").select("p_partkey", S.sanitize(F.concat_ws(" ", "p_brand", "p_name")).alias("name"))


@query("f9_depth_label", sql="SELECT p_partkey, replace(replace(CASE WHEN p_size % 20 = 0 THEN CAST(p_size // 20 AS VARCHAR) ELSE rtrim(CAST(CAST(p_size AS DECIMAL(18, 2)) / 20 AS VARCHAR), '0') END, '.', 'p'), '-', 'm') AS label FROM part")
def f9(t: Tables):
    return t.read("part").select("p_partkey", S.depth_label(F.col("p_size") / 20).alias("label"))


@query("f10_feature_group", sql="SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'lcc' WHEN p_size % 3 = 1 THEN p_type ELSE 'other' END AS g FROM part")
def f10(t: Tables):
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("C3S__"), F.col("p_name"))).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("__x"))).otherwise("plain")
    return t.read("part").select("p_partkey", S.feature_group(name).alias("g"))


@query("f11_prettify", sql="SELECT p_partkey, upper(substr(replace(p_name, '_', ' '), 1, 1)) || substr(replace(p_name, '_', ' '), 2) AS label FROM part")
def f11(t: Tables):
    return t.read("part").select("p_partkey", S.prettify(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("label"))


_ENG = "CASE p_size % 3 WHEN 0 THEN 'gwl_lag' || p_size WHEN 1 THEN 'rain_rmean' || p_size ELSE 'slope' END"


def _engineered():
    n = F.col("p_size").cast("string")
    return F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("gwl_lag"), n)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("rain_rmean"), n)).otherwise("slope")


@query("f12_base_column", sql=f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'gwl' ELSE {_ENG} END AS base FROM part")
def f12(t: Tables):
    return t.read("part").select("p_partkey", S.base_column(_engineered(), ["gwl", "slope"]).alias("base"))


@query("f13_window_label", sql="SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'lag' || p_size WHEN 1 THEN 'rmean' || p_size ELSE 'static' END AS w FROM part")
def f13(t: Tables):
    return t.read("part").select("p_partkey", S.window_label(_engineered()).alias("w"))


@query("f14_core_id", sql="SELECT o_orderkey, CAST(substr(CAST(2060000010 + o_orderkey * 10 AS VARCHAR), 1, 1) || substr(CAST(2060000010 + o_orderkey * 10 AS VARCHAR), 4, 7) AS BIGINT) AS core FROM orders")
def f14(t: Tables):
    return t.read("orders").select("o_orderkey", S.core_basin_id(F.col("o_orderkey") * 10 + 2060000010).alias("core"))


@query("f15_category_text", sql="SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS VARCHAR) ELSE 'missing' END AS c FROM part")
def f15(t: Tables):
    return t.read("part").select("p_partkey", S.category_text(F.when(F.col("p_size") % 4 != 0, F.col("p_size"))).alias("c"))


@query("f16_round_code", sql="SELECT p_partkey, CAST(round_even(CAST(p_size AS DOUBLE) / 2, 0) AS INTEGER) AS c FROM part")
def f16(t: Tables):
    return t.read("part").select("p_partkey", S.round_code(F.col("p_size") / 2).alias("c"))


@query("f17_terrain_functions", sql="SELECT p_partkey, round(degrees(atan(sqrt(pow(CAST(p_size AS DOUBLE) / 50, 2) + pow(CAST(p_partkey % 7 AS DOUBLE) / 10, 2)))), 6) AS slope FROM part")
def f17(t: Tables):
    got = S.terrain(F.col("p_size") / 50, F.col("p_partkey") % 7 / 10, F.lit(10.0), F.lit(1.0))
    return t.read("part").select("p_partkey", F.round(got["slope"], 6).alias("slope"))


@query("f18_skill_score", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_discount - l_tax) / (1 - l_tax), 6) AS s FROM lineitem")
def f18(t: Tables):
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.skill_score(F.col("l_discount"), F.col("l_tax")), 6).alias("s"))


@query("f19_truthy", sql="SELECT o_orderkey, o_orderstatus = 'F' AS t FROM orders")
def f19(t: Tables):
    return t.read("orders").select("o_orderkey", S.truthy(F.when(F.col("o_orderstatus") == "F", " Yes").otherwise("no")).alias("t"))


@query("f20_product_version", sql="SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1998 THEN 'v2' ELSE 'v1' END AS v FROM orders")
def f20(t: Tables):
    return t.read("orders").select("o_orderkey", S.product_version(F.year("o_orderdate"), 1998, "v2", "v1").alias("v"))


def _levels(t: Tables):
    """Zones of two levels, with codes of which the fine begin with the coarse, and their stations."""
    g = t.grid.groupBy("zone_id").agg(F.sum("area_m2").alias("area"), F.sum(F.when(F.col("value").isNotNull(), F.col("area_m2"))).alias("covered"))
    band = F.expr("cast(zone_id div 100 as int)")
    code = F.lpad(band.cast("string"), 6, "0")
    fine = g.select(F.lit(2).alias("level"), "zone_id", F.when(F.col("zone_id") % 100 == 0, band).otherwise(-F.col("zone_id")).alias("core_id"), F.concat(code, F.lpad((F.col("zone_id") % 100).cast("string"), 2, "0")).alias("code"), "area", "covered")
    coarse = g.groupBy(band.alias("zone_id")).agg(F.sum("area").alias("area"), F.sum("covered").alias("covered")).select(F.lit(1).alias("level"), "zone_id", F.col("zone_id").alias("core_id"), F.lpad(F.col("zone_id").cast("string"), 6, "0").alias("code"), "area", "covered")
    st = t.station.withColumn("row", F.floor((55.5 - F.col("lat")) / 0.025 + 0.5).cast("int")).withColumn("col", F.floor((F.col("lon") - 5.5) / 0.025 + 0.5).cast("int"))
    st = st.select("station_id", F.expr("row div 8").alias("y"), F.expr("col div 50").alias("x"))
    both = st.select(F.lit(2).alias("level"), (F.col("y") * 100 + F.col("x")).cast("int").alias("zone_id"), "station_id").unionByName(st.select(F.lit(1).alias("level"), F.col("y").cast("int").alias("zone_id"), "station_id"))
    return fine.unionByName(coarse), both


_LEVELS = """, f AS (SELECT 2 AS level, zone_id, CASE WHEN zone_id % 100 = 0 THEN zone_id // 100 ELSE -zone_id END AS core_id, lpad(CAST(zone_id // 100 AS VARCHAR), 6, '0') AS parent, sum(area_m2) AS area, sum(CASE WHEN value IS NOT NULL THEN area_m2 END) AS covered FROM grid GROUP BY zone_id),
z AS (SELECT level, zone_id, core_id, parent, area, covered FROM f UNION ALL SELECT 1, zone_id // 100, zone_id // 100, lpad(CAST(zone_id // 100 AS VARCHAR), 6, '0'), sum(area), sum(covered) FROM f GROUP BY zone_id // 100),
st AS (SELECT station_id, CAST(floor((55.5::DOUBLE - lat) / 0.025::DOUBLE + 0.5::DOUBLE) AS BIGINT) // 8 AS y, CAST(floor((lon - 5.5::DOUBLE) / 0.025::DOUBLE + 0.5::DOUBLE) AS BIGINT) // 50 AS x FROM station),
sb AS (SELECT 2 AS level, y * 100 + x AS zone_id, station_id FROM st UNION ALL SELECT 1, y, station_id FROM st),
sn AS (SELECT level, zone_id, count(DISTINCT station_id) AS n_stations FROM sb GROUP BY 1, 2),
tw AS (SELECT a.zone_id AS fine_id, b.zone_id AS coarse_id FROM z a JOIN z b ON a.level = 2 AND b.level = 1 AND a.core_id = b.core_id AND abs(a.area - b.area) <= 0.95::DOUBLE * greatest(a.area, b.area)),
k AS (SELECT parent, count(*) AS n FROM z WHERE level = 2 GROUP BY 1),
w AS (SELECT z.*, coalesce(covered, 0) / area >= 0.9 AS inside, n_stations, CASE WHEN level = 2 THEN zone_id IN (SELECT fine_id FROM tw) ELSE zone_id IN (SELECT coarse_id FROM tw) END AS twin, CASE WHEN level = 1 THEN coalesce(k.n, 0) END AS n_children FROM z LEFT JOIN sn USING (level, zone_id) LEFT JOIN k ON z.level = 1 AND k.parent = z.parent),
x AS (SELECT 'all' AS zone_set, * FROM w UNION ALL SELECT 'inside', * FROM w WHERE inside UNION ALL SELECT 'with_station', * FROM w WHERE n_stations > 0)
SELECT level, zone_set, count(area) AS n, round(quantile_cont(area, 0.1), 2) AS p10, round(quantile_cont(area, 0.5), 2) AS p50, round(quantile_cont(area, 0.9), 2) AS p90, CAST(coalesce(sum(n_stations), 0) AS BIGINT) AS n_stations, count(*) FILTER (WHERE twin) AS n_same, round(avg(n_children), 6) AS mean_children, round(count(area) / CAST((SELECT count(*) FROM z q WHERE q.level = x.level) AS DOUBLE), 6) AS share FROM x GROUP BY level, zone_set"""


@query("g10_level_comparison", "grid station", _LEVELS)
def g10_comparison(t: Tables):
    zones, stations = _levels(t)
    got = A.level_report(zones, stations, 2, 1, F.coalesce(F.col("covered"), F.lit(0.0)) / F.col("area") >= 0.9, 0.95)
    return got.select("level", "zone_set", "n", *[F.round(c, 2).alias(c) for c in ("p10", "p50", "p90")], "n_stations", "n_same", *r6("mean_children", "share"))
