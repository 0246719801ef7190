"""Queries over station series: roll-ups, lags, matrices, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import aggregates as A
from gridloom.operators import conform as P
from gridloom.operators import features as E
from gridloom.operators import joins as J
from gridloom.operators import ordering as K
from gridloom.operators import windows as W
from gridloom.plans.registry import query
from gridloom.plans.standins import Tables


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("a1_monthly_rollup", "monthly", "SELECT station_id, time, round(flux, 6) AS flux, round(state, 6) AS state, round(target, 6) AS target, time_days FROM monthly")
def a1(t: Tables):
    return t.monthly.select("station_id", "time", *r6("flux", "state", "target"), "time_days")


@query("w1_lag_features", "monthly", "SELECT station_id, time, round(lag(target, 1) OVER w, 6) AS target_lag1, round(lag(target, 3) OVER w, 6) AS target_lag3, round(lag(target, 12) OVER w, 6) AS target_lag12 FROM monthly WINDOW w AS (PARTITION BY station_id ORDER BY time)")
def w1(t: Tables):
    made = W.lag_features(["target"], [1, 3, 12])
    return t.monthly.select("station_id", "time", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query("w2_trailing_means", "monthly", "SELECT station_id, time, round(avg(flux) OVER (PARTITION BY station_id ORDER BY time ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS flux_rmean3, round(avg(flux) OVER (PARTITION BY station_id ORDER BY time ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 6) AS flux_rmean12 FROM monthly")
def w2(t: Tables):
    made = W.trailing_means(["flux"], [3, 12])
    return t.monthly.select("station_id", "time", *[F.round(c, 6).alias(n) for n, c in made.items()])


_SCAFFOLD = """, span AS (SELECT station_id, min(year) AS a, max(year) AS z FROM class_year GROUP BY 1),
y AS (SELECT s.station_id, CAST(u.year AS INTEGER) AS year, c.code FROM (SELECT station_id, unnest(range(a - 1, z + 2)) AS year FROM span) u JOIN span s USING (station_id) LEFT JOIN class_year c ON c.station_id = u.station_id AND c.year = u.year)"""


def _scaffold(t: Tables):
    span = t.class_year.groupBy("station_id").agg(F.min("year").alias("a"), F.max("year").alias("z"))
    return span.select("station_id", F.explode(F.sequence(F.col("a") - 1, F.col("z") + 1)).alias("year")).join(t.class_year, ["station_id", "year"], "left")


@query("w3_back_fill", "class_year", _SCAFFOLD + " SELECT station_id, year, first_value(code IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS code FROM y")
def w3(t: Tables):
    return _scaffold(t).select("station_id", "year", W.back_fill("code", "station_id", "year").alias("code"))


@query("w4_forward_fill", "class_year", _SCAFFOLD + " SELECT station_id, year, last_value(code IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code FROM y")
def w4(t: Tables):
    return _scaffold(t).select("station_id", "year", W.forward_fill("code", "station_id", "year").alias("code"))


@query("w5_change_flag", "class_year", "SELECT station_id, year, CASE WHEN code <> lag(code) OVER (PARTITION BY station_id ORDER BY year) THEN 1 ELSE 0 END AS changed FROM class_year")
def w5(t: Tables):
    return t.class_year.select("station_id", "year", W.change_flag("code", "station_id", "year").alias("changed"))


@query("w6_average_rank", sql="SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0::DOUBLE AS r FROM orders")
def w6(t: Tables):
    return t.read("orders").select("o_orderkey", W.average_rank("o_orderpriority", ["o_custkey"]).alias("r"))


@query("w7_holm", sql="WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 1000 END AS p FROM part), s AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY p_brand) AS m FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY coalesce(p, 1), p_partkey)) SELECT p_brand, p_partkey, round(max(least((m - r + 1) * coalesce(p, 1), 1)) OVER (PARTITION BY p_brand ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s")
def w7(t: Tables):
    p = t.read("part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double") / 1000).alias("p"))
    return W.holm(p, "p", ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", *r6("p_holm"))


@query("w8_first_of", sql="SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def w8(t: Tables):
    return W.first_of(t.read("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w10_snap_months", "monthly", ", s AS (SELECT station_id, time, min(time) OVER (PARTITION BY station_id) AS a, row_number() OVER (PARTITION BY station_id ORDER BY time) - 1 AS k FROM monthly) SELECT station_id, time, CAST(date_trunc('month', a) + to_months(CAST(k AS INTEGER)) AS DATE) AS month, CAST(date_trunc('month', a) + to_months(CAST(k AS INTEGER)) AS DATE) <> time AS mismatch FROM s")
def w10(t: Tables):
    return W.snap_months(t.monthly.select("station_id", "time"), "station_id", "time")


@query("w12_empirical_cdf", sql="SELECT o_orderkey, o_orderpriority, round(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) / CAST(count(*) OVER (PARTITION BY o_orderpriority) AS DOUBLE), 9) AS cdf FROM orders")
def w12(t: Tables):
    got = W.empirical_cdf(t.read("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"], "o_orderkey")
    return got.select("o_orderkey", "o_orderpriority", F.round("cdf", 9).alias("cdf"))


@query("w13_stride_sample", "monthly", ", k AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS i FROM (SELECT DISTINCT station_id FROM monthly)) SELECT station_id, time FROM monthly WHERE station_id IN (SELECT station_id FROM k WHERE i % 7 = 0 AND i < 70)")
def w13(t: Tables):
    return W.stride_sample(t.monthly.select("station_id", "time"), ["station_id"], 7, 10)


@query("a19_scaler", "monthly", "SELECT station_id, round(avg(target) FILTER (WHERE time < DATE '2000-01-01'), 6) AS mean, round(CASE WHEN stddev_pop(target) FILTER (WHERE time < DATE '2000-01-01') = 0 THEN 1 ELSE stddev_pop(target) FILTER (WHERE time < DATE '2000-01-01') END, 4) AS std FROM monthly GROUP BY 1")
def a19(t: Tables):
    return A.scaler(t.monthly, "target", F.col("time") < "2000-01-01").select("station_id", *r6("mean"), F.round("std", 4).alias("std"))


@query("a20_anomaly_stats", "monthly", "SELECT station_id, round(avg(target) FILTER (WHERE time >= DATE '1996-01-01' AND time < DATE '2000-01-01'), 6) AS ref_mean, count(target) FILTER (WHERE time >= DATE '1996-01-01' AND time < DATE '2000-01-01') AS n_ref, round(stddev_pop(target) * 100, 3) AS anomaly_std FROM monthly GROUP BY 1")
def a20(t: Tables):
    return A.anomaly_stats(t.monthly, "target", P.in_months(F.col("time"), "1996-01", "1999-12")).select("station_id", *r6("ref_mean"), "n_ref", F.round("anomaly_std", 3).alias("anomaly_std"))


@query("p8_time_window", "monthly", "SELECT station_id, count(*) AS n, max(time) AS last FROM monthly WHERE time >= DATE '1997-01-01' AND time < DATE '2000-01-01' GROUP BY 1")
def p8(t: Tables):
    return t.monthly.where(P.in_months(F.col("time"), "1997-01", "1999-12")).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last"))


@query("p19_date_split", "monthly", "SELECT station_id, CASE WHEN time < DATE '1999-01-01' THEN 'train' WHEN time < DATE '2000-01-01' THEN 'stop' ELSE 'test' END AS split, count(*) AS n FROM monthly GROUP BY 1, 2")
def p19(t: Tables):
    return t.monthly.withColumn("split", P.date_split(F.col("time"), "1999-01-01", "2000-01-01")).groupBy("station_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("p20_fold_rotations", "station", ", x AS (SELECT station_id, num % 5 AS fold, r FROM station CROSS JOIN range(5) q(r)) SELECT station_id, CAST(r AS INTEGER) AS rotation, CASE WHEN fold = r THEN 'test' WHEN fold = (r + 1) % 5 THEN 'val' ELSE 'train' END AS role FROM x")
def p20(t: Tables):
    return P.fold_rotations(t.station.select("station_id", (F.col("num") % 5).alias("fold")), "fold", 5).select("station_id", "rotation", "role")


@query("p21_min_history", sql="SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1 HAVING count(*) >= 8)")
def p21(t: Tables):
    return P.with_min_history(t.read("orders"), "o_custkey", 8, F.col("o_orderdate") < "1999-01-01").select("o_custkey", "o_orderkey")


@query("j1_spine_join", "monthly", ", f AS (SELECT station_id, time, count(*) AS n FROM monthly WHERE time_days % 2 = 0 GROUP BY 1, 2) SELECT m.station_id, m.time, f.n FROM monthly m LEFT JOIN f ON f.station_id = m.station_id AND f.time = m.time")
def j1(t: Tables):
    f = t.monthly.where("time_days % 2 = 0").groupBy("station_id", "time").agg(F.count(F.lit(1)).alias("n"))
    return J.on_spine(t.monthly.select("station_id", "time"), [f])


@query("j2_static_join", "monthly station", "SELECT m.station_id, m.time, s.lat, s.lon, s.depth_m FROM monthly m JOIN station s USING (station_id)")
def j2(t: Tables):
    return J.with_static(t.monthly.select("station_id", "time"), t.station.select("station_id", "lat", "lon", "depth_m"))


@query("j3_drop_reasons", "monthly station", ", k AS (SELECT DISTINCT m.station_id, CASE WHEN s.num % 9 = 0 THEN 'no_static' WHEN s.num % 4 = 0 THEN 'no_fold' ELSE 'kept' END AS reason FROM monthly m JOIN station s USING (station_id)) SELECT reason, count(*) AS n FROM k GROUP BY 1")
def j3(t: Tables):
    static, folds = t.station.where("num % 9 <> 0"), t.station.where("num % 4 <> 0")
    return J.drop_counts(J.kept_keys(t.monthly, {"no_static": static, "no_fold": folds}))


@query("j15_restrict", "monthly station", "SELECT station_id, count(*) AS n FROM monthly WHERE station_id IN (SELECT station_id FROM station WHERE zone2 = 1) GROUP BY 1")
def j15(t: Tables):
    return J.restrict(t.monthly, t.station.where("zone2 = 1")).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


def _matrix_sql() -> str:
    """Numbers as the matrix has them: cast to float, then compared at one decimal."""
    w = "PARTITION BY station_id ORDER BY time"
    made = {f"target_lag{k}": f"lag(target, {k}) OVER ({w})" for k in E.LAGS["monthly"]}
    made |= {f"target_rmean{k}": f"avg(target) OVER ({w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in E.MEANS["monthly"]}
    cols = ", ".join(f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 1) AS {n}" for n, x in {"flux": "flux", "target": "target", **made}.items())
    return f", m AS (SELECT station_id, time, {cols} FROM monthly) SELECT m.*, CAST(s.zone2 AS VARCHAR) AS zone2, CAST(s.num AS DOUBLE) AS num FROM m JOIN station s USING (station_id)"


@query("e5_feature_matrix", "monthly station", _matrix_sql())
def e5(t: Tables):
    m = E.feature_matrix(t.monthly, ["target"], ["flux"], t.station.select("station_id", "zone2", "num"), ["zone2"])
    return m.select(*[F.round(F.col(c).cast("double"), 1).alias(c) if k == "float" else F.col(c) for c, k in m.dtypes])


@query("e6_temporal_dataset", "monthly", ", s AS (SELECT station_id, avg(target) FILTER (WHERE time < DATE '2000-01-01') AS m, stddev_pop(target) FILTER (WHERE time < DATE '2000-01-01') AS d FROM monthly GROUP BY 1 HAVING count(*) FILTER (WHERE time < DATE '2000-01-01') >= 16) SELECT x.station_id, x.time, round((x.target - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) AS z, CASE WHEN x.time < DATE '1999-01-01' THEN 'train' WHEN x.time < DATE '2000-01-01' THEN 'stop' ELSE 'test' END AS split FROM monthly x JOIN s USING (station_id)")
def e6(t: Tables):
    return E.temporal_dataset(t.monthly, "target", "1999-01-01", "2000-01-01").select("station_id", "time", *r6("z"), "split")


@query("e7_spatial_dataset", "monthly station", ", r AS (SELECT station_id, avg(target) FILTER (WHERE time >= DATE '1996-01-01' AND time < DATE '1999-01-01') AS m FROM monthly GROUP BY 1 HAVING count(*) >= 16 AND count(target) FILTER (WHERE time >= DATE '1996-01-01' AND time < DATE '1999-01-01') >= 12) SELECT x.station_id, x.time, round((x.target - m) * 100, 3) AS anomaly, CAST(s.num % 5 AS INTEGER) AS fold FROM monthly x JOIN r USING (station_id) JOIN station s USING (station_id) WHERE s.num % 11 <> 0")
def e7(t: Tables):
    folds = t.station.select("station_id", (F.col("num") % 5).cast("int").alias("fold"))
    out, _ = E.spatial_dataset(t.monthly, "target", folds, t.station.where("num % 11 <> 0"), P.in_months(F.col("time"), "1996-01", "1998-12"))
    return out.select("station_id", "time", F.round("anomaly", 3).alias("anomaly"), "fold")


@query("e9_balanced_folds", "station", None)
def e9(t: Tables):
    return E.balanced_folds(t.station.select("station_id", "zone1"), "zone1", 5)


@query("e9_fold_balance", "station", None)
def e9_balance(t: Tables):
    return E.fold_balance(E.balanced_folds(t.station.select("station_id", "zone1"), "zone1", 5))


@query("e10_schema_export", sql="SELECT * FROM (SELECT 0 AS position, 'flux' AS feature, 'float' AS kind, CAST(NULL AS VARCHAR) AS categories UNION ALL SELECT 1, 'zone2', 'category', (SELECT array_to_string(list_sort(list(DISTINCT CAST(n_regionkey AS VARCHAR))), ',') FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)))")
def e10(t: Tables):
    m = t.monthly.select("station_id", "time", "flux").join(t.station.select("station_id", F.col("zone2").cast("string").alias("zone2")), "station_id")
    return E.schema_export(m, ["station_id", "time"]).withColumn("categories", F.array_join("categories", ","))


_LCC = """, span AS (SELECT station_id, min(year(time)) AS a, max(year(time)) AS z FROM m GROUP BY 1),
m0 AS (SELECT s.station_id, unnest(range(least(a, 1995), greatest(z, 2001) + 1)) AS year FROM span s),
y1 AS (SELECT m0.station_id, m0.year, first_value(c.code IGNORE NULLS) OVER (PARTITION BY m0.station_id ORDER BY m0.year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM m0 LEFT JOIN class_year c ON c.station_id = m0.station_id AND c.year = m0.year),
y2 AS (SELECT *, lag(c) OVER (PARTITION BY station_id ORDER BY year) AS p0 FROM y1),
y3 AS (SELECT station_id, year, c, first_value(p0 IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM y2),
y4 AS (SELECT *, coalesce(CAST(c <> p AS INTEGER), 0) AS x FROM y3),
y5 AS (SELECT *, last_value(CASE WHEN x = 1 THEN year END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, sum(CASE WHEN year BETWEEN 1995 AND 2001 THEN x ELSE 0 END) OVER (PARTITION BY station_id) AS s FROM y4)
SELECT m.station_id, m.time, c AS lcc, p AS lcc_previous, coalesce(x, 0) AS lcc_changed, CAST(s = 0 AS INTEGER) AS lcc_stable, CAST(coalesce((year(m.time) - l) * 12 + month(m.time) - 1, -1) AS INTEGER) AS months_since_change FROM m LEFT JOIN y5 ON y5.station_id = m.station_id AND y5.year = year(m.time)"""
_MONTHS = ", m AS (SELECT DISTINCT o_custkey AS station_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS time FROM orders)"


def _customer_months(t: Tables):
    return t.read("orders").select(F.col("o_custkey").alias("station_id"), S.month_start(F.col("o_orderdate")).alias("time")).distinct()


@query("e3_landcover_features", "class_year", _MONTHS + _LCC)
def e3(t: Tables):
    return E.landcover_features(t.class_year, _customer_months(t), 1995, 2001)


@query("d1_named_transform", "class_year", _MONTHS + _LCC)
def d1(t: Tables):
    return E.TRANSFORMS["landcover_changes"](t.class_year, _customer_months(t), 1995, 2001)


@query("e4_build_report", "station monthly", ", n AS (SELECT station_id, count(*) AS n, min(time) AS a, max(time) AS z FROM monthly WHERE station_id NOT LIKE '%7' GROUP BY 1) SELECT s.station_id, coalesce(n.n, 0) AS n_months, a AS t_min, z AS t_max, CASE WHEN n.n > 0 THEN 'OK' ELSE 'NO_SERIES' END AS status FROM station s LEFT JOIN n USING (station_id)")
def e4(t: Tables):
    return E.build_report(t.station, t.monthly.where("station_id not like '%7'"))


@query("e8_valid_stations", "monthly", "SELECT station_id FROM monthly WHERE time >= DATE '2001-06-01' GROUP BY 1 HAVING count(CASE WHEN flux > 30 THEN flux END) > 0")
def e8(t: Tables):
    return E.valid_stations(None, t.monthly.where(F.col("time") >= "2001-06-01").withColumn("v", F.when(F.col("flux") > 30, F.col("flux"))), "v")


@query("k1_sorted_report", sql="SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1, 3 DESC")
def k1(t: Tables):
    n = t.read("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return K.sort_report(n, [("o_orderpriority", True), ("n", False)])


@query("k2_top_features", sql="SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def k2(t: Tables):
    return K.top_n(t.read("part").select("p_partkey", "p_retailprice"), "p_retailprice", 25, "p_partkey")


@query("k3_top_members", sql="SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def k3(t: Tables):
    return K.top_per_group(t.read("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", 3, "o_orderkey")


@query("k4_worst_of", sql="SELECT p_brand, worst, value FROM (SELECT p_brand, p_name || p_partkey AS worst, p_size AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name || p_partkey) AS k FROM part) WHERE k = 1")
def k4(t: Tables):
    p = t.read("part").select("p_brand", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), "p_size")
    return K.worst_of(p, "p_brand", "p_size", "name")


@query("k5_row_sample", sql="SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '/7'), o_orderkey LIMIT 500")
def k5(t: Tables):
    return K.sample_rows(t.read("orders"), "o_orderkey", 500, 7).select("o_orderkey")


@query("k6_first_stations", "monthly", "SELECT station_id, time FROM monthly WHERE station_id IN (SELECT DISTINCT station_id FROM monthly ORDER BY 1 LIMIT 10)")
def k6(t: Tables):
    return K.first_stations(t.monthly.select("station_id", "time"), 10)
