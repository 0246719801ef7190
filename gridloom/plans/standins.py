"""Stations, series, grids and predictions derived from the given relational tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import pixel_area_m2
from gridloom.operators.aggregates import monthly_rollup
from gridloom.operators.spatial import Axes

N_LON = 401
RES = 0.025
EXPERIMENTS = {"m13": 13, "m17": 17, "m19": 19}
SEEDS = [1, 2, 3]
#: Unit of the stand-in values; a factor without a short decimal form, so that rounded means have no ties.
UNIT = 0.8537613


class Tables:
    """The stand-in tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def station(self) -> DataFrame:
        k = F.col("s_suppkey")
        s = self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            F.concat(F.lit("MW_"), k.cast("string")).alias("station_id"), k.alias("num"),
            ((k * 37 % 850 + 4700).cast("double") / 100).alias("lat"), ((k * 91 % 1000 + 550).cast("double") / 100).alias("lon"),
            F.col("s_nationkey").alias("zone1"), F.col("n_regionkey").alias("zone2"), F.col("s_acctbal").alias("depth_m"),
        )

    @cached_property
    def weekly(self) -> DataFrame:
        li = self.read("lineitem").select(F.concat(F.lit("MW_"), F.col("l_suppkey").cast("string")).alias("station_id"), F.date_trunc("week", "l_shipdate").cast("date").alias("week"), "l_quantity", "l_discount", "l_extendedprice")
        return li.groupBy("station_id", "week").agg(F.sum("l_quantity").alias("flux"), (F.avg("l_discount") * UNIT).alias("state"), (F.avg("l_extendedprice") * UNIT).alias("target"))

    @cached_property
    def monthly(self) -> DataFrame:
        return monthly_rollup(self.weekly, "target", ["flux"])

    @cached_property
    def num(self):
        return F.substring("station_id", 4, 20).cast("long")

    @cached_property
    def pred(self) -> DataFrame:
        runs = F.array(*[F.struct(F.lit(e).alias("experiment"), F.lit(m).alias("m"), F.lit(s).alias("seed")) for e, m in EXPERIMENTS.items() for s in SEEDS])
        p = self.monthly.select("station_id", "time", F.col("target").alias("obs"), F.inline(runs))
        shift = (self.num * F.col("seed") + F.month("time")) % F.col("m") - 6
        return p.select("experiment", "seed", "station_id", "time", "obs", (F.col("obs") * (shift.cast("double") / 100 + 1)).alias("sim"))

    @cached_property
    def axes(self) -> Axes:
        top = self.read("orders").agg(F.max("o_orderkey")).first()[0] or 0
        return Axes(55.5, -RES, top // N_LON + 1, 5.5, RES, N_LON)

    @cached_property
    def grid(self) -> DataFrame:
        o = self.read("orders").select(F.col("o_orderkey").alias("cell_id"), "o_totalprice", "o_orderpriority")
        o = o.withColumns({"lat_idx": F.expr(f"cast(cell_id div {N_LON} as int)"), "lon_idx": (F.col("cell_id") % N_LON).cast("int")})
        ok = (F.col("lat_idx") * 7 + F.col("lon_idx") * 13) % 11 != 0
        lat = (F.lit(2220) - F.col("lat_idx")).cast("double") / 40
        return o.select(
            "cell_id", "lat_idx", "lon_idx", lat.alias("lat"), ((F.lit(220) + F.col("lon_idx")).cast("double") / 40).alias("lon"),
            F.when(ok, F.col("o_totalprice") * UNIT).alias("value"), F.substring("o_orderpriority", 1, 1).cast("int").alias("code"),
            (F.expr("lat_idx div 8") * 100 + F.expr("lon_idx div 50")).cast("int").alias("zone_id"), pixel_area_m2(lat, RES, RES).alias("area_m2"),
        )

    @cached_property
    def globe_axes(self) -> Axes:
        return Axes(89.75, -0.5, 360, -179.75, 0.5, 720)

    @cached_property
    def globe(self) -> DataFrame:
        """Valid cells of a half-degree grid that goes round the globe."""
        cell = F.col("o_orderkey") * 7919 % 259200
        g = self.read("orders").select(F.expr("cast((o_orderkey * 7919 % 259200) div 720 as int)").alias("lat_idx"), (cell % 720).cast("int").alias("lon_idx"))
        return g.where((F.col("lat_idx") * 7 + F.col("lon_idx") * 13) % 29 == 0).distinct()

    @cached_property
    def globe_station(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(k.alias("station_id"), ((k * 37 % 1799 - 899) / 10 + 0.013).alias("lat"), ((k * 911 % 3599 - 1799) / 10 + 0.0171).alias("lon"))

    @cached_property
    def grid_month(self) -> DataFrame:
        g = self.grid.withColumn("month", F.explode(F.array(*[F.lit(m) for m in (1, 2, 3)])))
        v = ((F.col("lat_idx") * 3 + F.col("lon_idx") * 5 + F.col("month")) % 97).cast("double") / 10
        w = F.when((F.col("cell_id") + F.col("month")) % 50 != 0, F.col("cell_id") % 13 + F.col("month")).cast("double")
        return g.select("cell_id", "lat_idx", "lon_idx", "lat", "lon", "zone_id", "area_m2", F.make_date(F.lit(2000), F.col("month"), F.lit(1)).alias("time"), F.when(F.col("value").isNotNull(), v).alias("v1"), w.alias("v2"))

    @cached_property
    def class_year(self) -> DataFrame:
        o = self.read("orders").select(F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year"), F.substring("o_orderpriority", 1, 1).cast("int").alias("code"))
        return o.groupBy("station_id", "year").agg(F.mode("code", True).alias("code"))

    @cached_property
    def attribution(self) -> DataFrame:
        li = self.read("lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), "l_quantity", "l_discount", "l_tax")
        m = li.agg(*[F.avg(c).alias(f"m_{c}") for c in ("l_quantity", "l_discount", "l_tax")])
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), (F.col(c) - F.col(f"m_{c}")).alias("contribution")) for c in ("l_quantity", "l_discount", "l_tax")])
        return li.join(F.broadcast(m)).select("row_id", F.inline(rows))


CTE = {
    "station": "SELECT 'MW_' || s_suppkey AS station_id, s_suppkey AS num, CAST(s_suppkey * 37 % 850 + 4700 AS DOUBLE) / 100 AS lat, CAST(s_suppkey * 91 % 1000 + 550 AS DOUBLE) / 100 AS lon, s_nationkey AS zone1, n_regionkey AS zone2, s_acctbal AS depth_m FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "weekly": "SELECT 'MW_' || l_suppkey AS station_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS flux, avg(l_discount) * 0.8537613::DOUBLE AS state, avg(l_extendedprice) * 0.8537613::DOUBLE AS target FROM lineitem GROUP BY 1, 2",
    "monthly": "SELECT station_id, CAST(date_trunc('month', week) AS DATE) AS time, sum(flux) AS flux, avg(state) AS state, avg(target) AS target, CAST(date_diff('day', DATE '1970-01-01', CAST(date_trunc('month', week) AS DATE)) AS DOUBLE) AS time_days FROM weekly GROUP BY 1, 2, 6 HAVING avg(target) IS NOT NULL",
    "pred": "SELECT e.experiment, s.seed, station_id, time, target AS obs, target * (CAST((CAST(substr(station_id, 4) AS BIGINT) * s.seed + month(time)) % e.m - 6 AS DOUBLE) / 100 + 1) AS sim FROM monthly CROSS JOIN (VALUES ('m13', 13), ('m17', 17), ('m19', 19)) e(experiment, m) CROSS JOIN (VALUES (1), (2), (3)) s(seed)",
    "grid": "SELECT cell_id, lat_idx, lon_idx, CAST(2220 - lat_idx AS DOUBLE) / 40 AS lat, CAST(220 + lon_idx AS DOUBLE) / 40 AS lon, CASE WHEN (lat_idx * 7 + lon_idx * 13) % 11 <> 0 THEN o_totalprice * 0.8537613::DOUBLE END AS value, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code, CAST((lat_idx // 8) * 100 + lon_idx // 50 AS INTEGER) AS zone_id, 40589641000000.0::DOUBLE * radians(0.025::DOUBLE) * abs(sin(radians(CAST(2220 - lat_idx AS DOUBLE) / 40 + 0.0125::DOUBLE)) - sin(radians(CAST(2220 - lat_idx AS DOUBLE) / 40 - 0.0125::DOUBLE))) AS area_m2 FROM (SELECT o_orderkey AS cell_id, CAST(o_orderkey // 401 AS INTEGER) AS lat_idx, CAST(o_orderkey % 401 AS INTEGER) AS lon_idx, o_totalprice, o_orderpriority FROM orders)",
    "globe": "SELECT DISTINCT CAST((o_orderkey * 7919 % 259200) // 720 AS INTEGER) AS lat_idx, CAST(o_orderkey * 7919 % 259200 % 720 AS INTEGER) AS lon_idx FROM orders WHERE ((o_orderkey * 7919 % 259200) // 720 * 7 + o_orderkey * 7919 % 259200 % 720 * 13) % 29 = 0",
    "globe_station": "SELECT c_custkey AS station_id, (c_custkey * 37 % 1799 - 899) / 10::DOUBLE + 0.013::DOUBLE AS lat, (c_custkey * 911 % 3599 - 1799) / 10::DOUBLE + 0.0171::DOUBLE AS lon FROM customer",
    "grid_month": "SELECT cell_id, lat_idx, lon_idx, lat, lon, zone_id, area_m2, make_date(2000, m, 1) AS time, CASE WHEN value IS NOT NULL THEN CAST((lat_idx * 3 + lon_idx * 5 + m) % 97 AS DOUBLE) / 10 END AS v1, CASE WHEN (cell_id + m) % 50 <> 0 THEN CAST(cell_id % 13 + m AS DOUBLE) END AS v2 FROM grid CROSS JOIN (VALUES (1), (2), (3)) x(m)",
    "class_year": "SELECT station_id, year, code FROM (SELECT *, row_number() OVER (PARTITION BY station_id, year ORDER BY n DESC, code) AS k FROM (SELECT o_custkey AS station_id, year(o_orderdate) AS year, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code, count(*) AS n FROM orders GROUP BY 1, 2, 3)) WHERE k = 1",
    "attribution": "SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, f.feature, CASE f.feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END AS value, CASE f.feature WHEN 'l_quantity' THEN l_quantity - mq WHEN 'l_discount' THEN l_discount - md ELSE l_tax - mt END AS contribution FROM lineitem CROSS JOIN (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt FROM lineitem) CROSS JOIN (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) f(feature)",
}
NEEDS = {"monthly": ["weekly"], "pred": ["weekly", "monthly"], "grid_month": ["grid"]}


def with_tables(names: list[str], sql: str) -> str:
    """The SQL behind the stand-ins it needs; sql may go on with more common table expressions after a leading comma."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " + sql
