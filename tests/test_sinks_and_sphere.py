"""Nearest cells on the sphere, resumable and conforming sinks, pruned scans, zone products, levels, quantiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import spatial as G
from gridloom.operators import windows as W
from gridloom.sources import tables as IO


def distance(a, o, b, p):
    h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("axes", [G.Axes(87.5, -5.0, 36, -177.5, 5.0, 72), G.Axes(-88.0, 4.0, 45, 2.0, 4.0, 90), G.Axes(60.0, -2.0, 20, 150.0, 2.0, 25)])
@pytest.mark.parametrize("share", [0.02, 0.3])
def test_nearest_on_sphere_equals_all_distances(spark, axes, share):
    rng = random.Random(7)
    cells = [(y, x) for y in range(axes.n_lat) for x in range(axes.n_lon) if rng.random() < share]
    points = [(f"p{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(50)]
    points += [("date line", 10.0, 179.99), ("other side", 10.0, -179.99), ("north", 89.9, 13.0), ("pole", 90.0, 0.0), ("south", -89.95, -170.0), ("same", 10.0, 179.99)]
    df = spark.createDataFrame(points, "station_id string, lat double, lon double")
    parts, open_ = G.nearest_on_sphere(df.unionByName(spark.createDataFrame([("nowhere", None, 1.0)], df.schema)), spark.createDataFrame(cells, "lat_idx int, lon_idx int"), axes, tile=2)
    got = {r.station_id: r for part in parts for r in part.collect()}
    assert {r.station_id for r in open_.collect()} == {"nowhere"} and len(got) == len(points)
    for k, a, o in points:
        best = min(distance(a, o, axes.lat0 + axes.dlat * y, axes.lon0 + axes.dlon * x) for y, x in cells)
        assert got[k].dist_km == pytest.approx(best, abs=1e-6)


def test_station_by_the_date_line_takes_the_near_cell(spark):
    axes = G.Axes(89.5, -1.0, 180, -179.5, 1.0, 360)
    cells = spark.createDataFrame([(89, 0), (89, 300)], "lat_idx int, lon_idx int")  # 179.5 W and 120.5 E
    st = spark.createDataFrame([("a", 0.5, 179.6), ("b", 0.5, -179.9), ("c", 0.5, 180.2)], "station_id string, lat double, lon double")
    got = {r.station_id: r for r in G.choose_cells(st, cells, axes, 0.0, "nearest_global").collect()}
    assert {(r.lat_idx, r.lon_idx) for r in got.values()} == {(89, 0)} and got["a"].dist_km < 101
    assert got["b"].outcome == "home" and got["c"].outcome == "home"
    rescued = {r.station_id: r.outcome for r in G.choose_cells(st, cells, axes, 120.0, "keep_nan").collect()}
    assert rescued["a"] == "rescued"
    none = G.choose_cells(st, cells.limit(0), axes, 0.0, "nearest_global").collect()
    assert {r.outcome for r in none} == {"no_valid"}


def test_a_broken_store_is_finished(spark, tmp_path):
    path = str(tmp_path / "store")
    stations = spark.createDataFrame([(f"s{i}",) for i in range(30)] + [("s1",), (None,)], "station_id string")
    rows = spark.createDataFrame([(f"s{i % 30}", i) for i in range(90) if i % 30 != 4], "station_id string, v int")
    asked = []

    def build(mine, stop=2):
        if len(asked) == stop:
            raise RuntimeError("stopped")
        asked.append({r.station_id for r in mine.collect()})
        return rows.join(mine, "station_id", "left_semi")

    with pytest.raises(RuntimeError):
        IO.write_stations(stations, build, path, per_job=7)
    first = set().union(*asked)
    assert 0 < len(first) < 30 and {r.station_id for r in spark.read.parquet(path).collect()} == first - {"s4"}
    asked.clear()
    assert IO.write_stations(stations, lambda m: build(m, 99), path, per_job=7) == 30 - len(first)
    assert set().union(*asked) == {f"s{i}" for i in range(30)} - first
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [i for i in range(90) if i % 30 != 4]
    asked.clear()
    assert IO.write_stations(stations, lambda m: build(m, 99), path) == 0 and not asked
    assert IO.write_stations(stations, lambda m: build(m, 99), path, overwrite=True, limit=3) == 3
    assert {r.station_id for r in spark.read.parquet(path).collect()} == {"s0", "s1", "s10"}


GRID = "cell int, y double, longitude double, v double, c int"
SPEC = {"v": {"dtype": "float", "unit": "mm", "fill": -9999.0, "tier": "1"}, "c": {"dtype": "smallint", "unit": "1", "fill": -1}}


def test_conforming_sink_mends_and_verifies(spark, tmp_path):
    rows = [(i, 40.0 + i % 5, 5.0 + i // 5, -9999.0 if i == 3 else float("nan") if i == 4 else i / 2, -1 if i == 6 else i) for i in range(20)]
    df = spark.createDataFrame(rows, GRID)
    back = IO.save_grid(df, str(tmp_path / "g"), SPEC, ["cell"], bounds=(5, 40, 8, 44))
    got = {r.cell: r for r in back.collect()}
    assert dict(back.dtypes)["v"] == "float" and dict(back.dtypes)["c"] == "smallint"
    assert {f.name: f.metadata for f in back.schema.fields}["v"] == {"unit": "mm", "fill": -9999.0, "tier": "1"}
    assert [(got[i].lat_idx, got[i].lon_idx, got[i].lat, got[i].lon) for i in (0, 4, 7)] == [(4, 0, 40.0, 5.0), (0, 0, 44.0, 5.0), (2, 1, 42.0, 6.0)]
    assert got[3].v is None and got[4].v is None and got[6].c is None and got[5].v == 2.5
    for change, reason in (({"v": SPEC["v"] | {"unit": " "}}, "unit"), ({"v": {k: x for k, x in SPEC["v"].items() if k != "fill"}}, "fill"), ({"w": SPEC["v"]}, "no such"), ({"v": SPEC["v"] | {"dtype": "tinyint"}}, None), ({"c": SPEC["c"] | {"dtype": "tinyint"}}, None)):
        spec = SPEC | change
        if reason:
            with pytest.raises(ValueError, match=reason):
                IO.save_grid(df, str(tmp_path / "h"), spec)
    with pytest.raises(ValueError, match="don't fit"):
        IO.save_grid(df.withColumn("c", F.lit(70_000)), str(tmp_path / "h"), SPEC)
    with pytest.raises(ValueError, match="bounds"):
        IO.save_grid(df, str(tmp_path / "h"), SPEC, bounds=(5, 41, 8, 44))
    assert IO.save_grid(df.limit(0), str(tmp_path / "e"), SPEC, ["cell"]).count() == 0


def test_footers_answer_the_summary(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).selectExpr("cast(id as double) as lat", "id as k").write.parquet(path)
    r = IO.footer_summary(spark, path, ["lat", "k"])
    assert (r["rows"], r.min_lat, r.max_lat, r.max_k) == (100, 0.0, 99.0, 99)


def _scanned(df):
    """Rows that the scans of an executed query put out."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_box_skips_row_groups(spark, tmp_path):
    grid = spark.range(300 * 300).select(F.expr("cast(id div 300 as int)").alias("lat_idx"), F.expr("cast(id % 300 as int)").alias("lon_idx"), F.rand(1).alias("v"))
    grid = grid.withColumns({"lat": 60 - F.col("lat_idx") / 10, "lon": F.col("lon_idx") / 10})
    stations = spark.createDataFrame([("a", 50.0, 10.0), ("b", 50.4, 10.3)], "station_id string, lat double, lon double")
    seen = {}
    for name, written in (("clustered", IO.write_clustered_grid(grid, str(tmp_path / "c"), 1 << 15)), ("plain", None)):
        if written is None:
            grid.repartition(4).write.option("parquet.block.size", 1 << 15).parquet(str(tmp_path / "q"))
            written = spark.read.parquet(str(tmp_path / "q"))
        df = IO.read_grid(written, ["v"], stations, 5.0, 0.1)
        assert "PushedFilters: [" in df._jdf.queryExecution().toString() and "GreaterThanOrEqual(lat" in df._jdf.queryExecution().toString()
        n = len(df.collect())
        seen[name] = (n, _scanned(df))
    assert seen["clustered"][0] == seen["plain"][0] > 0
    assert seen["clustered"][1] < seen["plain"][1] / 4 and seen["clustered"][1] < 9_000, seen


def test_morton_keys_interleave_bits(spark):
    got = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (5, 3), (1023, 512)], "y int, x int").select("y", "x", IO.morton(F.col("y"), F.col("x")).alias("k")).collect()
    for r in got:
        assert r.k == sum(((r.y >> b & 1) << (2 * b + 1)) | ((r.x >> b & 1) << (2 * b)) for b in range(20))


def test_zone_products_equal_single_ones(spark):
    rng = random.Random(2)
    rows = [(c, t, c % 6 if c % 11 else None, c % 2, 1.0 + c % 3, *[None if rng.random() < 0.15 else rng.random() for _ in range(3)]) for c in range(60) for t in range(3)]
    df = spark.createDataFrame(rows, "cell_id int, time int, fine int, coarse int, area_m2 double, a double, b double, c double")
    products = {"p": ["a"], "q": ["b", "c"], "r": ["a", "c"]}
    got = {(r["product"], r.variable, r.level, r.zone_id, r.time): r["mean"] for r in A.zone_products(df, products, ["fine", "coarse"]).collect()}
    want = {}
    for p, vs in products.items():
        mask = A.valid_cells(df, vs, "time")
        for level in ("fine", "coarse"):
            for r in A.zonal_means(df.where(f"{level} is not null"), mask, vs, zone=level).collect():
                want |= {(p, v, level, r[level], r.time): r[v] for v in vs}
    assert got.keys() == want.keys() and any(v is not None for v in want.values()) and None in want.values()
    assert all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)


@pytest.mark.parametrize("sketch", [4000, 20])
def test_quantiles_equal_numpy(spark, monkeypatch, sketch):
    monkeypatch.setattr(A, "SKETCH", sketch)
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(5000)], "b": [float(rng.randint(0, 3)) for _ in range(3000)], "c": [2.0], None: [rng.random() for _ in range(11)], "e": [7.0] * 500}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0, 0.001, 0.25, 0.5, 0.9, 1]
    for r in A.quantiles(df, "v", ps, ["g"]).collect():
        if r.g == "d":
            assert r.n == 0 and r.p50 is None
        else:
            assert r.n == len(groups[r.g]) and [r[2 + i] for i in range(len(ps))] == pytest.approx(np.quantile(groups[r.g], ps).tolist())
    flat = [v for vs in groups.values() for v in vs]
    assert A.quantiles(df, "v", [0.5]).first().p50 == pytest.approx(np.quantile(flat, 0.5))


def test_quantiles_outside_their_brackets_come_from_positions(spark, monkeypatch):
    real = F.percentile_approx
    monkeypatch.setattr(A.F, "percentile_approx", lambda c, ps, acc=1: F.transform(real(c, ps, acc), lambda x: x + 100.0))
    df = spark.createDataFrame([("x", float(i)) for i in range(50)] + [("y", 5.0)], "g string, v double")
    got = {r.g: r.p50 for r in A.quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {"x": 24.5, "y": 5.0}


def test_empirical_cdf_of_ties_nulls_and_repeats(spark):
    rows = [("a", 1.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("a", None, 4), (None, 2.0, 5), ("a", 3.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    got = sorted((r.k, round(r.cdf, 6)) for r in W.empirical_cdf(df, "v", ["g"], "k").collect())
    assert got == [(1, 0.4), (2, 0.6), (3, 1.0), (3, 1.0), (4, 0.2), (5, 1.0)]
