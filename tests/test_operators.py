"""Operators on hand-made tables: nulls, ties, edges, and independent numpy checks."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import aggregates as A
from gridloom.operators import conform as P
from gridloom.operators import evaluation as R
from gridloom.operators import experiments as X
from gridloom.operators import features as E
from gridloom.operators import joins as J
from gridloom.operators import spatial as G
from gridloom.operators import windows as W
from gridloom.sources import tables as IO
from gridloom.streaming.rollup import run_once, windowed_rollup

D = datetime.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scalar_functions(spark):
    one = spark.range(1)
    got = one.select(
        S.depth_label(F.lit(0.05)), S.depth_label(F.lit(-2.0)), S.depth_label(F.lit(10.0)), S.depth_label(F.lit(0.3)), S.round_code(F.lit(2.5)), S.round_code(F.lit(3.5)),
        S.feature_group(F.lit("C3S__x")), S.feature_group(F.lit("plain")), S.base_column(F.lit("gwl_lag3"), ["gwl"]), S.base_column(F.lit("q_rmean3"), ["gwl"]),
        S.window_label(F.lit("a_rmean12")), S.window_label(F.lit("a")), S.core_basin_id(F.lit(2060012340)), S.valid_value(F.lit(float("nan"))), S.valid_value(F.lit(-9.0), -9), S.valid_value(F.lit(float("inf"))),
        S.auto_radius_km(F.lit(None).cast("double")), S.auto_radius_km(F.lit(0.1)), S.auto_radius_km(F.lit(0.001)), S.prettify(F.lit("soil_depth")), S.truthy(F.lit(None).cast("string")), S.sanitize(F.lit("a b-c.d")),
    ).first()
    assert list(got) == ["0p05", "m2", "10", "0p3", 2, 4, "lcc", "other", "gwl", "q_rmean3", "rmean12", "static", 20012340, None, None, None, 0.0, 22.264, 3.0, "Soil depth", None, "a_b_c_d"]


def test_rollup_nulls_and_dropped_months(spark):
    w = spark.createDataFrame([("a", D(2000, 1, 3), 1.0, None, 2.0, 1), ("a", D(2000, 1, 31), None, 4.0, None, 1), ("a", D(2000, 2, 1), None, 5.0, None, 1), ("b", D(2000, 2, 7), None, None, 3.0, 1)], "station_id string, week date, flux double, state double, target double, flag int")
    got = rows(A.monthly_rollup(w, "target", ["flux"], ["flag"]).select("station_id", "time", "flux", "state", "target"))
    assert got == [("a", D(2000, 1, 1), 1.0, 4.0, 2.0), ("b", D(2000, 2, 1), None, None, 3.0)]


def test_lags_and_means_never_see_now(spark):
    df = spark.createDataFrame([("a", i, float(i) if i != 3 else None) for i in range(8)], "station_id string, time int, x double")
    got = df.select("time", *[c.alias(n) for n, c in (W.lag_features(["x"], [1, 2]) | W.trailing_means(["x"], [2])).items()]).orderBy("time").collect()
    assert [r.x_lag1 for r in got] == [None, 0, 1, 2, None, 4, 5, 6]
    assert [r.x_rmean2 for r in got] == [None, 0, 0.5, 1.5, 2, 4, 4.5, 5.5]


def test_landcover_features(spark):
    annual = spark.createDataFrame([("a", 1995, 10), ("a", 1997, 20), ("b", 1999, 5), ("c", 1995, None)], "station_id string, year int, code int")
    months = spark.createDataFrame([(k, D(y, m, 1)) for k in "abc" for y, m in ((1994, 6), (1997, 1), (1998, 3), (2003, 1))], "station_id string, time date")
    got = {(r.station_id, r.time): tuple(r)[2:] for r in E.landcover_features(annual, months, 1995, 2000).collect()}
    # the gap of 1996 is filled from 1997, so the change is seen in 1996
    assert got["a", D(1994, 6, 1)] == (10, 10, 0, 0, -1)
    assert got["a", D(1997, 1, 1)] == (20, 20, 0, 0, 12)
    assert got["a", D(1998, 3, 1)] == (None, 20, 0, 0, 26)
    assert got["a", D(2003, 1, 1)] == (None, None, 0, 0, 84)
    assert got["b", D(1998, 3, 1)] == (5, 5, 0, 1, -1)
    assert got["c", D(2003, 1, 1)] == (None, None, 0, 1, -1)


def test_months_window_includes_the_end_month(spark):
    df = spark.createDataFrame([(D(1999, 12, 31),), (D(2000, 1, 1),), (D(2000, 12, 31),), (D(2001, 1, 1),)], "t date")
    assert df.where(P.in_months(F.col("t"), "2000-01", "2000-12")).count() == 2


def test_nearest_index_ties_go_to_the_lower_coordinate(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.5, 1.5, 1.51, 9.0)], "x double")
    up = [r[0] for r in df.select(J.nearest_index(F.col("x"), 0.0, 1.0, 4)).collect()]
    down = [r[0] for r in df.select(J.nearest_index(F.col("x"), 3.0, -1.0, 4)).collect()]
    assert up == [0, 0, 1, 2, 3] and down == [3, 3, 2, 1, 0]
    axis = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 4.0)], "idx int, coord double")
    pts = spark.createDataFrame([(i, x) for i, x in enumerate((-9.0, 0.5, 0.6, 2.5, 2.6, 50.0))], "k int, x double")
    assert [r.i for r in J.nearest_on_axis(pts, "x", axis, "i", 2.0).orderBy("k").collect()] == [0, 0, 1, 1, 2, 2]


def brute_cell(lat, lon, valid, axes, radius, policy):
    near = lambda v, o, s, n: min(range(n), key=lambda i: (abs(v - (o + i * s)), o + i * s))
    y, x = near(lat, axes.lat0, axes.dlat, axes.n_lat), near(lon, axes.lon0, axes.dlon, axes.n_lon)

    def dist(c):
        a, b = math.radians(lat), math.radians(axes.lat0 + c[0] * axes.dlat)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(axes.lon0 + c[1] * axes.dlon - lon) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    if (y, x) in valid:
        return (y, x, "home")
    best = min(valid, key=lambda c: (dist(c), c), default=None)
    if best and radius > 0 and dist(best) <= radius:
        return (*best, "rescued")
    if policy == "nearest_global" and best:
        return (*best, "nearest_global")
    return (None, None, "dropped" if policy == "skip_well" else "no_valid")


@pytest.mark.parametrize("policy", ["keep_nan", "skip_well", "nearest_global"])
def test_choose_cells(spark, policy):
    rng = random.Random(3)
    axes = G.Axes(50.0, -0.1, 30, 5.0, 0.1, 40)
    valid = {(y, x) for y in range(30) for x in range(40) if (y * 7 + x * 3) % 5 == 0 and x > 12}
    st = [(f"s{i}", 50.2 - rng.random() * 3.4, 4.8 + rng.random() * 4.4) for i in range(60)] + [("corner", 47.05, 5.05)]
    df = spark.createDataFrame(st, "station_id string, lat double, lon double")
    v = spark.createDataFrame(sorted(valid), "lat_idx int, lon_idx int")
    got = {r.station_id: (r.lat_idx, r.lon_idx, r.outcome) for r in G.choose_cells(df, v, axes, 15.0, policy).collect()}
    assert got == {k: brute_cell(a, o, valid, axes, 15.0, policy) for k, a, o in st}
    none = G.choose_cells(df, v.limit(0), axes, 15.0, policy).collect()
    assert {r.outcome for r in none} == {"dropped" if policy == "skip_well" else "no_valid"} and len(none) == 61
    assert all(r.keep == (policy == "keep_nan") for r in none)


def test_sampling_plan_has_no_nested_loop(spark):
    axes = G.Axes(50.0, -0.1, 30, 5.0, 0.1, 40)
    df = spark.createDataFrame([("a", 49.0, 6.0)], "station_id string, lat double, lon double")
    v = spark.createDataFrame([(1, 1)], "lat_idx int, lon_idx int")
    plan = G.choose_cells(df, v, axes, 15.0, "keep_nan")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_point_in_polygon_border_hole_and_null(spark):
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    polys = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in star]), (3, [{"x": 4.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 6.0, "y": 4.0}, {"x": 4.0, "y": 4.0}])], "poly_id int, ring array<struct<x:double,y:double>>")
    pts = [("in", 1.0, 1.0), ("notch", 2.0, 2.0), ("border", 4.0, 1.0), ("corner", 0.0, 0.0), ("out", 9.0, 9.0), ("null", None, 1.0), ("tip", 0.1, 3.7)]
    df = spark.createDataFrame([(k, x, y) for k, x, y in pts], "station_id string, lon double, lat double")
    got = {r.station_id: r.poly_id for r in J.points_in_polygons(df, polys).collect()}
    assert got == {"in": 7, "notch": None, "border": 3, "corner": 7, "out": None, "null": None, "tip": 7}


def test_zonal_mean_is_null_when_a_masked_cell_goes_missing(spark):
    t1, t2 = D(2000, 1, 1), D(2000, 2, 1)
    c = spark.createDataFrame([(1, 0, t1, 1.0, 2.0), (2, 0, t1, 3.0, 6.0), (3, 0, t1, 1.0, None), (1, 0, t2, 1.0, 4.0), (2, 0, t2, 3.0, None), (3, 0, t2, 1.0, 9.0), (4, 1, t1, 1.0, None), (4, 1, t2, 1.0, 1.0)], "cell_id int, zone_id int, time date, area_m2 double, v double")
    got = {(r.zone_id, r.time): r.v for r in A.zonal_means(c, A.valid_cells(c, ["v"], "time"), ["v"]).collect()}
    assert got == {(0, t1): 5.0, (0, t2): None, (1, t1): None, (1, t2): None}


def test_variance_parts(spark):
    rng = random.Random(1)
    data = [(i % 6, 1 + rng.random(), rng.gauss(i % 6, 1)) for i in range(200)] + [(0, 1.0, None)]
    r = A.variance_decomposition(spark.createDataFrame(data, "zone_id int, area_m2 double, v double"), "v").first()
    z, w, v = (np.array(x) for x in zip(*data[:200], strict=True))
    m = (w * v).sum() / w.sum()
    within = sum((w[z == k] * (v[z == k] - (w[z == k] * v[z == k]).sum() / w[z == k].sum()) ** 2).sum() for k in range(6)) / w.sum()
    assert abs(r.total - (w * (v - m) ** 2).sum() / w.sum()) < 1e-9 and abs(r.between + within - r.total) < 1e-9 and not r.suspicious


def test_block_mode_ties(spark):
    c = spark.createDataFrame([(0, 0, 5), (0, 1, 4), (1, 0, 0), (1, 1, None), (0, 2, 16), (5, 5, 0)], "lat_idx int, lon_idx int, code int")
    assert rows(A.block_mode(c, "code", 2, [16])) == sorted([(0, 0, 4), (0, 1, None), (2, 2, None)], key=str)


def test_height_above_drainage(spark):
    # row of cells flowing east to a drain, a cycle, a path off the grid, a cell below its drain
    cells = [(1, 0, 0, 9.0, 1.0, 1), (2, 0, 1, 7.0, 2.0, 1), (3, 0, 2, 5.0, 2000.0, 1), (4, 1, 0, 3.0, 1.0, 1), (5, 1, 1, 3.0, 1.0, 16), (6, 2, 0, 8.0, 1.0, 16), (7, 1, 2, 4.0, 1.0, 64), (8, 2, 1, None, 1.0, 64), (9, 2, 2, 8.0, 1.0, None)]
    got = {r.cell_id: r.hand for r in G.height_above_drainage(spark.createDataFrame(cells, "cell_id int, lat_idx int, lon_idx int, dem double, acc double, dir int"))
           .collect()}
    assert got == {1: 4.0, 2: 2.0, 3: 0.0, 4: None, 5: None, 6: None, 7: 0.0, 8: None, 9: None}


def test_height_above_drainage_on_a_long_path(spark):
    n = 300
    cells = [(i, 0, i, float(n - i), 5000.0 if i == n - 1 else 1.0, 1) for i in range(n)]
    got = {r.cell_id: r.hand for r in G.height_above_drainage(spark.createDataFrame(cells, "cell_id int, lat_idx int, lon_idx int, dem double, acc double, dir int")).collect()}
    assert got == {i: float(n - i - 1) for i in range(n)}


def test_distance_to_class(spark):
    rng = random.Random(4)
    cells = [(y, x, rng.choice([None] * 8 + [3, 4])) for y in range(12) for x in range(15)]
    got = {(r.klass, r.lat_idx, r.lon_idx): r.distance for r in G.distance_to_class(spark.createDataFrame(cells, "lat_idx int, lon_idx int, code int"), [3, 4, 9], 0.5).collect()}
    assert len(got) == 2 * 180
    for (k, y, x), d in got.items():
        assert abs(d - 0.5 * min(math.hypot(y - b, x - a) for b, a, c in cells if c == k)) < 1e-9


def test_distance_to_class_over_batch_borders(spark):
    rng = random.Random(5)
    cells = [(y, x, rng.choice([None] * 5 + [3])) for y in range(9) for x in range(11)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.lat_idx, r.lon_idx): r.distance for r in G.distance_to_class(spark.createDataFrame(cells, "lat_idx int, lon_idx int, code int"), [3], 1.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 99 and all(abs(d - min(math.hypot(y - b, x - a) for b, a, c in cells if c)) < 1e-9 for (y, x), d in got.items())


def test_points_in_many_polygons_equal_brute_force(spark):
    rng = random.Random(7)
    polys = []
    for i in range(25):
        cx, cy = rng.uniform(0, 20), rng.uniform(0, 20)
        polys.append((i, [(cx + rng.uniform(0.3, 4) * math.cos(t), cy + rng.uniform(0.3, 4) * math.sin(t)) for t in sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 40)))]))
    polys.append((3, polys[9][1]))  # a second part of polygon 3
    pts = [(f"p{i}", rng.uniform(-1, 21), rng.uniform(-1, 21)) for i in range(300)] + [("p0", None, 1.0)]

    def odd(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    df = spark.createDataFrame(polys, "poly_id int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([*pts, pts[5]], "station_id string, lon double, lat double")
    got = sorted((r.station_id, r.poly_id) for r in J.points_in_polygons(points.where("lon is not null"), df, bucket=1.5).collect())
    want = sorted((k, min((i for i, ring in polys if odd(ring, x, y)), default=None)) for k, x, y in [*pts[:-1], pts[5]])
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_segments_to_cells(spark):
    axes = G.Axes(10.0, -1.0, 11, 0.0, 1.0, 11)
    s = spark.createDataFrame([(1.0, 9.0, 4.0, 9.0, 5), (4.0, 9.0, 4.0, 9.0, 7)], "x1 double, y1 double, x2 double, y2 double, code int")
    assert rows(G.segments_to_cells(s, axes)) == [(1, 1, 5), (1, 2, 5), (1, 3, 5), (1, 4, 7)]


def test_balanced_folds(spark):
    sizes = {"a": 5, "b": 4, "c": 3, "d": 3, "e": 2}
    st = spark.createDataFrame([(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)] + [("x", None)], "station_id string, g string")
    got = E.balanced_folds(st, "g", 2)
    load, fold = [0, 0], {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold[g] = load.index(min(load))
        load[fold[g]] += n
    assert {r.g: r.fold for r in got.collect()} == fold and sorted(load) == [8, 9]
    assert got.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert {r.fold: r.n for r in E.fold_balance(got).collect()} == {0: load[0], 1: load[1]}


def test_scores_with_constants_nulls_and_one_row(spark):
    p = [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("n", 1.0, None), ("n", 2.0, 2.0), ("one", 4.0, 5.0), ("z", -1.0, 0.0), ("z", 1.0, 1.0), ("ok", 1.0, 1.5), ("ok", 2.0, 1.5), ("ok", 3.0, 3.5)]
    df = spark.createDataFrame(p, "station_id string, obs double, sim double")
    means = spark.createDataFrame([("ok", 2.5), ("c", 1.0)], "station_id string, mean double")
    got = {r.station_id: r for r in R.station_scores(df, ["station_id"], means).collect()}
    assert got["c"].nse is None and got["c"].r is None and got["c"].kge is None and got["c"].rmse == pytest.approx(math.sqrt(2.5))
    assert got["n"].rmse is None and got["one"].nse is None and got["one"].bias == 1.0 and got["z"].kge is None
    o, s = np.array([1.0, 2, 3]), np.array([1.5, 1.5, 3.5])
    assert got["ok"].nse == pytest.approx(1 - ((s - o) ** 2).sum() / ((o - 2.5) ** 2).sum())
    r = np.corrcoef(o, s)[0, 1]
    assert got["ok"].kge == pytest.approx(1 - math.sqrt((r - 1) ** 2 + (s.std() / o.std() - 1) ** 2 + (s.mean() / o.mean() - 1) ** 2))
    dropped = {r.station_id: r.n for r in R.station_scores(df, ["station_id"], drop_nulls=True, least=2).collect()}
    assert dropped == {"c": 2, "z": 2, "ok": 3}


def test_holm_is_monotone_and_counts_null_as_one(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(p)], "metric string, k int, p double")
    got = {r.k: r.p_holm for r in W.holm(df, "p", ["metric"], ["k"]).collect()}
    run, want = 0.0, {}
    for rank, i in enumerate(sorted(range(5), key=lambda i: 1.0 if p[i] is None else p[i])):
        run = max(run, min((5 - rank) * (1.0 if p[i] is None else p[i]), 1.0))
        want[i] = run
    assert got == pytest.approx(want)


def test_signed_rank_and_friedman_statistics(spark):
    rng = random.Random(5)
    s = [("nse", e, f"s{i}", round(rng.random(), 1)) for i in range(25) for e in "abc"]
    df = spark.createDataFrame(s, "metric string, experiment string, station_id string, score double")
    v = {(e, k): x for _, e, k, x in s}
    for r in R.wilcoxon(df).collect():
        d = [v[r.model_a, f"s{i}"] - v[r.model_b, f"s{i}"] for i in range(25)]
        d = [x for x in d if x != 0]
        rank = lambda x, d=d: sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2
        w = min(sum(rank(x) for x in d if x > 0), sum(rank(x) for x in d if x < 0))
        n = len(d)
        ties = sum(t**3 - t for t in [sum(abs(y) == a for y in d) for a in {abs(x) for x in d}])
        z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
        assert (r.w, r.n) == (w, n) and r.p_raw == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    f = R.friedman(df, 3).first()
    ranks, ties = dict.fromkeys("abc", 0.0), 0
    for i in range(25):
        x = {e: v[e, f"s{i}"] for e in "abc"}
        for e in "abc":
            ranks[e] += sum(y < x[e] for y in x.values()) + (sum(y == x[e] for y in x.values()) + 1) / 2
        ties += sum(t**3 - t for t in [list(x.values()).count(a) for a in set(x.values())])
    chi = (12 / (25 * 12) * sum(r * r for r in ranks.values()) - 3 * 25 * 4) / (1 - ties / (25 * 24))
    assert f.chi2 == pytest.approx(chi) and f.p == pytest.approx(math.exp(-chi / 2))
    assert R.friedman(df.where("experiment <> 'c'"), 2).first().chi2 is None


def test_experiment_errors(spark):
    ex = spark.createDataFrame([("a", "b", "m"), ("b", "a", "m")], "experiment string, base string, profile string")
    with pytest.raises(X.ConfigError):
        X.chains(ex)
    ex = spark.createDataFrame([("a", None, "m"), ("b", "a", "w"), ("c", "zz", "m")], "experiment string, base string, profile string")
    tok = spark.createDataFrame([("a", "include_group", "g"), ("b", "exclude_feature", "f1"), ("b", "include_feature", "nope")], "experiment string, op string, token string")
    meta = spark.createDataFrame([("f1", "g", 0), ("f2", "g", 1)], "feature string, group string, position int")
    res = X.resolve_features(ex, tok, meta)
    assert rows(res) == [("a", "f1", 0), ("a", "f2", 1), ("b", "f2", 1)]
    assert {(r.experiment, r.problem) for r in X.config_problems(ex, tok, meta, res).collect()} == {("b", "unknown feature"), ("b", "base of another profile"), ("c", "unknown base"), ("c", "no features left")}


def test_rule_lookup_order(spark):
    rules = spark.createDataFrame([("base", "era_t", 0, "b0"), ("base", "era", 1, "b1"), ("exact", "era_t_max", 2, "x"), ("prefix", "e", 3, "p1"), ("prefix", "er", 4, "p2")], "match_type string, key string, position int, label string")
    names = spark.createDataFrame([(n,) for n in ("era_t_max", "era_t_min", "era_q", "erb", "ez", "zz", "")], "column string")
    assert {r.column: r.label for r in J.rule_lookup(names, rules).collect()} == {"era_t_max": "x", "era_t_min": "b0", "era_q": "b1", "erb": "p2", "ez": "p1", "zz": None, "": None}


def test_series_files(spark, tmp_path):
    (tmp_path / "MW_1.csv").write_text("date,GWL,rain\n2000-01-03,1.5,2\n2000-01-10,oops,\n")
    (tmp_path / "MW_2_monthly.csv").write_text("date,GWL,rain\n2000-02-01,,7\n")
    (tmp_path / "merge_report.csv").write_text("date,GWL,rain\n2000-01-03,1,1\n")
    assert rows(IO.read_series(spark, str(tmp_path), ["GWL", "rain"])) == sorted([("MW_1", D(2000, 1, 3), 1.5, 2.0), ("MW_1", D(2000, 1, 10), None, None), ("MW_2", D(2000, 2, 1), None, 7.0)], key=str)
    p = tmp_path / "x.csv"
    p.write_bytes("# note\na;b\n1;gr\xfcn\n".encode("latin-1"))
    assert rows(IO.read_delimited(spark, str(p))) == [("1", "grün")]
    assert IO.read_group_series(spark, {"q": str(tmp_path / "none")}, ["v"]).count() == 0
    assert IO.read_first_existing(spark, [str(tmp_path / "none")], "a int").columns == ["a"]


def test_grid_sink_verifies(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 50.0, 5.0, 1.0), (1, 0, 49.0, 5.0, None)], "lat_idx int, lon_idx int, lat double, lon double, v double")
    assert dict(IO.write_grid(g, str(tmp_path / "g"), {"v": "float"}, (0, 40, 10, 60)).dtypes)["v"] == "float"
    with pytest.raises(ValueError):
        IO.write_grid(g, str(tmp_path / "h"), {"v": "float"}, (0, 49.5, 10, 60))


def test_attributions_sum_to_the_prediction(spark):
    from gridloom.operators import ml

    rng = random.Random(6)
    data = [(i, rng.random(), rng.random(), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, c, 3 * a + b * (c == "x"), "train") for i, a, b, c in data], "row_id int, a double, b double, c string, y double, split string")
    prepared, _ = ml.prepare(df, ["a", "b"], ["c"])
    model, _, _ = ml.fit_member(prepared, "y", 1, rounds=4, depth=3, least=5)
    leaves, base = ml.leaf_paths(model)
    got = ml.attributions(prepared.limit(40), model, ["a", "b", "c"], "row_id").groupBy("row_id").agg(F.sum("contribution").alias("s")).collect()
    pred = {str(r.row_id): (r.prediction, r.features.toArray()) for r in model.transform(prepared).collect()}
    for r in got:
        assert r.s + base == pytest.approx(pred[r.row_id][0])
    # brute force over feature subsets for some rows
    for k in list(pred)[:5]:
        x = pred[k][1]

        def value(known, x=x):
            total = 0.0
            for v, route in leaves:
                for f, lo, hi, cats, share in route:
                    v *= (lo < x[f] <= hi and (cats is None or x[f] in cats)) if f in known else share
                total += v
            return total

        phi = ml.shapley(x[None, :], leaves)[0]
        for f in range(3):
            others = [g for g in range(3) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, f}) - value(set(s))) for n in range(3) for s in itertools.combinations(others, n))
            assert phi[f] == pytest.approx(want)


def test_streaming_rollup_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    data = [(t0 + datetime.timedelta(hours=i), i % 3, float(i)) for i in range(240)]
    df = spark.createDataFrame(data, "ts timestamp, k int, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_once(windowed_rollup(stream, "ts", ["k"], ["v"], []), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.k, r.start): (r.v, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.k, r.start): (r.v, r.n) for r in windowed_rollup(df, "ts", ["k"], ["v"], []).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_feature_matrix_shuffles_once(spark):
    df = spark.createDataFrame([("a", D(2000, 1, 1), 1.0)], "station_id string, time date, x double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = E.feature_matrix(df, ["x"], [], None, [])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_segments_of_southern_stations_reach_the_grid(spark, tmp_path):
    """Station 0 lies at latitude 47, its segment starts in row 340 of the grid."""
    from gridloom import plans

    spark.createDataFrame([(0, 1, 1.0)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, 1)], "n_nationkey long, n_regionkey long").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(401 * 400,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = plans.registered()[0]["g8_segments_to_cells"](spark, str(tmp_path)).collect()
    assert (340, 0, 3) in [(r.lat_idx, r.lon_idx, r.code) for r in got]


def test_config_problems_cover_all_parts_and_customers(spark, tmp_path):
    """Part 300 is a feature; customer 300 names it, customer 301 names none."""
    from gridloom import plans

    spark.createDataFrame([(0, 0, "A")], "n_nationkey long, n_regionkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(0, "g0")], "r_regionkey long, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    spark.createDataFrame([(i, 0) for i in (1, 300, 301)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 7), (300, 7)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = plans.registered()[0]["e11_config_problems"](spark, str(tmp_path)).collect()
    assert [r.token for r in got if r.problem == "unknown feature"] == ["f301"]


def test_group_series_query_returns_the_operators_rows(spark, sf, monkeypatch):
    """An operator that loses its rows shows in the query."""
    from gridloom import plans
    from gridloom.sources import tables

    whole = tables.read_group_series
    monkeypatch.setattr(tables, "read_group_series", lambda *a, **k: whole(*a, **k).limit(0))
    assert plans.registered()[0]["s7_group_series"](spark, sf).count() == 0


def test_scores_do_not_cancel(spark):
    """Constants without an exact binary form, and small steps on a large offset."""
    o = [1e6 + 0.001 * i for i in range(50)]
    s = [x + (0.0005 if i % 3 else -0.0008) for i, x in enumerate(o)]
    rows_ = [("c", 0.1, 0.1 + 0.01 * i) for i in range(7)] + [("k", 0.1 + 0.01 * i, 0.3) for i in range(7)] + [("o", a, b) for a, b in zip(o, s, strict=True)]
    got = {r.station_id: r for r in R.station_scores(spark.createDataFrame(rows_, "station_id string, obs double, sim double"), ["station_id"]).collect()}
    assert got["c"].r is None and got["c"].nse_classic is None and got["c"].kge is None and got["c"].kge_a is None
    assert got["k"].r is None and got["k"].alpha == 0.0 and got["k"].kge is None
    d = np.array(s) - np.array(o)
    assert got["o"].rmse == pytest.approx(math.sqrt((d**2).mean()), rel=1e-6)
    assert got["o"].r == pytest.approx(np.corrcoef(np.array(o) - 1e6, np.array(s) - 1e6)[0, 1], rel=1e-6) and got["o"].r < 1
    assert got["o"].nse_classic == pytest.approx(1 - (d**2).sum() / ((np.array(o) - np.mean(o)) ** 2).sum(), rel=1e-6)


def test_gradient_stops_at_gaps(spark):
    cells = spark.createDataFrame([(0, x, v) for x, v in ((0, 0.0), (1, 10.0), (5, 110.0), (6, 120.0), (9, 1.0), (11, 5.0), (12, None), (13, 7.0))], "y int, x int, v double")
    got = {r.x: r.d for r in cells.select("x", W.central_difference("v", "y", "x").alias("d")).collect()}
    assert got == {0: 10.0, 1: 10.0, 5: 10.0, 6: 10.0, 9: None, 11: None, 12: 1.0, 13: None}


def test_depth_mean_needs_all_layers(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0), (1, None, 1.0), (2, 4.0, 1.0), (2, 8.0, 3.0)], "k int, v double, t double")
    assert {r.k: r.v for r in A.depth_mean(df, ["k"], "v", "t").collect()} == {1: None, 2: 7.0}


def test_longitudes_wrap_only_beyond_180(spark):
    near = spark.createDataFrame([(180.0, 1), (-180.0, 2), (None, 3)], "lon double, _x int")
    assert rows(P.wrap_longitudes(near)) == sorted([(180.0, 1), (-180.0, 2), (None, 3)], key=str)
    far = spark.createDataFrame([(0.0,), (180.0,), (359.5,)], "lon double")
    assert rows(P.wrap_longitudes(far)) == sorted([(0.0,), (-180.0,), (-0.5,)], key=str)
    assert P.wrap_longitudes(near.limit(0)).collect() == []


def test_value_positions_and_quantiles(spark):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)])) for _ in range(400)] + [("none", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double").repartition(5)
    got = {(r.k, r.v): (r["_count"], r["_before"]) for r in W.value_positions(df.where("v is not null"), "v", ["k"]).collect()}
    known = [(k, float(v)) for k, v in data if v is not None]
    assert got == {(k, v): (known.count((k, v)), sum(a == k and b < v for a, b in known)) for k, v in known}
    q = {r.k: (r.n, r.p10, r.p50, r.p90) for r in A.quantiles(df, "v", [0.1, 0.5, 0.9], ["k"]).collect()}
    for k in ("a", "b", None):
        v = [b for a, b in known if a == k]
        assert q[k][0] == len(v) and q[k][1:] == pytest.approx(tuple(np.quantile(v, [0.1, 0.5, 0.9])))
    assert q["none"] == (0, None, None, None)
    one = A.quantiles(df, "v", [0.25]).first()
    assert one.n == len(known) and one.p25 == pytest.approx(np.quantile([b for _, b in known], 0.25))
    assert A.quantiles(df.limit(0), "v", [0.25]).first().p25 is None


def test_signed_rank_p_is_exact_for_few_pairs(spark):
    s = [("m", e, f"s{i}", x) for i, (a, b) in enumerate([(1.0, 0.9), (2.0, 2.25), (3.0, 2.5), (4.0, 3.3), (5.0, 4.0), (6.0, 4.6)]) for e, x in (("a", a), ("b", b))]
    r = R.wilcoxon(spark.createDataFrame(s, "metric string, experiment string, station_id string, score double")).first()
    d = [a - b for a, b in [(1.0, 0.9), (2.0, 2.25), (3.0, 2.5), (4.0, 3.3), (5.0, 4.0), (6.0, 4.6)]]
    order = sorted(d, key=abs)
    signs = list(itertools.product([0, 1], repeat=6))
    sums = [sum(k + 1 for k, up in enumerate(x) if up) for x in signs]
    w = min(sum(k + 1 for k, x in enumerate(order) if x > 0), sum(k + 1 for k, x in enumerate(order) if x < 0))
    assert r.w == w and r.p_raw == pytest.approx(2 * sum(x <= w for x in sums) / 64)
    assert R.signed_rank_p(5, 0) == pytest.approx(2 / 32) and R.signed_rank_p(4, 5) == 1.0


def test_row_sample_is_the_same_for_any_order(spark):
    from gridloom.operators import ordering as K

    df = spark.range(500).withColumnRenamed("id", "k")
    a = [r.k for r in K.sample_rows(df, "k", 40, 3).collect()]
    b = [r.k for r in K.sample_rows(df.repartition(7), "k", 40, 3).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 40 and sorted(a) != sorted(r.k for r in K.sample_rows(df, "k", 40, 4).collect())
    assert 150 < np.mean(a) < 350 and K.sample_rows(df, "k", 900, 3).count() == 500


def test_completeness_of_datasets(spark):
    df = spark.createDataFrame([("s1", D(2000, 1, 1), 1.0, None, None), ("s1", D(2000, 2, 1), 1.0, 2.0, None), ("s2", D(2000, 1, 1), 1.0, 1.0, 3.0), ("s2", D(2000, 3, 1), None, None, None)], "station_id string, time date, a__x double, a__y double, b__z double")
    from gridloom.operators import quality as Q

    cover = spark.createDataFrame([("a", D(2000, 1, 1), D(2000, 2, 1)), ("b", D(2000, 1, 1), D(2000, 1, 1))], "dataset string, first date, last date")
    assert rows(Q.dynamic_completeness(df, cover)) == [("a", 1, 0, pytest.approx(100 / 6)), ("b", 1, 1, 50.0)]
    st = spark.createDataFrame([("s1", 1.0, None, None), ("s2", None, None, 1.0)], "station_id string, a__x double, a__y double, C3S__z double")
    assert rows(Q.static_completeness(st)) == [("a", 2, 2, 1, 75.0, "a__y"), ("lcc", 1, 1, 1, 50.0, "C3S__z")]
    assert rows(Q.feature_nulls(st))[0] == ("a", "a__x", 1, 2, "x") and Q.static_completeness(st.limit(0)).collect() == []


def test_ensembles_folds_and_deployment(spark):
    from gridloom.operators import ml

    rng = random.Random(9)
    data = [(f"s{i % 12}", i, rng.random(), rng.choice("xy"), ["train", "stop", "test"][i % 3], i % 12 % 3) for i in range(240)]
    df = spark.createDataFrame([(s, t, a, c, 2 * a + (c == "x"), split, fold) for s, t, a, c, split, fold in data], "station_id string, time int, a double, c string, y double, split string, fold int")
    truth = {(r.station_id, r.time): r for r in df.collect()}
    options = {"rounds": 4, "depth": 3, "least": 2}
    out, log = ml.temporal_ensemble(df, "y", ["a"], ["c"], [1, 2], ["station_id", "time"], **options)
    got = out.collect()
    assert sorted((r.station_id, r.time, r.seed) for r in got) == sorted((s, t, k) for s, t, *_, split, _f in data if split == "test" for k in (1, 2))
    assert all(r.obs == truth[r.station_id, r.time].y and abs(r.sim - r.obs) < 0.6 for r in got)
    for e in log:
        assert len(e["losses"]) == 4 and e["losses"][e["rounds"] - 1] == min(e["losses"]) and e["model"].getNumTrees == e["rounds"]
    assert {(r.seed, r.round): r.loss for r in ml.loss_history(log, spark).collect()} == {(e["seed"], i + 1): x for e in log for i, x in enumerate(e["losses"])}
    imp = ml.importances(log, ["a", "c"], spark).groupBy("seed").agg(F.sum("importance").alias("s")).collect()
    assert len(imp) == 2 and all(r.s == pytest.approx(1) for r in imp)
    cv, members = ml.grouped_cv(df.drop("split"), "y", ["a"], ["c"], 3, [1, 2], 1, ["station_id", "time"], **options)
    got = cv.collect()
    assert sorted((r.station_id, r.time, r.fold) for r in got) == sorted((s, t, f) for s, t, *_, f in data)
    assert all(r.ens_median == r.ens_mean and r.obs == truth[r.station_id, r.time].y for r in got)
    by = {}
    for m in members.collect():
        by.setdefault(m.fold, []).append(m)
    assert all(len(v) == 2 and [m.rmse for m in v if m.picked] == [min(m.rmse for m in v)] for v in by.values())
    prepared, _ = ml.prepare(df.drop("split"), ["a"], ["c"])
    picked = sorted(m.rounds for v in by.values() for m in v if m.picked)
    models = ml.deployment(prepared, "y", members, [5, 6], depth=3, least=2)
    assert [m.getNumTrees for m in models] == [picked[1]] * 2
    parts = [spark.createDataFrame([("r", "f", 1.0, x), ("r", "g", 2.0, -x)], "row_id string, feature string, value double, contribution double") for x in (1.0, 4.0)]
    assert rows(ml.ensemble_attributions(parts)) == [("r", "f", 1.0, 2.5), ("r", "g", 2.0, -2.5)]
