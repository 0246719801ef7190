"""Faults that showed on larger tables only."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom import plans
from gridloom.operators import evaluation as R
from gridloom.operators import experiments as X
from gridloom.operators import ml
from gridloom.operators import spatial as G
from gridloom.operators import windows as W
from gridloom.sources import tables as IO
from gridloom.sources.shared import materialize


def plan(df):
    return df._jdf.queryExecution().toString()


def test_covered_tiles_are_never_sent_to_all_tasks(spark):
    """Two small sides: Catalyst would send either; the points' tiles must stay where they are."""
    axes = G.Axes(89.75, -0.5, 360, -179.75, 0.5, 720)
    points = spark.createDataFrame([(1, 10, 700), (2, 20, 3)], "station_id long, y int, x int")
    cells = G._tiled(spark.createDataFrame([(12, 710)], "lat_idx int, lon_idx int"), 16)
    covering = G._covering(points, axes, 16, F.col("y"), F.col("x"), F.lit(5.0), F.lit(20.0))
    assert "SortMergeJoin" in plan(G._meet(covering, cells, False)) and "BroadcastExchange" not in plan(G._meet(covering, cells, False))
    sent = G._meet(covering, cells, True)
    assert "BuildRight" in plan(sent) and {r.station_id for r in sent.collect()} == {1, 2}


def test_no_window_goes_through_the_rest_of_its_group_for_each_row(spark):
    cells = spark.createDataFrame([(i, j, 1 if (i * 3 + j) % 7 == 0 else None) for i in range(9) for j in range(9)], "lat_idx int, lon_idx int, code int")
    got = G.distance_to_class(cells, [1], 1.0)
    assert "unboundedfollowing" not in plan(got).lower()
    source = [(i, j) for i in range(9) for j in range(9) if (i * 3 + j) % 7 == 0]
    for r in got.collect():
        assert abs(r.distance - min(((r.lat_idx - i) ** 2 + (r.lon_idx - j) ** 2) ** 0.5 for i, j in source)) < 1e-9
    filled = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, 7)], "k string, y int, v int").withColumn("v", W.back_fill("v", "k", "y"))
    assert "unboundedfollowing" not in plan(filled).lower()
    assert sorted((r.k, r.y, r.v) for r in filled.collect() if r.v) == [("a", 1, 5), ("a", 2, 5), ("b", 1, 7)]


def test_grid_sinks_take_rows_beyond_the_first_6000(spark, tmp_path):
    keys = [0, 401 * 3000 + 5, 401 * 6000 + 7]
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_totalprice": [10.0, 20.0, 30.0], "o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]}), tmp_path / "orders.parquet")
    for name in ("s10_grid_sink", "s10_conforming_sink"):
        assert {r.cell_id for r in plans.registered()[0][name](spark, str(tmp_path)).collect()} == set(keys)


def shifting(spark, kind, at):
    """A column whose value another evaluation of the same table changes in its last bit, as sums of doubles may."""
    runs = f"{spark.conf.get('spark.checkpoint.dir')}/evaluations-{kind}-{at}"

    @F.udf("double")
    def value(x):
        import os
        import uuid

        os.makedirs(runs, exist_ok=True)
        open(f"{runs}/{uuid.uuid4().hex}", "w").close()
        return x + len(os.listdir(runs)) * 1e-12

    return value.asNondeterministic()


def test_ranked_rows_keep_their_positions_when_values_shift(spark):
    rows = spark.createDataFrame([(f"s{i}", "e", float(i)) for i in range(40)], "station_id string, experiment string, score double")
    shifted = rows.withColumn("score", shifting(spark, "cdf", 0)("score"))
    assert R.cdf_table(shifted, ["experiment"]).count() == 40


def test_value_response_counts_every_row_when_contributions_shift(spark):
    rows = spark.createDataFrame([("f", float(i), float(i)) for i in range(40)], "feature string, value double, contribution double")
    got = ml.value_response(rows.withColumn("contribution", shifting(spark, "response", 0)("contribution")), []).first()
    assert got.n == 40 and got.spearman > 0.99


def test_fine_centres_are_not_shuffled(spark):
    """Same modes as by rasterised fine cells, but only whole cells are exchanged."""
    from gridloom.operators import aggregates as A

    axes = G.Axes(3.9, -0.2, 20, 0.1, 0.2, 20)
    ring = "array<struct<x: double, y: double>>"
    polygons = spark.createDataFrame([(1, [(0.0, 0.0), (2.3, 0.0), (2.3, 2.3), (0.0, 2.3)]), (2, [(1.03, 1.0), (3.5, 1.17), (2.0, 3.5)]), (3, [(3.0, 3.0), (3.9, 3.0), (3.9, 3.9)])], f"poly_id int, ring {ring}")
    polygons = materialize(polygons, "polygons")  # files have a known size
    cells = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)], "lat_idx int, lon_idx int")
    got = G.oversampled_mode(cells, axes, 5, polygons, [3])
    want = A.block_mode(G.rasterise(G.oversample(cells, axes, 5), polygons), "poly_id", 5, [3])
    rows = sorted(tuple(r) for r in got.select("lat_idx", "lon_idx", F.coalesce("poly_id", F.lit(-1))).collect())
    assert rows == sorted(tuple(r) for r in want.select("lat_idx", "lon_idx", F.coalesce("poly_id", F.lit(-1))).collect())
    assert len(rows) == 400 and {1, 2} < {r[2] for r in rows}
    exchanges = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and not any("_a" in x or "_px" in x for x in exchanges)


def test_a_matrix_is_made_once_for_all_fits(spark):
    """Preparing goes over the matrix for flags, categories, medians and again for each fit; only one pass makes its rows."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    matrix = spark.range(64).selectExpr("cast(id as double) x", "cast(id % 3 as string) c", "id % 2 = 0 as _even", "'train' split").mapInArrow(count, "x double, c string, _even boolean, split string")
    rows, _ = ml.prepare(matrix, ["x"], ["c"])
    assert rows.count() == rows.where("x > 5").count() + 6 and made.value == 64


@pytest.mark.parametrize("name", ["s1_series_scan", "s7_group_series"])
def test_series_files_lie_in_one_folder(spark, sf, name):
    """A folder for each station is listed by itself; files named by station are listed at once."""
    files = [f.rsplit("/", 1) for f in plans.registered()[0][name](spark, sf).inputFiles()]
    stations = {r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("MW_"), F.col("s_suppkey"), F.lit(".csv"))).collect()}
    assert len({folder for folder, _ in files}) == 1 and len(files) == len(stations) and {f for _, f in files} == stations


def test_written_series_come_back_whole(spark, tmp_path):
    """Stations longer than a batch, values without a short form, nulls; keys that the reader would lose are refused."""
    rows = spark.range(25_000).selectExpr("concat('MW_', id % 2) station_id", "date_add(date'1900-01-01', cast(id as int)) time", "if(id % 7 = 0, null, id / 3 * 1e-9) v")
    assert IO.write_series(rows, str(tmp_path / "a"), ["v"]) == 2
    back = IO.read_series(spark, str(tmp_path / "a"), ["v"])
    assert back.count() == 25_000 and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert IO.write_series(rows.limit(0), f"file://{tmp_path}/b", ["v"]) == 0 and IO.read_series(spark, f"file://{tmp_path}/b", ["v"]).count() == 0
    for key in ("a/b", "_a", "merge_report_1", "MW_1_monthly", None):
        bad = spark.createDataFrame([(key, 1.0)], "station_id string, v double").withColumn("time", F.current_date())
        with pytest.raises(Exception, match="no name of a series"):
            IO.write_series(bad, str(tmp_path / "c"), ["v"])


def test_wide_rows_are_filled_where_they_lie(spark):
    """Dealt by station, each task would hold nearly all wide rows; dealt by their order, one exchange does."""
    pred = spark.range(4000).selectExpr("cast(id % 20 as string) station_id", "id % 3 k", "date_add(date'2000-01-01', cast(id div 60 as int)) time", "id / 7 obs", "if(id % 5 = 0, null, id / 3) sim")
    for wide in (IO.wide_results(pred, [str(i) for i in range(20)], ["k"]), IO.wide_results(pred, [str(i) for i in range(20)], ["k"], 7)):
        exchanges = [x for x in wide._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
        assert len(exchanges) == 1 and "rangepartitioning(time" in exchanges[0]
        back = IO.long_results(wide, keys=["k"]).where("obs is not null").select(pred.columns)
        assert back.count() == 4000 and back.exceptAll(pred).isEmpty()
    assert [r.time for r in wide.collect()] == sorted(r.time for r in wide.collect()) and wide.rdd.getNumPartitions() == 7


def test_ranges_of_wide_rows_follow_the_stations(spark, tmp_path):
    from datetime import datetime

    pq.write_table(pa.table({"n_nationkey": pa.array([0], pa.int32()), "n_regionkey": pa.array([0], pa.int32())}), tmp_path / "nation.parquet")
    n = 4000
    pq.write_table(pa.table({"s_suppkey": pa.array(range(n), pa.int64()), "s_nationkey": pa.array([0] * n, pa.int32()), "s_acctbal": [1.0] * n}), tmp_path / "supplier.parquet")
    days = [datetime(1992 + i % 7, 1 + i % 12, 15) for i in range(n)]
    pq.write_table(pa.table({"l_suppkey": pa.array(range(n), pa.int64()), "l_quantity": [2.0] * n, "l_discount": [0.5] * n, "l_extendedprice": [3.0] * n, "l_shipdate": pa.array(days, pa.timestamp("us"))}), tmp_path / "lineitem.parquet")
    got = plans.registered()[0]["s11_all_wide_results"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 8 and got.count() == n * 9


def test_features_are_exchanged_once(spark):
    """Naming, inheritance and metadata meet by feature alone; an experiment's features never gather in one task."""
    ex = spark.createDataFrame([("a", None, "m"), ("b", "a", "m"), ("c", "b", "m")], "experiment string, base string, profile string")
    tok = spark.createDataFrame([("a", "include_group", "g1"), ("b", "exclude_feature", "f1"), ("b", "include_feature", "f2"), ("c", "include_feature", "f1"), ("c", "exclude_group", "g2")], "experiment string, op string, token string")
    meta = spark.createDataFrame([("f1", "g1", 1), ("f2", "g2", 2), ("f3", "g1", 3)], "feature string, group string, position int")
    for tasks in ({}, {"partitions": 7}):
        got = X.resolve_features(ex, tok, meta, **tasks)
        assert {tuple(r) for r in got.collect()} == {("a", "f1", 1), ("a", "f3", 3), ("b", "f2", 2), ("b", "f3", 3), ("c", "f1", 1), ("c", "f3", 3)}
        exchanges = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
        assert any("hashpartitioning(feature" in x for x in exchanges) and not any("hashpartitioning(experiment" in x and "feature" in x or "hashpartitioning(ancestor" in x and "feature" in x for x in exchanges)
    problems = X.config_problems(ex, tok, meta, got)
    assert "Aggregate [experiment#" in problems._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti, (experiment")[1]
    assert problems.count() == 0
