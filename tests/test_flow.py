"""Drainage over tiles, points of one key in polygons, explanation bundles."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.operators import spatial as G

CELLS = "cell_id int, lat_idx int, lon_idx int, dem double, acc double, dir int"


def _hand(cells, most):
    at = {(c[1], c[2]): c for c in cells}
    out = {}
    for c in cells:
        here, steps = c, 0
        while here is not None and not (here[4] or 0) >= 1000 and steps <= most:
            move = J.D8.get(here[5])
            here, steps = (at.get((here[1] + move[0], here[2] + move[1])) if move else None), steps + 1
        ok = here is not None and steps <= most and c[3] is not None and here[3] is not None
        out[c[0]] = max(c[3] - here[3], 0.0) if ok else None
    return out


@pytest.mark.parametrize(("tile", "most"), [(4, 5000), (3, 5), (64, 5000), (5, 1)])
def test_drainage_over_tiles_equals_walking(spark, tile, most):
    rng = random.Random(tile)
    cells = [(y * 30 + x, y, x, rng.choice([None, *range(40)]), rng.choice([None, 5000.0, *[1.0] * 18]), rng.choice([None, *[1] * 6, *[2] * 3, 4, 64, 128, 16, 7])) for y in range(20) for x in range(30) if rng.random() < 0.95]
    cells = [(i, y, x, None if d is None else float(d), a, k) for i, y, x, d, a, k in cells]
    got = {r.cell_id: r.hand for r in G.height_above_drainage(spark.createDataFrame(cells, CELLS), max_steps=most, tile=tile).collect()}
    assert got == _hand(cells, most) and any(v is not None for v in got.values())


def test_points_of_one_key_are_judged_apart(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    polygons = spark.createDataFrame([(1, ring), (1, [(x + 20, y) for x, y in ring])], "poly_id int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([("a", 1.0, 1.0), ("a", 9.0, 9.0), ("a", 1.0, 1.0), (None, 21.0, 1.0), ("b", None, 1.0)], "station_id string, lon double, lat double")
    got = sorted(((r.station_id, r.lon, r.poly_id) for r in J.points_in_polygons(points, polygons).collect()), key=str)
    assert got == sorted([("a", 1.0, 1), ("a", 9.0, None), ("a", 1.0, 1), (None, 21.0, 1), ("b", None, None)], key=str)


def test_bundle_has_groups_windows_and_categories(spark):
    from gridloom.operators import ml

    df = spark.createDataFrame([(1.0, "x", 1.0), (2.0, "y", 2.0), (3.0, None, 5.0)], "C3S__flux_lag3 double, kind string, y double")
    rows, model = ml.prepare(df, ["C3S__flux_lag3"], ["kind"])
    codes = {(r.feature, r.code): r.category for r in ml.category_codes(model).collect()}
    assert codes == {("kind", 0): "x", ("kind", 1): "y", ("kind", 2): None}
    long = spark.createDataFrame([(str(i), f, v, c) for i in range(3) for f, v, c in (("C3S__flux_lag3", 1.0 + i, 0.5), ("kind", float(i), 0.2))], "row_id string, feature string, value double, contribution double")
    got = {(r.feature, r.row_id): r for r in ml.explanation_bundle(long, 2, 9, 1, codes=ml.category_codes(model)).collect()}
    assert len(got) == 6 and got["kind", "1"].category == "y" and got["kind", "2"].category is None
    assert (got["C3S__flux_lag3", "0"].group, got["C3S__flux_lag3", "0"].window, got["kind", "0"].window) == ("lcc", "lag3", "static")
    assert rows.where(F.col("features").isNull()).count() == 0
