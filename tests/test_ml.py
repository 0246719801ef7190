"""Missing values, patience, held-out explanations and split counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ml


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), rng.choice([None, rng.random(), float("nan")]), rng.choice(["x", "y", None])
        y = 2 * a + (b is None or b != b) * 1.5 + (c == "x") + rng.gauss(0, 0.3)
        rows.append((f"s{i % 15}", i, a, b, c, y, ["train", "train", "stop", "test"][i % 4], i % 15 % 3))
    return spark.createDataFrame(rows, "station_id string, time int, a double, b double, c string, y double, split string, fold int").repartition(3).cache()


def test_missingness_alone_predicts(spark):
    rng = random.Random(3)
    data = [(i, rng.random() if i % 3 else None, float(i % 3 == 0), ["train", "stop", "test"][i // 3 % 3]) for i in range(360)]
    df = spark.createDataFrame(data, "k int, a double, y double, split string")
    rows, _ = ml.prepare(df, ["a"], [])
    assert ml.feature_names(rows) == ["a", "a__missing"]
    model, *_ = ml.fit_member(rows.where("split = 'train'"), "y", 1, rounds=3, depth=2, least=2)
    got = model.transform(rows.where("split = 'test'")).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert got < 0.05
    full, _ = ml.prepare(df.na.fill(0.5), ["a"], [])
    assert ml.feature_names(full) == ["a"]


def test_unseen_category_and_null_share_a_bin(spark):
    df = spark.createDataFrame([(1.0, "x", 1.0, "train"), (2.0, "y", 2.0, "train"), (3.0, "z", 3.0, "test"), (4.0, None, 3.0, "test")], "a double, c string, y double, split string")
    rows, _ = ml.prepare(df, ["a"], ["c"])
    assert [r.features[1] for r in rows.where("split = 'test'").collect()] == [2.0, 2.0]


def test_stopping_round():
    assert ml.stopping_round([5, 4, 3, 3.5, 3.4, 2], 2) == (3, 5)
    assert ml.stopping_round([5, 4, 3], 2) == (3, 3)
    assert ml.stopping_round([1, 2, 3], 9) == (1, 3)


def test_patience_equals_the_full_run_cut_at_its_best_round(spark, noisy):
    rows, _ = ml.prepare(noisy, ["a", "b"], ["c"])
    train, stop = rows.where("split = 'train'"), rows.where("split = 'stop'")
    options = {"rounds": 12, "depth": 4, "rate": 0.6, "least": 2, "stop": stop, "block": 3}
    full, best, losses = ml.fit_member(train, "y", 4, **options)
    assert len(losses) == 12 and losses[best - 1] == min(losses) and full.getNumTrees == best < 10
    early, again, few = ml.fit_member(train, "y", 4, patience=2, **options)
    cut = ml.stopping_round(losses, 2)
    assert (again, len(few)) == cut and few == pytest.approx(losses[: cut[1]])
    if again == best:
        a, b = (np.array([r.prediction for r in m.transform(rows).orderBy("time").collect()]) for m in (full, early))
        assert np.allclose(a, b)
    # the logged loss is that of the model cut there
    p = early.transform(stop).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert p == pytest.approx(few[again - 1])


def test_without_stop_rows_all_rounds_stay(spark, noisy):
    rows, _ = ml.prepare(noisy, ["a"], [])
    model, best, _ = ml.fit_member(rows, "y", 1, rounds=3, depth=2, stop=rows.limit(0), patience=1)
    assert best == model.getNumTrees == 3


def test_split_counts_equal_the_trees(spark, noisy):
    rows, _ = ml.prepare(noisy, ["a", "b"], ["c"])
    names = ml.feature_names(rows)
    models = [(s, ml.fit_member(rows.where("split = 'train'"), "y", s, rounds=4, depth=3, least=3)[0]) for s in (1, 2)]
    got = ml.split_importances(models, names).collect()
    assert len(got) == 2 * len(names)
    for s, m in models:
        inner = sum((t.numNodes - 1) // 2 for t in m.trees)
        assert sum(r.splits for r in got if r.member == s) == inner
        assert {r.feature for r in got if r.member == s and r.gain > 0} == {f for f, v in zip(names, m.featureImportances.toArray(), strict=True) if v > 0}


def test_held_out_rows_are_explained_by_their_folds_members(spark, noisy, monkeypatch):
    monkeypatch.setattr(ml, "ROWS", 7)
    monkeypatch.setattr(ml, "TREES", 2)
    rows, members = ml.grouped_members(noisy.drop("split"), "y", ["a", "b"], ["c"], 3, [1, 2, 3], 2, rounds=5, depth=3, least=3, patience=2)
    assert len(members) == 9 and all(sum(m["picked"] for m in members if m["fold"] == f) == 2 for f in range(3))
    rows = rows.withColumn("row_id", F.concat_ws("/", "station_id", "time"))
    names = ml.feature_names(rows)
    long = ml.held_out_attributions(rows, members, names, "row_id")
    assert long.count() == rows.count() * len(names)
    sums = long.groupBy("row_id").agg(F.sum("contribution").alias("s"))
    pred = ml.fold_predictions(rows, members, "y", ["row_id"]).groupBy("row_id", "fold").agg(F.avg("sim").alias("sim"))
    gap = pred.join(sums, "row_id").join(ml.base_values(members), "fold").agg(F.max(F.abs(F.col("s") + F.col("base") - F.col("sim"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == rows.count()
    one = long.where("feature = 'b__missing'").agg(F.avg(F.abs("contribution"))).first()[0]
    assert one > 0.1
    table = ml.members_table(spark, members).where("picked")
    assert table.count() == 6


def test_division_equals_the_plain_polynomial():
    rng = np.random.default_rng(2)
    leaves = [(float(rng.normal()), [(f, float(lo), float(lo + 0.6), None, float(rng.uniform(0.05, 0.95))) for f, lo in zip(rng.permutation(6)[: rng.integers(1, 6)].tolist(), rng.uniform(0, 0.5, 6), strict=False)]) for _ in range(30)]
    x = rng.uniform(0, 1, (20, 6))
    phi = ml.shapley(x, leaves)
    base = sum(v * np.prod([p[4] for p in r]) for v, r in leaves)
    full = [sum(v * all(lo < row[f] <= hi for f, lo, hi, *_ in r) for v, r in leaves) for row in x]
    assert np.allclose(phi.sum(1) + base, full)


def test_ensemble_attributions_are_the_mean_of_the_members(spark, noisy):
    rows, _ = ml.prepare(noisy, ["a", "b"], ["c"])
    rows = rows.withColumn("row_id", F.col("time").cast("string"))
    names = ml.feature_names(rows)
    models = [ml.fit_member(rows.where("split = 'train'"), "y", s, rounds=3, depth=3, least=3)[0] for s in (1, 2)]
    some = rows.where("time < 40")
    both = {(r.row_id, r.feature): (r.value, r.contribution) for r in ml.explain(some, [(0, 0.5, m) for m in models], names, "row_id").collect()}
    single = ml.ensemble_attributions([ml.attributions(some, m, names, "row_id") for m in models]).collect()
    assert len(both) == len(single) == 40 * len(names)
    for r in single:
        value, contribution = both[r.row_id, r.feature]
        assert value == r.value and contribution == pytest.approx(r.contribution)
    assert ml.explain(some.limit(0), [(0, 1.0, models[0])], names, "row_id").count() == 0
