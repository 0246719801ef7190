"""Seeded boosting ensembles and additive attributions."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import feature_group, window_label
from gridloom.operators.aggregates import ensemble
from gridloom.operators.evaluation import moments, pearson
from gridloom.operators.ordering import sample_rows, top_n
from gridloom.operators.windows import value_positions
from gridloom.sources.shared import materialize, shared_dir


def assembler(numeric: list[str], categorical: list[str], flagged: list[str] | None = None) -> Pipeline:
    """Numbers with median imputation, categories as indexes with one more for unseen ones and nulls, a 0/1 flag for each flagged number, one vector."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__ix", handleInvalid="keep") for c in categorical]
    stages.append(Imputer(inputCols=numeric, outputCols=[f"{c}__im" for c in numeric], strategy="median"))
    columns = [*[f"{c}__im" for c in numeric], *[f"{c}__ix" for c in categorical], *[f"{c}__missing" for c in flagged or []]]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")])


def prepare(matrix: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, PipelineModel]:
    """The matrix with a ``features`` vector; train rows fit the medians and categories; columns without any value are 0.

    A number that is missing (null or NaN) in any train row brings a flag ``<name>__missing`` into the vector, so a model
    can tell a missing value from the median that stands for it. The matrix is written once: every fit goes over it many times.
    """
    missing = {f"{c}__missing": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in numeric}
    known = matrix.withColumns(missing).withColumns({c: F.col(c).cast("double") for c in numeric})
    known = materialize(known, "matrix")
    train = known.where("split = 'train'") if "split" in matrix.columns else known
    any_ = train.agg(*[F.max(f"{c}__missing").alias(c) for c in numeric]).first()
    model = assembler(numeric, categorical, [c for c in numeric if any_[c]]).fit(train)
    return model.transform(known), model


def feature_names(rows: DataFrame) -> list[str]:
    """Names of the entries of the ``features`` vector of prepared rows, flags included."""
    groups = rows.schema["features"].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for g in groups.values() for a in g)
    return [n.removesuffix("__im").removesuffix("__ix") for _, n in named]


def _boosted(trees: list, weights: list[float], features: int) -> GBTRegressionModel:
    """A boosting model of single trees."""
    sc = SparkSession.active().sparkContext
    jvm, new = sc._jvm, sc._gateway.new_array
    kind = jvm.org.apache.spark.ml.regression
    listed, share = new(kind.DecisionTreeRegressionModel, len(trees)), new(jvm.double, len(trees))
    for i, (t, w) in enumerate(zip(trees, weights, strict=True)):
        listed[i], share[i] = t._java_obj, float(w)
    return GBTRegressionModel(kind.GBTRegressionModel(f"gbt_{uuid.uuid4().hex[:12]}", listed, share, features))


def stopping_round(losses: list[float], patience: int) -> tuple[int, int]:
    """The best round, from 1, and the round after which ``patience`` rounds have brought no gain (or the last one)."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        if i - best >= patience:
            return best + 1, i + 1
    return best + 1, len(losses)


def fit_member(rows: DataFrame, target: str, seed: int, rounds: int = 20, depth: int = 5, rate: float = 0.1, least: int = 20, stop: DataFrame | None = None, bins: int = 64, patience: int | None = None, block: int = 5) -> tuple[GBTRegressionModel, int, list[float]]:
    """M1: one seeded member. Returns the model, its rounds and the loss after each round on the stop rows.

    Without stop rows all rounds are fitted. With them, a tree at a time is fitted to the residuals (the first to the
    target itself), the predictions are written after each ``block`` of trees, one pass over the stop rows gives the
    block's losses, and once ``patience`` rounds bring no gain the member is cut after its best round: later trees
    don't change earlier ones, so nothing is fitted twice. ``patience`` None, or no stop row: all rounds.
    """
    if stop is None:
        gbt = GBTRegressor(labelCol=target, featuresCol="features", seed=seed, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=least, maxBins=bins)
        return gbt.fit(rows), rounds, []
    columns = ["features", F.col(target).cast("double").alias("_y"), F.lit(0.0).alias("_f")]
    state = rows.select(*columns, F.lit(False).alias("_stop")).unionByName(stop.select(*columns, F.lit(True).alias("_stop")))
    trees, losses, end = [], [], False
    while len(trees) < rounds and not end:
        state = now = materialize(state, "residuals")
        made = []
        for k in range(min(block, rounds - len(trees))):
            forest = RandomForestRegressor(numTrees=1, labelCol="_r", featuresCol="features", predictionCol="_p", seed=seed + len(trees), maxDepth=depth, minInstancesPerNode=least, maxBins=bins, featureSubsetStrategy="0.8", subsamplingRate=0.8, bootstrap=False)
            fitted = forest.fit(now.where("not _stop").select("features", (F.col("_y") - F.col("_f")).alias("_r")))
            now = fitted.transform(now).withColumn("_f", F.col("_f") + F.col("_p") * (rate if trees else 1.0)).withColumn(f"_f{k}", F.col("_f")).drop("_p")
            trees.append(fitted.trees[0])
            made.append(f"_f{k}")
        state = materialize(now, "block").select("features", "_y", "_f", "_stop", *made)
        losses += list(state.where("_stop").agg(*[F.avg((F.col("_y") - F.col(c)) ** 2) for c in made]).first())
        if losses[0] is None:  # no stop row
            best = last = len(trees)
        else:
            best, last = stopping_round(losses, patience or rounds)
            end = last - best >= (patience or rounds)
        state = state.drop(*made)
    losses = [math.nan if x is None else x for x in losses[:last]]
    size = len(feature_names(rows))
    return _boosted(trees[:best], [1.0, *[rate] * (best - 1)], size), best, losses


def temporal_ensemble(matrix: DataFrame, target: str, numeric: list[str], categorical: list[str], seeds: list[int], keys: list[str], **options) -> tuple[DataFrame, list[dict]]:
    """M1 and M4: (keys, seed, obs, sim) on the test split, and a log row per seed; one preparation for all seeds."""
    rows, _ = prepare(matrix, numeric, categorical)
    rows = materialize(rows, "prepared")
    known = rows.where(F.col(target).isNotNull())
    out, log = None, []
    for seed in seeds:
        model, best, losses = fit_member(known.where("split = 'train'"), target, seed, stop=known.where("split = 'stop'"), **options)
        part = model.transform(rows.where("split = 'test'")).select(*keys, F.lit(seed).alias("seed"), F.col(target).alias("obs"), F.col("prediction").alias("sim"))
        out = part if out is None else out.unionByName(part)
        log.append({"seed": seed, "rounds": best, "losses": losses, "model": model, "features": feature_names(rows)})
    return out, log


def inverse_scale(pred: DataFrame, scaler: DataFrame, columns: list[str], key: str = "station_id") -> DataFrame:
    """M4: back to the target's unit by each station's mean and deviation."""
    j = pred.join(scaler.select(key, "mean", "std"), key)
    return j.withColumns({c: F.col(c) * F.col("std") + F.col("mean") for c in columns}).drop("mean", "std")


def grouped_members(matrix: DataFrame, target: str, numeric: list[str], categorical: list[str], k: int, seeds: list[int], top: int, **options) -> tuple[DataFrame, list[dict]]:
    """M2: the prepared rows and a member (fold, seed, rounds, rmse, picked, model) for each seed and rotation (test r, validation r + 1, rest train); the ``top`` of a fold by validation error are picked."""
    rows, _ = prepare(matrix, numeric, categorical)
    rows = materialize(rows.where(F.col(target).isNotNull()), "prepared")
    log = []
    for r in range(k):
        val, train = rows.where(F.col("fold") == (r + 1) % k), rows.where(~F.col("fold").isin(r, (r + 1) % k))
        members = []
        for seed in seeds:
            model, best, losses = fit_member(train, target, seed, stop=val, **options)
            members.append({"fold": r, "seed": seed, "rounds": best, "rmse": math.sqrt(losses[best - 1]), "model": model})
        members.sort(key=lambda m: (m["rmse"], m["seed"]))
        log += [m | {"picked": i < top} for i, m in enumerate(members)]
    return rows, log


def fold_predictions(rows: DataFrame, members: list[dict], target: str, keys: list[str]) -> DataFrame:
    """M2: (keys, fold, seed, obs, sim) of the picked members on the test rows of their folds."""
    parts = [m["model"].transform(rows.where(F.col("fold") == m["fold"])).select(*keys, "fold", F.lit(m["seed"]).alias("seed"), F.col(target).alias("obs"), F.col("prediction").alias("sim")) for m in members if m["picked"]]
    return reduce(DataFrame.unionByName, parts)


def members_table(spark: SparkSession, members: list[dict]) -> DataFrame:
    """The log of M2 as a table."""
    return spark.createDataFrame([(m["fold"], m["seed"], m["rounds"], float(m["rmse"]), m["picked"]) for m in members], "fold int, seed int, rounds int, rmse double, picked boolean")


def grouped_cv(matrix: DataFrame, target: str, numeric: list[str], categorical: list[str], k: int, seeds: list[int], top: int, keys: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """M2: the folds' ensembles. Returns (keys, fold, obs, ens_median, ens_mean, ens_std) of all test folds and the log (fold, seed, rounds, rmse, picked)."""
    rows, members = grouped_members(matrix, target, numeric, categorical, k, seeds, top, **options)
    parts = fold_predictions(rows, members, target, keys)
    return ensemble(parts, [*keys, "fold", "obs"]), members_table(matrix.sparkSession, members)


def deployment(rows: DataFrame, target: str, log: DataFrame, seeds: list[int], **options) -> list[GBTRegressionModel]:
    """M3: members on all rows with the truncated median of the picked rounds."""
    rounds = int(log.where("picked").agg(F.median("rounds")).first()[0])
    rows = materialize(rows, "deployed")
    return [fit_member(rows, target, s, rounds=rounds, **options)[0] for s in seeds]


def loss_history(log: list[dict], spark) -> DataFrame:
    """M5: loss per seed and round."""
    return spark.createDataFrame([(e["seed"], i + 1, float(x)) for e in log for i, x in enumerate(e["losses"])], "seed int, round int, loss double")


def importances(log: list[dict], features: list[str], spark) -> DataFrame:
    """M5: importance of each feature per seed."""
    return spark.createDataFrame([(e["seed"], f, float(v)) for e in log for f, v in zip(features, e["model"].featureImportances.toArray(), strict=True)], "seed int, feature string, importance double")


def node_table(members: list[tuple[int, GBTRegressionModel]]) -> DataFrame:
    """(member, tree, weight, node fields) of models, read from where they are saved; never on the driver."""
    spark = SparkSession.active()
    parts = []
    for no, model in members:
        path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
        model.write().save(path)
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "params", "weight").select("tree", "weight")
        nodes = spark.read.parquet(f"{path}/data").select(F.lit(no).alias("member"), F.col("treeID").alias("tree"), "nodeData.*")
        parts.append(nodes.join(weights, "tree"))
    return reduce(DataFrame.unionByName, parts)


def split_importances(members: list[tuple[int, GBTRegressionModel]], features: list[str]) -> DataFrame:
    """M5: (member, feature, splits, gain): how often and with what gain in all (of the rows' summed squares) a feature splits a member's nodes; unused features have 0."""
    spark = SparkSession.active()
    used = node_table(members).where("leftChild >= 0").groupBy("member", F.col("split.featureIndex").alias("_f"))
    found = used.agg(F.count(F.lit(1)).alias("splits"), F.sum(F.col("gain") * F.col("rawCount")).alias("gain"))
    names = spark.createDataFrame([(no, i, f) for no, _ in members for i, f in enumerate(features)], "member int, _f int, feature string")
    return names.join(found, ["member", "_f"], "left").select("member", "feature", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def _paths(nodes: list[dict]) -> list[tuple[float, list[tuple]]]:
    """Leaves of one tree as (value, [(feature, low, high, categories or None, share of the parent's rows)]); repeated features merged."""
    by_id, leaves, stack = {n["id"]: n for n in nodes}, [], [(0, [])]
    while stack:
        i, route = stack.pop()
        n = by_id[i]
        if n["leftChild"] < 0:
            merged: dict[int, list] = {}
            for f, lo, hi, cats, share in route:
                m = merged.setdefault(f, [f, -math.inf, math.inf, None, 1.0])
                m[1], m[2], m[4] = max(m[1], lo), min(m[2], hi), m[4] * share
                if cats is not None:
                    m[3] = cats if m[3] is None else m[3] & cats
            leaves.append((float(n["weight"]) * n["prediction"], [tuple(m) for m in merged.values()]))
            continue
        s, left, right = n["split"], by_id[n["leftChild"]], by_id[n["rightChild"]]
        total = max(left["rawCount"] + right["rawCount"], 1)
        mine = frozenset(s["leftCategoriesOrThreshold"])
        for child, first in ((left, True), (right, False)):
            lo, hi, cats = -math.inf, math.inf, None
            if s["numCategories"] < 0:
                cut = s["leftCategoriesOrThreshold"][0]
                lo, hi = (lo, cut) if first else (cut, hi)
            else:
                cats = mine if first else frozenset(float(c) for c in range(s["numCategories"])) - mine
            stack.append((child["id"], [*route, (s["featureIndex"], lo, hi, cats, child["rawCount"] / total)]))
    return leaves


_LEAF = "value double, route array<struct<f: int, lo: double, hi: double, cats: array<double>, share: double>>"


def leaf_table(members: list[tuple[int, GBTRegressionModel]]) -> DataFrame:
    """(member, tree, leaf columns): the leaves of all trees, one task's group being one tree."""
    fields = ["id", "leftChild", "rightChild", "prediction", "rawCount", "weight", "split"]
    trees = node_table(members).select("member", "tree", F.struct(*fields).alias("node")).groupBy("member", "tree").agg(F.collect_list("node").alias("nodes"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("f", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("cats", pa.list_(pa.float64())), ("share", pa.float64())]))
        for b in batches:
            for member, tree, nodes in zip(*(b[c].to_pylist() for c in ("member", "tree", "nodes")), strict=True):
                found = _paths(nodes)
                routes = [[{"f": f, "lo": lo, "hi": hi, "cats": None if cats is None else sorted(cats), "share": share} for f, lo, hi, cats, share in route] for _, route in found]
                yield pa.RecordBatch.from_arrays([pa.array([member] * len(found), pa.int32()), pa.array([tree] * len(found), pa.int32()), pa.array([v for v, _ in found]), pa.array(routes, kind)], ["member", "tree", "value", "route"])

    return trees.mapInArrow(leaves, f"member int, tree int, {_LEAF}")


def _routes(values: list[float], routes: list[list[dict]]) -> list[tuple[float, list[tuple]]]:
    return [(v, [(p["f"], p["lo"], p["hi"], None if p["cats"] is None else frozenset(p["cats"]), p["share"]) for p in route]) for v, route in zip(values, routes, strict=True)]


def leaf_paths(model: GBTRegressionModel) -> tuple[list[list[tuple]], float]:
    """All leaves of one model and the value without any feature known: for looking at a model, no part of the attributions."""
    got = leaf_table([(0, model)]).orderBy("tree").collect()
    leaves = _routes([r.value for r in got], [[p.asDict() for p in r.route] for r in got])
    return leaves, sum(v * math.prod(p[4] for p in route) for v, route in leaves)


def shapley(x: np.ndarray, leaves: list) -> np.ndarray:
    """Path-dependent Shapley values of rows x: for each leaf the players are its features, each either follows the row or is split by row shares.

    The polynomial over all players, whose coefficient k sums the products with k players that follow the row, is made
    once for a leaf; dividing it by a player's own factor gives that over the others, in one step for each coefficient.
    """
    out = np.zeros(x.shape)
    for value, route in leaves:
        m = len(route)
        if not m or value == 0:
            continue
        one = np.empty((m, len(x)))
        for i, (f, lo, hi, cats, _) in enumerate(route):
            v = x[:, f]
            ok = (v > lo) & (v <= hi)
            if cats is not None:
                ok &= np.isin(v, list(cats))
            one[i] = ok
        share = [p[4] for p in route]
        poly = np.zeros((m + 1, len(x)))
        poly[0] = 1
        for j in range(m):
            poly[1 : j + 2] = poly[1 : j + 2] * share[j] + poly[: j + 1] * one[j]
            poly[0] *= share[j]
        weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        for i, (f, *_rest) in enumerate(route):
            follows, w = one[i] > 0, np.zeros(len(x))
            q = np.zeros(len(x))
            for k in range(m - 1, -1, -1):
                # the row follows player i: synthetic division by share + t; else a plain one by the share
                q = np.where(follows, poly[k + 1] - share[i] * q, poly[k] / max(share[i], 1e-300))
                w += weight[k] * q
            out[:, f] += value * w * (one[i] - share[i])
    return out


#: Rows that are explained together, and trees whose leaves travel together.
ROWS, TREES = 256, 256


def explain(rows: DataFrame, members: list[tuple[int, float, GBTRegressionModel]], features: list[str], row_id: str, group: str | None = None) -> DataFrame:
    """(row_id, feature, value, contribution), the weighted sum over the members of each row's group.

    members: (group, weight, model); without a group column every member explains every row. Rows are packed ROWS
    at a time and leaves TREES trees at a time; packs of one group meet in a join whose key is salted on both sides,
    and partial sums are added up for each pack of rows. Neither the leaves nor the rows pass the driver.
    """
    from pyspark.ml.functions import vector_to_array

    spark, width = rows.sparkSession, len(features)
    wide = rows.select((F.col(group) if group else F.lit(0)).cast("int").alias("_g"), F.col(row_id).cast("string").alias("row_id"), vector_to_array("features").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b["_g"].to_numpy(zero_copy_only=False)
            x = np.asarray(b["x"].flatten().to_numpy(zero_copy_only=False), float).reshape(len(g), width)
            for k in np.unique(g):
                of = np.flatnonzero(g == k)
                for at in range(0, len(of), ROWS):
                    part = of[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b["row_id"].take(pa.array(part)).to_pylist()], pa.list_(pa.string())), pa.array([x[part].tobytes()], pa.binary())], ["_g", "ids", "x"])

    packs = wide.mapInArrow(pack, "_g int, ids array<string>, x binary").withColumn("pack", F.monotonically_increasing_id())
    packs = materialize(packs, "row-packs")
    of = spark.createDataFrame([(i, int(g), float(w)) for i, (g, w, _) in enumerate(members)], "member int, _g int, share double")
    leaves = leaf_table([(i, m) for i, (_, _, m) in enumerate(members)]).join(of, "member").withColumn("value", F.col("value") * F.col("share"))
    blocks = leaves.withColumn("_block", F.expr(f"tree div {TREES}")).groupBy("_g", "member", "_block").agg(F.collect_list(F.struct("value", "route")).alias("leaves"))
    side = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = materialize(blocks, "leaves").withColumn("_b", F.pmod(F.xxhash64("member", "_block"), F.lit(side)))
    salts = F.sequence(F.lit(0), F.lit(side - 1))
    dealt = packs.drop("ids").withColumn("_a", F.col("pack") % side).withColumn("_b", F.explode(salts))
    met = dealt.join(blocks.withColumn("_a", F.explode(salts)), ["_g", "_a", "_b"]).select("pack", "x", "leaves")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack_id, x, found in zip(b["pack"].to_pylist(), b["x"], b["leaves"], strict=True):
                found = found.as_py()
                phi = shapley(np.frombuffer(x.as_buffer(), float).reshape(-1, width), _routes([p["value"] for p in found], [p["route"] for p in found]))
                yield pa.RecordBatch.from_arrays([pa.array([pack_id]), pa.array([phi.tobytes()], pa.binary())], ["pack", "phi"])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for i in range(left.num_rows):
            ids, x = left["ids"][i].as_py(), np.frombuffer(left["x"][i].as_py(), float)
            phi = sum((np.frombuffer(p, float) for p in right["phi"].to_pylist()), np.zeros(len(x)))
            parts.append(pa.table([pa.array(np.repeat(np.array(ids, object), width), pa.string()), pa.array(features * len(ids), pa.string()), pa.array(x), pa.array(phi)], names=["row_id", "feature", "value", "contribution"]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.float64(), pa.float64())], names=["row_id", "feature", "value", "contribution"])

    sums = met.mapInArrow(partial, "pack long, phi binary")
    return packs.groupBy("pack").cogroup(sums.groupBy("pack")).applyInArrow(total, "row_id string, feature string, value double, contribution double")


def attributions(rows: DataFrame, model: GBTRegressionModel, features: list[str], row_id: str) -> DataFrame:
    """(row_id, feature, value, contribution) of each row; contributions sum to the prediction minus the base value."""
    return explain(rows, [(0, 1.0, model)], features, row_id)


def held_out_attributions(rows: DataFrame, members: list[dict], features: list[str], row_id: str) -> DataFrame:
    """Rows of fold k explained by the mean of the picked members that were tested on it; members as of ``grouped_members``."""
    picked = [m for m in members if m["picked"]]
    count = Counter(m["fold"] for m in picked)
    return explain(rows.where(F.col("fold").isin(list(count))), [(m["fold"], 1 / count[m["fold"]], m["model"]) for m in picked], features, row_id, "fold")


def base_values(members: list[dict]) -> DataFrame:
    """(fold, base): what the mean of a fold's picked members gives without any feature known."""
    picked = [m for m in members if m["picked"]]
    folds = SparkSession.active().createDataFrame([(i, m["fold"]) for i, m in enumerate(picked)], "member int, fold int")
    known = F.aggregate("route", F.col("value"), lambda v, p: v * p["share"])
    one = leaf_table([(i, m["model"]) for i, m in enumerate(picked)]).groupBy("member").agg(F.sum(known).alias("base"))
    return one.join(folds, "member").groupBy("fold").agg(F.avg("base").alias("base"))


def ensemble_attributions(parts: list[DataFrame]) -> DataFrame:
    """Mean over members."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("row_id", "feature").agg(F.max("value").alias("value"), F.avg("contribution").alias("contribution"))


def attribution_summary(long: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Mean absolute, mean and population deviation of contributions per feature. labels: feature, label, driver."""
    s = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"), F.stddev_pop("contribution").alias("std"))
    return s if labels is None else s.join(labels, "feature", "left")


def value_response(long: DataFrame, categorical: list[str]) -> DataFrame:
    """Spearman correlation of value and contribution; null for categories, under 3 rows and constants.

    Ranks come from range partitions; a feature's rows are never sorted in one task. The rows are written
    once: made twice, sums of doubles may differ in their last bit and a row would miss its rank.
    """
    known = long.where(F.col("value").isNotNull() & F.col("contribution").isNotNull()).select("feature", "value", "contribution")
    known = materialize(known, "responses")
    for c in ("value", "contribution"):
        place = value_positions(known, c, ["feature"])
        known = known.join(place.select("feature", c, (F.col("_before") + (F.col("_count") + 1) / 2).alias(f"_r_{c}")), ["feature", c])
    m = known.groupBy("feature").agg(*[c.alias(k) for k, c in moments("_r_value", "_r_contribution").items()])
    rho = pearson(F.col("vo"), F.col("vs"), F.col("co"))
    return m.select("feature", "n", F.when(~F.col("feature").isin(categorical or [""]) & (F.col("n") >= 3), rho).alias("spearman"))


def held_out_rows(matrix: DataFrame, log: DataFrame) -> DataFrame:
    """Each row with the members (seeds) of the fold in which it was tested."""
    picked = log.where("picked").select(F.col("fold"), "seed")
    return matrix.join(picked, "fold")


def explanation_bundle(long: DataFrame, top: int, n_rows: int, seed: int, labels: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Contributions and values of the most important features on sampled rows, with group (F10), window (F13), labels and, for categories, the category behind the code.

    labels: feature, label; codes: feature, code, category (see ``category_codes``). A feature without either has null there.
    """
    best = top_n(attribution_summary(long), "mean_abs", top, "feature").select("feature")
    ids = sample_rows(long.select("row_id").distinct(), "row_id", n_rows, seed)
    out = long.join(best, "feature", "left_semi").join(ids, "row_id", "left_semi")
    out = out.withColumn("group", feature_group(F.col("feature"))).withColumn("window", window_label(F.col("feature")))
    if codes is not None:
        out = out.join(codes.select("feature", F.col("code").cast("double").alias("value"), "category"), ["feature", "value"], "left")
    return out if labels is None else out.join(labels, "feature", "left")


def category_codes(model: PipelineModel) -> DataFrame:
    """(feature, code, category) of the categories that ``prepare`` has indexed; one more code stands for unseen ones and nulls (category null)."""
    indexed = [(st.getInputCol(), st.labels) for st in model.stages if hasattr(st, "labels")]
    rows = [(c, i, label) for c, labels in indexed for i, label in enumerate([*labels, None])]
    return SparkSession.active().createDataFrame(rows, "feature string, code int, category string")
