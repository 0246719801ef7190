"""Queries over predictions, scores, stores, experiments, sources and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import evaluation as R
from gridloom.operators import experiments as X
from gridloom.operators import features as E
from gridloom.operators import joins as J
from gridloom.operators import quality as Q
from gridloom.operators import spatial as G
from gridloom.plans.grids import chosen_cte
from gridloom.plans.registry import query
from gridloom.plans.series import r6
from gridloom.plans.standins import EXPERIMENTS, SEEDS, Tables
from gridloom.sources import tables as IO
from gridloom.sources.shared import materialize, shared_dir

TEST = "2000-01-01"
_CONS = ", cons AS (SELECT experiment, station_id, time, min(obs) AS obs, median(sim) AS sim FROM pred WHERE time >= DATE '2000-01-01' GROUP BY 1, 2, 3)"
_MEANS = ", mn AS (SELECT station_id, avg(target) AS m FROM monthly WHERE time < DATE '2000-01-01' GROUP BY 1)"
_MOM = _CONS + _MEANS + """, q AS (SELECT experiment, station_id, count(*) AS n, avg(obs) AS mo, avg(sim) AS ms, CASE WHEN max(obs) > min(obs) THEN var_pop(obs) ELSE 0 END AS vo, CASE WHEN max(sim) > min(sim) THEN var_pop(sim) ELSE 0 END AS vs, covar_pop(obs, sim) AS co, sum((sim - obs) * (sim - obs)) AS sse FROM cons GROUP BY 1, 2),
d AS (SELECT experiment, c.station_id, sum((obs - m) * (obs - m)) AS den FROM cons c JOIN mn USING (station_id) GROUP BY 1, 2),
sc AS (SELECT q.experiment, q.station_id, n, 1 - sse / CASE WHEN den > 0 THEN den END AS nse, 1 - sse / CASE WHEN vo > 0 THEN n * vo END AS nse_classic, co / CASE WHEN vo > 0 AND vs > 0 THEN sqrt(vo * vs) END AS r, CASE WHEN vo > 0 THEN sqrt(vs) / sqrt(vo) END AS alpha, ms - mo AS bias, sqrt(sse / n) AS rmse, sse / n AS mse, mo, ms, vo FROM q LEFT JOIN d ON d.experiment = q.experiment AND d.station_id = q.station_id),
k AS (SELECT *, 1 - sqrt(pow(r - 1, 2) + pow(alpha - 1, 2) + pow(ms / mo - 1, 2)) AS kge, 1 - sqrt(pow(r - 1, 2) + pow(alpha - 1, 2) + pow((ms - mo) / sqrt(CASE WHEN vo > 0 THEN vo END), 2)) AS kge_a FROM sc)"""


def _cons(t: Tables):
    return R.consolidate(t.pred.where(F.col("time") >= TEST), ["experiment", "station_id", "time"])


def _scores(t: Tables, least: int = 3):
    return R.station_scores(_cons(t), ["experiment", "station_id"], R.pretest_means(t.monthly, "target", TEST), least=least)


def _long(t: Tables, metrics: list[str]):
    return R.long_scores(_scores(t), ["experiment", "station_id"], metrics)


def _sql_scores(metric: str) -> str:
    return _MOM + f", s AS (SELECT experiment, station_id, {metric} AS score FROM k WHERE n >= 3)"


@query("r1_nse_pretest", "pred", _MOM + " SELECT experiment, station_id, round(nse, 5) AS nse FROM k WHERE n >= 3")
def r1(t: Tables):
    return _scores(t).select("experiment", "station_id", F.round("nse", 5).alias("nse"))


_ALL = ["nse_classic", "kge", "kge_a", "r", "bias", "rmse", "alpha"]


@query("r2_skill_metrics", "pred", _MOM + " SELECT experiment, station_id, n, " + ", ".join(f"round({m}, 4) AS {m}" for m in _ALL) + " FROM k WHERE n >= 3")
def r2(t: Tables):
    return _scores(t).select("experiment", "station_id", "n", *[F.round(m, 4).alias(m) for m in _ALL])


@query("r3_safe_pearson", "monthly", "SELECT station_id, round(CASE WHEN max(flux) > min(flux) AND max(target) > min(target) THEN corr(flux, target) END, 5) AS r FROM monthly GROUP BY 1 HAVING count(*) > 2")
def r3(t: Tables):
    m = t.monthly.groupBy("station_id").agg(*[c.alias(k) for k, c in R.moments("flux", "target").items()]).where("n > 2")
    return m.select("station_id", F.round(R.pearson(F.col("vo"), F.col("vs"), F.col("co")), 5).alias("r"))


@query("r4_pair_filtering", "monthly", ", p AS (SELECT station_id, CASE WHEN month(time) <> 3 THEN target END AS obs, CASE WHEN month(time) <> 7 THEN flux END AS sim FROM monthly), q AS (SELECT station_id, count(*) AS n, avg(sim - obs) AS bias, sqrt(avg((sim - obs) * (sim - obs))) AS rmse FROM p WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) SELECT station_id, n, round(bias, 4) AS bias, round(rmse, 3) AS rmse FROM q")
def r4(t: Tables):
    p = t.monthly.select("station_id", F.when(F.month("time") != 3, F.col("target")).alias("obs"), F.when(F.month("time") != 7, F.col("flux")).alias("sim"))
    return R.station_scores(p, ["station_id"], drop_nulls=True, least=2).select("station_id", "n", F.round("bias", 4).alias("bias"), F.round("rmse", 3).alias("rmse"))


@query("r5_consolidated_runs", "pred", _CONS + " SELECT experiment, station_id, time, round(obs, 6) AS obs, round(sim, 6) AS sim, 3 AS n_seeds FROM cons")
def r5(t: Tables):
    return _cons(t).select("experiment", "station_id", "time", *r6("obs", "sim"), "n_seeds")


@query("r5_seeds_side_by_side", "pred", "SELECT experiment, station_id, time, round(min(obs), 6) AS obs, " + ", ".join(f"round(max(sim) FILTER (WHERE seed = {s}), 6) AS sim_{s}" for s in SEEDS) + " FROM pred GROUP BY 1, 2, 3")
def r5_wide(t: Tables):
    w = R.seeds_side_by_side(t.pred, ["experiment", "station_id", "time"], SEEDS)
    return w.select("experiment", "station_id", "time", *r6("obs", *[f"sim_{s}" for s in SEEDS]))


@query("r6_pretest_means", "monthly", "SELECT station_id, round(CASE WHEN CAST(substr(station_id, 4) AS INTEGER) % 4 = 0 THEN 1.5 ELSE avg(target) END, 6) AS mean FROM monthly WHERE time < DATE '2000-01-01' GROUP BY station_id")
def r6_means(t: Tables):
    stored = t.monthly.where((F.col("time") < TEST) & (t.num % 4 == 0)).select("station_id", F.lit(1.5).alias("mean")).distinct()
    return R.pretest_means(t.monthly, "target", TEST, stored).select("station_id", *r6("mean"))


@query("a21_score_summary", "pred", _sql_scores("rmse") + " SELECT experiment, round(min(score), 4) AS v_min, round(median(score), 4) AS v_median, round(avg(score), 4) AS v_mean, round(max(score), 4) AS v_max, count(score) AS n FROM s GROUP BY 1")
def a21(t: Tables):
    s = A.score_summary(_long(t, ["rmse"]), ["experiment"])
    return s.select("experiment", *[F.round(c, 4).alias(c) for c in ("v_min", "v_median", "v_mean", "v_max")], "n")


@query("a22_class_bins", "pred", _sql_scores("nse") + " SELECT experiment, count(*) FILTER (WHERE score <= 0) AS unsatisfactory, count(*) FILTER (WHERE score > 0 AND score <= 0.5) AS weak, count(*) FILTER (WHERE score > 0.5 AND score <= 0.65) AS satisfactory, count(*) FILTER (WHERE score > 0.65 AND score <= 0.75) AS good, count(*) FILTER (WHERE score > 0.75) AS very_good FROM s GROUP BY 1")
def a22(t: Tables):
    return A.class_bins(_long(t, ["nse"]))


@query("d2_class_predicates", "pred", _sql_scores("nse") + " SELECT experiment, station_id, CASE WHEN score <= 0 THEN 'unsatisfactory' WHEN score <= 0.5 THEN 'weak' WHEN score <= 0.65 THEN 'satisfactory' WHEN score <= 0.75 THEN 'good' WHEN score IS NOT NULL THEN 'very good' END AS class FROM s")
def d2(t: Tables):
    return _long(t, ["nse"]).select("experiment", "station_id", A.nse_class(F.col("score")).alias("class"))


@query("a23_driver_rollup", "attribution", ", f AS (SELECT feature, avg(abs(contribution)) AS a FROM attribution GROUP BY 1) SELECT CASE WHEN feature = 'l_quantity' THEN 'amount' ELSE 'rate' END AS driver, round(sum(a), 6) AS total, round(max(a), 6) AS largest, count(*) AS n_features FROM f GROUP BY 1")
def a23(t: Tables):
    f = _summary(t).withColumn("driver", F.when(F.col("feature") == "l_quantity", "amount").otherwise("rate"))
    return A.driver_rollup(f, "mean_abs").select("driver", *r6("total", "largest"), "n_features")


@query("a25_ensemble", "pred", "SELECT experiment, station_id, time, round(median(sim), 6) AS ens_median, round(avg(sim), 6) AS ens_mean, round(stddev_pop(sim), 4) AS ens_std FROM pred GROUP BY 1, 2, 3")
def a25(t: Tables):
    e = A.ensemble(t.pred, ["experiment", "station_id", "time"])
    return e.select("experiment", "station_id", "time", *r6("ens_median", "ens_mean"), F.round("ens_std", 4).alias("ens_std"))


@query("a26_cv_summary", "pred", _sql_scores("rmse") + ", f AS (SELECT experiment, CAST(substr(station_id, 4) AS INTEGER) % 3 AS fold, median(score) AS m FROM s GROUP BY 1, 2) SELECT experiment, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std, round(min(m), 4) AS v_min, round(max(m), 4) AS v_max FROM f GROUP BY 1")
def a26(t: Tables):
    s = _long(t, ["rmse"]).withColumn("fold", t.num % 3)
    return A.cv_summary(s, "experiment").select("experiment", *[F.round(c, 4).alias(c) for c in ("mean", "std", "v_min", "v_max")])


@query("j13_scores_side_by_side", "pred", _sql_scores("rmse") + " SELECT station_id, " + ", ".join(f"round(max(score) FILTER (WHERE experiment = '{e}'), 4) AS {e}" for e in EXPERIMENTS) + " FROM s GROUP BY 1")
def j13(t: Tables):
    return J.scores_side_by_side(_long(t, ["rmse"]).withColumn("score", F.round("score", 4)), list(EXPERIMENTS))


@query("j14_complete_cases", "pred", _sql_scores("nse") + ", h AS (SELECT experiment, station_id, CASE WHEN experiment <> 'm17' OR CAST(substr(station_id, 4) AS INTEGER) % 3 <> 0 THEN score END AS score FROM s), g AS (SELECT station_id FROM h WHERE score IS NOT NULL GROUP BY 1 HAVING count(DISTINCT experiment) = 3) SELECT experiment, station_id FROM h WHERE station_id IN (SELECT station_id FROM g)")
def j14(t: Tables):
    s = _long(t, ["nse"]).withColumn("score", F.when((F.col("experiment") != "m17") | (t.num % 3 != 0), F.col("score")))
    return J.complete_cases(s, 3).select("experiment", "station_id")


@query("u6_fold_concat", "monthly", "SELECT CAST(substr(station_id, 4) AS INTEGER) % 3 AS fold, count(*) AS n FROM monthly GROUP BY 1")
def u6(t: Tables):
    folds = [t.monthly.where(t.num % 3 == k) for k in range(3)]
    both, twice = J.concat_folds(folds)
    return both.join(twice, "station_id", "left_anti").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def _complete(t: Tables):
    s = materialize(_long(t, ["nse", "rmse"]).withColumn("score", F.round("score", 6)), "scores")
    return materialize(J.complete_cases(s.where("metric = 'nse'"), 3).unionByName(J.complete_cases(s.where("metric = 'rmse'"), 3)), "scores")


_WX = _MOM + """, s AS (SELECT experiment, station_id, 'nse' AS metric, round(nse, 6) AS score FROM k WHERE n >= 3 UNION ALL SELECT experiment, station_id, 'rmse', round(rmse, 6) FROM k WHERE n >= 3),
ok AS (SELECT metric, station_id FROM s WHERE score IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 3), c AS (SELECT s.* FROM s JOIN ok USING (metric, station_id))"""


_PAIR = "metric, model_a, model_b"
#: Signed ranks and z of each pair; p from the error function's series, or from the ranks' subset sums.
_SIGNED = _WX + f""", pr AS (SELECT a.metric, a.experiment AS model_a, b.experiment AS model_b, a.score - b.score AS d FROM c a JOIN c b ON a.metric = b.metric AND a.station_id = b.station_id AND a.experiment < b.experiment),
nz AS (SELECT *, rank() OVER (PARTITION BY {_PAIR} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {_PAIR}, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {_PAIR}, abs(d)) AS t FROM pr WHERE d <> 0),
sg AS (SELECT {_PAIR}, count(*) AS n, CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS w, sum(t * t - 1) AS ties FROM nz GROUP BY ALL),
md AS (SELECT {_PAIR}, median(d) AS median_diff, count(*) AS n_stations FROM pr GROUP BY ALL),
zs AS (SELECT md.*, sg.n, sg.w, ties, (w - n * (n + 1) / 4.0::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2.0::DOUBLE) / 24) AS z FROM md LEFT JOIN sg USING ({_PAIR})),
er({_PAIR}, i, x, t, s) AS (SELECT {_PAIR}, 0, abs(z) / sqrt(2), abs(z) / sqrt(2), abs(z) / sqrt(2) FROM zs WHERE z IS NOT NULL UNION ALL SELECT {_PAIR}, i + 1, x, t * 2 * x * x / (2 * i + 3), s + t * 2 * x * x / (2 * i + 3) FROM er WHERE i < 400),
ex({_PAIR}, n, w, k, d) AS (SELECT {_PAIR}, n, w, 0, list_transform(range(CAST(n * (n + 1) // 2 + 1 AS BIGINT)), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM zs WHERE n <= 50 AND ties = 0 AND n = n_stations UNION ALL SELECT {_PAIR}, n, w, k + 1, list_transform(range(len(d)), lambda i: d[i + 1] + CASE WHEN i > k THEN d[i - k] ELSE 0.0::DOUBLE END) FROM ex WHERE k < n),
pv AS (SELECT zs.*, CASE WHEN ex.d IS NOT NULL THEN least(1.0::DOUBLE, 2 * list_sum(ex.d[1 : CAST(floor(ex.w) AS BIGINT) + 1]) / pow(2, ex.n)) WHEN er.s IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(-er.x * er.x) * er.s) END AS p FROM zs LEFT JOIN er ON er.i = 400 AND er.metric = zs.metric AND er.model_a = zs.model_a AND er.model_b = zs.model_b LEFT JOIN ex ON ex.k = ex.n AND ex.metric = zs.metric AND ex.model_a = zs.model_a AND ex.model_b = zs.model_b)"""


@query("r7_wilcoxon", "pred", _SIGNED + f" SELECT {_PAIR}, round(median_diff, 4) AS median_diff, n_stations, n, w, round(z, 6) AS z, round(p, 6) AS p_raw FROM pv")
def r7(t: Tables):
    return R.wilcoxon(_complete(t)).select("metric", "model_a", "model_b", F.round("median_diff", 4).alias("median_diff"), "n_stations", "n", "w", F.round("z", 6).alias("z"), F.round("p_raw", 6).alias("p_raw"))


_FRIEDMAN = """, fr AS (SELECT metric, experiment, rank() OVER (PARTITION BY metric, station_id ORDER BY score) + (count(*) OVER (PARTITION BY metric, station_id, score) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY metric, station_id, score) AS t FROM c),
fg AS (SELECT metric, experiment, sum(r) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM fr GROUP BY 1, 2),
f AS (SELECT metric, max(n) AS n_stations, (12.0::DOUBLE / (max(n) * 3 * 4) * sum(s * s) - 3 * max(n) * 4) / (1 - sum(ties) / (max(n) * 24.0::DOUBLE)) AS chi2 FROM fg GROUP BY 1)"""


@query("r8_friedman", "pred", _WX + _FRIEDMAN + " SELECT metric, n_stations, round(chi2, 6) AS chi2, round(CASE WHEN chi2 > 0 THEN exp(-chi2 / 2) ELSE 1 END, 8) AS p FROM f")
def r8(t: Tables):
    return R.friedman(_complete(t), 3).select("metric", "n_stations", F.round("chi2", 6).alias("chi2"), F.round("p", 8).alias("p"))


_HOLM = _SIGNED + _FRIEDMAN + f""", hr AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(coalesce(p, 1), 12), model_a, model_b) AS k, count(*) OVER (PARTITION BY metric) AS m FROM pv),
hp AS (SELECT *, max(least((m - k + 1) * coalesce(p, 1), 1)) OVER (PARTITION BY metric ORDER BY k ROWS UNBOUNDED PRECEDING) AS p_holm FROM hr)"""


@query("r9_significance", "pred", _HOLM + f" SELECT hp.metric, model_a, model_b, round(p, 6) AS p_raw, round(p_holm, 6) AS p_holm, round(CASE WHEN chi2 > 0 THEN exp(-chi2 / 2) ELSE 1 END, 8) AS friedman_p, p_holm < 0.05 AS sig_5pct FROM hp LEFT JOIN f ON f.metric = hp.metric")
def r9(t: Tables):
    return R.significance(_complete(t), 3).select("metric", "model_a", "model_b", F.round("p_raw", 6).alias("p_raw"), F.round("p_holm", 6).alias("p_holm"), F.round("friedman_p", 8).alias("friedman_p"), "sig_5pct")


@query("r10_box_statistics", "pred", _sql_scores("rmse") + ", qu AS (SELECT experiment, quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM s GROUP BY 1) SELECT experiment, round(a, 4) AS p25, round(b, 4) AS p50, round(c, 4) AS p75, round(min(score) FILTER (WHERE score >= a - 1.5 * (c - a)), 4) AS low, round(max(score) FILTER (WHERE score <= c + 1.5 * (c - a)), 4) AS high FROM s JOIN qu USING (experiment) GROUP BY 1, a, b, c")
def r10(t: Tables):
    b = R.box_statistics(_long(t, ["rmse"]), ["experiment"])
    return b.select("experiment", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "low", "high")])


@query("r10_cdf_table", "pred", _sql_scores("rmse") + " SELECT experiment, station_id, round(row_number() OVER (PARTITION BY experiment ORDER BY score, station_id) / CAST(count(*) OVER (PARTITION BY experiment) AS DOUBLE), 9) AS cdf FROM s WHERE score IS NOT NULL")
def r10_cdf(t: Tables):
    return R.cdf_table(_long(t, ["rmse"]), ["experiment"]).select("experiment", "station_id", F.round("cdf", 9).alias("cdf"))


@query("r10_p_matrix", "pred", _HOLM + ", bo AS (SELECT metric, model_a AS model, model_b AS other, p_holm FROM hp UNION ALL SELECT metric, model_b, model_a, p_holm FROM hp) SELECT metric, model, " + ", ".join(f"round(max(p_holm) FILTER (WHERE other = '{e}'), 6) AS {e}" for e in EXPERIMENTS) + " FROM bo GROUP BY 1, 2")
def r10_matrix(t: Tables):
    return R.p_matrix(R.significance(_complete(t), 3), list(EXPERIMENTS)).select("metric", "model", *r6(*EXPERIMENTS))


@query("r10_clip_limit", "pred", _sql_scores("bias") + " SELECT round(quantile_cont(abs(score), 0.99), 4) AS clip_limit FROM s")
def r10_clip(t: Tables):
    return R.clip_limit(_long(t, ["bias"]), "score").select(F.round("clip_limit", 4).alias("clip_limit"))


@query("r11_comparison_report", "pred", _HOLM + " SELECT s.metric, s.experiment, round(min(score), 6) AS v_min, round(median(score), 6) AS v_median, round(avg(score), 5) AS v_mean, round(max(score), 6) AS v_max, count(score) AS n, round(max(least_p), 6) AS least_p FROM c s LEFT JOIN (SELECT metric, model_a, min(p_holm) AS least_p FROM hp GROUP BY 1, 2) l ON l.metric = s.metric AND l.model_a = s.experiment GROUP BY 1, 2")
def r11(t: Tables):
    s = _complete(t)
    summary = A.score_summary(s, ["metric", "experiment"])
    best = R.significance(s, 3).groupBy("metric", F.col("model_a").alias("experiment")).agg(F.min("p_holm").alias("least_p"))
    return summary.join(best, ["metric", "experiment"], "left").select("metric", "experiment", *r6("v_min", "v_median"), F.round("v_mean", 5).alias("v_mean"), *r6("v_max"), "n", *r6("least_p"))


@query("r12_hydrograph", "pred", "SELECT experiment, station_id, time, round(min(obs), 6) AS obs, round(median(sim), 6) AS sim FROM pred WHERE time BETWEEN DATE '2000-03-01' AND DATE '2001-03-01' GROUP BY 1, 2, 3")
def r12(t: Tables):
    return R.hydrograph(t.pred, "2000-03-01", "2001-03-01", ["experiment"]).select("experiment", "station_id", "time", *r6("obs", "sim"))


@query("r12_calendar", "monthly", "SELECT station_id, time, row_number() OVER (PARTITION BY station_id ORDER BY time) - 1 AS position FROM monthly WHERE time >= DATE '2000-01-01'")
def r12_calendar(t: Tables):
    cal = t.monthly.where(F.col("time") >= TEST).select("station_id", "time")
    n = cal.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    rows = n.select("station_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("position"))
    return R.attach_calendar(rows, cal).select("station_id", "time", "position")


# --- zones, polygons, sets -------------------------------------------------------------------


@query("j9_basin_attributes", "station weekly", "SELECT s.station_id, n.n_name, w.lo AS a__coverage, w.hi AS b__coverage FROM station s LEFT JOIN nation n ON n.n_nationkey = s.zone1 LEFT JOIN (SELECT c_nationkey, round(min_by(c_acctbal, c_custkey) FILTER (WHERE c_custkey % 2 = 0), 2) AS lo, round(min_by(c_acctbal, c_custkey) FILTER (WHERE c_custkey % 2 = 1), 2) AS hi FROM customer GROUP BY 1) w ON w.c_nationkey = s.zone1")
def j9(t: Tables):
    st = t.station.select("station_id", F.col("zone1").alias("zone_id"))
    basins = t.read("nation").select(F.col("n_nationkey").alias("zone_id"), "n_name")
    d = t.read("customer").select(F.col("c_nationkey").alias("zone_id"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("product"), F.col("c_custkey").alias("time"), F.col("c_acctbal").alias("coverage"))
    return J.basin_attributes(st, basins, d).select("station_id", "n_name", "a__coverage", "b__coverage")


def _zone_months(t: Tables, zone: str):
    return t.monthly.join(t.station.select("station_id", zone), "station_id").groupBy(F.col(zone), "time").agg(F.sum("flux").alias(f"flux_{zone}"))


@query("j10_zone_series", "station monthly", ", a AS (SELECT zone1, time, sum(flux) AS f FROM monthly JOIN station USING (station_id) GROUP BY 1, 2), b AS (SELECT zone2, time, sum(flux) AS f FROM monthly JOIN station USING (station_id) GROUP BY 1, 2) SELECT m.station_id, m.time, a.f AS flux_zone1, b.f AS flux_zone2 FROM monthly m JOIN station s USING (station_id) LEFT JOIN a ON a.zone1 = s.zone1 AND a.time = m.time LEFT JOIN b ON b.zone2 = s.zone2 AND b.time = m.time")
def j10(t: Tables):
    spine = t.monthly.select("station_id", "time").join(t.station.select("station_id", "zone1", "zone2"), "station_id")
    out = J.on_spine(spine, [_zone_months(t, "zone1")], ["zone1", "time"])
    return J.on_spine(out, [_zone_months(t, "zone2")], ["zone2", "time"]).select("station_id", "time", "flux_zone1", "flux_zone2")


@query("j11_attach_once", sql="SELECT o.o_orderkey, l.l_partkey FROM orders o LEFT JOIN (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1) l ON l.l_orderkey = o.o_orderkey")
def j11(t: Tables):
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return J.attach_once(t.read("orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select("o_orderkey", "l_partkey")


@query("j12_merge_on_axes", "grid", "SELECT lat_idx, lon_idx, round(max(value) FILTER (WHERE cell_id % 3 <> 0), 6) AS a, max(code) FILTER (WHERE cell_id % 4 <> 0) AS b FROM grid WHERE cell_id % 12 <> 0 GROUP BY 1, 2")
def j12(t: Tables):
    k = ["lat_idx", "lon_idx"]
    a = t.grid.where("cell_id % 3 <> 0").select(*k, F.round("value", 6).alias("a"))
    b = t.grid.where("cell_id % 4 <> 0").select(*k, F.col("code").alias("b"))
    return J.merge_on_axes([a, b], k)


_RULED = """WITH n AS (SELECT lower(p_type) || '__' || replace(p_name, ' ', '_') AS c, min(p_partkey) AS position FROM part GROUP BY 1),
ru AS (SELECT DISTINCT 0 AS r, 'exact' AS match_type, lower(p_type) || '__' || replace(p_name, ' ', '_') AS k FROM part WHERE p_partkey % 5 = 0 UNION SELECT DISTINCT 1, 'base', lower(p_type) || '__' || split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 7 = 0 UNION SELECT DISTINCT 2, 'prefix', substr(lower(p_type), 1, 3) FROM part),
fi AS (SELECT c, match_type, k, row_number() OVER (PARTITION BY c ORDER BY r, -length(k)) AS i FROM n JOIN ru ON (r = 0 AND c = k) OR (r = 1 AND starts_with(c, k || '_')) OR (r = 2 AND starts_with(c, k))),
na AS (SELECT n.c AS "column", n.position, match_type, k AS "key", match_type AS label FROM n LEFT JOIN fi ON fi.c = n.c AND i = 1)"""


@query("j16_rule_lookup", sql=_RULED + ' SELECT "column", match_type, "key", label FROM na')
def j16(t: Tables):
    return J.rule_lookup(_headers(t).select("column").distinct(), _rules(t))


def _headers(t: Tables):
    p = t.read("part")
    return p.select(F.concat(F.lower("p_type"), F.lit("__"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("column"), F.col("p_partkey").alias("position"))


def _rules(t: Tables):
    p = t.read("part")
    exact = p.where("p_partkey % 5 = 0").select(F.lit("exact").alias("match_type"), F.concat(F.lower("p_type"), F.lit("__"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("key"), F.lit("exact").alias("label"), F.col("p_partkey").alias("position"))
    base = p.where("p_partkey % 7 = 0").select(F.lit("base").alias("match_type"), F.concat(F.lower("p_type"), F.lit("__"), F.substring_index("p_name", " ", 1)).alias("key"), F.lit("base").alias("label"), F.col("p_partkey").alias("position"))
    prefix = p.select(F.lit("prefix").alias("match_type"), F.substring(F.lower("p_type"), 1, 3).alias("key"), F.lit("prefix").alias("label"), F.col("p_partkey").alias("position"))
    return exact.unionByName(base).unionByName(prefix).dropDuplicates(["match_type", "key"])


@query("j18_same_core", sql="WITH z AS (SELECT c_custkey AS zone_id, c_custkey // 2 AS core_id, 6 + c_custkey % 2 AS level, 100 + CAST(c_custkey % 13 AS DOUBLE) AS area FROM customer) SELECT a.core_id, a.zone_id AS fine_id, b.zone_id AS coarse_id FROM z a JOIN z b ON a.core_id = b.core_id AND a.level = 7 AND b.level = 6 WHERE abs(a.area - b.area) <= 0.05 * greatest(a.area, b.area)")
def j18(t: Tables):
    k = F.col("c_custkey")
    z = t.read("customer").select(k.alias("zone_id"), F.expr("c_custkey div 2").alias("core_id"), (k % 2 + 6).alias("level"), ((k % 13).cast("double") + 100).alias("area"))
    return J.same_core(z, 7, 6).select("core_id", "fine_id", "coarse_id")


@query("j19_children", sql="SELECT n_nationkey + 100 AS code, count(o_orderkey) AS n_children FROM nation LEFT JOIN orders ON substr(CAST(o_orderkey + 100000 AS VARCHAR), 1, 3) = CAST(n_nationkey + 100 AS VARCHAR) GROUP BY 1")
def j19(t: Tables):
    parents = t.read("nation").select((F.col("n_nationkey") + 100).alias("code"))
    children = t.read("orders").select((F.col("o_orderkey") + 100000).alias("code"))
    return J.children_per_parent(parents, children, "code", 3)


@query("u1_union_slices", sql="SELECT k, max_by(v, s) AS v, CAST(max_by(extra, s) AS VARCHAR) AS extra FROM (SELECT o_custkey AS k, count(*) AS v, 1 AS s, NULL AS extra FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1 UNION ALL SELECT o_custkey, count(*), 2, 'late' FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) GROUP BY 1")
def u1(t: Tables):
    o = t.read("orders")
    a = o.where(F.col("o_orderdate") < "1998-01-01").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    b = o.where(F.col("o_orderdate") >= "1997-01-01").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("v")).withColumn("extra", F.lit("late"))
    return J.union_slices([a, b], ["k"])


@query("u2_stack_layers", sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_linenumber - 1 AS DOUBLE) AS depth FROM lineitem")
def u2(t: Tables):
    li = t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return J.stack_layers({float(d): li.where(F.col("l_linenumber") == d + 1) for d in range(7)})


@query("u2_stack_all_layers", sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_linenumber - 1 AS DOUBLE) AS depth FROM lineitem")
def u2_all(t: Tables):
    li = t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return J.stack_layers({float(d): li.where(F.col("l_linenumber") == d + 1) for d in range(7)})


@query("u4_membership_matrix", sql="SELECT p_name AS feature, coalesce(bool_or(p_type = 'ECONOMY'), false) AS \"ECONOMY\", coalesce(bool_or(p_type = 'PROMO'), false) AS \"PROMO\" FROM part GROUP BY 1")
def u4(t: Tables):
    return J.membership_matrix(t.read("part").select(F.col("p_type").alias("experiment"), F.col("p_name").alias("feature")), ["ECONOMY", "PROMO"])


@query("u5_overlap", "station", "SELECT CASE WHEN num % 2 = 0 AND num % 3 = 0 THEN 'both' WHEN num % 2 = 0 THEN 'a_only' WHEN num % 3 = 0 THEN 'b_only' ELSE 'neither' END AS part, count(*) AS n FROM station GROUP BY 1")
def u5(t: Tables):
    return J.overlap(t.station.where("num % 2 = 0"), t.station.where("num % 3 = 0"), t.station)


@query("u7_concat_parts", sql="SELECT * FROM (SELECT s_suppkey AS k, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer)")
def u7(t: Tables):
    a = t.read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return J.concat_parts([a, t.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))])


# --- experiments -----------------------------------------------------------------------------


def _experiments(t: Tables):
    """One experiment per nation, whose base is the nation before it in the same region."""
    n = t.read("nation")
    base = F.when(F.col("n_nationkey") >= 5, F.concat(F.lit("e"), (F.col("n_nationkey") - 5).cast("string")))
    return n.select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("experiment"), base.alias("base"), F.lit("monthly").alias("profile"))


def _tokens(t: Tables):
    n, c = t.read("nation"), t.read("customer")
    group = n.select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("experiment"), F.lit("include_group").alias("op"), F.concat(F.lit("g"), (F.col("n_nationkey") % 7).cast("string")).alias("token"))
    # every customer's key is a feature that its nation excludes
    drop = c.select(F.concat(F.lit("e"), F.col("c_nationkey").cast("string")).alias("experiment"), F.lit("exclude_feature").alias("op"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("token"))
    return group.unionByName(drop.distinct())


def _meta(t: Tables):
    return t.read("part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), F.concat(F.lit("g"), (F.col("p_size") % 7).cast("string")).alias("group"), F.col("p_partkey").alias("position"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("time_end"))


_RES = """WITH RECURSIVE e AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 5 THEN n_nationkey - 5 END AS b FROM nation),
ch(k, a, d) AS (SELECT k, k, 0 FROM e UNION ALL SELECT ch.k, e.b, d + 1 FROM ch JOIN e ON e.k = ch.a WHERE e.b IS NOT NULL),
m AS (SELECT p_partkey AS f, p_size % 7 AS g, p_size FROM part),
nm AS (SELECT k AS a, f, 0 AS o FROM e JOIN m ON m.g = k % 7 UNION ALL SELECT DISTINCT c_nationkey, c_custkey, 1 FROM customer),
n1 AS (SELECT a, f, max(o) AS o FROM nm GROUP BY 1, 2),
l AS (SELECT ch.k, n1.f, min_by(n1.o, d) AS o FROM ch JOIN n1 ON n1.a = ch.a GROUP BY 1, 2),
res AS (SELECT 'e' || l.k AS experiment, 'f' || l.f AS feature, l.f AS position, m.p_size FROM l JOIN m ON m.f = l.f WHERE l.o = 0)"""


@query("u3_resolve_features", sql=_RES + " SELECT experiment, feature, position FROM res")
def u3(t: Tables):
    # tasks follow the features, so that a task's share doesn't grow with them
    tasks = max(t.spark.sparkContext.defaultParallelism, t.read("part").count() // 20_000)
    return X.resolve_features(_experiments(t), _tokens(t), _meta(t), tasks)


@query("u3_resolve_all_features", sql=_RES + " SELECT experiment, feature, position FROM res")
def u3_all(t: Tables):
    return u3(t)


_HULL = " SELECT 'e' || k AS experiment, DATE '2020-01-05' AS time_end, n.natural_end, CASE WHEN n.natural_end IS NULL THEN 'no end' WHEN DATE '2020-01-05' < n.natural_end THEN 'cap' WHEN DATE '2020-01-05' > n.natural_end THEN 'beyond' ELSE 'natural' END AS note FROM e LEFT JOIN (SELECT experiment, CAST(min(DATE '2020-01-01' + CAST(p_size AS INTEGER)) AS DATE) AS natural_end FROM res GROUP BY 1) n ON n.experiment = 'e' || k"


@query("e11_hull_notes", sql=_RES + _HULL)
def e11(t: Tables):
    hull = _experiments(t).select("experiment", F.lit("2020-01-05").cast("date").alias("time_end"))
    return X.hull_notes(u3(t), _meta(t), hull)


@query("e11_hull_notes_all", sql=_RES + _HULL)
def e11_all(t: Tables):
    hull = _experiments(t).select("experiment", F.lit("2020-01-05").cast("date").alias("time_end"))
    return X.hull_notes(u3(t), _meta(t), hull)


@query("e11_config_problems", sql=_RES + """, to_ AS (SELECT 'e' || c_nationkey AS experiment, 'unknown feature' AS problem, 'f' || c_custkey AS token FROM (SELECT DISTINCT c_nationkey, c_custkey FROM customer) WHERE c_custkey NOT IN (SELECT f FROM m) UNION ALL SELECT 'e' || k, 'unknown group', 'g' || k % 7 FROM e WHERE k % 7 NOT IN (SELECT g FROM m) UNION ALL SELECT 'e' || r_regionkey, 'unknown group', r_name FROM region WHERE r_name NOT IN (SELECT 'g' || g FROM m))
SELECT * FROM to_ UNION ALL SELECT 'e' || k, 'unknown base', 'e' || b FROM e WHERE b IS NOT NULL AND b NOT IN (SELECT k FROM e) UNION ALL SELECT 'e' || k, 'no features left', NULL FROM e WHERE 'e' || k NOT IN (SELECT experiment FROM res)""")
def e11_problems(t: Tables):
    bad = _tokens(t).unionByName(t.read("region").select(F.concat(F.lit("e"), F.col("r_regionkey").cast("string")).alias("experiment"), F.lit("include_group").alias("op"), F.col("r_name").alias("token")))
    return X.config_problems(_experiments(t), bad, _meta(t), u3(t))


@query("e11_merged_settings", sql="SELECT 'e' || n_nationkey AS experiment, u.key, CASE WHEN u.key = 'seed' AND n_regionkey = 1 THEN n_name WHEN u.key = 'rate' THEN 'shared' ELSE u.d END AS value FROM nation CROSS JOIN (VALUES ('seed', '7'), ('rate', '0.1'), ('depth', '5')) u(key, d)")
def e11_settings(t: Tables):
    own = t.read("nation").where("n_regionkey = 1").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("experiment"), F.lit("seed").alias("key"), F.col("n_name").alias("value"))
    shared = t.read("region").where("r_regionkey = 0").select(F.lit(None).cast("string").alias("experiment"), F.lit("rate").alias("key"), F.lit("shared").alias("value"))
    return X.merged_settings(_experiments(t), own.unionByName(shared), {"seed": "7", "rate": "0.1", "depth": "5"})


_LEAK = " SELECT experiment, feature FROM res WHERE p_size % 7 = 3 AND experiment IN (SELECT 'e' || n_nationkey FROM nation WHERE n_regionkey = 2)"


@query("e11_leakage", sql=_RES + _LEAK)
def e11_leak(t: Tables):
    spatial = t.read("nation").where("n_regionkey = 2").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("experiment"))
    return X.leakage(u3(t), _meta(t), spatial, "g3")


@query("e11_leakage_all", sql=_RES + _LEAK)
def e11_leak_all(t: Tables):
    spatial = t.read("nation").where("n_regionkey = 2").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("experiment"))
    return X.leakage(u3(t), _meta(t), spatial, "g3")


@query("e12_feature_metadata", sql=_RULED + ' SELECT na.*, split_part("column", \'__\', 1) AS "group", upper(split_part("column", \'__\', 1)) AS driver FROM na')
def e12(t: Tables):
    groups = t.read("part").select(F.lower("p_type").alias("group")).distinct().withColumn("driver", F.upper("group"))
    return X.feature_metadata(_headers(t), _rules(t), groups)


# --- stores and quality ----------------------------------------------------------------------


def _store(t: Tables):
    li = t.read("lineitem")
    f = li.groupBy(F.concat(F.lit("MW_"), F.col("l_suppkey").cast("string")).alias("station_id")).agg(F.sum("l_quantity").alias("a__q"), F.count(F.lit(1)).alias("n"))
    k = F.substring("station_id", 4, 20).cast("long")
    return f.select("station_id", F.when(k % 5 != 0, F.col("a__q")).alias("a__q"), F.when(k % 7 != 0, F.col("n")).alias("a__n"), F.when(k % 3 != 0, k).alias("b__k"))


_STORE = "st AS (SELECT 'MW_' || l_suppkey AS station_id, CASE WHEN l_suppkey % 5 <> 0 THEN sum(l_quantity) END AS a__q, CASE WHEN l_suppkey % 7 <> 0 THEN count(*) END AS a__n, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS b__k FROM lineitem GROUP BY l_suppkey)"


def _provenance(t: Tables):
    got = G.choose_cells(t.station, t.grid.where("value is not null"), t.axes, 2.0, "keep_nan")
    return materialize(got.select("station_id", F.lit("grid").alias("dataset"), "dist_km", "rescued", "outcome", "keep"), "provenance")


_CH = chosen_cte(2.0, "keep_nan")
_E1 = _CH + ", e1 AS (SELECT s.*, g.value AS grid__value, g.code AS grid__code FROM station s LEFT JOIN ch ON ch.station_id = s.station_id LEFT JOIN grid g ON g.lat_idx = ch.lat_idx AND g.lon_idx = ch.lon_idx)"


@query("e1_static_store", "station grid", _E1 + " SELECT * EXCLUDE (grid__value), round(grid__value, 6) AS grid__value FROM e1")
def e1(t: Tables):
    spec = E.manifest([E.Spec("grid", "static", ("value", "code"), 2.0, "keep_nan", ("code",))])[0]
    values, _ = E.sample_dataset(t.station, t.grid, t.axes, spec)
    return E.static_store(t.station, [values]).withColumn("grid__value", F.round("grid__value", 6))


@query("e2_dynamic_store", "station monthly grid_month", chosen_cte(2.0, "skip_well") + " SELECT m.station_id, m.time, round(m.target, 6) AS target, g.v1 AS grid__v1, g.v2 AS grid__v2, m.flux AS zone__flux FROM monthly m LEFT JOIN ch ON ch.station_id = m.station_id LEFT JOIN grid_month g ON g.lat_idx = ch.lat_idx AND g.lon_idx = ch.lon_idx AND g.time = m.time")
def e2(t: Tables):
    spec = E.Spec("grid", "monthly", ("v1", "v2"), 2.0, "skip_well")
    values, _ = E.sample_dataset(t.station, t.grid_month, t.axes, spec)
    # the grid's three months of 2000 meet the stations' months
    return E.dynamic_store(t.monthly.select("station_id", "time", F.round("target", 6).alias("target")), [values.where("time is not null")], zones=[t.monthly.select("station_id", "time", F.col("flux").alias("zone__flux"))])


_Q1 = _CH + """, q1 AS (SELECT 'grid' AS dataset, count(*) AS n_stations, """ + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in Q.OUTCOMES) + """, count(*) FILTER (WHERE outcome = 'rescued') * 100.0::DOUBLE / count(*) AS pct_rescued, count(*) FILTER (WHERE outcome IN ('no_valid', 'dropped')) * 100.0::DOUBLE / count(*) AS pct_without_cell,
median(dist_km) AS dist_km_median, quantile_cont(dist_km, 0.95) AS dist_km_p95, max(dist_km) AS dist_km_max, median(dist_km) FILTER (WHERE outcome = 'rescued') AS rescue_km_median, max(dist_km) FILTER (WHERE outcome = 'rescued') AS rescue_km_max FROM ch)"""
_Q1_REAL = ["pct_rescued", "pct_without_cell", "dist_km_median", "dist_km_p95", "dist_km_max", "rescue_km_median", "rescue_km_max"]


@query("q1_provenance_summary", "station grid", _Q1 + " SELECT * REPLACE (" + ", ".join(f"round({c}, 5) AS {c}" for c in _Q1_REAL) + ") FROM q1")
def q1(t: Tables):
    return Q.provenance_summary(_provenance(t)).withColumns({c: F.round(c, 5) for c in _Q1_REAL})


@query("q2_flagged_stations", "station grid", _CH + " SELECT station_id, 'grid' AS dataset, round(dist_km, 6) AS dist_km, outcome = 'rescued' AS rescued, outcome, true AS keep FROM ch WHERE outcome <> 'home'")
def q2(t: Tables):
    return Q.flagged(_provenance(t)).withColumn("dist_km", F.round("dist_km", 6))


@query("q3_static_completeness", sql=f"WITH {_STORE} SELECT 'a' AS dataset, 2 AS n_variables, count(*) FILTER (WHERE a__q IS NULL OR a__n IS NULL) AS n_affected, count(*) FILTER (WHERE a__q IS NULL AND a__n IS NULL) AS n_all_missing, round((count(*) * 2 - count(a__q) - count(a__n)) * 100.0 / (count(*) * 2), 6) AS pct_missing, CASE WHEN count(a__n) <= count(a__q) THEN 'a__n' ELSE 'a__q' END AS worst FROM st UNION ALL SELECT 'b', 1, count(*) - count(b__k), count(*) - count(b__k), round((count(*) - count(b__k)) * 100.0 / count(*), 6), 'b__k' FROM st")
def q3(t: Tables):
    return Q.static_completeness(_store(t)).withColumn("pct_missing", F.round("pct_missing", 6))


@query("q4_dynamic_completeness", "monthly", ", w AS (SELECT station_id, CASE WHEN month(time) <> 5 THEN flux END AS f, CASE WHEN CAST(substr(station_id, 4) AS INTEGER) % 6 <> 0 THEN state END AS s FROM monthly WHERE time >= DATE '1996-01-01' AND time <= DATE '1999-12-31'), g AS (SELECT station_id, count(*) AS n, count(f) AS cf, count(s) AS cs FROM w GROUP BY 1) SELECT 'x' AS dataset, count(*) FILTER (WHERE cf < n OR cs < n) AS n_affected, count(*) FILTER (WHERE cf = 0 OR cs = 0) AS n_all_missing, round(sum(2 * n - cf - cs) * 100.0 / sum(2 * n), 6) AS pct_missing FROM g")
def q4(t: Tables):
    d = t.monthly.select("station_id", "time", F.when(F.month("time") != 5, F.col("flux")).alias("x__f"), F.when(t.num % 6 != 0, F.col("state")).alias("x__s"))
    cover = t.read("region").where("r_regionkey = 0").select(F.lit("x").alias("dataset"), F.lit("1996-01-01").cast("date").alias("first"), F.lit("1999-12-01").cast("date").alias("last"))
    return Q.dynamic_completeness(d, cover).withColumn("pct_missing", F.round("pct_missing", 6))


_Q5 = _E1.replace(", homes AS", ", " + _STORE + ", homes AS", 1) + _Q1.removeprefix(_CH) + """, so AS (SELECT grid__value, grid__code, a__q, a__n, b__k FROM e1 LEFT JOIN st ON st.station_id = e1.station_id),
nu AS (SELECT count(*) AS n, count(*) - count(grid__value) AS gv, count(*) - count(grid__code) AS gc, count(*) FILTER (WHERE grid__value IS NULL OR grid__code IS NULL) AS g1, count(*) FILTER (WHERE grid__value IS NULL AND grid__code IS NULL) AS g2, count(*) - count(a__q) AS aq, count(*) - count(a__n) AS an, count(*) FILTER (WHERE a__q IS NULL OR a__n IS NULL) AS a1, count(*) FILTER (WHERE a__q IS NULL AND a__n IS NULL) AS a2, count(*) - count(b__k) AS bk FROM so),
co AS (SELECT 'grid' AS dataset, 2 AS n_variables, g1 AS n_affected, g2 AS n_all_missing, (gv + gc) * 100.0::DOUBLE / (2 * n) AS pct_missing, CASE WHEN gc >= gv THEN 'grid__code' ELSE 'grid__value' END AS worst FROM nu UNION ALL SELECT 'a', 2, a1, a2, (aq + an) * 100.0::DOUBLE / (2 * n), CASE WHEN an >= aq THEN 'a__n' ELSE 'a__q' END FROM nu UNION ALL SELECT 'b', 1, bk, bk, bk * 100.0::DOUBLE / n, 'b__k' FROM nu),
qc AS (SELECT co.dataset, n_variables, n_affected, n_all_missing, round(pct_missing, 6) AS pct_missing, worst, n_rescued, r_name AS display, r_regionkey AS position, CASE WHEN co.dataset = 'grid' THEN 'nearest cell' ELSE 'polygon join' END AS method, round(dist_km_median * 1000, 1) AS dist_m_median, round(dist_km_max * 1000, 1) AS dist_m_max FROM co LEFT JOIN q1 ON q1.dataset = co.dataset LEFT JOIN region ON r_regionkey = CASE co.dataset WHEN 'grid' THEN 0 WHEN 'a' THEN 1 END)"""


@query("q5_qc_table", "station grid", _Q5 + " SELECT * FROM qc")
def q5(t: Tables):
    store = e1(t).select("station_id", "grid__value", "grid__code").join(_store(t), "station_id", "left")
    config = t.read("region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "grid").otherwise("a").alias("dataset"), F.col("r_name").alias("display"), F.col("r_regionkey").alias("position"))
    return Q.qc_table(Q.static_completeness(store), Q.provenance_summary(_provenance(t)), config).withColumn("pct_missing", F.round("pct_missing", 6))


@query("j17_qc_join", "station grid", _Q5 + " SELECT dataset, method, pct_missing, display FROM qc")
def j17(t: Tables):
    return q5(t).select("dataset", "method", "pct_missing", "display")


@query("q6_loss_reasons", sql=f"WITH {_STORE} SELECT CASE WHEN b__k IS NULL AND (a__q IS NULL OR a__n IS NULL) THEN 'both' WHEN b__k IS NULL THEN 'no_priority_dataset' WHEN a__q IS NULL OR a__n IS NULL THEN 'incomplete_static' ELSE 'complete' END AS reason, count(*) AS n FROM st GROUP BY 1")
def q6(t: Tables):
    s = _store(t)
    return Q.loss_reasons(s, s.where("b__k is null"), s.where("a__q is null or a__n is null"))


@query("q7_feature_nulls", sql=f"WITH {_STORE} " + " UNION ALL ".join(f"SELECT '{c[0]}' AS dataset, '{c}' AS \"column\", count(*) - count({c}) AS n_null, count(*) AS n_rows, '{c[3:]}' AS variable FROM st" for c in ("a__q", "a__n", "b__k")))
def q7(t: Tables):
    return Q.feature_nulls(_store(t))


@query("q7_affected_datasets", sql=f"WITH {_STORE}, n AS (" + " UNION ALL ".join(f"SELECT '{c[0]}' AS dataset, count(*) - count({c}) AS n_null FROM st" for c in ("a__q", "a__n", "b__k")) + ") SELECT dataset, count(*) AS n_features, sum(n_null) AS n_null, max(n_null) AS most FROM n WHERE n_null > 0 GROUP BY 1")
def q7_groups(t: Tables):
    return Q.affected_datasets(Q.feature_nulls(_store(t)))


_NULLS = "CAST(a__q IS NULL AS INTEGER) + CAST(a__n IS NULL AS INTEGER) + CAST(b__k IS NULL AS INTEGER)"


@query("q8_null_histogram", sql=f"WITH {_STORE} SELECT {_NULLS} AS n_null, count(*) AS n_stations FROM st GROUP BY 1")
def q8(t: Tables):
    return Q.station_null_histogram(_store(t))


@query("q8_null_summary", sql=f"WITH {_STORE} SELECT count(*) FILTER (WHERE {_NULLS} = 0) AS n_complete, median({_NULLS}) AS median_null, max({_NULLS}) AS max_null FROM st")
def q8_summary(t: Tables):
    return Q.station_null_summary(_store(t))


# --- sources and sinks -----------------------------------------------------------------------


def _path(t: Tables, tag: str) -> str:
    import uuid

    return f"{shared_dir(t.spark)}/{tag}-{uuid.uuid4().hex}"


_ROUND = "SELECT station_id, time, flux FROM monthly"


def _edges(t: Tables) -> tuple[float, float, float, float]:
    """West, south, east and north of the stand-in grid, whose rows go on south with the orders."""
    return (5.0, t.axes.lat0 + t.axes.dlat * t.axes.n_lat, 16.0, 56.0)


def _series_csv(t: Tables):
    path = _path(t, "series")
    IO.write_series(t.monthly, path, ["flux", "state"])
    return IO.read_series(t.spark, path, ["flux", "state"])


@query("s1_series_scan", "monthly", _ROUND)
def s1(t: Tables):
    return _series_csv(t).select("station_id", "time", "flux")


@query("s2_file_names", sql="SELECT s_suppkey, 'MW_' || s_suppkey AS k, 1990 + s_suppkey % 40 AS y, 'v' || s_suppkey AS v FROM supplier")
def s2(t: Tables):
    k = F.col("s_suppkey").cast("string")
    year = (F.col("s_suppkey") % 40 + 1990).cast("string")
    return t.read("supplier").select("s_suppkey", IO.key_of_file(F.concat(F.lit("/a/MW_"), k, F.lit("_monthly.csv"))).alias("k"), IO.year_of_file(F.concat(F.lit("lcc-"), year, F.lit("-v2.nc"))).alias("y"), IO.variable_of_file(F.concat(F.lit("Climate_v"), k, F.lit("_1991-2022_AOI.nc")), "Climate").alias("v"))


@query("s3_station_scan", sql="SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_acctbal AS lon, CAST(s_nationkey AS DOUBLE) AS lat FROM supplier WHERE s_nationkey % 2 = 0")
def s3(t: Tables):
    path = _path(t, "stations")
    k = F.col("s_suppkey").cast("string")
    s = t.read("supplier").select(F.concat(F.lit(" MW_"), k, F.lit(" ")).alias("MW_ID"), F.col("s_acctbal").alias("lon"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).alias("lat"))
    s.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return IO.read_stations(t.spark, path)


@query("s4_delimited_scan", sql="SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS n FROM supplier")
def s4(t: Tables):
    path = _path(t, "dialect")
    t.read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n")).write.option("header", True).option("sep", ";").csv(path)
    return IO.read_delimited(t.spark, path)


@query("s5_pruned_scan", sql="SELECT l_orderkey, l_quantity FROM lineitem")
def s5(t: Tables):
    return IO.read_columns(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "absent"])


@query("s7_group_series", "monthly", "SELECT 'a' AS product, station_id AS zone_id, time, flux FROM monthly")
def s7(t: Tables):
    path = _path(t, "zones")
    IO.write_series(t.monthly, path, ["flux"])
    return IO.read_group_series(t.spark, {"a": path, "b": f"{path}-absent"}, ["flux"])


@query("s8_first_existing", sql="SELECT r_regionkey, r_name FROM region")
def s8(t: Tables):
    return IO.read_first_existing(t.spark, [f"{t.dir}/absent.parquet", f"{t.dir}/region.parquet"], "r_regionkey int, r_name string")


@query("s9_idempotent_sink", sql="SELECT n_nationkey, n_name FROM nation")
def s9(t: Tables):
    path = _path(t, "once")
    IO.write_once(t.read("nation").select("n_nationkey", "n_name"), path)
    IO.write_once(t.read("nation").select("n_nationkey", "n_name").limit(1), path)
    return t.spark.read.parquet(path)


@query("s10_grid_sink", "grid", "SELECT cell_id, lat_idx, lon_idx, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 1) AS value, code FROM grid")
def s10(t: Tables):
    g = t.grid.select("cell_id", "lat_idx", "lon_idx", "lat", "lon", "value", "code")
    return IO.write_grid(g, _path(t, "grid"), {"value": "float", "code": "smallint"}, _edges(t)).select("cell_id", "lat_idx", "lon_idx", F.round(F.col("value").cast("double"), 1).alias("value"), F.col("code").cast("int").alias("code"))


@query("s9_resumable_stations", "monthly", "SELECT station_id, time, flux FROM monthly")
def s9_stations(t: Tables):
    """A store whose first run stops after some jobs; the second builds only what is missing."""
    path, runs = _path(t, "stations-store"), []

    def build(mine):
        if len(runs) == 2:
            runs.append(None)
            raise RuntimeError("stopped")
        runs.append(mine)
        return t.monthly.join(mine, "station_id", "left_semi").select("station_id", "time", "flux")

    per_job = max(1, t.station.count() // 5)
    try:
        IO.write_stations(t.station, build, path, per_job=per_job)
    except RuntimeError:
        IO.write_stations(t.station, build, path, per_job=per_job)
    return t.spark.read.schema("time date, flux double, station_id string").parquet(path).select("station_id", "time", "flux")


@query("s10_conforming_sink", "grid", "SELECT cell_id, CAST(dense_rank() OVER (ORDER BY lat DESC) - 1 AS INTEGER) AS lat_idx, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INTEGER) AS lon_idx, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 1) AS value, code FROM grid")
def s10_conforming(t: Tables):
    """A grid with other coordinate names, rows from south to north and -9999 for no value comes back conforming."""
    g = t.grid.select("cell_id", (F.lit(9999) - F.col("lat_idx")).alias("lat_idx"), "lon_idx", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.coalesce("value", F.lit(-9999.0)).alias("value"), "code")
    spec = {"value": {"dtype": "float", "unit": "mm", "fill": -9999.0, "tier": "1"}, "code": {"dtype": "smallint", "unit": "1", "fill": -1}}
    back = IO.save_grid(g, _path(t, "conforming"), spec, ["cell_id"], bounds=_edges(t))
    return back.select("cell_id", "lat_idx", "lon_idx", F.round(F.col("value").cast("double"), 1).alias("value"), F.col("code").cast("int").alias("code"))


def _wide_blocks(t: Tables, rows, keys: list[str]):
    """Predictions written as wide files of 100 station columns each, and read back."""
    block = [*keys, "block"]
    p = rows.withColumns({"block": F.expr("cast(substr(station_id, 4) as bigint) div 100"), "station_id": (t.num % 100).cast("string")})
    # ranges follow the stations, so that a task's share doesn't grow with them
    ranges = max(t.spark.sparkContext.defaultParallelism, t.station.count() // 500)
    got = IO.long_results(IO.wide_results(p, [str(i) for i in range(100)], block, ranges), keys=block).where("obs is not null")
    station = F.concat(F.lit("MW_"), (F.col("block") * 100 + F.col("station_id").cast("long")).cast("string"))
    return got.select(*keys, station.alias("station_id"), "time", *r6("obs", "sim"))


@query("s11_wide_results", "pred", _CONS + " SELECT experiment, station_id, time, round(obs, 6) AS obs, round(sim, 6) AS sim FROM cons")
def s11(t: Tables):
    return _wide_blocks(t, _cons(t), ["experiment"])


@query("s11_all_wide_results", "pred", "SELECT experiment, seed, station_id, time, round(obs, 6) AS obs, round(sim, 6) AS sim FROM pred")
def s11_all(t: Tables):
    return _wide_blocks(t, t.pred, ["experiment", "seed"])


@query("r12_results_on_calendar", "pred monthly", _CONS + " SELECT c.experiment, c.station_id, m.time, round(c.obs, 6) AS obs, round(c.sim, 6) AS sim FROM cons c JOIN monthly m ON m.station_id = c.station_id AND m.time = c.time")
def r12_results(t: Tables):
    """Result files without dates get them back by each row's position in its station's test calendar."""
    w = Window.partitionBy("experiment", "station_id").orderBy("time")
    rows = _wide_blocks(t, _cons(t), ["experiment"]).withColumn("position", F.row_number().over(w) - 1).drop("time")
    calendar = t.monthly.where(F.col("time") >= TEST).select("station_id", "time")
    return R.attach_calendar(rows, calendar).select("experiment", "station_id", "time", "obs", "sim")


@query("s12_report_sink", sql="SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(round(p_retailprice / 7, 3) AS DOUBLE) AS price FROM part")
def s12(t: Tables):
    path = _path(t, "report")
    IO.write_report(t.read("part").select("p_partkey", (F.col("p_retailprice") / 7).alias("price")), path)
    return t.spark.read.option("sep", ";").option("header", True).csv(path).withColumn("price", F.col("price").cast("double"))


@query("s13_materialised_reuse", "monthly", "SELECT station_id, count(*) AS n FROM monthly GROUP BY 1")
def s13(t: Tables):
    return materialize(t.monthly, "monthly").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


# --- models and attributions -----------------------------------------------------------------


def _matrix(t: Tables):
    monthly = materialize(t.monthly, "monthly")
    m = E.feature_matrix(monthly, ["target"], ["flux", "state"], t.station.select("station_id", "zone2", "depth_m"), ["zone2"])
    d = E.temporal_dataset(monthly, "target", "1999-01-01", TEST)
    return m.drop("target").join(d.select("station_id", "time", "z", "split"), ["station_id", "time"]), ["flux", "state", "target_lag1", "target_lag12", "target_rmean3", "depth_m"], ["zone2"]


OPTIONS = {"rounds": 5, "depth": 4, "least": 5}


@query("m1_temporal_ensemble")
def m1(t: Tables):
    from gridloom.operators import ml

    m, num, cat = _matrix(t)
    return ml.temporal_ensemble(m, "z", num, cat, [1, 2], ["station_id", "time"], **OPTIONS | {"rounds": 8, "patience": 3})[0]


def _folded(t: Tables):
    m, num, cat = _matrix(t)
    return m.drop("split").withColumn("fold", (F.substring("station_id", 4, 20).cast("long") % 3).cast("int")), num, cat


@query("m2_grouped_cv")
def m2(t: Tables):
    from gridloom.operators import ml

    folded, num, cat = _folded(t)
    return ml.grouped_cv(folded, "z", num, cat, 3, [1, 2, 3], 2, ["station_id", "time"], **OPTIONS | {"patience": 2})[0]


@query("m3_deployment")
def m3(t: Tables):
    from gridloom.operators import ml

    folded, num, cat = _folded(t)
    rows, members = ml.grouped_members(folded, "z", num, cat, 3, [1], 1, **OPTIONS)
    model = ml.deployment(rows, "z", ml.members_table(t.spark, members), [1], depth=4, least=5)[0]
    return model.transform(rows).select("station_id", "time", F.col("prediction").alias("sim"))


@query("m4_inverse_scale", "monthly", "SELECT station_id, time, round(target, 4) AS z FROM monthly WHERE station_id IN (SELECT station_id FROM monthly GROUP BY 1 HAVING count(*) FILTER (WHERE time < DATE '2000-01-01') >= 16)")
def m4(t: Tables):
    from gridloom.operators import ml

    d = E.temporal_dataset(t.monthly, "target", "1999-01-01", TEST)
    scale = A.scaler(t.monthly, "target", F.col("time") < TEST)
    return ml.inverse_scale(d.select("station_id", "time", "z"), scale, ["z"]).select("station_id", "time", F.round("z", 4).alias("z"))


@query("m5_loss_history")
def m5(t: Tables):
    from gridloom.operators import ml

    m, num, cat = _matrix(t)
    _, log = ml.temporal_ensemble(m, "z", num, cat, [1], ["station_id", "time"], **OPTIONS)
    imp = ml.importances(log, log[0]["features"], t.spark).select(F.col("feature").alias("name"), F.col("importance").alias("value"))
    return imp.unionByName(ml.loss_history(log, t.spark).select(F.concat(F.lit("round "), F.col("round").cast("string")).alias("name"), F.col("loss").alias("value")))


@query("m5_split_importance")
def m5_splits(t: Tables):
    from gridloom.operators import ml

    m, num, cat = _matrix(t)
    rows, _ = ml.prepare(m, num, cat)
    train = materialize(rows.where("z is not null and split = 'train'"), "rows")
    members = [(s, ml.fit_member(train, "z", s, **OPTIONS)[0]) for s in (1, 2)]
    return ml.split_importances(members, ml.feature_names(rows)).select(F.col("member").alias("seed"), "feature", "splits", "gain")


def _attributed(t: Tables, seeds: list[int]):
    from gridloom.operators import ml

    m, num, cat = _matrix(t)
    rows, _ = ml.prepare(m, num, cat)
    names = ml.feature_names(rows)
    rows = materialize(rows.where("z is not null").withColumn("row_id", F.concat_ws("/", "station_id", "time")).select("row_id", "features", "z", "split"), "rows")
    members = [(0, 1 / len(seeds), ml.fit_member(rows.where("split = 'train'"), "z", s, **OPTIONS)[0]) for s in seeds]
    return ml.explain(rows, members, names, "row_id")


@query("x1_attributions")
def x1(t: Tables):
    return _attributed(t, [1])


@query("x2_ensemble_attributions")
def x2(t: Tables):
    return _attributed(t, [1, 2])


def _held_out(t: Tables):
    """Attributions of the folds' test rows by the members that the cross-validation picked, the rows, and these members."""
    from gridloom.operators import ml

    folded, num, cat = _folded(t)
    keyed = folded.withColumn("row_id", F.concat_ws("/", "station_id", "time"))
    rows, members = ml.grouped_members(keyed, "z", num, cat, 3, [1, 2], 1, **OPTIONS | {"rounds": 4, "patience": 2})
    return ml.held_out_attributions(rows, members, ml.feature_names(rows), "row_id"), rows, members


@query("x5_held_out_explanation")
def x5_explained(t: Tables):
    return _held_out(t)[0]


@query("x5_held_out_sums", "monthly", "SELECT station_id, time, CAST(CAST(substr(station_id, 4) AS BIGINT) % 3 AS INTEGER) AS fold, 0.0::DOUBLE AS gap FROM monthly WHERE station_id IN (SELECT station_id FROM monthly GROUP BY 1 HAVING count(*) FILTER (WHERE time < DATE '2000-01-01') >= 16)")
def x5_sums(t: Tables):
    """What the contributions and the base of a row miss of its fold's prediction: nothing."""
    from gridloom.operators import ml

    long, rows, members = _held_out(t)
    sums = long.groupBy("row_id").agg(F.sum("contribution").alias("s"))
    pred = ml.fold_predictions(rows, members, "z", ["row_id", "station_id", "time"]).groupBy("row_id", "station_id", "time", "fold").agg(F.avg("sim").alias("sim"))
    j = pred.join(sums, "row_id").join(ml.base_values(members), "fold")
    return j.select("station_id", "time", "fold", F.abs(F.round(F.col("s") + F.col("base") - F.col("sim"), 6)).alias("gap"))


def _summary(t: Tables):
    from gridloom.operators import ml

    return ml.attribution_summary(t.attribution)


@query("x3_attribution_summary", "attribution", "SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs, round(abs(avg(contribution)), 6) AS mean, round(stddev_pop(contribution), 5) AS std FROM attribution GROUP BY 1")
def x3(t: Tables):
    return _summary(t).select("feature", *r6("mean_abs"), F.abs(F.round("mean", 6)).alias("mean"), F.round("std", 5).alias("std"))


@query("x4_value_response", "attribution", ", k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY feature ORDER BY contribution) + (count(*) OVER (PARTITION BY feature, contribution) - 1) / 2.0::DOUBLE AS b FROM attribution) SELECT feature, count(*) AS n, round(corr(a, b), 5) AS spearman FROM k GROUP BY 1")
def x4(t: Tables):
    from gridloom.operators import ml

    return ml.value_response(t.attribution, []).withColumn("spearman", F.round("spearman", 5))


@query("x5_held_out_rows", "station", "SELECT station_id, CAST(num % 3 AS INTEGER) AS fold, CAST(r_regionkey AS INTEGER) AS seed FROM station JOIN region ON r_regionkey % 3 = num % 3 AND r_regionkey < 4")
def x5(t: Tables):
    from gridloom.operators import ml

    log = t.read("region").select((F.col("r_regionkey") % 3).cast("int").alias("fold"), F.col("r_regionkey").cast("int").alias("seed"), (F.col("r_regionkey") < 4).alias("picked"))
    return ml.held_out_rows(t.station.select("station_id", (F.col("num") % 3).cast("int").alias("fold")), log).select("station_id", "fold", "seed")


@query("x6_explanation_bundle", "attribution", """, be AS (SELECT feature FROM attribution GROUP BY 1 ORDER BY avg(abs(contribution)) DESC, feature LIMIT 2), ro AS (SELECT row_id FROM (SELECT DISTINCT row_id FROM attribution) ORDER BY md5(row_id || '/7'), row_id LIMIT 300)
SELECT feature, row_id, value, round(contribution, 6) AS contribution, upper(feature) AS label, 'other' AS "group", 'static' AS "window", CASE WHEN feature = 'l_quantity' AND value <= 10 THEN 'q' || CAST(CAST(value AS INTEGER) AS VARCHAR) END AS category FROM attribution WHERE feature IN (SELECT feature FROM be) AND row_id IN (SELECT row_id FROM ro)""")
def x6(t: Tables):
    from gridloom.operators import ml

    labels = t.attribution.select("feature").distinct().withColumn("label", F.upper("feature"))
    few = t.read("lineitem").select("l_quantity").distinct().where("l_quantity <= 10")
    codes = few.select(F.lit("l_quantity").alias("feature"), F.col("l_quantity").alias("code"), F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("category"))
    return ml.explanation_bundle(t.attribution, 2, 300, 7, labels, codes).withColumn("contribution", F.round("contribution", 6))
