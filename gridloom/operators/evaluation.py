"""Skill metrics and tests per station and experiment."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.aggregates import quantiles
from gridloom.operators.windows import average_rank, empirical_cdf, holm, value_positions
from gridloom.sources.shared import materialize


def moments(obs: str, sim: str) -> dict[str, Column]:
    """R2: counts, means, central moments and squared errors of one pass; the variance of a constant is exactly 0."""
    o, s = F.col(obs), F.col(sim)

    def spread(c: Column) -> Column:
        return F.when(F.max(c) == F.min(c), 0.0).otherwise(F.var_pop(c))

    return {"n": F.count(F.lit(1)), "mo": F.avg(o), "ms": F.avg(s), "vo": spread(o), "vs": spread(s), "co": F.covar_pop(o, s), "sse": F.sum((s - o) * (s - o)), "nulls": F.count_if(o.isNull() | s.isNull())}


def pearson(vo: Column, vs: Column, co: Column) -> Column:
    """Correlation from central moments, null when a side is constant."""
    return F.try_divide(co, F.sqrt(vo) * F.sqrt(vs))


def station_scores(pred: DataFrame, keys: list[str], means: DataFrame | None = None, drop_nulls: bool = False, least: int = 1, obs: str = "obs", sim: str = "sim") -> DataFrame:
    """Nse (against the pre-test mean), nse_classic, kge, kge_a, r, r2, bias, rmse, mse, alpha per key.

    With ``drop_nulls`` pairs with a null are left out and ``least`` pairs are needed, and kge is
    null when the mean of obs is 0; without, a null makes all metrics null. means: keys that occur
    in it and ``mean``. One aggregation of central moments, so large offsets don't cancel; a constant
    side leaves r and what is made of it null.
    """
    df = pred.where(F.col(obs).isNotNull() & F.col(sim).isNotNull()) if drop_nulls else pred
    m = df.groupBy(*keys).agg(*[c.alias(k) for k, c in moments(obs, sim).items()])
    m = m.where(F.col("n") >= least)
    if means is not None:
        m = m.join(means.select(*[k for k in keys if k in means.columns], F.col("mean").alias("_m")), [k for k in keys if k in means.columns], "left")
    else:
        m = m.withColumn("_m", F.lit(None).cast("double"))
    n, mo, ms, vo, vs, sse = (F.col(c) for c in ("n", "mo", "ms", "vo", "vs", "sse"))
    r = pearson(vo, vs, F.col("co"))
    alpha = F.try_divide(F.sqrt(vs), F.sqrt(vo))
    from_mean = n * (vo + F.pow(mo - F.col("_m"), 2))
    out = {
        "nse": F.lit(1.0) - F.try_divide(sse, from_mean),
        "nse_classic": F.lit(1.0) - F.try_divide(sse, n * vo),
        "kge": F.lit(1.0) - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(F.try_divide(ms, mo) - 1, 2)),
        "kge_a": F.lit(1.0) - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(F.try_divide(ms - mo, F.sqrt(vo)), 2)),
        "r": r, "r2": r * r, "bias": ms - mo, "rmse": F.sqrt(sse / n), "mse": sse / n, "alpha": alpha,
    }
    whole = F.col("nulls") == 0
    return m.select(*keys, "n", *[F.when(whole, c).alias(k) for k, c in out.items()])


def consolidate(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Observation of the first seed and median simulation of all seeds."""
    return runs.groupBy(*keys).agg(F.min_by("obs", "seed").alias("obs"), F.median("sim").alias("sim"), F.count(F.lit(1)).alias("n_seeds"))


def seeds_side_by_side(runs: DataFrame, keys: list[str], seeds: list[int]) -> DataFrame:
    """One sim column per seed."""
    obs = runs.groupBy(*keys).agg(F.min_by("obs", "seed").alias("obs"), *[F.max(F.when(F.col("seed") == s, F.col("sim"))).alias(f"sim_{s}") for s in seeds])
    return obs


def pretest_means(series: DataFrame, value: str, test_start: str, stored: DataFrame | None = None) -> DataFrame:
    """Stored mean, else recomputed from the rows before the test."""
    own = series.where(F.col("time") < F.lit(test_start).cast("date")).groupBy("station_id").agg(F.avg(value).alias("_own"))
    if stored is None:
        return own.withColumnRenamed("_own", "mean")
    return own.join(stored.select("station_id", F.col("mean").alias("_stored")), "station_id", "full").select("station_id", F.coalesce("_stored", "_own").alias("mean"))


def long_scores(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Scores with one row per metric."""
    return scores.unpivot(keys, metrics, "metric", "score")


def _normal_two_sided(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def chi2_survival(x: float, k: int) -> float:
    """P(X > x) of the chi-squared distribution: series or continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = k / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= h / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = h + 1 - a
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def signed_rank_p(n: int, w: float) -> float:
    """Exact two-sided p of the signed-rank statistic without ties: subsets of the ranks 1 to n by their sum."""
    ways = [1.0] + [0.0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2.0**n)


#: Most pairs for which p is exact (if none is zero or tied).
EXACT_PAIRS = 50


def wilcoxon(scores: DataFrame) -> DataFrame:
    """Signed-rank test of each pair of experiments within a metric, zeros dropped: n, w, z, p_raw, median_diff.

    scores: metric, experiment, station_id, score (complete cases). The p value is exact up to
    EXACT_PAIRS pairs without zeros or ties, else the normal approximation with tie correction; ranks
    come from range partitions, sums are aggregates, p is a pandas function of the aggregated rows.
    """
    a = scores.select("metric", "station_id", F.col("experiment").alias("model_a"), F.col("score").alias("_a"))
    b = scores.select("metric", "station_id", F.col("experiment").alias("model_b"), F.col("score").alias("_b"))
    d = a.join(b, ["metric", "station_id"]).where("model_a < model_b").withColumn("_d", F.col("_a") - F.col("_b")).where("_d is not null")
    keys = ["metric", "model_a", "model_b"]
    d = materialize(d.withColumn("_m", F.abs("_d")), "differences")
    mid = quantiles(d, "_d", [0.5], keys).select(*keys, F.col("p50").alias("median_diff"), F.col("n").alias("n_stations"))
    x = d.where("_d <> 0").groupBy(*keys, "_m").agg(F.count_if(F.col("_d") > 0).alias("_up"), F.count_if(F.col("_d") < 0).alias("_down"))
    place = value_positions(d.where("_d <> 0"), "_m", keys)
    t, r = F.col("_count"), F.col("_before") + (F.col("_count") + 1) / 2
    x = x.join(place, [*keys, "_m"])
    s = x.groupBy(*keys).agg(F.sum(t).alias("n"), F.sum(r * F.col("_up")).alias("_p"), F.sum(r * F.col("_down")).alias("_q"), F.sum(t * (t * t - 1)).alias("_ties"))
    w = F.least("_p", "_q")
    n = F.col("n").cast("double")
    se = F.sqrt((n * (n + 1) * (n * 2 + 1) - F.col("_ties") / 2) / 24)
    s = s.select(*keys, "n", w.alias("w"), F.try_divide(w - n * (n + 1) / 4, se).alias("z"), (F.col("_ties") > 0).alias("_tied"))
    out = mid.join(s, keys, "left")

    @F.pandas_udf("double")
    def p_value(n: pd.Series, w: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(int(k), x) if e else _normal_two_sided(y) for k, x, y, e in zip(n, w, z, exact, strict=True)], dtype="float64")

    exact = F.coalesce((F.col("n") <= EXACT_PAIRS) & (F.col("n") == F.col("n_stations")) & ~F.col("_tied"), F.lit(False))
    return out.withColumn("p_raw", p_value("n", "w", "z", exact)).drop("_tied")


def friedman(scores: DataFrame, n_experiments: int) -> DataFrame:
    """Chi-squared statistic with tie correction and p per metric; null for fewer than 3 experiments. scores: complete cases."""
    r = scores.withColumns({"_r": average_rank("score", ["metric", "station_id"]), "_t": F.count(F.lit(1)).over(Window.partitionBy("metric", "station_id", "score"))})
    per = r.groupBy("metric", "experiment").agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    k = F.lit(float(n_experiments))
    g = per.groupBy("metric").agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.max("_n").alias("n_stations"), F.sum("_ties").alias("_ties"))
    n = F.col("n_stations").cast("double")
    c = F.lit(1.0) - F.col("_ties") / (n * (k * k * k - k))
    stat = F.try_divide(F.lit(12.0) / (n * k * (k + 1)) * F.col("_ss") - n * 3 * (k + 1), c)
    out = g.select("metric", "n_stations", (stat if n_experiments >= 3 else F.lit(None).cast("double")).alias("chi2"))

    @F.pandas_udf("double")
    def p_value(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or math.isnan(v) else chi2_survival(v, n_experiments - 1))

    return out.withColumn("p", p_value("chi2"))


def significance(scores: DataFrame, n_experiments: int) -> DataFrame:
    """Pairwise tests with Friedman p, Holm-adjusted p and the 5 % flag, per metric."""
    pairs = holm(wilcoxon(scores), "p_raw", ["metric"], ["model_a", "model_b"])
    f = friedman(scores, n_experiments).select("metric", F.col("p").alias("friedman_p"))
    return pairs.join(f, "metric", "left").withColumn("sig_5pct", F.col("p_holm") < 0.05)


def box_statistics(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 interquartile ranges)."""
    q = quantiles(scores, value, [0.25, 0.5, 0.75], keys)
    j = scores.join(q, keys).where(F.col(value).isNotNull())
    reach = (F.col("p75") - F.col("p25")) * 1.5
    return j.groupBy(*keys, "p25", "p50", "p75").agg(F.min(F.when(F.col(value) >= F.col("p25") - reach, F.col(value))).alias("low"), F.max(F.when(F.col(value) <= F.col("p75") + reach, F.col(value))).alias("high"))


def cdf_table(scores: DataFrame, parts: list[str], value: str = "score") -> DataFrame:
    """R10 and W12."""
    return empirical_cdf(scores.where(F.col(value).isNotNull()), value, parts, "station_id")


def p_matrix(pairs: DataFrame, experiments: list[str], p: str = "p_holm") -> DataFrame:
    """Symmetric matrix of p values, one row per metric and experiment."""
    both = pairs.select("metric", F.col("model_a").alias("model"), F.col("model_b").alias("other"), p).unionByName(pairs.select("metric", F.col("model_b").alias("model"), F.col("model_a").alias("other"), p))
    return both.groupBy("metric", "model").agg(*[F.max(F.when(F.col("other") == e, F.col(p))).alias(e) for e in experiments])


def clip_limit(scores: DataFrame, value: str, prob: float = 0.99) -> DataFrame:
    """Limit of an axis: quantile of absolute values."""
    q = quantiles(scores.select(F.abs(value).alias("_v")), "_v", [prob])
    return q.select(F.col(q.columns[-1]).alias("clip_limit"))


def hydrograph(pred: DataFrame, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """Observation and ensemble median of each station and date (and more keys) in a window."""
    return consolidate(pred.where(F.col("time").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), [*(keys or []), "station_id", "time"])


def attach_calendar(rows: DataFrame, calendar: DataFrame, position: str = "position", key: str = "station_id") -> DataFrame:
    """Dates for result rows that lost them, by position within the station's test calendar."""
    days = calendar.withColumn(position, F.row_number().over(Window.partitionBy(key).orderBy("time")) - 1)
    return rows.join(days, [key, position], "left")
