"""Experiment resolution and feature metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import feature_group, prettify
from gridloom.operators.joins import rule_lookup
from gridloom.operators.windows import first_of


class ConfigError(ValueError):
    """A configuration that can't be resolved."""


def chains(experiments: DataFrame, max_depth: int = 50) -> DataFrame:
    """Each experiment with its ancestors (experiment, ancestor, depth), itself at depth 0, by joins along ``base``.

    experiments: experiment, base. A chain that comes back to itself or is deeper than ``max_depth``
    raises ConfigError. Configuration-sized tables.
    """
    links = experiments.where("base is not null").select(F.col("experiment").alias("ancestor"), F.col("base").alias("_up"))
    level = experiments.select("experiment", F.col("experiment").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    for _ in range(max_depth):
        level = level.join(links, "ancestor").select("experiment", F.col("_up").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            return out
        if not level.where("experiment = ancestor").isEmpty():
            raise ConfigError("cycle in the base chain: " + ", ".join(r[0] for r in level.where("experiment = ancestor").select("experiment").distinct().limit(20).collect()))
        out = out.unionByName(level)
    raise ConfigError(f"base chain deeper than {max_depth}")


def resolve_features(experiments: DataFrame, tokens: DataFrame, meta: DataFrame, partitions: int | None = None) -> DataFrame:
    """(experiment, feature, position): (base or include) without exclude, along the chain, in metadata order.

    tokens: experiment, op (include_group, include_feature, exclude_group, exclude_feature), token;
    meta: feature, group, position. The nearest ancestor that names a feature decides; within one
    experiment exclusion wins. Everything after one exchange by feature stays in its task; chains go to all tasks.
    partitions: how many tasks share the features.
    """
    by_group = tokens.where("op like '%group'").join(meta.select("feature", F.col("group").alias("token")), "token").select("experiment", "op", "feature")
    by_name = tokens.where("op like '%feature'").select("experiment", "op", F.col("token").alias("feature"))
    every = by_group.unionByName(by_name)
    dealt = every.repartition(partitions, "feature") if partitions else every.repartition("feature")
    named = dealt.groupBy(F.col("experiment").alias("ancestor"), "feature").agg(F.max(F.col("op").startswith("exclude").cast("int")).alias("out"))
    along = named.join(F.broadcast(chains(experiments)), "ancestor")
    last = along.groupBy("experiment", "feature").agg(F.min_by("out", "depth").alias("out")).where("out = 0")
    return last.join(meta.select("feature", "position"), "feature").select("experiment", "feature", "position")


def config_problems(experiments: DataFrame, tokens: DataFrame, meta: DataFrame, resolved: DataFrame) -> DataFrame:
    """(experiment, problem, token) for unknown groups, features and bases, bases of another profile, and empty lists."""
    groups = meta.select(F.col("group").alias("token")).distinct()
    names = meta.select(F.col("feature").alias("token")).distinct()
    a = tokens.where("op like '%group'").join(groups, "token", "left_anti").select("experiment", F.lit("unknown group").alias("problem"), "token")
    b = tokens.where("op like '%feature'").join(names, "token", "left_anti").select("experiment", F.lit("unknown feature").alias("problem"), "token")
    bases = experiments.select(F.col("experiment").alias("base"), F.col("profile").alias("_profile"))
    up = experiments.where("base is not null").join(bases, "base", "left")
    c = up.where("_profile is null").select("experiment", F.lit("unknown base").alias("problem"), F.col("base").alias("token"))
    d = up.where("_profile <> profile").select("experiment", F.lit("base of another profile").alias("problem"), F.col("base").alias("token"))
    kept = resolved.select("experiment").distinct()  # few; all of an experiment's features would meet in one task
    e = experiments.join(kept, "experiment", "left_anti").select("experiment", F.lit("no features left").alias("problem"), F.lit(None).cast("string").alias("token"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def merged_settings(experiments: DataFrame, settings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Setting of each experiment: own value, else the global one (experiment null), else the default."""
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("_default")) for k, v in defaults.items()])
    every = experiments.select("experiment", F.inline(keys))
    own = settings.where("experiment is not null").select("experiment", "key", F.col("value").alias("_own"))
    shared = settings.where("experiment is null").select("key", F.col("value").alias("_global"))
    return every.join(own, ["experiment", "key"], "left").join(shared, "key", "left").select("experiment", "key", F.coalesce("_own", "_global", "_default").alias("value"))


def hull_notes(resolved: DataFrame, meta: DataFrame, hull: DataFrame) -> DataFrame:
    """Natural end of the used features and whether the hull's end is a cap or beyond it. meta: feature, time_end; hull: experiment, time_end."""
    natural = resolved.join(meta.select("feature", F.col("time_end").alias("_e")), "feature").groupBy("experiment").agg(F.min("_e").alias("natural_end"))
    note = F.when(F.col("natural_end").isNull(), "no end").when(F.col("time_end") < F.col("natural_end"), "cap").when(F.col("time_end") > F.col("natural_end"), "beyond").otherwise("natural")
    return hull.join(natural, "experiment", "left").withColumn("note", note)


def leakage(resolved: DataFrame, meta: DataFrame, spatial: DataFrame, fold_group: str) -> DataFrame:
    """Features of spatial experiments that carry the fold dimension itself."""
    return resolved.join(spatial.select("experiment"), "experiment", "left_semi").join(meta.where(F.col("group") == fold_group).select("feature"), "feature", "left_semi").select("experiment", "feature")


def feature_metadata(headers: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per column with label, group and group settings. headers: column, position; rules as in rule_lookup; groups: group and settings."""
    once = first_of(headers, ["column"], [F.col("position")])
    named = rule_lookup(once, rules).withColumn("group", feature_group(F.col("column")))
    return named.withColumn("label", F.coalesce("label", prettify(F.element_at(F.split("column", "__"), -1)))).join(groups, "group", "left")


def in_metadata_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positions renumbered without gaps."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("position")))
