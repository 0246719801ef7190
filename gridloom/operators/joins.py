"""Joins of stations, series, zones, polygons and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.windows import value_positions

#: Most products that become columns.
MAX_PRODUCTS = 1000


def on_spine(spine: DataFrame, features: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Features at the spine's keys, null outside their coverage."""
    return reduce(lambda a, b: a.join(b, keys or ["station_id", "time"], "left"), features, spine)


def with_static(series: DataFrame, static: DataFrame, key: str = "station_id") -> DataFrame:
    """Static columns on every row of the series."""
    return series.join(static, key)


def kept_keys(keys: DataFrame, allowed: dict[str, DataFrame], key: str = "station_id") -> DataFrame:
    """Each key with the first reason it is dropped for, null when kept; reasons in the order given."""
    out, reason = keys.select(key).distinct(), F.lit(None).cast("string")
    for name in reversed(list(allowed)):
        out = out.join(allowed[name].select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
        reason = F.when(F.col(f"_{name}").isNull(), name).otherwise(reason)
    return out.select(key, reason.alias("dropped_for"))


def drop_counts(kept: DataFrame) -> DataFrame:
    """Keys per reason."""
    return kept.groupBy(F.coalesce("dropped_for", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def polygon_edges(polygons: DataFrame, ring: str = "ring", key: str = "poly_id") -> DataFrame:
    """Edges (x1, y1, x2, y2) of rings of points {x, y}; the ring closes on its first point."""
    after = F.concat(F.slice(F.col(ring), 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(F.col(ring), 1, 1))
    e = polygons.select(key, F.explode(F.arrays_zip(F.col(ring).alias("p"), after.alias("q"))).alias("e"))
    return e.select(key, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def polygons_of(points: DataFrame, keys: list[str], polygons: DataFrame, bucket: float = 1.0, first: Column | None = None) -> DataFrame:
    """(keys, _px, _py, poly_id) of the points (keys, _px, _py; once each) that lie in a polygon: the one with the least id, or the largest ``first``.

    Points meet polygons through an equality join on buckets of the bounding boxes, and the edges of
    those polygons through the same bucket of rows, so no ring travels whole. The crossing number is
    a sum over edges; a point on an edge counts as inside. Points that come partitioned by some of the keys are not shuffled again
    where the polygons are sent to all tasks.
    """
    b = F.lit(float(bucket))
    ring = F.col("ring")
    # rings are told apart by their polygon and 128 bits of their points
    polygons = polygons.withColumn("_ring", F.struct("poly_id", F.md5(F.to_json("ring")).alias("points"))).dropDuplicates(["_ring"])
    box = polygons.withColumns({"_x0": F.array_min(F.transform(ring, lambda p: p["x"])), "_x1": F.array_max(F.transform(ring, lambda p: p["x"])), "_y0": F.array_min(F.transform(ring, lambda p: p["y"])), "_y1": F.array_max(F.transform(ring, lambda p: p["y"]))})
    box = box.select("poly_id", "_ring", "_x0", "_x1", "_y0", "_y1", (first if first is not None else F.col("poly_id")).alias("_order"))
    cells = box.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("_x0") / b), F.floor(F.col("_x1") / b)))).withColumn("_by", F.explode(F.sequence(F.floor(F.col("_y0") / b), F.floor(F.col("_y1") / b))))
    p = points.withColumns({"_bx": F.floor(F.col("_px") / b), "_by": F.floor(F.col("_py") / b)})
    near = p.join(cells, ["_bx", "_by"]).where("_px between _x0 and _x1 and _py between _y0 and _y1").select(*keys, "_px", "_py", "_by", "poly_id", "_ring", "_order")
    edges = polygon_edges(polygons, key="_ring")
    edges = edges.withColumn("_by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / b), F.floor(F.greatest("y1", "y2") / b))))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("_px", "_py", "x1", "y1", "x2", "y2"))
    turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on = (turn == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    hit = ((y1 > y) != (y2 > y)) & ((turn > 0) == (y2 > y1))
    met = near.join(edges, ["_ring", "_by"]).groupBy(*keys, "_px", "_py", "_ring", "poly_id", "_order").agg(F.count_if(hit).alias("n"), F.max(on).alias("on"))
    inside = met.where((F.col("n") % 2 == 1) | F.col("on"))
    return inside.groupBy(*keys, "_px", "_py").agg(F.min("poly_id").alias("poly_id") if first is None else F.max_by("poly_id", "_order").alias("poly_id"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, bucket: float = 1.0, key: str = "station_id", first: Column | None = None) -> DataFrame:
    """Points with the poly_id they lie in (least id on ties, or by ``first``), null outside."""
    p = points.select(key, F.col("lon").alias("_px"), F.col("lat").alias("_py")).where("_px is not null and _py is not null").distinct()
    # rows of one key may be different points
    match = polygons_of(p, [key], polygons, bucket, first).withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("lon") == F.col("_px")) & (F.col("lat") == F.col("_py"))
    return points.join(match, same, "left").drop("_key", "_px", "_py")


def nearest_index(value: Column, origin: float, step: float, size: int | Column) -> Column:
    """Index of the nearest coordinate of a regular axis; on ties the lower coordinate value."""
    t = (value - F.lit(float(origin))) / F.lit(float(step))
    # step > 0: ties to the smaller index; step < 0: ties to the larger index, which is the lower coordinate
    i = F.ceil(t - 0.5) if step > 0 else F.floor(t + 0.5)
    last = size - 1 if isinstance(size, Column) else F.lit(size - 1)
    return F.greatest(F.lit(0), F.least(last, i)).cast("int")


def nearest_on_axis(points: DataFrame, column: str, axis: DataFrame, out: str, width: float) -> DataFrame:
    """J5 for irregular axes (idx, coord): half-open intervals between midpoints, met through buckets of ``width``."""
    place = value_positions(axis.select("coord", "idx"), "coord", [])
    order = axis.join(place.select("coord", F.col("_before").alias("_i")), "coord")
    after = order.select((F.col("_i") - 1).alias("_i"), F.col("coord").alias("_next"))
    before = order.select((F.col("_i") + 1).alias("_i"), F.col("coord").alias("_last"))
    axis = order.join(after, "_i", "left").join(before, "_i", "left")
    lo, hi = (F.col("coord") + F.col("_last")) / 2, (F.col("coord") + F.col("_next")) / 2
    span = points.agg(F.min(column).alias("_a"), F.max(column).alias("_z"))
    cells = axis.withColumns({"_lo": lo, "_hi": hi}).join(F.broadcast(span))
    first, last = F.greatest(F.coalesce("_lo", "_a"), F.col("_a")), F.least(F.coalesce("_hi", "_z"), F.col("_z"))
    cells = cells.where(first <= last).withColumn("_b", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))
    keyed = points.withColumn("_b", F.floor(F.col(column) / width))
    met = keyed.join(cells.select("_b", "_lo", "_hi", F.col("idx").alias(out)), "_b", "left")
    # a point on a midpoint belongs to the lower coordinate
    return met.where(F.col(out).isNull() | ((F.col("_lo").isNull() | (F.col(column) > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(column) <= F.col("_hi"))))).drop("_b", "_lo", "_hi")


def basin_attributes(stations: DataFrame, basins: DataFrame, diagnostics: DataFrame, key: str = "zone_id") -> DataFrame:
    """Attributes once per zone and one diagnostic column per product, that of the product's first time step."""
    once = basins.dropDuplicates([key])
    first = diagnostics.groupBy(key, "product").agg(F.min_by("coverage", "time").alias("coverage"))
    products = [r[0] for r in diagnostics.select("product").distinct().orderBy("product").limit(MAX_PRODUCTS + 1).collect()]
    if len(products) > MAX_PRODUCTS:
        raise ValueError(f"more than {MAX_PRODUCTS} products would become columns")
    wide = first.groupBy(key).pivot("product", products).agg(F.first("coverage"))
    wide = wide.withColumnsRenamed({p: f"{p}__coverage" for p in products})
    return stations.join(once, key, "left").join(wide, key, "left")


def attach_once(df: DataFrame, attributes: DataFrame, key: str, order: list) -> DataFrame:
    """Left join of attributes with one row per key, first in the given order."""
    one = attributes.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
    return df.join(one, key, "left")


def merge_on_axes(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Variables of several datasets on shared cell indexes, cells of any of them kept."""
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def scores_side_by_side(scores: DataFrame, experiments: list[str], value: str = "score", key: str = "station_id") -> DataFrame:
    """One column per experiment; stations of any experiment."""
    return scores.groupBy(key).pivot("experiment", experiments).agg(F.first(value))


def complete_cases(scores: DataFrame, n_experiments: int, value: str = "score", key: str = "station_id") -> DataFrame:
    """Rows of stations that have a value in every experiment."""
    full = scores.where(F.col(value).isNotNull()).groupBy(key).agg(F.count_distinct("experiment").alias("_n")).where(F.col("_n") == n_experiments)
    return scores.join(full.select(key), key, "left_semi")


def restrict(df: DataFrame, ids: DataFrame, key: str = "station_id") -> DataFrame:
    """J15."""
    return df.join(ids.select(key), key, "left_semi")


def rule_lookup(names: DataFrame, rules: DataFrame, name: str = "column") -> DataFrame:
    """The rule of each name: exact, else base (name starts with key and _; first in file order), else the longest prefix.

    Exact and base keys equal a prefix of the name at a known length, so the join is by equality on
    (match type, text) over the lengths that rules have; rules: match_type, key, position, label.
    """
    lengths = F.sequence(F.lit(1), F.length(name))
    probes = names.select(name, F.explode(lengths).alias("_n")).where(f"length(`{name}`) > 0")
    part = F.substring(F.col(name), F.lit(1), F.col("_n"))
    kind = F.array(
        F.when(F.col("_n") == F.length(name), F.lit("exact")),
        F.when(F.substring(F.col(name), F.col("_n") + 1, F.lit(1)) == "_", F.lit("base")),
        F.lit("prefix"),
    )
    probes = probes.select(name, part.alias("key"), F.explode(kind).alias("match_type")).where("match_type is not null")
    rank = F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "base", 1).otherwise(2)
    tie = F.when(F.col("match_type") == "prefix", -F.length("key")).otherwise(0)
    best = probes.join(rules, ["match_type", "key"]).withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(rank, tie, "position"))).where("_k = 1")
    return names.join(best.select(name, "match_type", "key", "label"), name, "left")


def same_core(levels: DataFrame, fine: int, coarse: int, tolerance: float = 0.05) -> DataFrame:
    """Zones that are one polygon at two levels: equal core id and areas within the tolerance."""
    a = levels.where(F.col("level") == fine).select("core_id", F.col("zone_id").alias("fine_id"), F.col("area").alias("fine_area"))
    b = levels.where(F.col("level") == coarse).select("core_id", F.col("zone_id").alias("coarse_id"), F.col("area").alias("coarse_area"))
    return a.join(b, "core_id").where(F.abs(F.col("fine_area") - F.col("coarse_area")) <= tolerance * F.greatest("fine_area", "coarse_area"))


def children_per_parent(parents: DataFrame, children: DataFrame, code: str, length: int) -> DataFrame:
    """Children whose code begins with the parent's."""
    n = children.groupBy(F.substring(F.col(code).cast("string"), 1, length).alias("_p")).agg(F.count(F.lit(1)).alias("n_children"))
    return parents.join(n, F.col(code).cast("string") == F.col("_p"), "left").drop("_p").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


#: Flow direction codes with their row and column steps (row 0 is north).
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def grid_neighbours(cells: DataFrame, row: str = "lat_idx", col: str = "lon_idx") -> DataFrame:
    """Each cell with its up to eight neighbours (columns n_<row>, n_<col>, direction)."""
    steps = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for d, (r, c) in D8.items()])
    out = cells.withColumn("_s", F.explode(steps)).select(row, col, F.col("_s.direction").alias("direction"), (F.col(row) + F.col("_s.dr")).alias(f"n_{row}"), (F.col(col) + F.col("_s.dc")).alias(f"n_{col}"))
    there = cells.select(F.col(row).alias(f"n_{row}"), F.col(col).alias(f"n_{col}"))
    return out.join(there, [f"n_{row}", f"n_{col}"], "left_semi")


def union_slices(slices: list[DataFrame], key: list[str]) -> DataFrame:
    """Union by name, missing columns null; of rows with one key the later slice's wins."""
    tagged = [s.withColumn("_order", F.lit(i)) for i, s in enumerate(slices)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_order")))).where("_k = 1").drop("_k", "_order")


def stack_layers(layers: dict[float, DataFrame], name: str = "depth") -> DataFrame:
    """Layers under one depth column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(float(d))) for d, df in layers.items()])


def membership_matrix(lists: DataFrame, experiments: list[str]) -> DataFrame:
    """U4: features by experiments, true where listed. lists: experiment, feature."""
    return lists.groupBy("feature").agg(*[F.max((F.col("experiment") == e).cast("int")).cast("boolean").alias(e) for e in experiments])


def overlap(a: DataFrame, b: DataFrame, everything: DataFrame, key: str = "station_id") -> DataFrame:
    """Stations in a only, b only, both and neither."""
    flags = everything.select(key).distinct().join(a.select(key).distinct().withColumn("_a", F.lit(1)), key, "left").join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "left")
    kind = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "a_only").when(F.col("_b").isNotNull(), "b_only").otherwise("neither")
    return flags.groupBy(kind.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def concat_folds(folds: list[DataFrame], key: str = "station_id") -> tuple[DataFrame, DataFrame]:
    """All folds' rows, and the stations that occur in more than one fold."""
    both = reduce(lambda a, b: a.unionByName(b), [f.withColumn("fold", F.lit(i)) for i, f in enumerate(folds)])
    twice = both.groupBy(key).agg(F.count_distinct("fold").alias("n_folds")).where("n_folds > 1")
    return both, twice


def concat_parts(parts: list[DataFrame]) -> DataFrame:
    """U7."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
