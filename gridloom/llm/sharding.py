"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, text_or_empty

#: A prime below 2**31: all products of the round function stay below 2**62.
_P = 2147483647


def _round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    x, keys = seed % _P, []
    for _ in range(rounds):
        a = x = (x * 48271 + 11) % _P
        b = x = (x * 48271 + 11) % _P
        keys.append((a, 1 + b % (_P - 1)))
    return keys


def _shifted(value: Column, other: Column, k: Column, m: Column, size: Column) -> Column:
    """(value + keyed function of other) mod size."""
    t = (other + k) % _P
    return (value + ((t * t) % _P * m + other) % _P) % size


def permute(df: DataFrame, x: str, out: str, seed: int, rounds: int = 6) -> DataFrame:
    """Column ``out``: the Feistel permutation of 0 .. _a*_b-1 applied to ``x``; left half below _a, right half below _b, alternately shifted by a keyed function of the other."""
    df = df.withColumns({"_l": F.floor(F.col(x) / F.col("_b")).cast("long"), "_r": F.col(x) % F.col("_b")})
    for i, (k, m) in enumerate(_round_keys(seed, rounds)):
        one, other, size = ("_l", "_r", "_a") if i % 2 == 0 else ("_r", "_l", "_b")
        df = df.withColumn(one, _shifted(F.col(one), F.col(other), F.lit(k), F.lit(m), F.col(size)))
    return df.withColumn(out, F.col("_l") * F.col("_b") + F.col("_r")).drop("_l", "_r")


def permute_value(x: Column, a: Column, b: Column, seed: int, rounds: int = 6) -> Column:
    """The same permutation as one expression, for use inside a loop over steps."""
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(m).cast("long").alias("m"), F.lit(i % 2 == 0).alias("left")) for i, (k, m) in enumerate(_round_keys(seed, rounds))])
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["left"], _shifted(s["l"], s["r"], k["k"], k["m"], a)).otherwise(s["l"])
        right = F.when(k["left"], s["r"]).otherwise(_shifted(s["r"], s["l"], k["k"], k["m"], b))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])


def numbered_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1 << 20) -> DataFrame:
    """(doc_id, size, text_crc32, _x, _total): the global number of each row, in the order of (hash bucket, id, checksum, size).

    Equal rows are counted first, and that table, without text, is written once. Buckets hold about
    ``bucket_rows`` rows each, so their number follows the input; a bucket is numbered by one window,
    and the rows before it come from a table of one row per bucket that has the same partitioning.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)).cast("long") + 16).alias("size"),
        F.crc32(text_or_empty(text_col)).alias("text_crc32"),
    )
    same = materialize(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")), "rows")
    total = same.agg(F.sum("_n")).first()[0] or 0
    n_buckets = max(64, -(-total // bucket_rows))
    same = same.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = same.groupBy("_bucket").agg(F.sum("_n").alias("_rows")).select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = same.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets.hint("merge"), "_bucket")
    run = 65536
    numbered = numbered.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(run).cast("long"))))
    numbered = numbered.withColumn("_i", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + run, F.col("_n")) - 1)))
    return numbered.select("doc_id", "size", "text_crc32", (F.col("_offset") + F.col("_before") + F.col("_i")).alias("_x"), F.lit(total).cast("long").alias("_total"))


def walk(grid: DataFrame, seed: int, steps: int = 3) -> DataFrame:
    """Column ``_p``: _y while it is below _total, else the next value below it along the permutation's cycle.

    About one row in sqrt(total) has to walk, and of those again one in sqrt(total) a second step;
    the first ``steps`` are single steps, the loop, at most _a * _b - _total long, is for what is
    left after them.
    """
    a, b, total = F.col("_a"), F.col("_b"), F.col("_total")
    grid = grid.withColumn("_p", F.col("_y"))
    for _ in range(steps):
        grid = grid.withColumn("_p", F.when(F.col("_p") < total, F.col("_p")).otherwise(permute_value(F.col("_p"), a, b, seed)))
    rest = F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - total), F.col("_p"), lambda y, _: F.when(y < total, y).otherwise(permute_value(y, a, b, seed)))
    return grid.withColumn("_p", F.when(F.col("_p") < total, F.col("_p")).otherwise(rest))


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 20260101, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1 << 20) -> DataFrame:
    """Shard and slot of each row: position Feistel(row number), shard = position mod n, slot = position div n.

    The global row number depends on the rows alone, not on files or partitions (``numbered_rows``).
    Shard sizes differ by at most one row and slots have no gaps (law ``rows``). The permutation acts
    on 0 .. a*b-1, the least such grid over the row count; a position past the count walks on along
    its cycle (``walk``).

    Only (id, size, checksum) is shuffled, never text. Equal rows are counted before the shuffle and
    expanded at the end, in runs of 65,536, so a hot row is no hot task. Nothing is broadcast.

    Null text has size 16 and checksum 0, a null id is a value like any other; repeated rows each get
    a position; an empty table gives an empty result. Other columns are not read.
    """
    rows = numbered_rows(docs, id_col, text_col, bucket_rows)
    a = F.greatest(F.ceil(F.sqrt(F.col("_total").cast("double"))).cast("long"), F.lit(1))
    grid = rows.withColumns({"_a": a, "_b": F.ceil(F.col("_total") / a).cast("long")})
    return walk(permute(grid, "_x", "_y", seed), seed).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
