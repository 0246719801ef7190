"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CLASS, materialize, text_or_empty

#: Bytes of the first radix digit; each later digit is FACTOR times as wide.
FIRST, FACTOR = 48, 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: keep_id, group_size, kept and the SHA-256 of the normalised text[, row_col].

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]. The sort key of a text is its
    byte length followed by its bytes. Each round splits every open group by the next digit (48
    bytes, then 32 times as many each round); a group closes when it has one member or all its bytes
    were read. Equality is decided by the bytes alone; the digest is output. Closed rows drop their
    text, so later rounds carry only rows that still share everything read so far. Groups are
    counted with map-side combining and their size is joined back, so a hot group is split by the
    skew join and never gathered in one task. Rounds grow with the logarithm of the longest text.

    Of equal texts the row with the most code points stays, then the smallest id (null last), then
    any one of identical rows. Null text counts as empty; an empty table gives an empty result.
    Other columns are not read; ``row_col`` names a unique row key (long) to pass on.
    """
    norm = F.regexp_replace(text_or_empty(text_col), SPACE_CLASS + "+", "")
    base = (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.length(text_or_empty(text_col)).alias("_points"),
            norm.alias("_norm"),
            (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("_uid"),
        )
        .withColumn("text_sha256", F.sha2("_norm", 256))
        .withColumn("_bytes", F.col("_norm").cast("binary"))
        .withColumn("_len", F.octet_length("_norm"))
        .withColumn("_digit", F.substring("_bytes", 1, FIRST))
    )
    rest = F.expr(f"substring(_bytes, {FIRST + 1})")
    first_keys = (
        docs.select(norm.alias("_norm"))
        .select(F.octet_length("_norm").alias("_len"), F.substring(F.col("_norm").cast("binary"), 1, FIRST).alias("_digit"))
        .groupBy("_len", "_digit")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    done_cols = ["doc_id", "_uid", "text_sha256", "_best", "_n"]
    rank = F.struct((-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_uid").alias("u"))
    split = base.join(first_keys.hint("shuffle_hash"), ["_len", "_digit"], "left")
    state = materialize(
        split.select(
            "doc_id", "_uid", "_points", "text_sha256", "_len",
            F.col("_n").isNotNull().alias("_open"),
            F.when(F.col("_n").isNotNull(), F.col("_digit")).alias("_group"),
            F.when(F.col("_n").isNotNull(), rest).alias("_rest"),
        ),
        "radix",
    )
    closed = [state.where(~F.col("_open")).select("doc_id", "_uid", "text_sha256", rank.alias("_best"), F.lit(1).cast("long").alias("_n"))]
    live, consumed, width = state.where("_open"), FIRST, FIRST
    keys = ["_len", "_group", "_next"]
    while True:
        width *= FACTOR
        step = live.withColumn("_next", F.substring("_rest", 1, width))
        groups = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_best"))
        joined = step.join(groups.hint("shuffle_hash"), keys)
        consumed += width
        done = (F.col("_n") == 1) | (F.col("_len") <= consumed)
        state = materialize(
            joined.select(
                "doc_id", "_uid", "_points", "text_sha256", "_len", "_best", "_n", (~done).alias("_open"),
                F.when(~done, F.col("_best.u").cast("string").cast("binary")).alias("_group"),
                F.when(~done, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
            ),
            "radix",
        )
        closed.append(state.where(~F.col("_open")).select(*done_cols))
        live = state.where("_open").drop("_best", "_n")
        if live.isEmpty():
            break
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out.select(
        "doc_id",
        F.col("_best.d").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_uid") == F.col("_best.u")).alias("kept"),
        "text_sha256",
        *([F.col("_uid").alias(row_col)] if row_col else []),
    )
