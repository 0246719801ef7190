"""What the corpus operators share: the shared folder, written intermediate tables, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and \\t \\n \\v \\f \\r (what bytes.split() splits on).
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master only, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def hash_limit(share: float) -> int:
    """The largest of the first ``share`` of all signed 64-bit hashes; never below the first one."""
    return min((1 << 63) - 1, max(1, int(share * (1 << 64))) - (1 << 63) - 1)


def hash_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the first ``share`` of all its values; fine enough for any row count."""
    return h <= F.lit(hash_limit(share)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few hundred rows, so that a task's Python objects stay small; unused Arrow memory goes back after each batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()
