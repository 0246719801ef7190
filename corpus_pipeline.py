"""The corpus pipeline: documents pass toxicity, exact and near deduplication and decontamination, and leave as tokens.

Every stage but the last returns the columns of its input, whatever else they hold or are called.
Null texts and ids are rows like others: a null text counts as empty, so one such row stays; of
repeated rows one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, exact_dedup, jaccard_join, sentencepiece_codec, toxicity
from gridloom.llm.common import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.3."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row key, written once so that the key is the same wherever it is read, and the key's name, which no column has."""
    names, key = {c.lower() for c in docs.columns}, "_row"
    while key in names:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    rows, key = _numbered(docs)
    kept = exact_dedup.exact_dedup(rows, row_col=key).where("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest doc_id; wordless documents stay."""
    rows, key = _numbered(docs)
    linked = materialize(jaccard_join.ngram_jaccard_join(rows, row_col=key), "linked-rows")
    first = linked.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col(key).alias("r"))).alias("x"))
    kept = first.select(F.col("x.r").alias(key)).unionByName(linked.where("class_key is null").select(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its words as edits."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of the whole text."""
    return sentencepiece_codec.encode(docs, ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL can't express the learnt stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
