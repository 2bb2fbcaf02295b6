"""The corpus pipeline: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, what
the stage before kept. All but the last return the columns of documents. A
stage's result is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm import exact_dedup, mixing, near_dup, packing, quality
from corroba.llm.common import SPACE, free_name, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go.

    Null and empty texts are scored like any others, repeated rows and ties fare
    alike, an empty table stays empty, extra columns pass whatever their names.
    """
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), keep_rows=True)
    verdict = scored.columns[-1]
    return scored.where(F.col(verdict) == 1).drop(verdict)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the rows with the smallest id stay.

    Rows are dropped by id and text, so that another text of the same id stays;
    rows that repeat id and text stay together. An empty table stays empty.
    """
    gone = exact_dedup.exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), 256)
    own = free_name(docs, "own")
    rows = docs.withColumn(own, sha)
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows[own] == gone["__sha"]), "left_anti").drop(own)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays.

    Rows go by id and text, so that another text of the same id stays; rows that
    repeat id and text stay together. Null and empty texts link with nothing. An
    empty table stays empty, extra columns pass whatever their names.
    """
    gone = near_dup.near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own = free_name(docs, "own")
    rows = docs.withColumn(own, near_dup.text_hash("text"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows[own] == gone["__hash"]), "left_anti").drop(own)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages get the square root of their share of tokens; with the floor of 1 documents are repeated and none is lost.

    A null language is unlabelled, a null text has no tokens, ties have equal
    rates. An empty table stays empty, extra columns pass whatever their names.
    """
    return mixing.mix(docs, floor=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row a piece; null and empty texts are the end id alone, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack_best_fit(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models and byte-pair encodings are beyond SQL; tests/llm/test_pipeline.py checks every stage on its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
