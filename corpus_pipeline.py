"""A training corpus in five stages: toxic and poor documents go, repeated lines go, one document of each group of near copies stays, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on what the stage before kept, as it was written; all but the last return the columns of
documents, whose n_chars follows the text. Columns beyond those are carried along, whatever their names. Labels are read from the same
folder as the documents.

A verdict holds for a row: rows that share an id, or have none, are judged one by one by their texts, however long these are. Nulls and
empty texts pass the first stage and fail the second (they have no words). Of near copies the one with the least id stays, rows without
an id coming last; of rows with one id and one text, one stays. Empty tables stay empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard_join, line_dedup, packing, quality, toxicity
from factloom.session import importable, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return toxicity.drop_toxic(docs, quality.labels_table(spark, sf_dir))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.drop_poor(docs, quality.fit(docs, quality.labels_table(spark, sf_dir)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    cleaned = line_dedup.dedup_lines(docs, counts=False)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents without words are in no group."""
    importable(spark)
    return jaccard_join.first_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    importable(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES = [("toxicity", reject_toxic), ("quality rules", reject_poor), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("best-fit packing", pack)]

#: Models and packing plans are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
