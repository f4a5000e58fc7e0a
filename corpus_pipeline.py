"""The training-data pipeline: five stages from documents to shards.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of their input, whatever these are and however they are named. Rows are
documents: rows that share an id, or have none, are told apart by their texts.
Every stage gives an empty table for an empty one. Texts are read whole.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from newsflow.operators.staging import Staging


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy of the rule ledger keeps.

    Null, empty and short texts fail the rule on length. Rows are judged one by
    one, so repeated rows stay or go together.
    """
    return quality_rules.accepted(docs, quality_rules.STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets overlap by 0.8: that with the smallest id.

    A null id counts as the largest. Of rows with the smallest id that with the
    smallest hash of all columns stays; rows equal in all columns are one.
    Documents without words stay.
    """
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none; without items all documents stay. Equal
    rows stay or go together.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is two rows.

    A null source is a source of its own, last in order. Documents that share
    an id are taken or left together, those without one by their text. Of a
    source without words all documents stay, as they cost nothing.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, linked) of every row.

    A null text has size 8 and is linked with nothing; equal texts are linked,
    and repeated rows are rows of their own.
    """
    return sharding.into_shards(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Sharding and the order of label moves cannot be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    staging = Staging(spark)
    for name, stage in STAGES:
        docs = staging.table(stage(spark, docs, sf_dir), f"{name}-{uuid.uuid4().hex[:6]}")
    return docs
