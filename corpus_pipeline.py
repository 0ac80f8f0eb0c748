"""A training-data pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, packing.

Each stage is written as Parquet to the shared folder and read again as the next one's documents. No SQL
states it (hash-ordered draws and best fit); tests hold it against a plain version.

Defined results, in every stage: columns other than doc_id, text, source and lang go along, whatever their names, and null
values in them stay; null and empty texts fail the quality rules and go there; very long texts are read whole; ties
go to the smaller id; repeated rows of one document id count as one document and stay or go together until the mix,
which takes each; rows with a null id link with nothing; an empty table gives empty stages and no bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import discard, materialise, read
from docketry.llm.mixing import mixed_documents
from docketry.llm.ngram_join import ngram_join
from docketry.llm.packing import pack
from docketry.llm.quality_rules import quality_rules
from docketry.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    renamed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))
    return quality_rules(renamed, keep=("row",)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest id stays."""
    gone = ngram_join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some twice, some cut, some not at all."""
    return mixed_documents(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and offset of each piece of each document of the mix."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("packing", bins)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
