"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir), calls one operator on all that the stage before it kept, and returns a
DataFrame; run() writes each stage's result as Parquet in the shared folder and reads it back for the next one.
All stages but the last return the columns of documents. Rows with a null doc_id go through every stage; see the
operators for what they do with empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import mixing, ngram, packing, quality, scratch, substring


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity of 0.8 or more."""
    return ngram.one_of_each(docs, 5, 80)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that are in a document with a smaller doc_id are cut from the texts."""
    return _counted(substring.remove_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a row for each draw of a text or part of it."""
    return _counted(mixing.mixed(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in token-budget batches inside length buckets."""
    return packing.packed(docs)


STAGES = [("quality", good_quality), ("near_copies", near_unique), ("substrings", no_repeats), ("mixing", mix), ("packing", pack)]

#: SQL cannot express the stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return scratch.save(STAGES[-1][1](spark, docs, sf_dir))


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
