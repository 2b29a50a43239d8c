"""The corpus pipeline: five stages, each a table that the next one reads.

quality classifier -> n-gram Jaccard join -> suffix-array dedup -> benchmark decontamination -> packing

Every stage takes all rows its predecessor kept and returns the columns of `documents`, except the last,
which returns the packed sequences. The first stage learns from the labels and the documents it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.llm import decontamination, jaccard, packing, quality, repeats
from postmatch.llm.common import shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard.one_per_component(docs)


def unrepeated_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere; n_chars follows the text."""
    kept = repeats.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the texts that are left."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("jaccard_join", distinct_documents),
    ("suffix_array_dedup", unrepeated_texts),
    ("decontamination", uncontaminated_documents),
    ("best_fit_packing", packed_sequences),
]

#: The classifier and the packing have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
