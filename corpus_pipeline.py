"""A training-data pipeline over `documents`: language, near duplicates, repeated passages, benchmark items, packing.

Every stage gets the rows that its predecessor kept, written as Parquet and read
again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, language, near_duplicates, packing, substrings
from lectern.llm.batches import numbered, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that has at least 0.4 of their words go, so do null texts; copies and rows without id are judged like any other."""
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class stays; null and empty texts are one class."""
    return near_duplicates.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become their kept words; documents of which nothing is left go. Null and empty texts lose nothing and stay, null ids too."""
    plain, (key, text) = numbered(docs, "doc_id", "text")  # so that columns named like the operator's stay what they are
    out = substrings.drop_repeated_passages(plain, key, text)
    left = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text))
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn(text, left)
    if "n_chars" in docs.columns:
        kept = kept.withColumn(numbered(docs, "n_chars")[1][0], F.length(text).cast("long"))
    return kept.select(plain.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of five words or more, up to a tenth of its words changed, go; null and empty texts stay."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row for each piece of a document; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("repeated-passage removal", drop_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Encoding, the language model and the samples can't be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
