"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.llm import decontam, language_id, neardup, pieces, pii
from finlark.llm.common import delete, shared_folder, table
from finlark.llm.queries import model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go: no letters, or two languages within the margin."""
    return language_id.classify(docs, language_id.fit(docs)).where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id; groups are linked at a likeness of 0.8.

    Where a doc_id repeats, its rows go only if none of them would stay.
    """
    out = neardup.groups(docs, percent=80).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).where("not _kept").select("_gone")
    return docs.join(out, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.search(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as piece ids, beside the columns of documents."""
    return pieces.encode(docs, model_path()).select(*COLUMNS, "ids", "n_tokens")


STAGES = [("language_id", languages), ("near_dedup", near_duplicates), ("decontamination", benchmark_leaks), ("pii", personal_data), ("sentencepiece", token_ids)]

# Compression, boosted trees and the transducer have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read from there, and goes once the next one is written."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    top = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}_{name}")
        docs = spark.read.parquet(f"{top}/{k}_{name}")
        if k:
            delete(spark, f"{top}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
