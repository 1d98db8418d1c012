"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, secret masking, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import line_dedup, near_dedup, packing, quality, secrets
from plumbline.llm.tokens import vocabulary
from plumbline.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; the others lose the lines that fail."""
    return quality.clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles go; so does a document with no line left."""
    return line_dedup.dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; every document stays."""
    return secrets.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; documents end with the vocabulary's end-of-text id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=49407)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("near-duplicate removal", near_dedup_stage),
    ("secret scan", secret_stage), ("packing", packing_stage)]

#: Similarity joins and tokenisation are not SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
