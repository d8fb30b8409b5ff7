"""A training-data pipeline over documents: quality, near duplicates, secrets, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm import mixing, near_dedup, pieces, quality_gam, secrets
from larkmill.llm.base import documents, labels, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.5 or more); it learns from those of docs that have labels."""
    return quality_gam.accepted(docs, quality_gam.train(docs, labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, likeness of 0.8 or more."""
    return near_dedup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redacted(docs, secrets.train(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them, twice at most."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32, with begin and end) of each document."""
    return pieces.encode(docs).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixture", mixture), ("token_ids", token_ids)]

#: No SQL expresses the trained stages. Tests hold each stage's rows, on small tables, against its operator's own scores, links and
#: copies, which other tests hold against brute force, held-out labels, planted secrets and the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet and read again as the next one's."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
