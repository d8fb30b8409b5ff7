"""Files: CSV, Parquet, and backups of tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkmill.sources import files


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With a header; cells that do not fit their type are null."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "error") -> None:
    """compression: zstd, lz4, snappy or none."""
    df.write.mode(mode).option("compression", compression).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def backup(df: DataFrame, folder: str, name: str) -> None:
    """Rows as Parquet and, once they are complete, what they are as JSON."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}/rows")
    files.write_text(df.sparkSession, f"{folder}/{name}/info.json", json.dumps({"name": name, "schema": json.loads(df.schema.json())}))


def restore(spark: SparkSession, folder: str, name: str) -> DataFrame:
    info = json.loads(files.read_text(spark, f"{folder}/{name}/info.json") or "null")
    if info is None:
        raise FileNotFoundError(f"{folder}/{name} holds no backup")
    return spark.read.schema(T.StructType.fromJson(info["schema"])).parquet(f"{folder}/{name}/rows")


def backups(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in files.listed(spark, folder) if files.exists(spark, f"{folder}/{n}/info.json")]


def remove_backup(spark: SparkSession, folder: str, name: str) -> None:
    files.delete(spark, f"{folder}/{name}")
