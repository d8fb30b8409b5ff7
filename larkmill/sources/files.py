"""Small files through Hadoop's file systems, so that any store Spark reaches will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from larkmill.errors import CatalogProblem


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def own_folder(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/larkmill-engine-{uuid.uuid4().hex}"
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise CatalogProblem("Give the engine a folder, or set spark.checkpoint.dir to one that driver and executors share")
    return tempfile.mkdtemp(prefix="larkmill-engine-")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = _at(spark, old)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new))


def listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a second file that then takes the first one's place."""
    fs, p = _at(spark, f"{path}.new")
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    delete(spark, path)
    rename(spark, f"{path}.new", path)
