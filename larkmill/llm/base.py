"""What the operators of this subpackage share: words, batches, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: blank and x09-x0D, the white space of bytes.split().
SPACE = " \t\n\x0b\f\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []
_tables: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="larkmill-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage; its shuffle files go once it is written.

    The table stays until release(): frames that were derived from it are read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkmill-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """df as a table in the shared folder, dealt by the column by: tables of as many buckets are joined and grouped by it without a shuffle. For rows of large binaries: no dictionaries."""
    spark = df.sparkSession
    path, table = f"{shared_dir(spark)}/larkmill-{uuid.uuid4().hex}/{name}", f"larkmill_{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format("parquet").option("path", path).option("compression", "zstd").option("parquet.enable.dictionary", "false").bucketBy(buckets, by).saveAsTable(table)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _written.append(path)
    _tables[path] = table
    return spark.table(table)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, plans hand batches of that many rows at most to Python: for columns of large binaries."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_written(df: DataFrame) -> None:
    """Deletes the table that written() returned as df, when nothing reads it any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        for path in [p for p in _written if f.split(":", 1)[-1].lstrip("/") == p.split(":", 1)[-1].lstrip("/")]:
            _delete(df.sparkSession, path)
            _written.remove(path)


def release(spark: SparkSession) -> None:
    """Deletes every table that written() made in this session; frames that read them are dead afterwards."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(name: str, df: DataFrame) -> str:
    """name, with underscores before it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Sub-batches of about max_bytes (small enough for a processor's cache to hold what is made of them) of the column at index text (one row at least), with its values as bytes, null as b""."""
    for batch in batches:
        col = batch.column(text).cast(pa.large_binary())
        if not len(col):
            continue
        size = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(size, size[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, end - at), [x or b"" for x in col.slice(at, end - at).to_pylist()]
            at = end


def words_column(text: Column) -> Column:
    """array<string> of the words of text; null text gives no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+", -1))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, mod: int, value: int) -> Column:
    """crc32 of doc_id as text, modulo mod, is value; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == value
