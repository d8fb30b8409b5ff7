"""The log of a stream: Parquet files of (offset, payload, ts) with dense offsets, one writer at a time."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkmill.sources import files

SCHEMA = "offset long, payload string, ts timestamp"


def log_path(root: str, stream: str) -> str:
    return f"{root}/_streams/{stream}"


def read(spark: SparkSession, root: str, stream: str) -> DataFrame:
    path = log_path(root, stream)
    if not files.exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def append_values(spark: SparkSession, root: str, stream: str, first: int, payloads: list[str]) -> int:
    """The next offset. first: that of the first payload."""
    if payloads:
        now = datetime.now(UTC)
        rows = [(first + i, p, now) for i, p in enumerate(payloads)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log_path(root, stream))
    return first + len(payloads)


def append_frame(df: DataFrame, root: str, stream: str, first: int, order: list[str]) -> int:
    """Appends column payload of df, in the order given (none: as its partitions come). Offsets come from each range's rank and the sizes of the ranges before it, so
    that no task sees more than its own range."""
    spark = df.sparkSession
    staged = f"{log_path(root, stream)}-staged"
    (df.orderBy(*order) if order else df).withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, at = {}, first
    for p in sorted(sizes):
        starts[p], at = at, at + sizes[p]
    if sizes:
        begins = spark.createDataFrame(sorted(starts.items()), "part int, start long")
        rank = F.row_number().over(W.partitionBy("part").orderBy("within"))
        made = rows.join(F.broadcast(begins), "part").select((F.col("start") + rank - 1).alias("offset"), "payload", F.current_timestamp().alias("ts"))
        made.write.mode("append").parquet(log_path(root, stream))
    files.delete(spark, staged)
    return at


def take(spark: SparkSession, root: str, stream: str, start: int, limit: int) -> list[tuple[int, str]]:
    """Offsets are dense, so the rows are found by their offsets, which reach the scan."""
    found = read(spark, root, stream).where((F.col("offset") >= start) & (F.col("offset") < start + limit)).select("offset", "payload").collect()
    return sorted((r.offset, r.payload) for r in found)


def purge(spark: SparkSession, root: str, stream: str, days: int, now: datetime) -> None:
    """Drops events that are older than days."""
    path = log_path(root, stream)
    if files.exists(spark, path):
        kept = f"{path}-kept"
        read(spark, root, stream).where(F.col("ts") >= F.lit(now) - F.make_dt_interval(days=F.lit(days))).write.mode("overwrite").parquet(kept)
        files.delete(spark, path)
        files.rename(spark, kept, path)


def read_stream(spark: SparkSession, root: str, stream: str, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a streaming frame."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(log_path(root, stream))


def windowed_counts(events: DataFrame, window: str, late: str, ts: str = "ts", *keys: str, slide: str | None = None) -> DataFrame:
    """Events in each window and key, with a watermark: works on streaming and plain frames. slide: from one window's start to the next
    (None: windows follow each other without overlap). Rows without a time are in no window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), *keys).agg(F.count("*").alias("events"))


def session_counts(events: DataFrame, gap: str, late: str, ts: str = "ts", *keys: str) -> DataFrame:
    """Events in each session of a key, with a watermark: a session ends when its key has no event for gap; its end is the last event's
    time and gap. Works on streaming and plain frames."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("events"))
