"""Media columns: PNG images in binary columns, read back with checksum tests and hashed by their low frequencies."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.llm.base import documents, slices, written

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of a payload image; payloads are padded with zeros to a positive multiple of it.
WIDTH = 64
#: Side of the reduced image, and of the block of low frequencies that makes the hash.
SIDE, LOW = 32, 8


class MediaError(ValueError):
    """Bytes that are no readable PNG: bad signature, chunk, checksum or size."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """samples: rows x columns of uint8, grey. Each row takes the filter (none, sub, up) with the least sum of absolute values."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    tried = np.stack([samples, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """lines: rows of a filter byte and samples; step: bytes in a pixel. Runs of rows with one of the first three filters go at once;
    what lies between the first and the last row with another filter goes by diagonals."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise MediaError("unknown filter")
    above = np.zeros(out.shape[1], np.uint8)
    hard = np.flatnonzero(kinds > 2)
    runs = kinds.copy()
    if len(hard):
        runs[hard[0] : hard[-1] + 1] = 3
    starts = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1, [len(runs)]]) if len(runs) else [0]
    for at, end in zip(starts[:-1], starts[1:], strict=True):
        kind, rows = runs[at], out[at:end]
        if kind == 1:
            for k in range(step):
                rows[:, k::step] = np.cumsum(rows[:, k::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            rows[0] += above
            np.cumsum(rows, axis=0, dtype=np.uint8, out=rows)
        elif kind == 3:
            rows[:] = _by_diagonals(kinds[at:end], rows, above, step)
        above = out[end - 1]
    return out


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """rows with any of the five filters undone. A pixel needs the ones to its left, above it and between them, so those of a diagonal
    go at once: in a table with a border, they are width apart. write_png makes no Average or Paeth rows; they come in foreign images."""
    height, width = len(rows), rows.shape[1] // step
    table = np.zeros((height + 1, width + 1, step), np.uint8)
    table[0, 1:], table[1:, 1:] = above.reshape(width, step), rows.reshape(height, width, step)
    flat = table.reshape(-1, step)
    for t in range(height + width - 1):
        low, high = max(0, t - width + 1), min(height - 1, t)
        at = low * width + width + t + 2
        end = at + (high - low) * width + 1
        left, up, corner = (flat[at - back : end - back : width].astype(np.int16) for back in (1, width + 1, width + 2))
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        flat[at:end:width] += np.choose(kinds[low : high + 1, None], [np.zeros_like(left), left, up, (left + up) >> 1, paeth]).astype(np.uint8)
    return table[1:, 1:].reshape(height, -1)


def read_png(data: bytes) -> np.ndarray:
    """rows x columns x channels of uint8. 8-bit images without palette or interlace; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut off")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != data[at + 8 + n : at + 12 + n]:
            raise MediaError("checksum")
        if kind == b"IHDR":
            if n != 13 or head is not None:
                raise MediaError("header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise MediaError("cut off")
    width, height, depth, colour, *rest = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or not channels or any(rest):
        raise MediaError("only 8-bit samples without palette and interlace")
    size = height * (width * channels + 1)
    unpacker = zlib.decompressobj()
    try:  # never more than the header says, whatever the stream holds
        raw = unpacker.decompress(b"".join(packed), size + 1)
    except zlib.error as e:
        raise MediaError("stream") from e
    if not width or not height or len(raw) != size or not unpacker.eof:
        raise MediaError("size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1)
    return unfilter(lines, channels).reshape(height, width, channels)


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


def _reduce(image: np.ndarray, side: int) -> np.ndarray:
    """Mean of side equal bands along the first axis; a sample on a border counts for each band by its share."""
    n = len(image)
    total = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0)])
    edges = np.arange(side + 1) * n / side
    low = np.minimum(edges.astype(int), n)
    at = total[low] + (edges - low)[:, None] * image[np.minimum(low, n - 1)]
    return np.diff(at, axis=0) * side / n


def frequency_hash(image: np.ndarray) -> str:
    """16 hex digits: for each of the 8 x 8 lowest cosine frequencies of the 32 x 32 image, whether it is over their median."""
    if not image.size:
        return "0" * 16
    grey = image.astype(np.float64).mean(axis=2)
    small = _reduce(_reduce(grey, SIDE).T, SIDE).T
    low = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_png(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 bytes and zeros up to a positive multiple of width, as an 8-bit grey PNG.

    Null text counts as empty: one row of zeros. Repeated rows are stored each; other columns are left out.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            made = [write_png(np.frombuffer(x.ljust(max(1, -(-len(x) // width)) * width, b"\0"), np.uint8).reshape(-1, width)) for x in texts]
            yield pa.record_batch([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(made, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with samples (the image's bytes, row by row) and feature (frequency_hash). Null or unreadable media give null for both."""
    schema = T.StructType([*df.schema.fields, T.StructField("samples", T.BinaryType()), T.StructField("feature", T.StringType())])
    at = df.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stored in slices(batches, at, 2 << 20):
            samples: list[bytes | None] = []
            found: list[str | None] = []
            for x in stored:
                try:
                    image = read_png(x)
                    samples.append(image.tobytes())
                    found.append(frequency_hash(image))
                except MediaError:
                    samples.append(None)
                    found.append(None)
            yield pa.record_batch([*part.columns, pa.array(samples, pa.binary()), pa.array(found, pa.string())], [*part.schema.names, "samples", "feature"])

    return df.mapInArrow(run, schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what its stored PNG holds when it is read back, and the PNG's feature."""
    stored = written(to_png(documents(spark, sf_dir)), "media", "uncompressed")
    return features(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op3_media": op3_media}
ORACLES: dict[str, str] = {}
