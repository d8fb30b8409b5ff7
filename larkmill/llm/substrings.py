"""Substring dedup: anchors at the positions of a difference cover find long repeats, which whole windows then confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm.base import documents, drop_written, slices, written
from larkmill.llm.words import hash_words, rolling, scramble

#: Words of a window, and period of the cover; an anchor has WINDOW - PERIOD + 1 words.
WINDOW, PERIOD = 35, 21
#: Classes of equal texts that are broadcast, at most: those with more copies than this part of all copies.
HOT_CLASSES = 10_000
_SECOND = 0xD6E8FEB86659FD93
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)


@lru_cache(8)
def cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences give every residue: for any i and j both i + d and j + d are in it for some d."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
        size += 1


def _digest(words: np.ndarray) -> bytes:
    return blake2b(words.tobytes(), digest_size=16).digest()


def _place(digest: bytes, at: np.ndarray) -> np.ndarray:
    """One 64-bit number for a position of a text."""
    seed = np.frombuffer(digest[:8], np.uint64)[0]
    return scramble(seed + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _starts_of_anchors(n: int, window: int, period: int) -> np.ndarray:
    """Positions of the cover at which an anchor fits into a text of n words; a text shorter than a window has none."""
    if n < window:
        return np.empty(0, np.int64)
    at = np.arange(n - (window - period))
    member = np.zeros(period, bool)
    member[list(cover(period))] = True
    return at[member[at % period]]


def _open_windows(hits: np.ndarray, n: int, window: int, period: int) -> np.ndarray:
    """Starts of the windows that hold a hit anchor."""
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, np.maximum(hits - period + 1, 0), 1)
    np.add.at(change, hits + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: max(0, n - window + 1)] > 0)


def _anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(anchor, cls, at): hashed anchors of each text. A task gives those of equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        size = window - period + 1
        for _, texts in slices(batches, 0):
            words, bounds, _, _ = hash_words(texts)
            for a, z in zip(bounds, bounds[1:], strict=False):
                at = _starts_of_anchors(z - a, window, period)
                if not len(at):
                    continue
                own = words[a:z]
                digest = _digest(own)
                if digest in seen:
                    continue
                seen.add(digest)
                made = scramble(rolling(own, at, at + size))
                cls = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([digest], pa.binary())).dictionary_decode()
                yield pa.record_batch([pa.array(made.view(np.int64)), cls, pa.array(at.astype(np.int32))], ["anchor", "cls", "at"])

    return docs.select("text").mapInArrow(lambda x: _gathered(run(x)), "anchor long, cls binary, at int")


def _places(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(anchor, place): as _anchors, with the text and position as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        size = window - period + 1
        for _, texts in slices(batches, 0):
            words, bounds, _, _ = hash_words(texts)
            anchors, places = [], []
            for a, z in zip(bounds, bounds[1:], strict=False):
                at = _starts_of_anchors(z - a, window, period)
                if len(at):
                    own = words[a:z]
                    digest = _digest(own)
                    if digest not in seen:
                        seen.add(digest)
                        anchors.append(scramble(rolling(own, at, at + size)))
                        places.append(_place(digest, at))
            if anchors:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (anchors, places)], ["anchor", "place"])

    return docs.select("text").mapInArrow(run, "anchor long, place long")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _with_class(docs: DataFrame, distinct: bool, least: int = 0) -> DataFrame:
    """(cls, n_words and the columns of docs) of texts of least words or more; distinct: a task gives a class once."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part, texts in slices(batches, at):
            words, bounds, _, _ = hash_words(texts)
            cls = [_digest(words[a:z]) for a, z in zip(bounds, bounds[1:], strict=False)]
            out = pa.record_batch([pa.array(cls, pa.binary()), pa.array(np.diff(bounds).astype(np.int64)), *part.columns], ["cls", "n_words", *part.schema.names])
            if distinct or least:
                new = [i for i in np.flatnonzero(np.diff(bounds) >= least) if not distinct or (cls[i] not in seen and not seen.add(cls[i]))]
                out = out.take(pa.array(new, pa.int64()))
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"cls binary, n_words long, {fields}")


def _windows(marked: DataFrame, window: int, period: int) -> DataFrame:
    """(h1, h2, place, cls, at) of the windows of each text of marked (cls, text, hits) that hold a hit anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1, 1 << 20):
            words, bounds, _, _ = hash_words(texts)
            others = hash_words(texts, base=_SECOND)[0]
            hits = part.column(2).to_pylist()
            for i, digest in enumerate(part.column(0).to_pylist()):
                own = words[bounds[i] : bounds[i + 1]]
                at = _open_windows(np.array(hits[i], np.int64), len(own), window, period)
                if len(at):
                    h1 = scramble(rolling(own, at, at + window))
                    h2 = scramble(rolling(others[bounds[i] : bounds[i + 1]], at, at + window, _SECOND, _SECOND_INVERSE))
                    cls = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([digest], pa.binary())).dictionary_decode()
                    yield pa.record_batch([*(pa.array(x.view(np.int64)) for x in (h1, h2, _place(digest, at))), cls, pa.array(at.astype(np.int32))], ["h1", "h2", "place", "cls", "at"])

    return marked.select("cls", "text", "hits").mapInArrow(lambda x: _gathered(run(x)), "h1 long, h2 long, place long, cls binary, at int")


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """The keys by that occur at two places or more: pre-aggregated, so that a passage of all documents is a row a task."""
    return rows.groupBy(*by).agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select(*by)


def without_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept): each text without the words that lie in a window of that many words which starts anywhere else too.

    Windows lie within one document and are judged on the input; a repeat within a document counts, and so does that of a repeated
    row. kept has the remaining words joined by one blank. Null and empty texts have no words and keep "". An empty table gives no rows.

    Texts of equal words are one class, all of whose words go if it has two rows. For the rest, any two equal windows have equal
    anchors at some position that the cover marks in both; only windows with a repeated anchor are hashed (two hashes of 64 bits over two hashes of each word) and compared.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    only = source.select("text")
    anchors = written(_repeated(_places(only, window, period), "anchor"), "anchors")
    hits = written(_anchors(only, window, period).join(anchors, "anchor").groupBy("cls").agg(F.collect_list("at").alias("hits")), "hits")
    marked = written(_with_class(only, True, window).select("cls", "text").join(hits, "cls").groupBy("cls").agg(F.first("text").alias("text"), F.first("hits").alias("hits")), "marked")
    drop_written(anchors)
    repeated = written(_repeated(_windows(marked, window, period), "h1", "h2"), "windows")
    gone = written(_windows(marked, window, period).select("h1", "h2", "cls", "at").join(repeated, ["h1", "h2"]).groupBy("cls").agg(F.collect_list("at").alias("gone")), "gone")
    classes = written(_with_class(only, False, window).groupBy("cls").agg(F.count("*").alias("held")).where("held > 1"), "classes")
    known = written(classes.join(gone, "cls", "full"), "known")
    # Rows of a class with many copies, all of whose words go, and texts shorter than a window need nothing from known: they are dealt evenly.
    copies = classes.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    hot = classes.where(F.col("held") > max(100, copies // HOT_CLASSES)).select("cls", F.lit(2).cast("long").alias("many"))
    rows = _with_class(source, False).join(F.broadcast(hot), "cls", "left")
    alone = F.col("many").isNotNull() | (F.col("n_words") < window)
    rows = rows.withColumn("cls", F.when(alone, F.unhex(F.md5(F.concat(F.col("cls"), F.rand(3).cast("string").cast("binary"))))).otherwise(F.col("cls")))
    rows = rows.join(known, "cls", "left").select("key", "n_words", "text", F.coalesce("many", "held", F.lit(1)).alias("held"), "gone")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 2):
            removed, kept = [], []
            for x, held, gone in zip(texts, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                words = x.split()
                if held > 1 and len(words) >= window:
                    removed.append(len(words))
                    words = []
                elif gone:
                    change = np.zeros(len(words) + 1, np.int64)
                    starts = np.array(gone, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                    stay = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256. Null and empty texts have no words and the digest of no bytes; repeated rows
    are each other's repeats."""
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op6_substrings": op6_substrings}
ORACLES: dict[str, str] = {}
