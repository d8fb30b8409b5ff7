"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.llm.base import documents, slices

MARK = "▁"
#: Entries that a task's chunk table holds before it starts anew, and the longest chunk (characters) that it keeps.
TABLE_ENTRIES, TABLE_CHUNK = 150_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cannot_cross(processor) -> bool:
    """Whether no piece has a mark after another character, so that each marked word can be segmented alone."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces)


@lru_cache(2)
def load(path: str | None):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    if not cannot_cross(processor) or processor.encode(" a") == processor.encode("a"):
        raise ValueError("distinct chunks need pieces that do not cross marks, and white space that is kept")
    return processor


class Chunks(dict):
    """Chunk, without its first mark and with blanks for its others, to (ids as little-endian uint32, decoded chunk)."""

    def __init__(self, processor) -> None:
        self.processor = processor
        self.mark = [processor.piece_to_id(MARK)]

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        ids = self.processor.encode(chunk) if chunk else self.mark
        made = array("I", ids).tobytes(), self.processor.decode(ids)
        if len(chunk) <= TABLE_CHUNK:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[chunk] = made
        return made


def chunks_of(text: str) -> list[str]:
    """The marked words of text: runs of marks go with the word after them; each loses its first mark."""
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for i, part in enumerate(parts):
        if part or i == len(parts) - 1:
            out.append(" " * run + part)
            run = 0
        else:
            run += 1
    return out


def encode_text(table: Chunks, text: str, ends: tuple[bytes, bytes]) -> tuple[bytes, str]:
    """(ids with begin and end, decoded text)."""
    if not text:
        return ends[0] + ends[1], ""
    found = [table[x] for x in chunks_of(text)]
    return b"".join([ends[0], *[x[0] for x in found], ends[1]]), " ".join([x[1] for x in found])


def encode(docs: DataFrame, model: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): ids of each whole text with begin and end as little-endian uint32 in a binary column, and their decoded text.

    Exactly what the library gives for the whole text. Null text counts as empty: begin and end only, decoded "". Repeated rows are
    encoded each; other columns are left out. Each task keeps one table of distinct chunks, of bounded size: it segments a distinct
    marked word once and joins the ids back by position, so no row is shuffled and a lost task is redone alone.
    model: a path on every executor; None is the installed public model.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        table = Chunks(processor)
        ends = tuple(array("I", [x]).tobytes() for x in (processor.bos_id(), processor.eos_id()))
        for part, texts in slices(batches, 1):
            made = [encode_text(table, x.decode("utf-8", "replace"), ends) for x in texts]
            yield pa.record_batch([part.column(0), pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.string())], ["key", "ids", "decoded"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(documents(spark, sf_dir)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
