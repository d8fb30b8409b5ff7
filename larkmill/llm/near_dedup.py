"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, with links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm.base import documents, drop_written, free, slices, written
from larkmill.llm.graph import components
from larkmill.llm.words import hash_words, scramble

#: Signature: CHUNKS x WIDTH symbols of 16 bits, each the low bits of a minimum over all shingles.
CHUNKS, WIDTH = 12, 4
#: Symbols in which a chunk may differ; two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 of the symbols share a key.
ERRORS = 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Members of a key, and shingles of a group of candidates, in one block.
BLOCK, WEIGHT = 4096, 2_000_000
#: Size of the bitmap of candidates that is broadcast, at most (2^26 bits are 8 MB), with 12 bits for each.
MOST_BITS = 26

_SEEDS = scramble(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles (A-Z as a-z) as sorted 64-bit hashes; fewer words: the whole sequence as one; none: empty."""
    hashes, bounds, _, _ = hash_words(texts, lower=True)
    for a, z in zip(bounds, bounds[1:], strict=False):
        words = hashes[a:z]
        k = min(n, len(words))
        if not k:
            yield words
            continue
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
        yield np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS x WIDTH symbols: for each seed the 16 bits that mark the smallest shingle in that seed's order."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _SEEDS).min(axis=0), out=least)
    return (scramble(least) >> np.uint64(48)).astype(np.uint16)


def keys(symbols: np.ndarray) -> np.ndarray:
    """rows x symbols to rows x keys. Each chunk gives a key for each symbol that may be wrong, made of the chunk's other symbols.

    By pigeonhole, signatures with fewer than 2 * CHUNKS differing symbols have a chunk with one at most, and so a key in common.
    """
    chunked = symbols.reshape(len(symbols), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(symbols), CHUNKS, WIDTH), np.uint64)
    for skip in range(WIDTH):
        key = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(WIDTH) + np.uint64(skip)
        for i in range(WIDTH):
            if i != skip:
                key = scramble(key * np.uint64(1 << 16) + chunked[:, :, i])
        out[:, :, skip] = key
    return out.reshape(len(symbols), -1).view(np.int64)


def sketched(docs: DataFrame, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, cls, symbols): cls is a 128-bit digest of the whole shingle set; symbols its signature; both null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            sizes, cls, symbols = [], [], []
            for s in shingle_sets(texts, n):
                sizes.append(len(s))
                cls.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                symbols.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(cls, pa.binary()), pa.array(symbols, pa.binary())], ["key", "n_shingles", "cls", "symbols"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_shingles long, cls binary, symbols binary")


def _keyed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), -1))
                of = np.repeat(np.arange(len(batch)), made.shape[1])
                for at in range(0, len(of), 200_000):
                    yield pa.record_batch([batch.column(0).take(pa.array(of[at : at + 200_000])), pa.array(made.ravel()[at : at + 200_000])], ["cls", "key"])

    return classes.select("cls", "symbols").mapInArrow(run, "cls binary, key long")


def _places(cls: list[bytes], bits: int) -> np.ndarray:
    """rows x 2: a class's bits in a bitmap; the digest itself is the hash."""
    return (np.frombuffer(b"".join(cls), np.uint64).reshape(-1, 2) % np.uint64(bits)).astype(np.int64)


def _bitmap(classes: DataFrame, number: int) -> np.ndarray:
    """A bitmap that has all classes, of which there are number: texts whose class is not in it need not be shuffled."""
    bits = 1 << max(16, (12 * number).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits, bool)
        for batch in batches:
            if len(batch):
                out[_places(batch.column(0).to_pylist(), bits).ravel()] = True
        yield pa.record_batch([pa.array([np.packbits(out).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in classes.select("cls").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _sets(docs: DataFrame, n: int, text: str, key: str, sketch: DataFrame, clumps: DataFrame) -> DataFrame:
    """(cls, shingles) of each document whose class is in clumps, and of some others; a task gives the set of a class once, so that a
    class with many copies has a row a task.

    Few classes are told by a bitmap within the scan. If they are too many for one, one document of each is joined by its key.
    """
    number = clumps.count()
    wanted = _bitmap(clumps, number) if 12 * number < 1 << MOST_BITS else np.full(1, 255, np.uint8)
    if 12 * number >= 1 << MOST_BITS:
        one = sketch.join(clumps, "cls", "left_semi").groupBy("cls").agg(F.first("key").alias("key")).select("key").distinct()
        docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(one.withColumnRenamed("key", "wanted"), F.col("key").eqNullSafe(F.col("wanted")), "left_semi")
        text = "text"
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bitmap = shared.value
        for _, texts in slices(batches, 0):
            sets = [s for s in shingle_sets(texts, n) if len(s)]
            cls = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            at = _places(cls, len(bitmap) * 8)
            may = ((bitmap[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1)
            pick = [i for i in np.flatnonzero(may) if cls[i] not in seen and not seen.add(cls[i])]
            yield pa.record_batch([pa.array([cls[i] for i in pick], pa.binary()), pa.array([sets[i].tobytes() for i in pick], pa.binary())], ["cls", "shingles"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "cls binary, shingles binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first columns (all but the last two), from rows that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch) + 1, bool)
        change[[0, -1]] = True
        for column in batch.columns[:-2]:
            x = np.array(column.to_pylist(), object)
            change[1:-1] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == 0 and held and all(c[0] == h[-1] for c, h in zip(batch.columns[:-2], held[-1].columns[:-2], strict=True)):
                held.append(batch.slice(0, z))
                continue
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, z - a)]
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, by: list[str], size: str, most: int) -> DataFrame:
    """rows with unit: groups by columns whose size is over most are split into blocks by hash, and each pair of blocks is a unit."""
    blocks = F.ceil(F.col(size) / most).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "cls"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    return rows.withColumn("unit", F.explode(F.when(blocks > 1, pair).otherwise(F.array(F.lit(0)))))


def _near(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the members (key, unit, cls, symbols) of a key as their pairs under the distance threshold do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for group in _groups(batches):
            cls = group.column("cls").to_pylist()
            symbols = np.frombuffer(b"".join(group.column("symbols").to_pylist()), np.uint16).reshape(len(cls), -1)
            left = np.arange(len(cls))
            while len(left):
                first, left = left[0], left[1:]
                todo = [first]
                while todo and len(left):
                    x = todo.pop()
                    close = (symbols[left] != symbols[x]).sum(axis=1) <= DISTANCE
                    found = left[close]
                    todo += found.tolist()
                    out += [(cls[i], cls[first]) for i in found]
                    left = left[~close]
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])

    return members.select("key", "unit", "cls", "symbols").repartition("key", "unit").sortWithinPartitions("key", "unit").mapInArrow(run, "a binary, b binary")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest index it is connected to by links (100 * intersection >= percent * union), exactly.

    A row of intersection sizes comes from the postings of the set's shingles. Rows are needed only for sets outside one component,
    the largest at the end: two sets that are not connected are not both in it. A set that is passed over because it is in what is
    the largest so far is taken up later if another component ends as the largest.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    shingles, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(inverse, kind="stable")
    postings, ends = owner[order], np.cumsum(np.bincount(inverse, minlength=len(shingles)))
    starts = np.concatenate([[0], ends[:-1]])
    bounds = np.concatenate([[0], np.cumsum(size)])
    root, done = np.arange(m), np.zeros(m, bool)
    # The set whose shingles are most common is likely the one that the others were made from.
    common = np.add.reduceat((ends - starts)[inverse], bounds[:-1]) / size
    following = np.argsort(-common, kind="stable")
    largest = -1
    while len(following):
        for i in following:
            if root[i] == largest:
                continue
            done[i] = True
            own = inverse[bounds[i] : bounds[i + 1]]
            shared = np.bincount(np.concatenate([postings[starts[k] : ends[k]] for k in own]), minlength=m)
            for r in np.unique(root[100 * shared >= percent * (size + size[i] - shared)]):
                low, high = min(r, root[i]), max(r, root[i])
                if low != high:
                    root[root == high] = low
            largest = np.bincount(root, minlength=m).argmax()
        following = following[~done[following] & (root[following] != largest)]
    return root


def _confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the classes (clump, unit, cls, shingles) of a unit as their links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for group in _groups(batches):
            cls = group.column("cls").to_pylist()
            root = linked([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], percent)
            out += [(cls[i], cls[r]) for i, r in enumerate(root) if i != r]
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])

    return sets.select("clump", "unit", "cls", "shingles").repartition("clump", "unit").sortWithinPartitions("clump", "unit").mapInArrow(run, "a binary, b binary")


def link(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id): documents linked by 100 * intersection >= percent * union of their n-word shingle sets.

    component_id is the smallest key that is reachable over links, the own one included (null keys count only where no other is in
    the component). Texts without words, null ones included, are linked with nothing: their component_id is their own key. Repeated
    rows and texts with equal sets are one component. An empty table gives no rows.

    Texts with equal sets are one class. The multi-index Hamming join finds all pairs of classes whose signatures differ in at most
    DISTANCE symbols (a pair with 80 % likeness differs in more with a probability under 1e-5, one with 85 % of about 1e-8); its pairs
    are not spelled out but kept as the groups that they connect. Within a group the links are found on the full sets, all of them,
    so that g copies give g rows and not g^2. Keys and groups that are large are split into blocks, pair of blocks by pair of blocks.
    """
    sketch = written(sketched(docs, n, text, key), "sketch")
    classes = sketch.where("cls is not null").groupBy("cls").agg(F.first("symbols").alias("symbols"), F.first("n_shingles").alias("n"))
    classes = written(classes, "classes")
    keyed = written(_keyed(classes), "keys")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    members = keyed.join(shared, "key").join(classes.select("cls", "symbols"), "cls")
    near = written(_near(_dealt(members, ["key"], "held", BLOCK)), "near")
    drop_written(keyed)
    roots = None
    if near.limit(1).count():
        clumps = written(components(near).select(F.col("node").alias("cls"), F.col("root").alias("clump")), "clumps")
        weights = written(clumps.join(classes.select("cls", "n"), "cls").groupBy("clump").agg(F.sum("n").alias("weight")), "weights")
        sets = _sets(docs, n, text, key, sketch, clumps).join(clumps, "cls").groupBy("cls").agg(F.first("shingles").alias("shingles"), F.first("clump").alias("clump"))
        links = written(_confirmed(_dealt(sets.join(weights, "clump"), ["clump"], "weight", WEIGHT), percent), "links")
        if links.limit(1).count():
            roots = written(components(links), "roots").withColumnRenamed("node", "cls")
    placed = sketch if roots is None else sketch.join(roots, "cls", "left")
    placed = placed.select("key", "n_shingles", (F.col("cls") if roots is None else F.coalesce("root", "cls")).alias("root"))
    least = written(placed.where("root is not null").groupBy("root").agg(F.min("key").alias("component_id")), "least")
    joined = placed.join(least, "root", "left")
    return joined.select(F.col("key").alias(key), "n_shingles", F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id (of rows with it, that with the smallest digest of its text); its
    columns are those of docs. Rows that share a doc_id are told apart by their texts. Rows without a doc_id are told apart by their
    texts alone: one of each text stays. Texts without words are linked with nothing and stay, repeated rows of them once."""
    digest = F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b""))
    row = free("row", docs)
    rows = docs.where("doc_id is not null").withColumn(row, F.struct("doc_id", digest.alias("digest")))
    linked_ = link(rows.select(F.col(row).alias("row"), "text"), n, percent, key="row")
    kept = linked_.where("row = component_id").select(F.col("row").alias(row)).distinct()
    named = rows.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, over 2-word shingles."""
    return link(documents(spark, sf_dir), n=2).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES = {
    "op10_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM words
), sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN sized m ON m.doc_id = a.doc_id JOIN sized n ON n.doc_id = b.doc_id
  WHERE 100 * least(m.n, n.n) >= 80 * greatest(m.n, n.n)
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT sized.doc_id, sized.n AS n_shingles, least.component_id, sized.doc_id = least.component_id AS kept FROM sized JOIN least ON least.x = sized.doc_id"""
}
