"""Quality classifier: a generalised additive model with pairwise interactions, scored by adding up looked-up bins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.llm.base import documents, held_out, labels, slices

#: Labelled rows that the model is fitted on, at most: those with the smallest seeded hash of doc_id.
SAMPLE = 16_000
#: Features of a text, in order.
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "punctuation", "exclamation", "bar", "symbol", "stop", "non_ascii",
    "unique_words", "repeats", "log_longest_run", "top_word", "short_words", "odd_ends", "log_lines", "unique_lines", "line_length", "capitals",
)

_KINDS = np.zeros((256, 8), np.uint8)
for _i, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(x for x in range(33, 127) if not chr(x).isalnum()), b"!", b"|", b"#&*$%^~=+<>{}[]\\@_", b".,;:?", bytes(range(128, 256)))):
    _KINDS[list(_members), _i] = 1
_ODD = frozenset(b"#&*$%^~=+<>|!@_")


def describe(text: bytes) -> list[float]:
    """FEATURES of a whole text; all finite for any text, empty ones included."""
    words = text.split()
    n, m = len(words), len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = (seen @ _KINDS) / max(1, m)
    letters = int(seen[65:91].sum() + seen[97:123].sum())
    size = np.fromiter(map(len, words), np.int64, n)
    counted = Counter(words)
    same = np.fromiter(map(eq, words[1:], words), bool, max(0, n - 1))
    changes = np.flatnonzero(~same)
    run = int(np.diff(np.concatenate([[-1], changes, [n - 1]])).max()) if n else 0
    lines = text.split(b"\n")
    odd = sum(c for w, c in counted.items() if w[-1] in _ODD)
    return [
        np.log1p(m), np.log1p(n), float(size.mean()) if n else 0.0, float(size.std()) if n else 0.0, float(seen[65:91].sum()) / max(1, letters), *(float(x) for x in share[1:]),
        len(counted) / max(1, n) * (1 + np.log1p(n) / 10), float(same.mean()) if n > 1 else 0.0, np.log1p(run), max(counted.values()) / n if n else 0.0, float((size <= 3).mean()) if n else 0.0, odd / max(1, n),
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(m / len(lines)), sum(c for w, c in counted.items() if 65 <= w[0] <= 90) / max(1, n),
    ]


def described(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and features (array of doubles, see FEATURES) of each whole text; null text counts as empty."""
    schema = T.StructType([*(T.StructField(k, docs.schema[k].dataType) for k in keep), T.StructField("features", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, len(keep)):
            found = pa.array([describe(x) for x in texts], pa.list_(pa.float64()))
            yield pa.record_batch([*part.columns[: len(keep)], found], [*keep, "features"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass
class Gam:
    """Edges of each feature's bins, a table of additions for each feature, and one for each pair over coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float = 0.0
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for f, g, table in self.pairs:
            out += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between values that occur, at quantiles."""
    values = np.unique(x)
    if len(values) <= 1:
        return np.empty(0)
    at = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(values) > bins else values[1:]
    common = np.unique(np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1], method="nearest"))
    return np.unique(np.concatenate([at, common]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 2.0, ridge: float = 1.0) -> np.ndarray:
    """Additions of a tree over ordered bins, whose gradient and curvature sums are g and h."""
    gs, hs = g.cumsum(), h.cumsum()
    whole = gs[-1] / (hs[-1] + ridge)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), whole)
    left, right = hs[:-1], hs[-1] - hs[:-1]
    gain = gs[:-1] ** 2 / (left + ridge) + (gs[-1] - gs[:-1]) ** 2 / (right + ridge)
    gain[(left < least) | (right < least)] = -1
    cut = int(gain.argmax())
    if gain[cut] <= gs[-1] ** 2 / (hs[-1] + ridge) + 1e-9:
        return np.full(len(g), whole)
    return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1, least, ridge), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1, least, ridge)])


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a table of sums along both axes: its gain, and the additions of its four parts."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for s in (gs, hs):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        parts.append((a, b, c, s[-1, -1] - a - b - c))
    if not parts[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(x**2 / (y + ridge) for x, y in zip(*parts, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    add = np.empty_like(g)
    leaf = [x[i, j] / (y[i, j] + ridge) for x, y in zip(*parts, strict=True)]
    add[: i + 1, : j + 1], add[: i + 1, j + 1 :], add[i + 1 :, : j + 1], add[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), add


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, bins: int = 64, coarse: int = 12) -> Gam:
    """Cyclic boosting: each round gives every feature in turn a tree of depth two on its own bins, then the chosen pairs get theirs.

    Pairs are ranked by what their best pair of cuts gains on the residuals of the single features. Without rows of both labels the
    model is a constant.
    """
    model = Gam([_edges(x[:, f], bins) for f in range(x.shape[1])], [], coarse=[_edges(x[:, f], coarse) for f in range(x.shape[1])])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    positive = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(positive / (1 - positive)))
    if not len(y) or y.min() == y.max():
        return model
    margin = np.full(len(y), model.intercept)
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = slopes()
                add = rate * _tree(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)), 2)
                table += add
                margin += add[at[f]]
    low = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]

    def sums(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(low[f] * width[g] + low[g], values, width[f] * width[g]).reshape(width[f], width[g])

    g, h = slopes()
    ranked = sorted(((_quadrants(sums(a, b, g), sums(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in ranked[:pairs]]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = slopes()
            add = rate * _quadrants(sums(a, b, g), sums(a, b, h))[1]
            table += add
            margin += add[low[a], low[b]]
    return model


def sample_labels(marked: DataFrame, label: str, skip_mod: int, skip_value: int, most: int) -> DataFrame:
    """(doc_id, label) of at most most labelled rows outside the held-out remainder, by seeded hash; equal doc_ids count once, by their largest label."""
    usable = marked.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), skip_mod, skip_value))
    return usable.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, marked: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Fits on sample labelled rows at most (so that many features reach the driver), never on those whose crc32(doc_id) mod 4 is 2.

    Null labels and doc_ids are left out, equal doc_ids in labels count by the largest label, repeated rows of documents are rows each,
    null texts are empty. Without rows of both labels every score is the share of label 1 (0.5 without any).
    """
    chosen = F.broadcast(sample_labels(marked, label, 4, 2, sample))
    rows = described(docs.select("doc_id", "text").join(chosen, "doc_id"), keep=("doc_id", "label"))
    rows = rows.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "features").limit(sample).toPandas()
    x = np.array(rows.features.tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows.label.to_numpy(float))


def score(docs: DataFrame, model: Gam, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score): probability of label 1 for each whole text; null and empty texts get a score too, repeated rows one each."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            found = held.value.score(np.array([describe(x) for x in texts], float).reshape(len(texts), len(FEATURES)))
            yield pa.record_batch([part.column(0), pa.array(found)], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Gam, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose score is least or more: a filter within the scan, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, at):
            found = held.value.score(np.array([describe(x) for x in texts], float).reshape(len(texts), len(FEATURES)))
            yield part.filter(pa.array(found >= least))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
