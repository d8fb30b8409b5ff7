"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offending offsets."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.llm.base import documents, held_out, labels, slices
from larkmill.llm.quality_gam import sample_labels

#: Labelled documents that the field is trained on, at most, and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
#: Words that a task's table holds at most, besides those of the texts at hand.
TABLE_WORDS = 200_000
#: Words on each side of a labelled one in a training sequence.
AROUND = 8

_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def stems(words: Sequence[bytes]) -> list[str]:
    """The words as the field sees them: in lower case, without the ASCII punctuation at their ends (unless that is all)."""
    lower = b"\n".join(words).decode("utf-8", "replace").lower().split("\n")
    return [x.strip(_EDGES) or x for x in lower]


def parts(stem: str) -> tuple[str, ...]:
    """What may mark a word: itself and its beginnings of 4 to 6 characters."""
    return f"w{stem}", f"4{stem[:4]}", f"5{stem[:5]}", f"6{stem[:6]}"


def marks(texts: Sequence[bytes], toxic: Sequence[bool], least: int = 3, pure: float = 0.97, often: int = 15) -> set[str]:
    """The parts of words (see parts) that mark toxic documents: token labels out of document labels.

    Greedily, the part that explains the most toxic texts which no earlier one explains, as long as there are least of them and at
    least pure of all texts with it are toxic; then every as pure part of often texts or more, unless they are mostly those of one
    earlier part (as the words of a toxic text with many near copies are). Equal texts count once.
    """
    seen = {t: bool(y) for t, y in zip(texts, toxic, strict=True)}
    having: dict[str, set[int]] = defaultdict(set)
    for i, (text, y) in enumerate(seen.items()):
        if y:
            for p in {p for w in stems(list(set(text.split()))) for p in parts(w)}:
                having[p].add(i)
    having = {p: ids for p, ids in having.items() if len(ids) >= least}
    total = Counter({p: len(ids) for p, ids in having.items()})
    for text, y in seen.items():
        if not y:
            total.update(having.keys() & {p for w in stems(list(set(text.split()))) for p in parts(w)})
    having = {p: ids for p, ids in having.items() if len(ids) >= least and len(ids) >= pure * total[p]}
    whole, out = dict(having), set()
    while having:
        best = max(having, key=lambda p: (len(having[p]), p[0] == "w", p))
        explained = having[best]
        if len(explained) < least:
            break
        out.add(best)
        having = {p: rest for p, ids in having.items() if len(rest := ids - explained) >= least}
    chosen = [whole[p] for p in sorted(out)]
    return out | {p for p, ids in whole.items() if len(ids) >= often and max((len(ids & x) for x in chosen), default=0) < 0.7 * len(ids)}


class Steps:
    """Words of several sequences, ordered by position and then by sequence (longest first): a step takes all sequences at once."""

    def __init__(self, sizes: np.ndarray) -> None:
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
        long = sizes[order]
        self.running = np.searchsorted(-long, -np.arange(1, int(long[0]) + 1 if len(long) else 1), "right")
        self.at = np.concatenate([[0], np.cumsum(self.running)])
        step = np.repeat(np.arange(len(self.running)), self.running)
        self.index = starts[np.arange(len(step)) - self.at[step]] + step


def odds(emission: np.ndarray, sizes: np.ndarray, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of tag 1 against 0 for each word: forward, backward (without the word itself), and the words' order by Steps."""
    steps = Steps(sizes)
    e = np.exp(np.clip(emission[steps.index], -60, 60))
    t00, t01, t10, t11 = np.exp(move).ravel()
    forward, backward = np.empty_like(e), np.ones_like(e)
    at, running = steps.at, steps.running
    if len(running):
        forward[: at[1]] = e[: at[1]] * np.exp(start)
    for k in range(1, len(running)):
        before = forward[at[k - 1] : at[k - 1] + running[k]]
        forward[at[k] : at[k + 1]] = e[at[k] : at[k + 1]] * (t01 + t11 * before) / (t00 + t10 * before)
    for k in range(len(running) - 2, -1, -1):
        after = e[at[k + 1] : at[k + 2]] * backward[at[k + 1] : at[k + 2]]
        backward[at[k] : at[k] + running[k + 1]] = (t10 + t11 * after) / (t00 + t01 * after)
    return forward, backward, steps.index


def marginals(emission: np.ndarray, sizes: np.ndarray, move: np.ndarray, start: float) -> np.ndarray:
    """Probability of tag 1 for each word, given its whole sequence. sizes: words of each sequence, in order."""
    forward, backward, index = odds(emission, sizes, move, start)
    out = np.empty(len(emission))
    both = forward * backward
    out[index] = both / (1 + both)
    return out


@dataclass
class Field:
    #: Weights by feature: parts of a word for its own tag; "p" and "n" with a word for the tag after and before it; "" for every tag.
    weights: dict[str, float]
    move: np.ndarray
    start: float
    #: Slope and offset of a document's score by the logit of its largest marginal.
    scale: tuple[float, float] = (1.0, 0.0)

    def document_scores(self, probability: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        largest = np.zeros(len(sizes))
        full = np.flatnonzero(sizes)
        if len(full):
            largest[full] = np.maximum.reduceat(probability, np.concatenate([[0], np.cumsum(sizes)])[:-1][full])
        p = np.clip(largest, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(self.scale[0] * np.log(p / (1 - p)) + self.scale[1])))


def fit(sequences: Sequence[tuple[list[bytes], list[int]]], rounds: int = 60, rate: float = 0.5, ridge: float = 2e-6, often: int = 20) -> Field:
    """Likelihood of the tags by adaptive gradient steps over all sequences of (words, tags); feature counts come from the marginals."""
    used: Counter = Counter()
    whole = [stems(words) for words, _ in sequences]
    for words in whole:
        used.update(words)
    slot: dict[str, int] = {"": 0}
    rows, cols, tags, sizes, n = [], [], [], [], 0
    for words, (_, marked) in zip(whole, sequences, strict=True):
        for i, word in enumerate(words):
            use = ["", *parts(word)]
            if i and used[words[i - 1]] >= often:
                use.append(f"p{words[i - 1]}")
            if i + 1 < len(words) and used[words[i + 1]] >= often:
                use.append(f"n{words[i + 1]}")
            rows += [n + i] * len(use)
            cols += [slot.setdefault(x, len(slot)) for x in use]
        tags += marked
        sizes.append(len(words))
        n += len(words)
    weights, move, start = np.zeros(len(slot)), np.zeros((2, 2)), 0.0
    weights[0] = -2.0
    if not n:
        return Field({"": -2.0}, move, start)
    rows_, cols_, y, sizes_ = np.array(rows), np.array(cols), np.array(tags, float), np.array(sizes)
    first = np.concatenate([[0], np.cumsum(sizes_)])[:-1][sizes_ > 0]
    inner = np.ones(n, bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    seen = np.bincount((y[inner - 1] * 2 + y[inner]).astype(int), minlength=4).reshape(2, 2)
    sums = [np.full(len(slot), 1e-8), np.full((2, 2), 1e-8), 1e-8]
    for _ in range(rounds):
        emission = np.bincount(rows_, weights[cols_], n)
        forward, backward, index = odds(emission, sizes_, move, start)
        f, b = np.empty(n), np.empty(n)
        f[index], b[index] = forward, backward
        p = f * b / (1 + f * b)
        turn = np.exp(move)
        e = np.exp(np.clip(emission[inner], -60, 60)) * b[inner]
        pair = np.stack([turn[0, 0] + 0 * e, turn[0, 1] * e, turn[1, 0] * f[inner - 1], turn[1, 1] * f[inner - 1] * e])
        expected = (pair / pair.sum(0)).sum(1).reshape(2, 2)
        for k, step in enumerate((np.bincount(cols_, (y - p)[rows_], len(slot)) / n - ridge * weights, (seen - expected) / n, (y[first] - p[first]).sum() / n)):
            sums[k] = sums[k] + step**2
            change = rate * step / np.sqrt(sums[k])
            if k == 0:
                weights += change
            elif k == 1:
                move = np.clip(move + change, -6, 6)
            else:
                start += float(change)
    return Field({x: float(weights[k]) for x, k in slot.items() if abs(weights[k]) > 1e-3 or not x}, move, start)


def learn(texts: Sequence[bytes], toxic: Sequence[bool]) -> Field:
    """Tags the words of labelled texts (see marks), trains the field on the marked words' surroundings and as many others, and fits
    the scores' scale to the texts' labels."""
    if not len(texts) or not any(toxic) or all(toxic):
        model = fit([])
        return Field(model.weights, model.move, model.start, (0.0, 0.0 if not len(texts) else 6.0 * bool(toxic[0]) - 3.0))
    marking = marks(texts, toxic)
    is_marked = lru_cache(None)(lambda w: int(not marking.isdisjoint(parts(w))))
    sequences: dict[tuple, tuple[list[bytes], list[int]]] = {}
    for text in dict.fromkeys(texts):
        words = text.split()
        tags = [is_marked(w) for w in stems(words)] if words else []
        at = [i for i, t in enumerate(tags) if t]
        middle = len(text) % max(1, len(words))
        for i in [*at, middle]:
            a, z = max(0, i - AROUND), i + AROUND + 1
            sequences[tuple(words[a:z])] = (words[a:z], tags[a:z])
    model = fit(list(sequences.values()))
    table = Table(model)
    highest = []
    for k in range(0, len(texts), 500):
        emission, sizes = table.emissions(texts[k : k + 500])
        p = marginals(emission, sizes, model.move, model.start)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        highest += [p[a:z].max() if z > a else 0.0 for a, z in zip(bounds, bounds[1:], strict=False)]
    q = np.clip(np.array(highest), 1e-9, 1 - 1e-9)
    x, y = np.log(q / (1 - q)), np.array(toxic, float)
    slope, offset = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((y - p) * x).sum() - 0.5 * slope, (y - p).sum() - 0.05 * offset])
        curve = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        change = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        slope, offset = slope + change[0], offset + change[1]
    return Field(model.weights, model.move, model.start, (float(max(slope, 0.0)), float(offset)))


class Table(dict):
    """Word to the sums of its weights for its own tag, the one after and the one before. Words that were seen since the table was
    last full stay when it is full again."""

    def __init__(self, model: Field) -> None:
        self.weights, self.bias, self.old = model.weights, model.weights[""], {}

    def learn(self, words: set[bytes]) -> None:
        """Entries for words, which the caller then finds here."""
        if len(self) + len(words) > TABLE_WORDS:
            self.old = dict(self)
            self.clear()
        new = []
        for w in words - self.keys():
            known = self.old.get(w)
            if known is None:
                new.append(w)
            else:
                self[w] = known
        get, bias = self.weights.get, self.bias
        for w, s in zip(new, stems(new) if new else (), strict=True):
            self[w] = (bias + get("w" + s, 0.0) + get("4" + s[:4], 0.0) + get("5" + s[:5], 0.0) + get("6" + s[:6], 0.0), get("p" + s, 0.0), get("n" + s, 0.0))

    def emissions(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of tag 1 over 0 for each word of all texts, and the number of words of each text."""
        words = [x.split() for x in texts]
        sizes = np.array([len(x) for x in words], np.int64)
        n = int(sizes.sum())
        self.learn(set().union(*words))
        found = np.fromiter(chain.from_iterable(map(self.__getitem__, chain.from_iterable(words))), float, 3 * n).reshape(n, 3)
        out, after, before = found[:, 0].copy(), found[:, 1], found[:, 2]
        inner = np.ones(n, bool)
        inner[np.concatenate([[0], np.cumsum(sizes)])[:-1][sizes > 0]] = False
        at = np.flatnonzero(inner)
        out[at] += after[at - 1]
        out[at - 1] += before[at]
        return out, sizes


def offending(text: bytes, probability: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(start, end) in code points of the runs of words with at least that probability."""
    hits = probability >= least
    if not hits.any():
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    while at < len(spans):
        if hits[at]:
            end = at
            while end + 1 < len(spans) and hits[end + 1]:
                end += 1
            a = len(text[: spans[at][0]].decode("utf-8", "replace"))
            out.append((a, a + len(text[spans[at][0] : spans[end][1]].decode("utf-8", "replace"))))
            at = end
        at += 1
    return out


def train(docs: DataFrame, marked: DataFrame, label: str = "toxic", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Field:
    """Learns from sample labelled documents at most, never those whose crc32(doc_id) mod 3 is 1.

    Their whole texts reach the driver: the shortest first, as long as they are most_bytes together. Null labels and doc_ids are left
    out, equal doc_ids in labels count by the largest label, repeated rows of documents are documents each, null texts are empty.
    """
    chosen = F.broadcast(sample_labels(marked, label, 3, 1, sample))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").withColumn("size", F.octet_length("text"))
    sizes = sorted(r.size_ for r in rows.select(F.col("size").alias("size_")).orderBy("size").limit(sample).collect())
    fits = np.cumsum(sizes) <= most_bytes
    longest = sizes[int(fits.sum()) - 1] if fits.any() else -1
    rows = rows.where(F.col("size") <= longest).orderBy("doc_id", F.xxhash64("text")).limit(sample).select("label", "text").collect()
    return learn([x.text.encode() for x in rows], [bool(x.label) for x in rows])


def score(docs: DataFrame, model: Field, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(key, score, spans) of each whole text: probability of being toxic, and the offending runs of words (start, end in code points)
    whose marginal is least or more. Null and empty texts get the score of a text without toxic words and no spans."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        table = Table(field)
        for part, texts in slices(batches, 1, 6 << 20):
            emission, sizes = table.emissions(texts)
            p = marginals(emission, sizes, field.move, field.start)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            spans = [[{"start": a, "end": b} for a, b in offending(x, p[i:j], least)] for x, i, j in zip(texts, bounds, bounds[1:], strict=False)]
            yield pa.record_batch([part.column(0), pa.array(field.document_scores(p, sizes)), pa.array(spans, arrow)], ["key", "score", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, offending (its toxic runs of words as "start-end", code points, joined by commas)."""
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, labels(spark, sf_dir)))
    offending = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), offending.alias("offending"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
