"""Mixing sources to target weights: word budgets met by bounded-knapsack fitting over counts of equal sizes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkmill.llm.base import documents, free, words_column, written

#: Weights of the sources in code point order (null last), repeating; share of all words that the mix has; most copies of a document.
WEIGHTS, SHARE, COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: Documents of one source and size in one bucket of the seeded choice, about.
BUCKET = 512
#: Longest length that dynamic programming takes (its tables have up to four times as many entries).
MOST = 1 << 22
#: Budget up to which all of a source may be fitted by dynamic programming.
SMALL = 1 << 16


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = COPIES) -> list[float]:
    """Shares of total by weight; a source stops at most times its size and the excess is shared anew until none is above."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = min(total, most * sum(sizes))
    while free:
        weight = sum(weights[i] for i in sorted(free))
        full = [i for i in sorted(free) if left * weights[i] / weight >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        left = max(left, 0.0)
        free -= set(full)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = MOST) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to budget, or as near to it, below or above, as is found.

    A proportional part of every length first, long ones before short ones with the rounding carried on; then lengths over most as
    often as they fit; then bounded-knapsack dynamic programming over what is left of the others for the remaining budget. Its tables
    have at most four times most entries, however long the documents are. Last, one more document is taken if that is nearer. Where a
    source has so few documents that this misses a small budget, dynamic programming over all of them is tried, which cannot miss.
    """
    taken = np.zeros(len(lengths), np.int64)
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    use = np.flatnonzero((lengths > 0) & (counts > 0))
    total = int((lengths[use] * counts[use]).sum())
    if budget >= total:
        taken[use] = counts[use]
        return taken
    if budget <= 0:
        return taken
    use = use[np.argsort(-lengths[use], kind="stable")]
    goal, carry = max(0, budget - 2 * int(lengths[use[0]])), 0.0
    for i in use:
        want = goal / total * (int(lengths[i]) * int(counts[i])) + carry
        taken[i] = min(int(counts[i]), max(0, int(want // lengths[i])))
        carry = want - int(taken[i]) * int(lengths[i])
    rest = budget - int((taken * lengths).sum())
    for i in use:  # what a table cannot hold
        spare = rest if lengths[i] > most else rest - 3 * most
        n = max(0, min(int(counts[i] - taken[i]), spare // int(lengths[i])))
        taken[i] += n
        rest -= n * int(lengths[i])
    short = use[lengths[use] <= most]
    if 0 < rest <= 3 * most and len(short):
        taken += knapsack(lengths, counts - taken, rest, short, int(lengths[short[0]]))
        rest = budget - int((taken * lengths).sum())
    if rest > 0:
        left = use[counts[use] > taken[use]]
        nearest = left[np.argmin(np.abs(lengths[left] - rest))] if len(left) else -1
        if nearest >= 0 and abs(int(lengths[nearest]) - rest) < rest:
            taken[nearest] += 1
    off = abs(budget - int((taken * lengths).sum()))
    if off and budget <= SMALL and lengths[use[0]] <= SMALL:
        whole = knapsack(lengths, counts, budget, use, int(lengths[use[0]]))
        if abs(budget - int((whole * lengths).sum())) < off:
            return whole
    return taken


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, order: Sequence[int], over: int = 0) -> np.ndarray:
    """Numbers of each length, within counts, whose sum is the nearest to budget that is reachable up to budget + over (of two, the lower)."""
    size = budget + over
    reach, via = np.zeros(size + 1, bool), np.full(size + 1, -1, np.int32)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in order:
        left, n = min(int(counts[i]), size // int(lengths[i])), 1
        while left > 0 and not reach[budget]:
            n = min(n, left)
            w = n * int(lengths[i])
            new = reach[: size + 1 - w] & ~reach[w:]
            via[w:][new] = len(items)
            reach[w:] |= new
            items.append((i, n))
            left, n = left - n, n * 2
        if reach[budget]:
            break
    out = np.zeros(len(lengths), np.int64)
    found = np.flatnonzero(reach)
    at = int(found[np.argmin(np.abs(found - budget))])
    while at:
        i, n = items[via[at]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


def size_of(text: Column) -> Column:
    """Words of text; null has none."""
    return F.size(words_column(text)).cast("long")


def mix(docs: DataFrame, seed: int = 7, weights: Sequence[float] = WEIGHTS, share: float = SHARE, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(key, source, size, source_size, target, copies) of each row: how often the mix takes it, 0 to 2 times. row: a column to carry along.

    Every source gets its target in words (see targets) as nearly as whole documents allow. When the target is over the source's size,
    every document is taken once and the remainder is fitted with second copies. Documents of one source and size are chosen by a
    seeded hash of the key, so that reruns agree; a null key counts as a key, a null source as a source of its own, rows of size 0 are
    not taken. Rows of one key are ordered by their texts; repeated rows are documents each. An empty table gives no rows.

    The weights are a list by source, so the sources' totals (a row each) are held by the driver; everything per document or per size
    stays distributed. Documents of one source and size are split into buckets by hash before they are ranked.
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("src"), size_of(F.col(text)).alias("size"), F.xxhash64(text).alias("of_text"), *([] if row is None else [F.col(row).alias("row")])), "sizes").withColumn("part", F.coalesce(F.concat(F.lit("s"), "src"), F.lit("n")))
    counts = written(rows.groupBy("part", "src", "size").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("part", "src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    totals.sort(key=lambda r: (r.src is None, r.src or ""))
    wanted = targets([r.source_size for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share * sum(r.source_size for r in totals))
    plan = spark.createDataFrame([(r.part, r.source_size, t, round(t)) for r, t in zip(totals, wanted, strict=True)], "part string, source_size long, target double, budget long")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = bool(pdf.budget.iloc[0] >= pdf.source_size.iloc[0])
        more = fit(pdf["size"].to_numpy(), pdf.n.to_numpy(), int(pdf.budget.iloc[0] - whole * pdf.source_size.iloc[0]))
        return pd.DataFrame({"part": pdf.part, "size": pdf["size"], "n": pdf.n, "source_size": pdf.source_size, "target": pdf.target, "base": int(whole), "more": more})

    chosen = written(counts.drop("src").join(plan, "part").groupBy("part").applyInPandas(fitted, "part string, size long, n long, source_size long, target double, base long, more long"), "chosen")
    chosen = chosen.withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    # The seeded hash as a number from 0 to 1, by which a bucket is taken whole, in part or not at all.
    mixed = F.xxhash64(F.lit(seed), F.col("key"))
    ranked = rows.join(chosen, ["part", "size"]).withColumn("h", mixed).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    before = ranked.groupBy("part", "size", "bucket").agg(F.count("*").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(W.partitionBy("part", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "size", "bucket", "before")
    rank = F.row_number().over(W.partitionBy("part", "size", "bucket").orderBy("h", "key", "of_text"))
    second = F.when(F.col("before") + rank <= F.col("more"), 1).otherwise(0)
    return ranked.join(before, ["part", "size", "bucket"]).select(F.col("key").alias(key), F.col("src").alias(source), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base") + second).otherwise(0).cast("long").alias("copies"), *([] if row is None else [F.col("row").alias(row)]))


def mixed_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with the columns of docs.

    Each row has a number of its own in a written copy of docs, so rows that share a key, null ones included, are taken as mix() says.
    """
    row = free("row", docs)
    stored = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mix(stored, seed, row=row, **options).where("copies > 0").select(F.col(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(free("times", stored)))
    joined = stored.join(taken, row)
    return joined.select(*docs.columns, F.explode(free("times", stored)).alias(free("time", stored))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted); see mix() for nulls, ties and empty texts."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
