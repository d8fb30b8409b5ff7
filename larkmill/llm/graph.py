"""Connected components of a graph in a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.llm.base import drop_written, written


#: Nodes that may count as hubs: those with more edges than the HUBS-th part of all. Their smallest neighbours are broadcast.
HUBS, HUB_EDGES = 10_000, 200


def _with_least(edges: DataFrame, least: DataFrame, number: int) -> DataFrame:
    """edges (a, b) with m of least (a, m, n: edges of a). Edges of a hub stay where they are and get its m from a broadcast of HUBS rows at
    most (no more nodes can have number / HUBS edges each); those of all other nodes are dealt by a."""
    hub = F.col("n") > max(HUB_EDGES, number // HUBS)
    hubs = F.broadcast(least.where(hub).select("a", F.col("m").alias("hub_m")))
    tagged = edges.join(hubs, "a", "left")
    rest = tagged.where("hub_m is null").select("a", "b").join(least.where(~hub).select("a", "m"), "a")
    return rest.select("a", "b", "m").union(tagged.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node reachable. Self-loops and repeated edges do no harm.

    Alternating large-star and small-star steps: every step lets each node point to the smallest node it sees, so paths shrink by
    half, and no step holds a node's neighbours in memory. Each step is written to the shared folder. No edges give no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        # Large star: the larger neighbours of each node point to the smallest of its neighbourhood.
        large = _with_least(both.where("b > a"), least, 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        # Small star: the smaller neighbours of each node, and itself, point to the smallest of them.
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = _with_least(large, low, 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "edges")
        was, state = state, _state(after)
        for table in (now, least, large, low):
            drop_written(table)
        now = after
        if was == state:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)
