"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation (combined before the shuffle) and an equi-join
between two saved tables, so a hub vertex is split by the skew join and never
gathered in one task.  Labels never reach the driver; it sees one row of
counters per round.

A round is some nine exchanges, and each of them costs the driver a thread and
a plan.  A caller that labels again and again can have as many edges as one
task holds with ease labelled there, without any exchange; more take rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


ONE_TASK = 1 << 20  # edges: 16 MB as two longs


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (sorted) and the smallest node reachable from each, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(i):
        # the root of either end goes below that of the other one
        x, y = up[i], up[j]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (top := up[up])).any():
            up = top
        different = up[i] != up[j]
        i, j = i[different], j[different]
    return nodes, nodes[up]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if ends:
        node, component = forest(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        for i in range(0, len(node), 10_000):
            yield pa.record_batch([pa.array(node[i : i + 10_000]), pa.array(component[i : i + 10_000])], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, rows: int | None = None, one_task: int = 0) -> DataFrame:
    """Columns ``node`` and ``component`` (smallest node reachable) for every node with an edge.

    Self-loops, repeated edges and either direction are allowed; null ends are
    ignored.  Rounds grow with the logarithm of the longest path; if
    ``max_rounds`` is ever reached this raises instead of returning labels
    that are not final.  ``rows``: number of edges, if known; no table of the
    loop holds more than twice as many.  Up to ``one_task`` of them (ends are
    longs) are labelled in one task, which reads ``edges`` as it is: it should
    be a saved table.
    """
    spark, old = edges.sparkSession, []
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    if rows is not None and rows <= one_task:
        return pair.coalesce(1).mapInArrow(_whole, "node long, component long")
    star = saved(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), old, rows)
    twice = None if rows is None else 2 * rows
    for _ in range(max_rounds):
        # star holds (larger, smaller) pairs
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.when(F.col("v") < F.col("u"), 1)).alias("less"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("more"))
        mine: list[str] = []
        near = saved(near, mine, twice)
        open_nodes = near.where("less > 1 or (less = 1 and more > 0)").limit(1).count()
        if not open_nodes:
            break
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        low = near.select("u", F.least("u", "low").alias("m"))
        large = saved(star.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), mine, rows)
        # small star: u and its smaller neighbours move to the smallest of them
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), mine, rows)
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after: list[str] = []
        star = saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), after, twice)
        drop_saved(spark, old + mine)
        old = after
    else:
        raise RuntimeError(f"components still open after {max_rounds} rounds")
    heads = near.where("less = 0").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
