"""Connected components of a graph in a DataFrame: alternating large and small stars.

Every round is one grouping and one equi-join on node ids; a hub's grouping
combines on the map side, its join is split by adaptive execution.  Rounds are
stored in the shared folder and stop when a round changes nothing; their number
grows with the logarithm of the longest path.

A round costs some 1300 tasks at 211 partitions however few the edges, and the driver
keeps books on each: a graph of up to FEW_EDGES is solved in one task instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

FEW_EDGES = 1 << 20  # that one task solves: 16 MB
EDGE_ROWS = 20_000  # of an Arrow batch


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(a):
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))  # a and b are roots
        while not np.array_equal(low, further := low[low]):
            low = further
        a, b = low[a], low[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[low]


def _solved(batches):
    """node, root of a whole graph."""
    got = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches if len(b)]
    if got:
        node, root = smallest_reachable(np.concatenate([u for u, _ in got]), np.concatenate([v for _, v in got]))
        yield pd.DataFrame({"node": node[node != root], "root": root[node != root]})


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (u, v; longs) but the roots."""
    edges = stored(edges.select("u", "v").where("u <> v"))
    if edges.count() <= FEW_EDGES:
        return stored(edges.coalesce(1).mapInPandas(_solved, "node long, root long"), EDGE_ROWS)
    edges = stored(edges.distinct())
    mark = _print(edges)
    while mark[0]:
        edges = stored(_small(stored(_large(edges))))
        now = _print(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """What components gives for its edges and more ones (u, v), from what it gave for its edges alone:
    only the graph of the roots that the new edges link is solved."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = more.select("u", "v").join(at("u"), "u", "left").join(at("v"), "v", "left")
    step = components(between.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
    moved = roots.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(moved.unionByName(step))
