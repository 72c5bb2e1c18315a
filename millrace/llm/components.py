"""Connected components by alternating large-star and small-star steps over an edge table.

Each step replaces edges by edges to the smallest known neighbour; the edge set
shrinks to one star per component in a logarithmic number of rounds.  Every step
is a partially aggregated minimum and a join that leaves a hub's edges where they
are, so they never meet in one task.  Each round is checkpointed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: A node with over one part in HEAVY of all edges is a hub. There are fewer than HEAVY of these, so their list is broadcast.
HEAVY = 10_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) that keep the connectivity of the pairs a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        # hook the current labels, then the nodes, to the smaller label; then jump to the root
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local_forests(frames):
    """Contract a partition's edges, batch by batch, before any shuffle."""
    for f in frames:
        a, b = spanning_forest(f["u"].to_numpy(), f["v"].to_numpy())
        if len(a):
            yield pd.DataFrame({"u": a, "v": b})


def _beside_least(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges with m of their u; low has m and n, the edges, of each u, and total is the number of all edges."""
    hub = F.col("n") * HEAVY > total
    listed = F.broadcast(low.where(hub).select("u", "m"))
    rest = edges.join(listed, "u", "left_anti").join(low.where(~hub).select("u", "m"), "u")
    return edges.join(listed, "u").unionByName(rest)


def connected_components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """(node, component) for each node of an edge table (u, v of type long).

    contracted says that the edges come as forests of large batches already.

    component is the smallest node reachable.  Self-edges, repeated edges and
    edges in both directions are allowed; edges with a null end are ignored; an
    empty table gives an empty result.
    """
    plain = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    plain = plain.where("u != v") if contracted else plain.where("u != v").mapInPandas(_local_forests, "u long, v long")
    now = checkpointed(plain.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = _beside_least(both, low, 2 * state[0]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _beside_least(large, low, large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    tops = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
