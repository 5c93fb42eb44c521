"""Connected components: in one task up to a checked size, else by alternating large-star and small-star steps.

A graph of at most ``SOLO_EDGES`` edges is 16 MB and costs one job instead of
dozens of shuffles; the result is the same either way. Beyond that size
every step is a join of written tables and an aggregation that combines before
it shuffles; nothing gathers a component in one place. Hubs are no problem: the
written tables let adaptive execution split the join at a hot vertex, and
minima of neighbours combine on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialise

#: Edges that one task may join up.
SOLO_EDGES = 1_000_000


def smallest_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of the places 0 to n - 1 that each place is connected with."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label


def _solo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b.to_numpy(np.int64) for b in batches if len(b)]
    if held:
        nodes, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pd.DataFrame({"node": nodes, "component": nodes[smallest_labels(len(nodes), at[:, 0], at[:, 1])]})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours of each vertex u to the least vertex m around u.

    Large star: its larger neighbours. Small star: its smaller ones and u itself.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    found = both.join(least, "u")
    if large:
        out = found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # edges run from the larger u to the smaller v
        out = found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60, solo: int = SOLO_EDGES) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (columns u, v).

    ``component`` is the least vertex id reachable. Self-loops alone and null
    ends give no row. Raises if ``max_rounds`` rounds do not settle it; a round
    at least halves the depth, so 60 are enough for any graph in practice.
    """
    spark = edges.sparkSession
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges"
    )
    if now.count() <= solo:
        return now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInPandas(_solo, "node long, component long")
    before = None
    for _ in range(max_rounds):
        # Settled once every vertex has one edge, to a vertex that has none of its own.
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = seen
        large = materialise(_star(now, True), "star-large")
        now = materialise(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "star-small")
    raise RuntimeError("components did not settle")
