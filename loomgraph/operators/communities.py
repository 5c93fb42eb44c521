"""The levels of Louvain and Leiden with the labels of all vertices at hand.

Edges lie in blocks, each of which holds all edges of its vertices; a round is
one pass over the blocks without a shuffle, in which every task gets the labels
and the communities' weights as two arrays. A graph of at most ``LOCAL_EDGES``
directed edges, as coarse ones are, is one block on the driver. The caller
counts the vertices first; results are those of the joins in ``algorithms``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialise

#: Vertices whose labels tasks get as arrays (some 50 bytes each on the driver).
VERTICES = 4_000_000
LOCAL_EDGES, BLOCK_EDGES = 1_000_000, 500_000

Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def best_moves(block: Edges, label: np.ndarray, tot: np.ndarray, k: np.ndarray, m2: float, resolution: float, down: bool) -> Edges:
    """(vertex, community, gain) of each vertex that gains by a move to a smaller (larger) label."""
    s, d, w = (x[block[0] != block[1]] for x in block)
    keys, at = np.unique(s.astype(np.int64) * len(label) + label[d], return_inverse=True)
    near = np.bincount(at, w, len(keys))
    v, c = np.divmod(keys, len(label))
    own = label[v]
    gain = near - resolution * k[v] * (tot[c] - np.where(c == own, k[v], 0.0)) / m2
    at_all, of = np.unique(v, return_inverse=True)
    stay = -resolution * k[at_all] * (tot[label[at_all]] - k[at_all]) / m2
    stay[of[c == own]] = gain[c == own]
    good = np.flatnonzero(((c < own) if down else (c > own)) & (gain > stay[of] + 1e-12))
    good = good[np.lexsort((c[good], -gain[good], v[good]))]
    v, c, gain = v[good], c[good], gain[good]
    first = np.diff(v, prepend=-1) != 0
    return v[first], c[first], gain[first]


def hooks(block: Edges, label: np.ndarray, part: np.ndarray) -> Edges:
    """(part, smaller part, 0): the least part that each touches inside its community."""
    s, d, _ = block
    a, b = part[s], part[d]
    keep = (label[s] == label[d]) & (a != b)
    a, b = np.maximum(a, b)[keep], np.minimum(a, b)[keep]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.diff(a, prepend=-1) != 0
    return a[first], b[first], np.zeros(int(first.sum()))


def coarsened(block: Edges, label: np.ndarray) -> Edges:
    """Each undirected edge once, between communities, with summed weights."""
    s, d, w = (x[block[0] <= block[1]] for x in block)
    w = np.where(s == d, w / 2, w)  # a loop counts twice in a block
    a, b = np.minimum(label[s], label[d]), np.maximum(label[s], label[d])
    keys, at = np.unique(a.astype(np.int64) * len(label) + b, return_inverse=True)
    return *np.divmod(keys, len(label)), np.bincount(at, w, len(keys))


def _arrays(t: pa.Table) -> list[np.ndarray]:
    return [c.to_numpy() for c in t.columns]


class Blocks:
    """Directed edges (both ways, loops once with double weight) between 0 and n - 1."""

    def __init__(self, spark: SparkSession, edges: DataFrame, names: np.ndarray):
        """``edges``: src, dst, weight of undirected edges between ``names``, which ascend."""
        self.spark, self.local, self.far = spark, None, None
        loop = F.col("src") == F.col("dst")
        both = edges.select("src", "dst", F.when(loop, F.col("weight") * 2).otherwise(F.col("weight")).cast("double").alias("weight"))
        both = both.union(both.where(~loop).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        n = 2 * edges.count()
        if n <= LOCAL_EDGES:
            s, d, w = _arrays(both.toArrow())
            self.local = np.searchsorted(names, s), np.searchsorted(names, d), w
            return
        known = spark.sparkContext.broadcast(names)

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                s, d, w = _arrays(pa.Table.from_batches(held))
                ends = [np.searchsorted(known.value, x).astype(np.int32).tobytes() for x in (s, d)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*ends, w.tobytes())], names=["s", "d", "w"])

        self.far = materialise(both.repartition(-(-n // BLOCK_EDGES), "src").mapInArrow(block, "s binary, d binary, w binary"), "community-blocks")
        known.unpersist()

    def each(self, kernel: Callable[..., Edges], *state) -> DataFrame | Edges:
        """The kernel's rows over all blocks; its state goes to the tasks once."""
        if self.local is not None:
            return kernel(self.local, *state)
        sent = self.spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, d, w in zip(*(c.to_pylist() for c in b.columns)):
                    a, c, x = kernel((np.frombuffer(s, np.int32), np.frombuffer(d, np.int32), np.frombuffer(w)), *sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(x, pa.float64())], names=["src", "dst", "weight"])

        return self.far.mapInArrow(run, "src long, dst long, weight double")

    def pairs(self, kernel: Callable[..., Edges], *state) -> tuple[np.ndarray, np.ndarray]:
        """Two columns of ``each``, a row per vertex at most."""
        got = self.each(kernel, *state)
        return got[:2] if isinstance(got, tuple) else tuple(_arrays(got.select("src", "dst").toArrow()))


def _connected(blocks: Blocks, label: np.ndarray) -> np.ndarray:
    """The least vertex that each is connected with inside its community."""
    part = np.arange(len(label))
    while True:
        a, b = blocks.pairs(hooks, label, part)
        if not len(a):
            return part
        np.minimum.at(part, a, b)
        while (part != part[part]).any():
            part = part[part]


def levels_of(edges: DataFrame, names: np.ndarray, k: np.ndarray, m2: float, resolution: float, levels: int, rounds: int, refine: bool) -> np.ndarray:
    """The label (one of ``names``) of each of ``names``; ``k``: their weights."""
    spark, whole, found = edges.sparkSession, names, np.arange(len(names))
    at = np.arange(len(names))  # of each vertex of this level, the vertex it is named for
    for _ in range(levels):
        blocks = Blocks(spark, edges, names)
        label, any_move = np.arange(len(names)), False
        for t in range(rounds):
            tot = np.bincount(label, k, len(label))
            v, c = blocks.pairs(best_moves, label, tot, k, m2, resolution, t % 2 == 0)
            if not len(v):
                if t % 2:
                    break
                continue
            any_move = True
            label[v] = c
        if not any_move:
            break
        if refine:
            label = _connected(blocks, label)
        up = np.unique(label)
        dense = np.searchsorted(up, label)
        found = dense[found]
        coarse = blocks.each(coarsened, label)
        if isinstance(coarse, tuple):
            coarse = spark.createDataFrame(pa.table(dict(zip(("src", "dst", "weight"), coarse))))
        edges = materialise(coarse.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "louvain")
        names, at, k = up, at[up], np.bincount(dense, k, len(up))
    return whole[at[found]]
