"""Graph sampling for training: seeded by hashes, so a rerun gives the same sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialise


def neighbours(edges: DataFrame, nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, neighbour): up to k out-neighbours of each node."""
    e = nodes.select(F.col("id").alias("src")).join(edges.select("src", "dst").distinct(), "src")
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "dst"))
    return e.withColumn("r", r).where(F.col("r") <= k).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))


def random_walks(edges: DataFrame, nodes: DataFrame, steps: int, seed: int = 0, p: float = 1.0, q: float = 1.0, walks: int = 1) -> DataFrame:
    """(id, walk, path): walks of up to ``steps`` steps. With p or q not 1 a step
    back weighs 1/p, one to a neighbour of the last vertex 1, others 1/q."""
    e = materialise(edges.select("src", "dst").distinct(), "walk-edges")
    biased = p != 1.0 or q != 1.0
    now = nodes.select("id", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.array("id").alias("path"))
    for t in range(steps):
        ahead = now.withColumn("src", F.element_at("path", -1)).join(e, "src", "left").drop("src")
        weight = F.lit(1.0)
        if biased and t > 0:
            ahead = ahead.withColumn("prev", F.element_at("path", -2))
            near = e.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("near"))
            ahead = ahead.join(near, ["prev", "dst"], "left")
            weight = F.when(F.col("dst") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
        # The least of exponential clocks with the weights as rates picks a step.
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(t), "id", "walk", "dst"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        ahead = ahead.withColumn("clock", -F.log(u) / weight)
        won = ahead.groupBy("id", "walk").agg(F.first("path").alias("path"), F.min_by("dst", F.struct("clock", "dst")).alias("dst"))
        now = materialise(won.select("id", "walk", F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("dst"))).alias("path")), "walks")
    return now


def node2vec_walks(edges: DataFrame, nodes: DataFrame, length: int, walks: int, p: float, q: float, seed: int = 0) -> DataFrame:
    return random_walks(edges, nodes, length - 1, seed, p, q, walks)


def negative_edges(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(src, dst): up to n pairs of different nodes without an edge between them.

    Pairs of hashed places are drawn from numbered nodes, four times as many as
    asked, and existing edges taken out.
    """
    ids = materialise(nodes.select("id").distinct().withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("place", F.monotonically_increasing_id()), "negative")
    per = ids.withColumn("part", F.shiftright("place", 33)).groupBy("part").count().orderBy("part").collect()
    starts, run = {}, 0
    for r in per:
        starts[r["part"]], run = run, run + r["count"]
    if run < 2:
        return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    first = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[F.shiftright("place", 33)]
    dense = ids.select("id", (first + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"))
    drawn = nodes.sparkSession.range(4 * n).select("id", F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(1)), F.lit(run)).alias("a"), F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(2)), F.lit(run)).alias("b")).withColumnRenamed("id", "draw")
    pairs = drawn.where("a <> b").join(dense.select(F.col("i").alias("a"), F.col("id").alias("src")), "a").join(dense.select(F.col("i").alias("b"), F.col("id").alias("dst")), "b")
    free = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("draw").alias("draw"))
    return free.orderBy("draw").limit(n).select("src", "dst")


def edge_sample(edges: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Each edge with the given chance, by its hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), *edges.columns), F.lit(1 << 30)) / float(1 << 30)
    return edges.where(u < rate)


def whole_graph(graph) -> tuple[DataFrame, DataFrame]:
    return graph.ids(), graph.pairs()
