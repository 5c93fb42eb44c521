"""Whole-graph algorithms over (src, dst[, weight]) tables.

Each round is a join and an aggregation with a written table between rounds, so
plans stay short and executors may be lost. Results are keyed by vertex id.
"""

from __future__ import annotations

import math
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.communities import VERTICES, levels_of
from loomgraph.operators.components import components
from loomgraph.plans.storage import materialise

DAMPING = 0.85


def ids_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    more = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *more).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours, both ways, without loops."""
    return both_ways(edges.select("src", "dst")).where("src <> dst").distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from the end of lower degree (ties: lower id).

    So the number of later neighbours is at most the square root of twice the
    number of edges, whatever the degrees are."""
    e = materialise(simple(edges), "simple")
    d = materialise(e.groupBy("src").agg(F.count("*").alias("d")), "degrees")
    j = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return materialise(j.where((F.col("d") < F.col("e")) | (F.col("d") == F.col("e")) & (F.col("src") < F.col("dst"))).select(F.col("src").alias("a"), F.col("dst").alias("b")), "ordered")


# -- ranking ----------------------------------------------------------------
def pagerank(ids: DataFrame, edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(id, rank). The mass of vertices without out-edges is spread evenly one round later."""
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    state = materialise(ids.join(out, ids["id"] == out["src"], "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg")), "rank-state")
    n = state.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    links = materialise(edges.select("src", "dst"), "rank-links")
    rank = materialise(state.withColumn("rank", F.lit(1.0 / n)), "rank")
    for _ in range(iterations):
        dangling = rank.where("deg = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        share = rank.where("deg > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("m"))
        got = links.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("m"))
        base = (1 - DAMPING) / n + DAMPING * dangling / n
        rank = materialise(state.join(got, "id", "left").select("id", "deg", (F.lit(base) + DAMPING * F.coalesce("m", F.lit(0.0))).alias("rank")), "rank")
    return rank.select("id", "rank")


def _spread(state: DataFrame, edges: DataFrame, weight: Column) -> DataFrame:
    """(id, m): sums over in-edges of value / out-degree times ``weight``."""
    share = state.where("deg > 0").select(F.col("id").alias("src"), (F.col("value") / F.col("deg")).alias("s"))
    return edges.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("s") * weight).alias("m"))


def _seeded(ids: DataFrame, edges: DataFrame, seeds: list, iterations: int, start: float, teleport: float, keep: float) -> DataFrame:
    edges = materialise(edges, "seeded-edges")
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    seed = F.col("id").isin(seeds)
    base = materialise(ids.join(out, ids["id"] == out["src"], "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"), F.when(seed, start).otherwise(0.0).alias("value"), F.when(seed, teleport).otherwise(0.0).alias("back")), "seeded")
    now = base
    for _ in range(iterations):
        got = _spread(now, edges, F.lit(1.0))
        now = materialise(base.join(got, "id", "left").select("id", "deg", (keep * F.coalesce("m", F.lit(0.0)) + F.col("back")).alias("value"), "back"), "seeded")
    return now.select("id", F.col("value").alias("score"))


def personalized_pagerank(ids: DataFrame, edges: DataFrame, root, iterations: int = 20) -> DataFrame:
    """(id, score); no rows if the root has no out-edge."""
    if edges.where(F.col("src") == root).limit(1).count() == 0:
        return ids.select("id", F.lit(0.0).alias("score")).limit(0)
    return _seeded(ids, edges, [root], iterations, 1.0, 1 - DAMPING, DAMPING)


def trustrank(ids: DataFrame, edges: DataFrame, trusted: list, iterations: int = 20) -> DataFrame:
    start = 1.0 / max(len(set(trusted)), 1)
    return _seeded(ids, edges, trusted, iterations, start, (1 - DAMPING) * start, DAMPING)


def sybilrank(ids: DataFrame, edges: DataFrame, seeds: list) -> DataFrame:
    """(id, score) after ceil(ln N) rounds without teleport."""
    return _seeded(ids, edges, seeds, math.ceil(math.log(max(ids.count(), 1))), 1.0, 0.0, 1.0)


def weighted_pagerank(ids: DataFrame, edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(id, rank): shares of an edge's weight in its source's total out-weight."""
    edges = materialise(edges, "wrank-edges")
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    state = materialise(ids.join(out, ids["id"] == out["src"], "left").select("id", F.coalesce("total", F.lit(0.0)).alias("deg")), "wrank")
    n = max(state.count(), 1)
    now = materialise(state.withColumn("value", F.lit(1.0 / n)), "wrank")
    for _ in range(iterations):
        dangling = now.where("deg = 0").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
        got = _spread(now, edges, F.col("weight"))
        now = materialise(state.join(got, "id", "left").select("id", "deg", (F.lit((1 - DAMPING) / n + DAMPING * dangling / n) + DAMPING * F.coalesce("m", F.lit(0.0))).alias("value")), "wrank")
    return now.select("id", F.col("value").alias("rank"))


def hits(ids: DataFrame, edges: DataFrame, iterations: int = 20, delta: float = 1e-9) -> DataFrame:
    """(id, authority, hub), each of unit length."""
    edges = materialise(edges.select("src", "dst"), "hits-edges")
    now = materialise(ids.select("id", F.lit(1.0).alias("authority"), F.lit(1.0).alias("hub")), "hits")
    for _ in range(iterations):
        a = edges.join(now.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        a = materialise(ids.join(a, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a")), "hits-a")
        norm = math.sqrt(a.agg(F.sum(F.col("a") ** 2)).first()[0] or 0) or 1.0
        a = a.withColumn("a", F.col("a") / norm)
        h = edges.join(a.select(F.col("id").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        h = materialise(a.join(h, "id", "left").select("id", "a", F.coalesce("h", F.lit(0.0)).alias("h")), "hits-h")
        norm = math.sqrt(h.agg(F.sum(F.col("h") ** 2)).first()[0] or 0) or 1.0
        after = materialise(h.select("id", F.col("a").alias("authority"), (F.col("h") / norm).alias("hub")), "hits")
        moved = after.join(now.select("id", F.col("authority").alias("a0"), F.col("hub").alias("h0")), "id").agg(F.sum(F.abs(F.col("authority") - F.col("a0")) + F.abs(F.col("hub") - F.col("h0")))).first()[0]
        now = after
        if (moved or 0.0) < delta:
            break
    return now


# -- paths ------------------------------------------------------------------
def distances(edges: DataFrame, roots: DataFrame, max_rounds: int = 1 << 20, per_root: bool = False) -> DataFrame:
    """(id, dist[, root]): least total weight (hops without a weight column) from ``roots`` (id).

    Unreached vertices have no row. Only improved vertices send messages.
    """
    edges = materialise(edges, "dist-edges")
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    keys = ["root", "id"] if per_root else ["id"]
    best = materialise(roots.select(*([F.col("id").alias("root")] if per_root else []), "id", F.lit(0.0).alias("dist")).distinct(), "dist")
    changed = best
    for _ in range(max_rounds):
        sent = changed.withColumnRenamed("id", "src").join(edges, "src").select(*([F.col("root")] if per_root else []), F.col("dst").alias("id"), (F.col("dist") + weight).alias("new"))
        sent = sent.groupBy(*keys).agg(F.min("new").alias("new"))
        merged = materialise(best.join(sent, keys, "full_outer"), "dist-merged")
        changed = merged.where("new is not null and (dist is null or new < dist)").select(*keys, F.col("new").alias("dist"))
        if changed.limit(1).count() == 0:
            return best
        best = merged.select(*keys, F.least("dist", "new").alias("dist"))
    return best


def sssp(edges: DataFrame, root) -> DataFrame:
    return distances(edges, edges.sparkSession.createDataFrame([(root,)], "id long"))


def mssp(edges: DataFrame, roots: list) -> DataFrame:
    return distances(edges, edges.sparkSession.createDataFrame([(r,) for r in roots], "id long"))


def apsp(edges: DataFrame) -> DataFrame:
    """(root, id, dist) of all reachable pairs of different vertices."""
    return distances(edges, ids_of(edges), per_root=True).where("root <> id")


def bfs(edges: DataFrame, root) -> DataFrame:
    """(id, depth, parent); the parent is the least of those one step nearer the root."""
    d = distances(edges.select("src", "dst"), edges.sparkSession.createDataFrame([(root,)], "id long"))
    near = d.select(F.col("id").alias("src"), F.col("dist").alias("before"))
    parents = edges.join(near, "src").join(d.select(F.col("id").alias("dst"), "dist"), "dst").where("before + 1 = dist").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return d.join(parents, "id", "left").select("id", F.col("dist").cast("long").alias("depth"), F.coalesce("parent", "id").alias("parent"))


def spsp(edges: DataFrame, src, dst) -> int:
    """Hops of a shortest path, -1 if there is none: two frontiers grow in turns."""
    spark = edges.sparkSession
    if src == dst:
        return 0
    e = materialise(edges.select("src", "dst").distinct(), "spsp")
    seen = [spark.createDataFrame([(v, 0)], "id long, d int") for v in (src, dst)]
    front, depth = list(seen), [0, 0]
    while True:
        i = 0 if depth[0] <= depth[1] else 1
        a, b = ("src", "dst") if i == 0 else ("dst", "src")
        new = front[i].select(F.col("id").alias(a)).join(e, a).select(F.col(b).alias("id")).distinct().join(seen[i], "id", "left_anti")
        depth[i] += 1
        front[i] = materialise(new.withColumn("d", F.lit(depth[i])), "spsp-front")
        met = front[i].join(seen[1 - i], "id").select(front[i]["d"] + seen[1 - i]["d"]).agg(F.min(F.col("(d + d)"))).first()[0]
        if met is not None:
            return int(met)
        if front[i].limit(1).count() == 0:
            return -1
        seen[i] = materialise(seen[i].union(front[i]), "spsp-seen")


def all_shortest_paths(edges: DataFrame, src, dst, max_hops: int = 128) -> DataFrame:
    """(nodes array, cost) of every shortest path by hops."""
    spark = edges.sparkSession
    e = edges.select("src", "dst")
    d = distances(e, spark.createDataFrame([(src,)], "id long"), max_hops)
    goal = d.where(F.col("id") == dst).first()
    if goal is None:
        return spark.createDataFrame([], "nodes array<long>, cost double")
    paths = spark.createDataFrame([([dst], dst)], "nodes array<long>, at long")
    layer = d.select(F.col("id").alias("src"), F.col("dist").alias("d"))
    for k in range(int(goal["dist"]) - 1, -1, -1):
        back = e.join(layer.where(F.col("d") == k), "src")
        paths = paths.join(back, paths["at"] == back["dst"]).select(F.array_prepend("nodes", F.col("src")).alias("nodes"), F.col("src").alias("at"))
    return paths.select("nodes", F.lit(float(goal["dist"])).alias("cost"))


def egonet(edges: DataFrame, root, k: int) -> int:
    """Vertices within k hops, the root included."""
    return distances(edges.select("src", "dst"), edges.sparkSession.createDataFrame([(root,)], "id long"), k).count()


def khop(edges: DataFrame, root, k: int) -> DataFrame:
    """Vertices at exactly k hops."""
    return distances(edges.select("src", "dst"), edges.sparkSession.createDataFrame([(root,)], "id long"), k).where(F.col("dist") == k).select("id")


def dimension_estimation(edges: DataFrame, roots: list) -> int:
    """Greatest depth of breadth-first searches from the roots, edges both ways."""
    found = distances(both_ways(edges.select("src", "dst")), edges.sparkSession.createDataFrame([(r,) for r in roots], "id long"), per_root=True)
    return int(found.agg(F.max("dist")).first()[0] or 0)


def closeness(edges: DataFrame, roots: list | None = None) -> DataFrame:
    """(id, score): roots that ``id`` reaches, over its summed (weighted) distance to them.

    All vertices are roots by default, which is exact and as large as all pairs.
    A vertex that reaches no root but itself has no row.
    """
    start = edges.sparkSession.createDataFrame([(r,) for r in roots], "id long") if roots is not None else ids_of(edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if "weight" in edges.columns else []))
    return distances(back, start, per_root=True).where("root <> id").groupBy("id").agg((F.count("*") / F.sum("dist")).alias("score"))


def betweenness(edges: DataFrame, roots: list | None = None) -> DataFrame:
    """(id, score): Brandes' dependencies summed over the roots (all vertices by default)."""
    e = edges.select("src", "dst")
    start = edges.sparkSession.createDataFrame([(r,) for r in roots], "id long") if roots is not None else ids_of(edges)
    d = materialise(distances(e, start, per_root=True), "bc-dist")
    deep = int(d.agg(F.max("dist")).first()[0] or 0)
    dag = e.join(d.select("root", F.col("id").alias("src"), F.col("dist").alias("a")), "src").join(d.select("root", F.col("id").alias("dst"), F.col("dist").alias("b")), ["root", "dst"]).where("a + 1 = b")
    dag = materialise(dag.select("root", "src", "dst", "b"), "bc-dag")
    sigma = materialise(d.where("dist = 0").select("root", "id", F.lit(1.0).alias("sigma"), F.lit(0.0).alias("dist")), "bc-sigma")
    for k in range(1, deep + 1):
        up = sigma.where(F.col("dist") == k - 1).select("root", F.col("id").alias("src"), "sigma")
        level = dag.where(F.col("b") == k).join(up, ["root", "src"]).groupBy("root", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        sigma = materialise(sigma.union(level.select("root", "id", "sigma", F.lit(float(k)).alias("dist"))), "bc-sigma")
    delta = sigma.select("root", "id", "dist", F.lit(0.0).alias("delta")).limit(0)
    for k in range(deep, 0, -1):
        low = sigma.where(F.col("dist") == k).join(delta.select("root", "id", "delta"), ["root", "id"], "left").select("root", F.col("id").alias("dst"), ((1 + F.coalesce("delta", F.lit(0.0))) / F.col("sigma")).alias("x"))
        up = sigma.where(F.col("dist") == k - 1).select("root", F.col("id").alias("src"), "sigma")
        level = dag.where(F.col("b") == k).join(low, ["root", "dst"]).join(up, ["root", "src"]).groupBy("root", F.col("src").alias("id")).agg(F.sum(F.col("sigma") * F.col("x")).alias("delta"))
        delta = materialise(delta.union(level.select("root", "id", F.lit(float(k - 1)).alias("dist"), "delta")), "bc-delta")
    scores = delta.where("root <> id").groupBy("id").agg(F.sum("delta").alias("score"))
    return ids_of(edges).join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


# -- components and communities --------------------------------------------
def wcc(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the weakly connected component."""
    found = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return ids.join(found, ids["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("label"))


def scc(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the strongly connected component.

    Each round colours vertices with the least id that reaches them and takes
    out, for every colour, what reaches its least vertex within the colour.
    """
    left, e = materialise(ids.select("id"), "scc-left"), materialise(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    done = None
    while left.limit(1).count():
        colour = _least_reaching(left, e)
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("label").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), "label"), "dst").where("c = label")
        inside = materialise(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-inside")
        found = distances(inside, colour.where("id = label").select("id")).select("id")
        part = materialise(colour.join(found, "id", "left_semi"), "scc-found")
        done = part if done is None else done.union(part)
        left = materialise(left.join(part, "id", "left_anti"), "scc-left")
        e = materialise(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc-edges")
    return done if done is not None else ids.select("id", F.col("id").alias("label"))


def _least_reaching(ids: DataFrame, edges: DataFrame) -> DataFrame:
    now = materialise(ids.select("id", F.col("id").alias("label")), "least")
    while True:
        got = edges.join(now.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        after = materialise(now.join(got, "id", "left").select("id", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "least")
        now = after.select("id", "label")
        if after.where("moved").limit(1).count() == 0:
            return now


def _modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of undirected edges with ``weight``."""
    both = both_ways(edges.select("src", "dst", "weight"))
    m2 = both.agg(F.sum("weight")).first()[0]
    if not m2:
        return 0.0
    j = both.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    per = j.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("t"))
    return float(per.agg(F.sum(F.col("i") / m2 - (F.col("t") / m2) ** 2)).first()[0])


def _weighted(edges: DataFrame) -> DataFrame:
    return edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    return _modularity(_weighted(edges), labels)


def label_propagation(ids: DataFrame, edges: DataFrame, iterations: int = 10, own: bool = True) -> DataFrame:
    """(id, label): the label with most weight around (own counts once); ties to the smallest."""
    e = materialise(both_ways(_weighted(edges).select("src", "dst", "weight")), "lpa")
    now = materialise(ids.select("id", F.col("id").alias("label")), "lpa-labels")
    best = Window.partitionBy("id").orderBy(F.desc("w"), "label")
    for _ in range(iterations):
        votes = e.join(now.select(F.col("id").alias("src"), "label"), "src").select(F.col("dst").alias("id"), "label", F.col("weight").alias("w"))
        if own:
            votes = votes.union(now.select("id", "label", F.lit(1.0)))
        won = votes.groupBy("id", "label").agg(F.sum("w").alias("w")).withColumn("r", F.row_number().over(best)).where("r = 1").select("id", F.col("label").alias("new"))
        after = materialise(now.join(won, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "lpa-labels")
        now = after.select("id", "label")
        if after.where("moved").limit(1).count() == 0:
            break
    return now


def weighted_label_propagation(ids: DataFrame, edges: DataFrame, iterations: int = 10) -> DataFrame:
    return label_propagation(ids, edges, iterations, own=False)


def speaker_listener(ids: DataFrame, edges: DataFrame, iterations: int = 10, threshold: int = 2, seed: int = 0) -> DataFrame:
    """(id, labels): labels heard at least ``threshold`` times. Each round every
    neighbour speaks a label drawn from its memory; draws are seeded."""
    e = materialise(simple(edges), "slpa")
    memory = materialise(ids.select("id", F.col("id").alias("label"), F.lit(0).alias("t")), "slpa-memory")
    for t in range(1, iterations + 1):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(t), "src", "dst"), F.lit(t)).cast("int")
        said = e.withColumn("t", draw).join(memory.select(F.col("id").alias("src"), "label", "t"), ["src", "t"]).groupBy(F.col("dst").alias("id"), "label").count()
        won = said.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), F.xxhash64(F.lit(seed + t), "label")))).where("r = 1")
        heard = ids.join(won.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), F.lit(t).alias("t"))
        memory = materialise(memory.union(heard), "slpa-memory")
    kept = memory.groupBy("id", "label").count().where(F.col("count") >= threshold)
    return ids.join(kept.groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels")), "id", "left").select("id", F.coalesce("labels", F.array().cast("array<long>")).alias("labels"))


def _louvain_at_hand(ids: DataFrame, e: DataFrame, resolution: float, levels: int, rounds: int, refine: bool) -> DataFrame | None:
    """``louvain`` over edges between whole numbers, if the vertices are few enough to hold their labels."""
    kinds = dict(e.dtypes)
    if {kinds["src"], kinds["dst"]} - {"int", "bigint"} or kinds["weight"] not in ("int", "bigint", "float", "double"):
        return None
    e = e.select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight").where("src is not null and dst is not null")
    both = both_ways(e)  # a loop comes twice, as it counts
    k = materialise(both.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight").cast("double")).alias("k")), "louvain-k")
    n, m2 = k.agg(F.count("*"), F.sum("k")).first()
    odd = F.col("weight").isNull() | ~(F.abs(F.col("weight").cast("double")) < float("inf"))
    if not n or n > VERTICES or not m2 or not math.isfinite(m2) or e.where(odd).limit(1).count():
        return None
    names, weights = (c.to_numpy() for c in k.orderBy("id").toArrow().columns)
    labels = levels_of(e, names, weights, m2, resolution, levels, rounds, refine)
    rows = ids.sparkSession.createDataFrame(pa.table({"name": names, "label": labels}))
    own = F.coalesce(F.col("label"), F.col("id")).cast(ids.schema["id"].dataType)
    return materialise(ids.select("id").join(rows, F.col("id") == F.col("name"), "left").select("id", own.alias("label")), "louvain-labels")


def louvain(ids: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 10, refine: bool = False) -> DataFrame:
    """(id, label): greedy modularity moves, then coarsening, until nothing moves.

    In a round a vertex moves to the neighbouring community of best gain, ties
    to the smaller label; moves run towards smaller labels in even rounds and
    larger ones in odd rounds, so that two vertices never swap for ever.
    """
    e = materialise(_weighted(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "louvain")
    if (found := _louvain_at_hand(ids, e, resolution, levels, rounds, refine)) is not None:
        return found
    total = materialise(ids.select("id", F.col("id").alias("label")), "louvain-labels")
    for _ in range(levels):
        both = materialise(both_ways(e.where("src <> dst")).union(e.where("src = dst").select("src", "dst", F.col("weight") * 2)), "louvain-both")
        m2 = both.agg(F.sum("weight")).first()[0]
        if not m2:
            return total
        k = materialise(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "louvain-k")
        now, any_move = materialise(k.select("id", F.col("id").alias("label")), "louvain-now"), False
        for t in range(rounds):
            kl = k.join(now, "id")
            tot = kl.groupBy("label").agg(F.sum("k").alias("tot"))
            near = both.where("src <> dst").join(now.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
            own = kl.select("id", "k", F.col("label").alias("own"))
            cand = near.join(own, "id").join(tot, "label").join(tot.select(F.col("label").alias("own"), F.col("tot").alias("own_tot")), "own")
            gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
            scored = cand.withColumn("g", gain)
            stay = scored.where("label = own").select("id", F.col("g").alias("g0"))
            alone = -resolution * F.col("k") * (F.col("own_tot") - F.col("k")) / m2
            way = F.col("label") < F.col("own") if t % 2 == 0 else F.col("label") > F.col("own")
            moves = scored.where(way).join(stay, "id", "left").where(F.col("g") > F.coalesce("g0", alone) + 1e-12)
            moves = moves.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("g"), "label"))).where("r = 1").select("id", F.col("label").alias("new"))
            moves = materialise(moves, "louvain-moves")
            if moves.limit(1).count() == 0:
                if t % 2:
                    break
                continue
            any_move = True
            now = materialise(now.join(moves, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "louvain-now")
        if not any_move:
            return total
        if refine:  # communities must be connected: each takes the components inside it
            inside = e.join(now.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(now.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
            now = materialise(wcc(now.select("id"), inside.select("src", "dst")), "louvain-refined")
        total = materialise(total.join(now.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left").select("id", F.coalesce("new", "label").alias("label")), "louvain-labels")
        e = e.join(now.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(now.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        e = materialise(e.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain")
    return total


def leiden(ids: DataFrame, edges: DataFrame, gamma: float = 0.2, levels: int = 10) -> DataFrame:
    """(id, label): as Louvain with resolution ``gamma``; communities are split into
    connected ones before each coarsening."""
    return louvain(ids, edges, gamma, levels, refine=True)


# -- local structure --------------------------------------------------------
def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): every triangle of the undirected simple graph once."""
    o = _ordered(edges)
    wedge = o.select("a", "b").join(o.select("a", F.col("b").alias("c")), "a").where("b <> c")
    return wedge.join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangle_count(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, triangles)."""
    found = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


fast_triangle_count = triangle_count


def local_clustering(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score)."""
    d = simple(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    score = F.when(F.col("d") >= 2, 2 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return triangle_count(ids, edges).join(d, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def _around(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both degrees and the number of shared neighbours."""
    e = simple(edges)
    d = e.groupBy("src").agg(F.count("*").alias("d"))
    shared = pairs.join(e.select(F.col("src").alias("a"), F.col("dst").alias("x")), "a").join(e.select(F.col("src").alias("b"), F.col("dst").alias("x")), ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    out = pairs.join(d.select(F.col("src").alias("a"), F.col("d").alias("da")), "a", "left").join(d.select(F.col("src").alias("b"), F.col("d").alias("db")), "b", "left").join(shared, ["a", "b"], "left")
    return out.select("a", "b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("da", "db", "n")))


def jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity); 1 if both have no neighbour, 0 if one has none."""
    union = F.col("da") + F.col("db") - F.col("n")
    return _around(edges, pairs).select("a", "b", F.when(union == 0, 1.0).otherwise(F.col("n") / union).alias("similarity"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return _around(edges, pairs).select("a", "b", F.col("n").alias("common"))


def degree_correlation(edges: DataFrame) -> float:
    """Pearson correlation of the out-degrees of edges' ends."""
    d = edges.groupBy("src").agg(F.count("*").cast("double").alias("d"))
    j = edges.select("src", "dst").join(d.select("src", F.col("d").alias("x")), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("y")), "dst", "left")
    return j.agg(F.corr("x", F.coalesce("y", F.lit(0.0)))).first()[0]


def kcore(ids: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, in_core)."""
    e = materialise(simple(edges), "kcore")
    while True:
        low = materialise(e.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") < k).select("src"), "kcore-low")
        if low.limit(1).count() == 0:
            break
        e = materialise(e.join(low, "src", "left_anti").join(low.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"), "kcore")
    core = e.select(F.col("src").alias("id")).distinct().withColumn("in_core", F.lit(True)) if k > 0 else ids.withColumn("in_core", F.lit(True))
    return ids.join(core, "id", "left").select("id", F.coalesce("in_core", F.lit(False)).alias("in_core"))


def ktruss(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst): edges, once each, that lie in at least k - 2 triangles of what remains."""
    e = materialise(simple(edges).where("src < dst"), "ktruss")
    while True:
        t = triangles(e)
        sides = t.select(F.explode(F.array(*(F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))).alias("s")).select("s.*")
        support = sides.groupBy("src", "dst").agg(F.count("*").alias("n"))
        after = materialise(e.join(support, ["src", "dst"], "left").where(F.coalesce("n", F.lit(0)) >= k - 2).select("src", "dst"), "ktruss")
        if after.count() == e.count():
            return after
        e = after


def kcliques(edges: DataFrame, k: int) -> DataFrame:
    """(id, cliques): cliques of k vertices that hold ``id``; a vertex without one has no row."""
    o = _ordered(edges)
    found = o.select(F.array("a", "b").alias("c"))
    for size in range(2, k):
        grown = found.withColumn("last", F.element_at("c", -1)).join(o.select(F.col("a").alias("last"), F.col("b").alias("x")), "last")
        for i in range(size - 1):
            grown = grown.withColumn("y", F.get("c", F.lit(i))).join(o.select(F.col("a").alias("y"), F.col("b").alias("x")), ["y", "x"])
        found = materialise(grown.select(F.array_append("c", F.col("x")).alias("c")), "kcliques")
    return found.select(F.explode("c").alias("id")).groupBy("id").agg(F.count("*").alias("cliques"))


def subgraph_isomorphism(ids: DataFrame, edges: DataFrame, pattern: list[list[int]]) -> DataFrame:
    """(v0, v1, ...): injective maps of the query graph (``pattern[i]`` lists the
    targets of query vertex i) that keep its edges."""
    e = materialise(edges.select("src", "dst").distinct(), "iso")
    n = len(pattern)
    found, placed = ids.select(F.col("id").alias("v0")), 1
    for i in range(1, n):
        ins, outs = [j for j in range(i) if i in pattern[j]], [j for j in range(i) if j in pattern[i]]
        if ins:
            found = found.join(e.select(F.col("src").alias(f"v{ins[0]}"), F.col("dst").alias(f"v{i}")), f"v{ins[0]}")
            ins = ins[1:]
        elif outs:
            found = found.join(e.select(F.col("dst").alias(f"v{outs[0]}"), F.col("src").alias(f"v{i}")), f"v{outs[0]}")
            outs = outs[1:]
        else:
            raise ValueError(f"query vertex {i} has no edge to an earlier one")
        for j in ins:
            found = found.join(e.select(F.col("src").alias(f"v{j}"), F.col("dst").alias(f"v{i}")), [f"v{j}", f"v{i}"], "left_semi")
        for j in outs:
            found = found.join(e.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{j}")), [f"v{i}", f"v{j}"], "left_semi")
        for j in range(i):
            found = found.where(F.col(f"v{j}") != F.col(f"v{i}"))
        placed += 1
    return found.select(*(f"v{i}" for i in range(placed)))


def locate_cycles(edges: DataFrame, k: int) -> int:
    """Simple directed cycles of k vertices; parallel edges multiply."""
    e = edges.select("src", "dst").groupBy("src", "dst").agg(F.count("*").alias("m"))
    paths = e.where("src < dst" if k > 1 else "src = dst").select(F.array("src", "dst").alias("p"), "m")
    if k == 1:
        return int(paths.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("x"), F.col("m").alias("m2"))
    for _ in range(k - 2):
        paths = paths.withColumn("last", F.element_at("p", -1)).join(step, "last").where((F.col("x") > F.get("p", F.lit(0))) & ~F.array_contains("p", F.col("x"))).select(F.array_append("p", F.col("x")).alias("p"), (F.col("m") * F.col("m2")).alias("m"))
    closed = paths.withColumn("last", F.element_at("p", -1)).withColumn("x", F.get("p", F.lit(0))).join(step, ["last", "x"])
    return int(closed.agg(F.coalesce(F.sum(F.col("m") * F.col("m2")), F.lit(0))).first()[0])


def motif(edges: DataFrame, roots: list, k: int) -> DataFrame:
    """(code, count): connected sets of k vertices around each root by shape.

    A shape's code has bit i*k+j for an edge i to j and is the least over all
    orders of the vertices; a set counts once for each root in it."""
    spark = edges.sparkSession
    e = materialise(edges.select("src", "dst").where("src <> dst").distinct(), "motif")
    near = materialise(simple(e), "motif-near")
    sets = spark.createDataFrame([(r, [r]) for r in roots], "root long, s array<long>")
    for _ in range(k - 1):
        grown = sets.withColumn("src", F.explode("s")).join(near, "src").where(~F.array_contains("s", F.col("dst")))
        sets = materialise(grown.select("root", F.sort_array(F.array_append("s", F.col("dst"))).alias("s")).distinct(), "motif-sets")
    places = sets.select("root", "s", F.posexplode("s").alias("i", "src"))
    inner = places.join(e, "src").where(F.array_contains("s", F.col("dst"))).select("root", "s", "i", (F.array_position("s", F.col("dst")) - 1).alias("j"))
    shaped = inner.groupBy("root", "s").agg(F.collect_set(F.struct("i", "j")).alias("e"))

    def code(order: tuple[int, ...]) -> Column:
        spots = F.array(*(F.lit(x).cast("long") for x in order))
        return F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + F.pow(F.lit(2.0), F.get(spots, x["i"].cast("int")) * k + F.get(spots, x["j"].cast("int"))).cast("long"))

    codes = [code(p) for p in permutations(range(k))]
    return shaped.select((F.least(*codes) if len(codes) > 1 else codes[0]).alias("code")).groupBy("code").agg(F.count("*").alias("count"))


def maximal_independent_set(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, chosen): in each round the vertices smaller than all open neighbours."""
    e = materialise(simple(edges), "mis")
    left = materialise(ids.select("id"), "mis-left")
    chosen = None
    while left.limit(1).count():
        least = e.groupBy("src").agg(F.min("dst").alias("m"))
        won = materialise(left.join(least, left["id"] == least["src"], "left").where("m is null or id < m").select("id"), "mis-won")
        chosen = won if chosen is None else chosen.union(won)
        out = materialise(e.join(won.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).union(won).distinct(), "mis-out")
        left = materialise(left.join(out, "id", "left_anti"), "mis-left")
        e = materialise(e.join(out.select(F.col("id").alias("src")), "src", "left_anti").join(out.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "mis")
    flags = (chosen if chosen is not None else ids.limit(0)).withColumn("chosen", F.lit(True))
    return ids.join(flags, "id", "left").select("id", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def belief_propagation(ids: DataFrame, edges: DataFrame, iterations: int = 5, coupling: float = 0.6) -> DataFrame:
    """(id, belief) of two states by log-odds messages; ``ids`` has ``prior`` in (0, 1)."""
    e = materialise(simple(edges), "bp")
    logit = F.log(F.col("prior") / (1 - F.col("prior")))
    base = materialise(ids.select("id", logit.alias("h")), "bp-base")
    messages = materialise(e.select("src", "dst", F.lit(0.0).alias("m")), "bp-m")
    for _ in range(iterations):
        inbox = messages.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("t"))
        field_ = base.join(inbox, "id", "left").select(F.col("id").alias("src"), (F.col("h") + F.coalesce("t", F.lit(0.0))).alias("f"))
        back = messages.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("m").alias("back"))
        x = F.tanh((F.col("f") - F.col("back")) / 2) * (2 * coupling - 1)
        messages = materialise(e.join(field_, "src").join(back, ["src", "dst"]).select("src", "dst", F.log((1 + x) / (1 - x)).alias("m")), "bp-m")
    inbox = messages.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("t"))
    return base.join(inbox, "id", "left").select("id", (1 / (1 + F.exp(-(F.col("h") + F.coalesce("t", F.lit(0.0)))))).alias("belief"))
