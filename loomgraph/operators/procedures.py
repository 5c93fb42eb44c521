"""Procedures that ``CALL`` finds, and a registry for one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import algorithms as A
from loomgraph.operators import fulltext, vectors

Procedure = Callable[..., DataFrame]
_OWN: dict[str, tuple[Procedure, str]] = {}


class ProcedureError(ValueError):
    pass


def register(name: str, procedure: Procedure, description: str = "") -> None:
    """A procedure takes the graph and the call's arguments."""
    if name in _OWN:
        raise ProcedureError(f"procedure {name} is there already")
    _OWN[name] = (procedure, description)


def unregister(name: str) -> None:
    if _OWN.pop(name, None) is None:
        raise ProcedureError(f"no procedure {name}")


def listed(graph) -> DataFrame:
    rows = [(k, "built in") for k in BUILT_IN] + [(k, d) for k, (_, d) in _OWN.items()]
    return graph.spark.createDataFrame(rows, "name string, description string")


def call(graph, name: str, args: list) -> DataFrame:
    low = {k.lower(): v for k, v in BUILT_IN.items()}
    if name.lower() in low:
        return low[name.lower()](graph, *args)
    key = name.rsplit(".", 1)[-1] if name not in _OWN else name
    if key in _OWN:
        return _OWN[key][0](graph, *args)
    raise ProcedureError(f"no procedure {name}")


def _edges(graph, options: dict) -> DataFrame:
    queries = options.get("relationshipQuery") or []
    labels = [q["label"] for q in queries if "label" in q] or None
    out = None
    for label in labels or list(graph.edges):
        e = graph.edge(label)
        for q in queries:
            if q.get("label") == label and q.get("property_filter"):
                f = q["property_filter"]
                test = F.col(f["field"])
                e = e.where({"=": test == f["value"], ">": test > f["value"], ">=": test >= f["value"], "<": test < f["value"], "<=": test <= f["value"]}[f.get("op", "=")])
        part = e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        out = part if out is None else out.union(part)
    way = str(options.get("direction", "PointingRight")).lower()
    if "both" in way or "any" in way:
        return A.both_ways(out)
    return out.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if "left" in way else out


def shortest_path(graph, src: int, dst: int, options: dict | None = None) -> DataFrame:
    """nodeCount (0 if unreachable), totalCost, path."""
    options = options or {}
    found = A.all_shortest_paths(_edges(graph, options), src, dst, int(options.get("maxHops", 128)))
    best = found.agg(F.min("nodes").alias("path"), F.min("cost").alias("totalCost"))
    return best.select(F.coalesce(F.size("path"), F.lit(0)).alias("nodeCount"), F.coalesce("totalCost", F.lit(0.0)).alias("totalCost"), "path").select(F.greatest("nodeCount", F.lit(0)).alias("nodeCount"), "totalCost", "path")


def all_shortest(graph, src: int, dst: int, options: dict | None = None) -> DataFrame:
    options = options or {}
    found = A.all_shortest_paths(_edges(graph, options), src, dst, int(options.get("maxHops", 128)))
    return found.select(F.col("nodes").alias("nodeIds"), "cost")


def _knn(graph, label: str, field: str, vector: list, options: dict | None = None) -> DataFrame:
    o = options or {}
    found = vectors.knn(graph.vertex(label), field, vector, int(o.get("top_k", 10)), o.get("metric", "l2"))
    return found.select(F.struct(*graph.vertex(label).columns).alias("node"), "distance")


def _radius(graph, label: str, field: str, vector: list, options: dict | None = None) -> DataFrame:
    o = options or {}
    found = vectors.within_radius(graph.vertex(label), field, vector, float(o.get("radius", 0)), o.get("metric", "l2"), limit=o.get("limit"))
    return found.select(F.struct(*graph.vertex(label).columns).alias("node"), "distance")


def _jaccard(graph, a: list, b: list) -> DataFrame:
    x, y = set(a), set(b)
    return graph.spark.createDataFrame([(len(x & y) / len(x | y) if x | y else 1.0,)], "similarity double")


def _extract(graph, ids, options: dict) -> DataFrame:
    wanted = ids if isinstance(ids, list) else [ids]
    table, key = (graph.all_vertices(), "_vid") if options.get("isNode", True) else (graph.all_edges().withColumn("_uid", F.concat_ws("_", "_src", "_dst", "_lid", "_tid", "_eid")), "_uid")
    return table.where(F.col(key).isin(wanted)).select(F.col(options["field"]).alias("value"))


def _count(graph) -> DataFrame:
    return graph.counts().groupBy("kind").agg(F.sum("count").alias("count"))


BUILT_IN: dict[str, Procedure] = {
    "db.vertexLabels": lambda g: g.labels("vertex"),
    "db.edgeLabels": lambda g: g.labels("edge"),
    "db.getLabelSchema": lambda g, kind, label: g.label_schema(label),
    "db.getVertexSchema": lambda g, label: g.label_schema(label),
    "db.getEdgeSchema": lambda g, label: g.label_schema(label),
    "db.indexes": lambda g: g.spark.createDataFrame([(l.name, l.primary, True) for l in g.vertex_labels.values() if l.primary], "label string, field string, unique boolean"),
    "db.subgraph": lambda g, ids: g.subgraph(ids).pairs(),
    "db.vertexVectorKnnSearch": _knn,
    "db.vertexVectorRangeSearch": _radius,
    "db.fullTextSearch": lambda g, label, field, query, top: fulltext.search(g.vertex(label), field, query, int(top)),
    "dbms.meta.count": _count,
    "dbms.meta.countDetail": lambda g: g.counts(),
    "dbms.procedures": listed,
    "db.plugin.listPlugin": listed,
    "algo.shortestPath": shortest_path,
    "algo.allShortestPaths": all_shortest,
    "algo.pagerank": lambda g, n=20: A.pagerank(g.ids(), g.pairs(), int(n)).select(F.col("id").alias("node"), F.col("rank").alias("pr")),
    "algo.jaccard": _jaccard,
    "algo.native.extract": _extract,
    "algo.wcc": lambda g: A.wcc(g.ids(), g.pairs()),
    "algo.scc": lambda g: A.scc(g.ids(), g.pairs()),
    "algo.lpa": lambda g, n=10: A.label_propagation(g.ids(), g.pairs(), int(n)),
    "algo.louvain": lambda g: A.louvain(g.ids(), g.pairs()),
    "algo.lcc": lambda g: A.local_clustering(g.ids(), g.pairs()),
    "algo.triangle": lambda g: A.triangle_count(g.ids(), g.pairs()),
    "algo.bfs": lambda g, root: A.bfs(g.pairs(), root),
    "algo.sssp": lambda g, root, weight=None: A.sssp(g.pairs(weight=weight), root),
    "algo.kcore": lambda g, k: A.kcore(g.ids(), g.pairs(), int(k)),
}
