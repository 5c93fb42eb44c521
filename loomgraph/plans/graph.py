"""A property graph as typed vertex and edge DataFrames.

Vertices of a label have ``_vid`` (unique in the graph) and their properties;
edges have ``_src``, ``_dst``, ``_eid``, ``_tid`` and theirs. Updates give a new
graph, as tables do not change in place.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialise

VERTEX_COLUMNS = ("_vid",)
EDGE_COLUMNS = ("_src", "_dst", "_eid", "_tid")


class SchemaError(ValueError):
    """A label, property or constraint that the schema does not have."""


@dataclass(frozen=True)
class VertexLabel:
    name: str
    primary: str | None = None
    unique: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeLabel:
    name: str
    #: Allowed (source label, target label) pairs; empty allows all.
    constraints: tuple[tuple[str, str], ...] = ()
    temporal: str | None = None


@dataclass(frozen=True)
class Graph:
    """Labels are numbered in the order of the mappings."""

    vertices: Mapping[str, DataFrame]
    edges: Mapping[str, DataFrame]
    vertex_labels: Mapping[str, VertexLabel] = field(default_factory=dict)
    edge_labels: Mapping[str, EdgeLabel] = field(default_factory=dict)
    #: (label, field) -> long table of ``element``, ``ts`` and measures.
    series: Mapping[tuple[str, str], DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return next(iter([*self.vertices.values(), *self.edges.values()])).sparkSession

    # -- schema -------------------------------------------------------------
    def vertex(self, label: str) -> DataFrame:
        if label not in self.vertices:
            raise SchemaError(f"no vertex label {label}")
        return self.vertices[label]

    def edge(self, label: str) -> DataFrame:
        if label not in self.edges:
            raise SchemaError(f"no edge label {label}")
        return self.edges[label]

    def edge_label_id(self, label: str) -> int:
        return list(self.edges).index(label)

    def properties(self, label: str) -> list[str]:
        df = self.vertices.get(label, self.edges.get(label))
        if df is None:
            raise SchemaError(f"no label {label}")
        return [c for c in df.columns if c not in VERTEX_COLUMNS + EDGE_COLUMNS]

    def label_schema(self, label: str) -> DataFrame:
        """A row per property: name, type, optional."""
        df = self.vertices.get(label, self.edges.get(label))
        if df is None:
            raise SchemaError(f"no label {label}")
        rows = [(f.name, f.dataType.simpleString().upper(), f.nullable) for f in df.schema if f.name in self.properties(label)]
        return self.spark.createDataFrame(rows, "name string, type string, optional boolean")

    def labels(self, kind: str = "vertex") -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in (self.vertices if kind == "vertex" else self.edges)], "label string")

    def inferred_sources(self, edge: str) -> list[str] | None:
        """Vertex labels an edge label may start from; None if any."""
        pairs = self.edge_labels[edge].constraints if edge in self.edge_labels else ()
        return sorted({a for a, _ in pairs}) or None

    # -- construction -------------------------------------------------------
    @staticmethod
    def empty() -> Graph:
        return Graph({}, {})

    def with_vertices(self, label: str, df: DataFrame, primary: str | None = None, unique: tuple[str, ...] = ()) -> Graph:
        """Add or replace a vertex label. Rows without ``_vid`` are numbered past
        the graph's greatest id and written down, so the numbers stay."""
        if "_vid" not in df.columns:
            df = materialise(df.withColumn("_vid", F.monotonically_increasing_id() + self.top_id() + 1), "vertices")
        return replace(self, vertices={**self.vertices, label: df}, vertex_labels={**self.vertex_labels, label: VertexLabel(label, primary, unique)})

    def with_edges(self, label: str, df: DataFrame, constraints: tuple[tuple[str, str], ...] = (), temporal: str | None = None) -> Graph:
        """Add or replace an edge label; missing ``_eid`` and ``_tid`` are filled in."""
        if "_tid" not in df.columns:
            df = df.withColumn("_tid", F.lit(0).cast("long"))
        if "_eid" not in df.columns:
            df = df.withColumn("_eid", (F.row_number().over(Window.partitionBy("_src", "_dst").orderBy(*[c for c in df.columns if c not in ("_src", "_dst", "_tid")] or [F.lit(0)])) - 1).cast("long"))
        return replace(self, edges={**self.edges, label: df}, edge_labels={**self.edge_labels, label: EdgeLabel(label, tuple(constraints), temporal)})

    def link(self, label: str, df: DataFrame, src: tuple[str, str, str], dst: tuple[str, str, str], **kw) -> Graph:
        """Edges from a table of keys: ``src`` and ``dst`` are (column, label, property)."""
        out = df
        for column, end in ((src, "_src"), (dst, "_dst")):
            name, vertex, key = column
            ids = self.vertex(vertex).select(F.col(key).alias(f"{end}_key"), F.col("_vid").alias(end))
            out = out.join(ids, out[name] == F.col(f"{end}_key")).drop(f"{end}_key")
        keep = [c for c in out.columns if c not in (src[0], dst[0])]
        return self.with_edges(label, out.select(*keep), ((src[1], dst[1]),), **kw)

    # -- tables -------------------------------------------------------------
    def all_vertices(self, labels: list[str] | None = None) -> DataFrame:
        """Vertices of several labels with ``_label``; absent properties are null."""
        out = None
        for name in labels if labels is not None else self.vertices:
            part = self.vertex(name).withColumn("_label", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise SchemaError("the graph has no vertex label")
        return out

    def all_edges(self, labels: list[str] | None = None) -> DataFrame:
        out = None
        for name in labels if labels else self.edges:
            part = self.edge(name).withColumn("_label", F.lit(name)).withColumn("_lid", F.lit(self.edge_label_id(name)))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise SchemaError("the graph has no edge label")
        return out

    def pairs(self, labels: list[str] | None = None, weight: str | None = None) -> DataFrame:
        """(src, dst[, weight]) of the edges, as the algorithms take them."""
        e = self.all_edges(labels)
        return e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *([F.col(weight).cast("double").alias("weight")] if weight else []))

    def top_id(self) -> int:
        """The greatest vertex id, -1 if there is none."""
        tops = [v.agg(F.max("_vid")).first()[0] for v in self.vertices.values()]
        return max((t for t in tops if t is not None), default=-1)

    def ids(self, labels: list[str] | None = None) -> DataFrame:
        return self.all_vertices(labels).select(F.col("_vid").alias("id"))

    # -- updates ------------------------------------------------------------
    def insert_vertices(self, label: str, rows: DataFrame) -> Graph:
        primary = self.vertex_labels[label].primary if label in self.vertex_labels else None
        if primary and rows.select(primary).unionByName(self.vertex(label).select(primary)).groupBy(primary).count().where("count > 1").limit(1).count():
            raise SchemaError(f"{label}.{primary} is not unique")
        return replace(self, vertices={**self.vertices, label: self.vertex(label).unionByName(rows, allowMissingColumns=True)})

    def insert_edges(self, label: str, rows: DataFrame) -> Graph:
        return replace(self, edges={**self.edges, label: self.edge(label).unionByName(rows, allowMissingColumns=True)})

    def set_properties(self, label: str, where: Column, values: Mapping[str, Column]) -> Graph:
        """SET: new values where the condition holds."""
        kind = "vertices" if label in self.vertices else "edges"
        df = getattr(self, kind)[label]
        for name in values:
            if (label, name) in self.series:
                raise SchemaError(f"{name} is a series field; use the series functions")
            if name not in df.columns:
                raise SchemaError(f"{label} has no property {name}")
        df = df.withColumns({k: F.when(where, v).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, v in values.items()})
        return replace(self, **{kind: {**getattr(self, kind), label: df}})

    def remove_properties(self, label: str, where: Column, names: list[str]) -> Graph:
        return self.set_properties(label, where, {n: F.lit(None) for n in names})

    def delete_vertices(self, label: str, where: Column) -> Graph:
        """DELETE with the edges at the vertices."""
        df = self.vertex(label)
        gone = df.where(where).select(F.col("_vid").alias("_gone"))
        edges = {k: e.join(gone, e["_src"] == F.col("_gone"), "left_anti").join(gone, e["_dst"] == F.col("_gone"), "left_anti") for k, e in self.edges.items()}
        return replace(self, vertices={**self.vertices, label: df.where(~F.coalesce(where, F.lit(False)))}, edges=edges)

    def delete_edges(self, label: str, where: Column) -> Graph:
        return replace(self, edges={**self.edges, label: self.edge(label).where(~F.coalesce(where, F.lit(False)))})

    def merge_vertices(self, label: str, rows: DataFrame, key: str, on_create: Mapping[str, Column] | None = None, on_match: Mapping[str, Column] | None = None) -> Graph:
        """MERGE on ``key``: rows not there are created, the others updated."""
        old = self.vertex(label)
        new = rows.dropDuplicates([key])
        seen = old.join(new.select(F.col(key).alias("_key")), old[key] == F.col("_key"), "left").withColumn("_hit", F.col("_key").isNotNull())
        for name, value in (on_match or {}).items():
            seen = seen.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)).cast(old.schema[name].dataType))
        fresh = new.join(old.select(F.col(key)), key, "left_anti").withColumns(dict(on_create or {}))
        fresh = materialise(fresh.withColumn("_vid", F.monotonically_increasing_id() + self.top_id() + 1), "vertices")
        return replace(self, vertices={**self.vertices, label: seen.drop("_key", "_hit").unionByName(fresh.select(*[c for c in fresh.columns if c in old.columns]), allowMissingColumns=True)})

    def subgraph(self, ids: list[int]) -> Graph:
        """Given vertices and the edges among them."""
        return replace(
            self,
            vertices={k: v.where(F.col("_vid").isin(ids)) for k, v in self.vertices.items()},
            edges={k: e.where(F.col("_src").isin(ids) & F.col("_dst").isin(ids)) for k, e in self.edges.items()},
        )

    def counts(self) -> DataFrame:
        """A row per label: kind, label, count."""
        out = None
        for kind, tables in (("vertex", self.vertices), ("edge", self.edges)):
            for name, df in tables.items():
                part = df.agg(F.count("*").alias("count")).select(F.lit(kind).alias("kind"), F.lit(name).alias("label"), "count")
                out = part if out is None else out.union(part)
        return out

    # -- queries ------------------------------------------------------------
    def cypher(self, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
        from loomgraph.plans.cypher import run

        return run(self, text, dict(params or {}))

    gql = cypher

    def execute(self, text: str, params: Mapping[str, object] | None = None) -> tuple[Graph, DataFrame]:
        """Run text that may change data: the new graph and what RETURN gives, or a summary."""
        from loomgraph.plans.cypher import execute

        return execute(self, text, dict(params or {}))
