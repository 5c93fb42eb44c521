"""Import by a schema description, export, and edge lists."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialise
from loomgraph.plans.graph import Graph, SchemaError

#: Type names of a schema description.
TYPES = {
    "BOOL": "boolean", "INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT64": "bigint", "FLOAT": "float", "DOUBLE": "double",
    "DATE": "date", "DATETIME": "timestamp_ntz", "STRING": "string", "BLOB": "binary", "FLOAT_VECTOR": "array<float>",
}


def _value(raw: Column, kind: str, strict: bool) -> Column:
    kind = kind.upper()
    if kind not in TYPES:
        raise SchemaError(f"unknown type {kind}")
    if kind == "STRING":
        return raw
    if kind == "BLOB":
        return F.unbase64(raw)
    if kind == "FLOAT_VECTOR":
        return F.transform(F.split(F.regexp_replace(raw, r"[\[\]\s]", ""), ","), lambda x: x.cast("float"))
    empty = F.when(F.trim(raw) == "", None).otherwise(F.trim(raw))
    return empty.cast(TYPES[kind]) if strict else empty.try_cast(TYPES[kind])


def read_csv(spark: SparkSession, path: str, columns: list[str], separator: str = ",", header: int = 0) -> DataFrame:
    """String columns; ``header`` lines at the head of each file are left out."""
    names = [f"c{i}" for i in range(len(columns))]
    df = spark.read.csv(path, sep=separator, schema=", ".join(f"{n} string" for n in names), quote='"', escape='"', multiLine=False, header=header == 1)
    if header > 1:
        raise SchemaError("a CSV file has one header line at most")
    return df.select(*(F.col(n).alias(c) for n, c in zip(names, columns) if c != "SKIP"))


def read_json_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One JSON array per line."""
    row = F.from_json("value", "array<string>")
    df = spark.read.text(path).select(row.alias("r"))
    return df.select(*(F.get("r", F.lit(i)).alias(c) for i, c in enumerate(columns) if c != "SKIP"))


def import_graph(spark: SparkSession, config: Mapping | str, continue_on_error: bool = False) -> tuple[Graph, DataFrame | None]:
    """(graph, rejected rows) from ``{"schema": [...], "files": [...]}``.

    Without ``continue_on_error`` a vertex value that does not fit its type raises
    at once, an edge value or an edge end that does not exist when the graph is
    read; with it such rows go
    to the second result: (label, row, reason).
    """
    conf = json.loads(config) if isinstance(config, str) else config
    schema = {s["label"]: s for s in conf["schema"]}
    graph, rejected = Graph.empty(), None

    def load(f: Mapping) -> DataFrame:
        if f["format"].upper() == "CSV":
            return read_csv(spark, f["path"], f["columns"], f.get("separator", ","), int(f.get("header", 0)))
        return read_json_lines(spark, f["path"], f["columns"])

    def reject(df: DataFrame, label: str, reason: str) -> None:
        nonlocal rejected
        part = df.select(F.lit(label).alias("label"), F.to_json(F.struct(*df.columns)).alias("row"), F.lit(reason).alias("reason"))
        rejected = part if rejected is None else rejected.union(part)

    def typed(df: DataFrame, label: str, keep: list[str]) -> DataFrame:
        props = {p["name"]: p for p in schema[label].get("properties", [])}
        for c in df.columns:
            if c not in props and c not in keep:
                raise SchemaError(f"{label} has no property {c}")
        own = [c for c in props if c in df.columns]
        values = {c: _value(F.col(c), props[c]["type"], not continue_on_error) for c in own}
        if continue_on_error:
            bad = F.lit(False)
            for c in own:
                given = F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
                bad = bad | (given & values[c].isNull()) | (~given & F.lit(not props[c].get("optional", False)))
            reject(df.where(bad), label, "a value does not fit its type")
            df = df.where(~bad)
        return df.select(*keep, *(values[c].alias(c) for c in own))

    for f in conf["files"]:
        label = f["label"]
        if schema[label]["type"].upper() == "VERTEX":
            graph = graph.with_vertices(label, typed(load(f), label, []), schema[label].get("primary"))
    for f in conf["files"]:
        label = f["label"]
        if schema[label]["type"].upper() == "EDGE":
            df = load(f)
            df = df.withColumnsRenamed({"SRC_ID": "_from", "DST_ID": "_to"})
            df = typed(df, label, ["_from", "_to"])
            for name, end, vertex in (("_from", "_src", f["SRC_ID"]), ("_to", "_dst", f["DST_ID"])):
                key = schema[vertex]["primary"]
                ids = graph.vertex(vertex).select(F.col(key).cast("string").alias(name), F.col("_vid").alias(end))
                joined = df.join(ids, name, "left")
                if continue_on_error:
                    reject(joined.where(F.col(end).isNull()).drop(end), label, f"no {vertex} with this key")
                    df = joined.where(F.col(end).isNotNull())
                else:
                    df = joined.withColumn(end, F.coalesce(end, F.raise_error(F.concat(F.lit(f"no {vertex} "), name)).cast("bigint")))
            pairs = tuple(tuple(c) for c in schema[label].get("constraints", []))
            graph = graph.with_edges(label, df.drop("_from", "_to"), pairs, schema[label].get("temporal"))
    return graph, rejected


def export_graph(graph: Graph, path: str, format: str = "csv", separator: str = ",") -> None:
    """A folder per label; JSON lines keep structure, CSV joins arrays by commas."""
    for kind, tables in (("vertices", graph.vertices), ("edges", graph.edges)):
        for label, df in tables.items():
            out = df
            if format == "csv":
                flat = [(F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ",") if f.dataType.typeName() == "array" else F.base64(F.col(f.name)) if f.dataType.typeName() == "binary" else F.col(f.name)).alias(f.name) for f in df.schema]
                out.select(*flat).write.csv(f"{path}/{kind}/{label}", sep=separator, header=True)
            elif format == "json":
                out.write.json(f"{path}/{kind}/{label}")
            else:
                out.write.parquet(f"{path}/{kind}/{label}")


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, string_ids: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(edges, id table) of lines ``src dst [weight]``; string ids get numbers."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    get = lambda i: F.get(parts, F.lit(i))
    weight = [get(2).cast("double").alias("weight")] if weighted else []
    if not string_ids:
        return rows.select(get(0).cast("long").alias("src"), get(1).cast("long").alias("dst"), *weight), None
    raw = rows.select(get(0).alias("a"), get(1).alias("b"), *weight)
    names = raw.select(F.col("a").alias("name")).union(raw.select(F.col("b").alias("name"))).distinct()
    names = materialise(names.withColumn("id", F.monotonically_increasing_id()), "names")
    out = raw.join(names.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(names.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b")
    return out.select("src", "dst", *(["weight"] if weighted else [])), names
