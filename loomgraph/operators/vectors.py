"""Exact vector search over a property of ``array<float>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(vector: Column, query: list[float], metric: str = "l2", squared: bool = True) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    both = F.zip_with(vector.cast("array<double>"), q, (lambda a, b: (a - b) * (a - b)) if metric == "l2" else (lambda a, b: a * b))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return total
    return total if squared else F.sqrt(total)


def knn(df: DataFrame, field: str, query: list[float], k: int, metric: str = "l2", squared: bool = True) -> DataFrame:
    """The k nearest rows with ``distance``; ties by ``_vid``."""
    found = df.where(F.size(field) == len(query)).withColumn("distance", distance(F.col(field), query, metric, squared))
    order = F.desc("distance") if metric == "ip" else F.asc("distance")
    return found.orderBy(order, *(["_vid"] if "_vid" in df.columns else [])).limit(k)


def within_radius(df: DataFrame, field: str, query: list[float], radius: float, metric: str = "l2", squared: bool = True, limit: int | None = None) -> DataFrame:
    found = df.where(F.size(field) == len(query)).withColumn("distance", distance(F.col(field), query, metric, squared))
    found = found.where(F.col("distance") >= radius if metric == "ip" else F.col("distance") <= radius)
    return found if limit is None else found.orderBy("distance").limit(limit)
