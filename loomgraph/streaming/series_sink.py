"""Series fed by a stream: append-only batches, the latest point wins on read.

Each micro-batch is one folder, overwritten if Spark repeats the batch, so a
restart neither loses nor doubles points. A late point simply takes its place in
time. Within a batch the last by ``order`` stays; of several batches the latest
one does, as a point replaces any earlier one at its timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.series import KEYS, append, measures
from loomgraph.plans.storage import drop_path


def upsert_stream(points: DataFrame, path: str, checkpoint: str, series: DataFrame, order: str | None = None, **trigger: object) -> StreamingQuery:
    """Write the stream ``points`` (element, ts, measures) under ``path``.

    ``series`` is an empty series table that gives the schema; a measure that the
    stream lacks is null. ``trigger`` is passed to Spark, ``availableNow=True``
    by default.
    """

    def write(batch: DataFrame, number: int) -> None:
        append(series, batch, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    started = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return started.trigger(**(trigger or {"availableNow": True})).start()


def read_series(spark: SparkSession, path: str, series: DataFrame) -> DataFrame:
    """The series as it stands: one point for each element and timestamp."""
    held = spark.read.schema(f"{series._jdf.schema().toDDL()}, batch BIGINT").parquet(path)
    values = F.struct("batch", *(F.col(f"`{c}`") for c in measures(series)))
    latest = held.groupBy(*KEYS).agg(F.max_by(values, "batch").alias("p"))
    return latest.select(*KEYS, *(F.col("p")[c].alias(c) for c in measures(series)))


def compact(spark: SparkSession, path: str, series: DataFrame, target: str) -> None:
    """Write the series as one batch under ``target``, older than any that follow."""
    read_series(spark, path, series).write.mode("errorifexists").parquet(f"{target}/batch=-1")


def remove(spark: SparkSession, path: str) -> None:
    drop_path(spark, path)


def windowed(points: DataFrame, measure: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum, mean and extremes of a measure per element and time window.

    Works on streams (with a watermark of ``late``) and on tables alike.
    """
    df = points.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if df.isStreaming else df
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    x = F.col(f"`{measure}`").cast("double")
    out = df.groupBy("element", span.alias("w")).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select("element", F.col("w")["start"].alias("start"), F.col("w")["end"].alias("end"), "count", "sum", "mean", "min", "max")
