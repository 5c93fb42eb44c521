"""Time series owned by vertices and edges: long tables of element, ts, measures.

A point replaces any earlier one at its timestamp. Ranges include both ends.
Aggregates skip null measures, the count of points does not; integer sums that
overflow raise; a mean is a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("element", "ts")
BUCKET_OPTIONS = {"bucket_max_points", "bucket_span_us", "bucket_max_bytes"}
READS = frozenset("at range latest earliest count sum mean min max".split())


class SeriesError(ValueError):
    pass


def measures(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def check_options(options: dict[str, int]) -> None:
    """Storage hints: validated and otherwise without effect."""
    for k, v in options.items():
        if k not in BUCKET_OPTIONS:
            raise SeriesError(f"unknown series option {k}")
        if not 1 <= int(v) <= 1_000_000:
            raise SeriesError(f"{k} is out of range")


def create(spark, element: str, fields: dict[str, str], options: dict[str, int] | None = None) -> DataFrame:
    """An empty series table. ``element`` and measures by Spark type (double or bigint)."""
    check_options(options or {})
    if len(fields) > 64:
        raise SeriesError("a series has at most 64 measures")
    if any(t not in ("double", "bigint") for t in fields.values()):
        raise SeriesError("a measure is a double or a bigint")
    return spark.createDataFrame([], ", ".join([f"element {element}", "ts timestamp_ntz", *(f"`{k}` {t}" for k, t in fields.items())]))


def _finite(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    for c in doubles:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)))
    return df


def append(series: DataFrame, points: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert whole points; omitted measures become null. Of several new points
    at one place the last by ``order`` stays."""
    for c in points.columns:
        if c not in series.columns and c != order:
            raise SeriesError(f"unknown measure {c}")
    kinds = {f.name: f.dataType for f in series.schema}
    new = points.select(*((F.col(c) if c in points.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in series.columns), (F.col(order) if order else F.lit(0)).alias("_order"))
    new = _finite(new).withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("_order")))).where("_r = 1").drop("_r", "_order")
    return series.join(new.select(*KEYS), list(KEYS), "left_anti").select(series.columns).unionByName(new)


def update(series: DataFrame, element, ts, measure: str, value) -> DataFrame:
    """Set one measure of one point and keep the others; creates the point if absent."""
    return update_cas(series, element, ts, measure, None, value, check=False)[0]


def update_cas(series: DataFrame, element, ts, measure: str, expected, value, check: bool = True) -> tuple[DataFrame, int]:
    """(series, written): write if the measure equals ``expected``; an expected null also fits an absent point."""
    if measure not in measures(series):
        raise SeriesError(f"unknown measure {measure}")
    if isinstance(value, float) and (value != value or abs(value) == float("inf")):
        raise SeriesError(f"{measure} is not finite")
    kind = series.schema[measure].dataType
    here = (F.col("element") == F.lit(element)) & (F.col("ts") == F.lit(ts).cast("timestamp_ntz"))
    held = series.where(here).select(measure).limit(1).collect()
    if held:
        if check and held[0][0] != expected:
            return series, 0
        return series.withColumn(measure, F.when(here, F.lit(value).cast(kind)).otherwise(F.col(measure))), 1
    if check and expected is not None:
        return series, 0
    row = series.sparkSession.range(1).select(*((F.lit(element) if c == "element" else F.lit(ts) if c == "ts" else F.lit(value) if c == measure else F.lit(None)).cast(series.schema[c].dataType).alias(c) for c in series.columns))
    return series.unionByName(row), 1


def clear(series: DataFrame, element) -> DataFrame:
    return series.where(F.col("element") != F.lit(element))


def upsert_stream(batches, read, write, order: str | None = None):
    """A ``foreachBatch`` sink that appends each micro-batch: ``read()`` gives the
    series, ``write(df)`` keeps it. Late points take their place by timestamp."""

    def sink(batch: DataFrame, _: int) -> None:
        write(append(read(), batch, order))

    return batches.writeStream.foreachBatch(sink)


def _within(series: DataFrame, t0: Column | None, t1: Column | None) -> DataFrame:
    if t0 is not None:
        series = series.where(F.col("ts") >= t0)
    return series.where(F.col("ts") <= t1) if t1 is not None else series


def read(series: DataFrame, name: str, args: list) -> tuple[DataFrame, Column | None]:
    """(element, value) of one reading function, and its value where no point is.

    ``args``: time columns, after a measure's name for aggregates.
    """
    if name not in READS:
        raise SeriesError(f"no series function {name}")
    point = F.struct("ts", *measures(series))
    if name == "at":
        return series.where(F.col("ts") == args[0]).groupBy("element").agg(F.first(point).alias("value")), None
    if name == "range":
        found = _within(series, args[0], args[1]).groupBy("element").agg(F.sort_array(F.collect_list(point)).alias("value"))
        return found, F.array().cast(found.schema["value"].dataType)
    if name in ("latest", "earliest"):
        by = F.max_by if name == "latest" else F.min_by
        return series.groupBy("element").agg(by(point, F.col("ts")).alias("value")), None
    if name == "count":
        return _within(series, *(args or [None, None])).groupBy("element").agg(F.count("*").alias("value")), F.lit(0).cast("bigint")
    measure, window = args[0], args[1:] or [None, None]
    if measure not in measures(series):
        raise SeriesError(f"unknown measure {measure}")
    fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[name]
    return _within(series, *window).groupBy("element").agg(fn(measure).alias("value")), None


def summary(series: DataFrame) -> DataFrame:
    """(element, value): count, first and last timestamp and the measures' names."""
    names = F.array(*(F.lit(m) for m in measures(series)))
    return series.groupBy("element").agg(F.struct(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.first(names).alias("measures")).alias("value"))


def as_of(left: DataFrame, series: DataFrame, element: str, ts: str) -> DataFrame:
    """``left`` with the latest point at or before its ``ts``: one sort by union and window."""
    more = measures(series)
    point = F.struct(F.col("ts").alias("ts"), *more)
    tagged = left.select(F.col(element).alias("_e"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(series.select(point.alias("p")).schema["p"].dataType).alias("_point"))
    points = series.select(F.col("element").alias("_e"), F.col("ts").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(tagged.schema["_row"].dataType).alias("_row"), point.alias("_point"))
    w = Window.partitionBy("_e").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.union(points).withColumn("_last", F.last("_point", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *(F.col("_last")[m].alias(m) for m in ["ts", *more] if m not in left.columns))
