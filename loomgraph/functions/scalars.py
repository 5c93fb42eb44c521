"""Scalar functions of the query language as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean radius of the Earth in metres, for distances on SRID 4326.
EARTH = 6371008.8


def index(xs: Column, i: Column) -> Column:
    """0-based; negative counts from the end; out of range is null."""
    return F.get(xs, F.when(i < 0, F.size(xs) + i).otherwise(i).cast("int"))


def cut(xs: Column, a: Column | None, b: Column | None) -> Column:
    """``xs[a..b]``, end exclusive, negative from the end, reversed is empty."""
    n = F.size(xs)

    def place(x: Column | None, default: Column) -> Column:
        if x is None:
            return default
        x = x.cast("int")
        return F.least(F.greatest(F.when(x < 0, n + x).otherwise(x), F.lit(0)), n)

    first, last = place(a, F.lit(0)), place(b, n)
    return F.slice(xs, first + 1, F.greatest(last - first, F.lit(0)))


def is_sorted(xs: Column, falling: bool = False) -> Column:
    later = F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))).alias("a"), later.alias("b"))
    return F.forall(pairs, lambda p: (p["a"] > p["b"]) if falling else (p["a"] < p["b"]))


def to_string(x: Column, kind: T.DataType) -> Column:
    """Doubles take six decimals."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.format_string("%f", x.cast("double"))
    return x.cast("string")


def point(x: Column, y: Column, srid: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), srid.cast("int").alias("srid"))


def _coordinates(wkt: Column) -> Column:
    inside = F.regexp_replace(wkt, r"^[^(]*\(+|\)+\s*$", "")
    return F.transform(F.split(inside, r"\s*,\s*"), lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).cast("double").alias("y")))


def shape(wkt: Column, srid: Column) -> Column:
    return F.struct(srid.cast("int").alias("srid"), _coordinates(wkt).alias("coords"))


def distance(a: Column, b: Column) -> Column:
    """Metres on SRID 4326, plane units otherwise; different SRIDs raise."""
    plane = F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)
    la, lb, dx = F.radians(a["y"]), F.radians(b["y"]), F.radians(b["x"] - a["x"])
    h = F.sin((lb - la) / 2) ** 2 + F.cos(la) * F.cos(lb) * F.sin(dx / 2) ** 2
    sphere = 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    value = F.when(a["srid"] == 4326, sphere).otherwise(plane)
    return F.when(a["srid"] != b["srid"], F.raise_error(F.lit("points have different SRIDs")).cast("double")).otherwise(value)


def component(x: Column, part: Column, micros: bool) -> Column:
    moment = F.timestamp_micros(x.cast("long")) if micros else F.date_add(F.lit("1970-01-01").cast("date"), x.cast("int")).cast("timestamp")
    second = F.floor(F.extract(F.lit("SECOND"), moment)).cast("long")
    out = F.when(part == "second", second).when(part == "microsecond", F.pmod(F.unix_micros(moment), F.lit(1_000_000)))
    for name in ("year", "month", "day", "hour", "minute"):
        out = out.when(part == name, F.extract(F.lit(name.upper()), moment).cast("long"))
    return out


FUNCTIONS: dict[str, Callable[..., Column]] = {
    # strings
    "tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "replace": F.replace, "split": lambda s, d: F.split(s, F.concat(F.lit(r"\Q"), d, F.lit(r"\E"))),
    "left": F.left, "right": F.right,
    "substring": lambda s, a, n=None: F.substr(s, a + 1, n) if n is not None else F.substr(s, a + 1),
    "substr": lambda s, a, n=None: F.substr(s, a, n) if n is not None else F.substr(s, a),
    "length": F.length, "character_length": F.length, "char_length": F.length, "concat": F.concat, "concat_ws": lambda d, *x: F.array_join(F.array(*x), d),
    "instr": lambda s, x: F.position(x, s), "findstr": lambda s, x: F.position(x, s),
    "isblank": lambda s: F.trim(F.coalesce(s, F.lit(""))) == "", "isnotblank": lambda s: F.trim(F.coalesce(s, F.lit(""))) != "",
    # numbers
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x, n=None: F.round(x.cast("double"), 0 if n is None else n.cast("int")).cast("double"),
    "sign": lambda x: F.signum(x).cast("int"), "sqrt": F.sqrt, "log": F.log, "ln": F.log, "exp": F.exp, "rand": F.rand, "mod": lambda a, b: a % b, "pow": F.pow, "power": F.pow,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "pi": F.pi, "e": F.e, "degrees": F.degrees, "radians": F.radians,
    "tofloat": lambda x: x.cast("double"), "todouble": lambda x: x.cast("double"), "toboolean": lambda x: F.lower(x.cast("string")).cast("boolean"), "tobool": lambda x: F.lower(x.cast("string")).cast("boolean"),
    "coalesce": F.coalesce, "nullif": F.nullif, "ifnull": F.ifnull, "isnull": F.isnull,
    # time
    "date": lambda x=None: F.current_date() if x is None else F.to_date(x), "datetime": lambda x=None: F.localtimestamp() if x is None else F.to_timestamp_ntz(x), "timestamp": lambda x: F.to_timestamp_ntz(x), "now": F.localtimestamp,
    "datecomponent": lambda x, p: component(x, p, False), "datetimecomponent": lambda x, p: component(x, p, True),
    "date_add": lambda d, n: F.date_add(d, n.cast("int")), "date_sub": lambda d, n: F.date_sub(d, n.cast("int")), "date_diff": F.datediff, "to_date": F.to_date,
    "unix_timestamp": F.unix_timestamp, "from_unixtime": F.from_unixtime,
    # lists
    "range": lambda a, b, s=None: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")) if s is None else F.sequence(a, b, s),
    "head": lambda xs: F.get(xs, F.lit(0)), "last": lambda xs: F.get(xs, F.size(xs) - 1), "tail": lambda xs: F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))),
    "isasc": is_sorted, "isdesc": lambda xs: is_sorted(xs, True), "hasduplicates": lambda xs: F.size(F.array_distinct(xs)) < F.size(xs),
    "mininlist": F.array_min, "maxinlist": F.array_max,
    # binary and space
    "bin": F.unbase64, "point": point, "linestringwkt": shape, "polygonwkt": shape, "spatial.distance": distance, "distance": distance,
}
