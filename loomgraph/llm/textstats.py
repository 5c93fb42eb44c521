"""Counts over whole texts, as native column expressions.

Words are runs of characters other than space and \\t to \\r. A null text is an
empty one everywhere: no words, no lines, all counts zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
_WHITE_RUN = r"[ \x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return let(
        F.btrim(text, F.lit(WHITE)),
        lambda t: F.when(F.length(t) > 0, F.split(t, _WHITE_RUN)).otherwise(F.array().cast("array<string>")),
    )


def lines(text: Column) -> Column:
    """Lines that hold a word, whole."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)


def _covered(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted
    by their 64-bit hash, equal neighbours give the repeated places."""

    def window_hash(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    windows = F.slice(w, 1, F.size(w) - 2)
    hashes = F.transform(windows, window_hash)
    some = let(F.sort_array(hashes), lambda h: F.exists(F.sequence(F.lit(1), F.size(h) - 1), lambda j: F.get(h, j) == F.get(h, j - 1)))
    placed = F.transform(windows, lambda x, i: F.struct(window_hash(x, i).alias("h"), i.alias("i")))
    return F.when(some, let(let(F.sort_array(placed), places), total)).otherwise(F.lit(0).cast("long"))


def repeated_words(w: Column) -> Column:
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_covered(w))


def stats(text: Column) -> Column:
    """A struct of the counts that quality rules and classifiers use."""

    def of(t: Column, w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return let(text, lambda t: let(words(t), lambda w: let(lines(t), lambda ls: of(t, w, ls))))
