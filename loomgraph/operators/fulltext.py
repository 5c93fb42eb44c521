"""Full-text lookup with BM25 scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda w: w == F.lit(term)))


def search(df: DataFrame, field: str, query: str, top: int, key: str = "_vid") -> DataFrame:
    """(key, score) of the best rows for the words of ``query``."""
    terms = sorted({t for t in query.lower().split() if t})
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(field), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    docs = df.select(key, words.alias("w")).select(key, F.size("w").alias("n"), *(_times(t).alias(f"t{i}") for i, t in enumerate(terms)))
    stats = docs.agg(F.count("*").alias("N"), F.avg("n").alias("len"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    size, mean = stats["N"], stats["len"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (size - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / mean))
    return docs.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(top)
