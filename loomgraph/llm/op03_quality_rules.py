"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

A rule rejects a document when a signal exceeds its cutoff. Cutoffs come from
labelled holdouts: in each stratum (a band of word counts, so their number is
fixed) the documents labelled good are counted above every cutoff of a fixed
grid, and the cutoffs are tested from the mildest to the strictest with the
exact binomial lower tail P(Bin(n, risk) <= k). Testing a signal stops at its
first failure, which needs no correction among cutoffs; Bonferroni corrects
over strata and signals, and a stratum's risk is divided among its signals.
So with probability 1 - delta no stratum rejects more than ``risk`` of its good
documents. A signal without enough evidence in a stratum rejects nothing there.

Edge cases: a null or empty text has no words and fails the base rule; a ratio
over zero counts as 0; labels that are null are no holdout and several labels
of one document count as their minimum; an empty labels table certifies no
cutoff; repeated rows each get their own verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.textstats import stats, text_of
from loomgraph.plans.storage import materialise, table

#: False rejections allowed per stratum, and the chance that any stratum has more.
RISK, DELTA = 0.02, 0.05
#: Lower ends of the strata, in words.
BANDS = (0, 150, 400, 1200)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Signal: numerator, denominator, cutoffs.
SIGNALS = {
    "symbol": ("n_symbols", "word_chars", (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)),
    "upper": ("n_upper", "word_chars", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
    "dup_line": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
    "repeat": ("n_repeat_words", "n_words", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
}


def signal(s: Column, name: str) -> Column:
    top, bottom, _ = SIGNALS[name]
    return F.when(s[bottom] > 0, s[top] / s[bottom]).otherwise(F.lit(0.0))


def stratum(s: Column) -> Column:
    return sum(((s["n_words"] >= low).cast("int") for low in BANDS[1:]), F.lit(0))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly; 1 if k >= n p, where no test could pass."""
    first = n * math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log(n - i + 1) - F.log(i) + math.log(p) - math.log1p(-p)
        return F.struct(term.alias("term"), (F.greatest(a["total"], term) + F.log1p(F.exp(-F.abs(a["total"] - term)))).alias("total"))

    counts = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(counts, F.struct(first.alias("term"), first.alias("total")), step, lambda a: F.exp(a["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(tail)


def certified(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, signal, cutoff) of the strictest certified cutoffs.

    ``labelled``: a struct ``s`` of counts and ``quality`` for each document of
    the holdout. The result has a row per stratum and signal at most.
    """
    good = labelled.where(F.col("quality") == 1).select(stratum(F.col("s")).alias("stratum"), *(signal(F.col("s"), x).alias(x) for x in SIGNALS))
    over = [F.count_if(F.col(x) > c).alias(f"{x}_{i}") for x, (_, _, grid) in SIGNALS.items() for i, c in enumerate(grid)]
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *over)
    cells = F.array(*(F.struct(F.lit(x).alias("signal"), F.lit(c).alias("cutoff"), F.col(f"{x}_{i}").alias("k")) for x, (_, _, grid) in SIGNALS.items() for i, c in enumerate(grid)))
    tests = counts.select("stratum", "n", F.inline(cells))
    passed = binomial_tail(F.col("n"), F.col("k"), risk / len(SIGNALS)) <= delta / (len(SIGNALS) * len(BANDS))
    mildest_first = Window.partitionBy("stratum", "signal").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    kept = tests.withColumn("passed", passed).withColumn("so_far", F.min("passed").over(mildest_first)).where("so_far")
    return kept.groupBy("stratum", "signal").agg(F.min("cutoff").alias("cutoff"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> dict[tuple[int, str], float]:
    """Certified cutoffs by (stratum, signal), at most strata x signals numbers."""
    truth = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("quality"))
    labelled = docs.select(F.col(key).alias("_key"), stats(text_of(text)).alias("s")).join(truth, "_key")
    return {(r["stratum"], r["signal"]): r["cutoff"] for r in certified(labelled).collect()}


def rejected(s: Column, cutoffs: dict[tuple[int, str], float]) -> Column:
    """True if any certified rule rejects the document."""
    rules = [(stratum(s) == b) & (signal(s, x) > c) for (b, x), c in sorted(cutoffs.items())]
    out = F.lit(False)
    for r in rules:
        out = out | r
    return out


def keep(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the certified rules keep."""
    from loomgraph.llm.textstats import let

    cutoffs = fit(docs, labels, text)
    return docs.where(let(stats(text_of(text)), lambda s: ~base_failed(s) & ~rejected(s, cutoffs)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", stats(text_of("text")).alias("s"))
    counted = materialise(docs, "quality-counts")
    labels = table(spark, sf_dir, "labels")
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cutoffs = {(r["stratum"], r["signal"]): r["cutoff"] for r in certified(counted.join(truth, "doc_id")).collect()}
    s = F.col("s")
    return counted.select(
        "doc_id",
        *(s[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & ~rejected(s, cutoffs)).alias("kept"),
    )
