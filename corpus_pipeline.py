"""From raw documents to packed training sequences: four stages in a row.

Every stage reads what the one before it kept, written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import op03_quality_rules, op06_packing, op08_gam_classifier, op10_simhash
from loomgraph.plans.storage import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the raw documents: what the rules kept holds almost no bad label."""
    return op08_gam_classifier.keep(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-sliced SimHash at a wide radius, then an exact five-word Jaccard of 0.8."""
    return op10_simhash.keep(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("simhash near duplicates", near_duplicates),
    ("packing", packing),
]

#: Models, fingerprints and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
