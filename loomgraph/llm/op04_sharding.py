"""Uniform shuffle into shards of exact sizes by a hypergeometric matrix.

Rows are numbered in their partitions once and written down, so a lost executor
changes nothing later. From the partitions' counts the driver draws how many
rows each partition sends to each shard (a multivariate hypergeometric matrix
with the shard sizes as column sums). Each partition permutes its rows by a
seeded permutation and deals them by its line of the matrix. After the exchange
a shard is permuted again: rows fall into buckets at random and are ordered at
random within each bucket, which is a uniform permutation of the shard whatever
the bucket sizes are, and needs no task to hold a shard.

The driver holds partitions x shards numbers, never rows.

Edge cases: an empty table gives no rows; a null text has size 1 and the crc of
no bytes; repeated rows are dealt like any others; with fewer rows than shards
some shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import fresh, materialise, table

SHARDS, SEED = 8, 42
#: Rows of a bucket of the second permutation, on average.
BUCKET_ROWS = 8192
#: Buckets of a shard at most, so that their offsets stay a short list; past it they get larger.
BUCKETS = 4096
_INDEX_BITS = 33


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard, drawn uniformly.

    Shard sizes differ by one at most; rows of the matrix sum to ``counts``.
    """
    total, rng = int(counts.sum()), np.random.default_rng(seed)
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        need, pool = int(n), int(left.sum())
        for j in range(shards):  # one hypergeometric draw after another
            pool -= int(left[j])
            out[i, j] = _hypergeometric(rng, int(left[j]), pool, need)
            need -= int(out[i, j])
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # Beyond numpy's range: the law's own ratios, from the likeliest count outward by 40 standard deviations.
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    span = 10 + int(40 * (draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))) ** 0.5)
    lo, hi = max(0, draws - bad, mode - span), min(draws, good, mode + span)
    x = np.arange(mode, hi, dtype=float)
    up = np.cumprod((good - x) * (draws - x) / ((x + 1) * (bad - draws + x + 1)))
    x = np.arange(mode, lo, -1, dtype=float)
    down = np.cumprod(x * (bad - draws + x) / ((good - x + 1) * (draws - x + 1)))
    chances = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return lo + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: gapless from 0 in each shard, uniformly at random."""
    place, part, at = (fresh(x, df) for x in ("place", "part", "at"))
    shard, bucket, key = (fresh(x, df) for x in ("dealt", "bucket", "order"))
    numbered = materialise(df.withColumn(place, F.monotonically_increasing_id()), "shard-numbered")
    numbered = numbered.withColumn(part, F.shiftright(place, _INDEX_BITS)).withColumn(at, F.col(place).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)))
    found = numbered.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect()
    parts, counts = np.array([r[0] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)
    total = int(counts.sum())
    matrix = communication_matrix(counts, shards, seed)
    ends, n_buckets = np.cumsum(matrix, axis=1), min(BUCKETS, max(1, -(-total // (shards * BUCKET_ROWS))))
    order = {int(p): i for i, p in enumerate(parts)}

    dealt_schema = numbered.withColumn(shard, F.lit(0)).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] = (-1, np.empty(0, np.int64))
        for b in batches:
            p, i = (b.column(dealt_schema.names.index(x)).to_numpy() for x in (part, at))
            out = np.empty(len(p), np.int32)
            for v in np.unique(p):
                if held[0] != v:  # one permutation of row numbers at a time
                    held = (v, np.random.default_rng([seed, int(v)]).permutation(counts[order[int(v)]]))
                mine = p == v
                out[mine] = np.searchsorted(ends[order[int(v)]], held[1][i[mine]], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=dealt_schema.names)

    dealt = numbered.mapInArrow(deal, dealt_schema).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), place), F.lit(n_buckets)).cast("int"))
    dealt = dealt.withColumn(key, F.xxhash64(F.lit(seed + 1), place))
    dealt = materialise(dealt.drop(part, at), "shard-dealt")
    sizes = {(r[0], r[1]): r[2] for r in dealt.groupBy(shard, bucket).count().collect()}
    starts, run = [], 0
    for s in range(shards):
        run = 0
        for b in range(n_buckets):
            starts.append(run)
            run += sizes.get((s, b), 0)
    first = F.get(F.lit(starts) if starts else F.array(), F.col(shard) * n_buckets + F.col(bucket)).cast("long")
    inner = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(key, place)) - 1
    out = dealt.withColumn(at, first + inner).drop(bucket, key, place)
    return out.withColumnRenamed(shard, fresh("shard", df)).withColumnRenamed(at, fresh("slot", df))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle(narrow).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
