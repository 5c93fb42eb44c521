"""SimHash near duplicates by bit-sliced comparison.

A fingerprint has one bit per hash bit that is set in over half of a text's
shingle hashes. Equal fingerprints are one node. Two fingerprints within the
radius of 2 agree on two of four 16-bit blocks at least, so they meet in one of
six tables of buckets. A bucket's fingerprints are stored as 64 bit planes; a
fingerprint is compared with 64 others per machine word: each plane's
differences are added into carry-save counters, and a word of candidates is
abandoned as soon as every counter in it has passed the radius.

A bucket over ``BUCKET`` fingerprints (a hot neighbourhood) is split by the same
rule over the 32 bits that it leaves open, which gives parts of 65,536
fingerprints at most; a part still over ``BUCKET`` is compared tile by tile.

Only fingerprints that meet some other one are ever gathered, in groups of about
``BUCKET`` (a pair of tiles: twice that); components are found by distributed
star contraction.

``keep`` is the operator as a stage that removes near copies; it compares
five-word shingles and is in ``near_copies``.

Edge cases: a null text is an empty one; a text without words has the
fingerprint zero and links like any other; with fewer words than a shingle has,
the whole sequence is the one shingle; repeated rows share node and component;
a null id belongs to the component of its fingerprint but never names one
unless no id is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.textstats import let, text_of, words
from loomgraph.operators.components import components
from loomgraph.plans.storage import materialise, table

SHINGLE, RADIUS = 3, 2
#: Fingerprints of a bucket, or of a tile of a larger one, that are compared at once.
BUCKET = 4096
#: Shingle hashes expanded to bits, or words of 64 candidates compared, at a time.
_CHUNK = 1 << 17
#: Two blocks of four that agree, and the two others.
_SPLITS = [(i, j, *(x for x in range(4) if x not in (i, j))) for i, j in combinations(range(4), 2)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of lower-cased words, repeats included."""

    def of(w: Column) -> Column:
        def joined(x: Column, i: Column) -> Column:
            return F.xxhash64(F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, size))))

        return (
            F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
            .when(F.size(w) < size, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(1))), joined))
        )

    return let(words(F.translate(text, _UPPER, _LOWER)), of)


def _majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs of ``values`` between ``offsets``."""
    n = len(offsets) - 1
    ones = np.zeros((n, 64), np.int64)
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(values), _CHUNK):
        hi = min(lo + _CHUNK, len(values))
        bits = np.unpackbits(raw[lo:hi], axis=1, bitorder="little")
        first, last = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left")
        rows = np.arange(first, last)
        rows = rows[offsets[rows] < offsets[rows + 1]]
        starts = np.maximum(offsets[rows] - lo, 0)
        ones[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    over = 2 * ones > np.diff(offsets)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(hashes: pa.ListArray) -> pa.Array:
    offsets = hashes.offsets.to_numpy().astype(np.int64)
    values = hashes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return pa.array(_majority(values.astype(np.int64), offsets - offsets[0]).view(np.int64))


def with_fingerprint(df: DataFrame, text: Column, name: str, size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the 64-bit fingerprint of ``text``, as a signed long, in column ``name``."""
    keep = df.columns if keep is None else keep
    schema = df.select(*keep, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [*b.columns[:-1], _fingerprints(b.columns[-1])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*keep, shingle_hashes(text, size).alias(name)).mapInArrow(run, schema)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 to a word."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def close_pairs(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``queries``, places among the candidates, differing bits) of the pairs within ``radius`` bits.

    Query i is compared with the candidates ``lo[i]`` to ``hi[i]``, 64 of them to
    a machine word, all queries at once: a plane's differences are added into
    carry-save counters, one word of each counter bit for 64 candidates, and a
    word whose candidates all passed the radius is abandoned. Every turn takes
    whole queries, ``_CHUNK`` words or one query at least.
    """
    bits = max(int(radius).bit_length(), 1)
    first, words = lo // 64, np.maximum((hi + 63) // 64 - lo // 64, 0) * (hi > lo)
    ends, i = np.cumsum(words), 0
    while i < len(queries):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CHUNK, side="right")), i + 1)
        row = np.repeat(np.arange(i, j), words[i:j])
        word = np.arange(len(row)) - np.repeat(np.cumsum(words[i:j]) - words[i:j], words[i:j]) + first[row]
        i = j
        outside = np.zeros(len(row), np.uint64)
        start, stop = lo[row] - word * 64, hi[row] - word * 64
        cut = start > 0
        outside[cut] = (np.uint64(1) << start[cut].astype(np.uint64)) - np.uint64(1)
        cut = stop < 64
        outside[cut] |= ~((np.uint64(1) << stop[cut].astype(np.uint64)) - np.uint64(1))
        counts = [np.zeros(len(row), np.uint64) for _ in range(bits)]
        over = outside
        for b in range(64):
            carry = planes[b, word] ^ (np.uint64(0) - (queries[row] >> np.uint64(b) & np.uint64(1)))
            for c in range(bits):
                counts[c], carry = counts[c] ^ carry, counts[c] & carry
            over = over | carry
            if b % 8 == 7:
                equal, more = ~over, over
                for c in range(bits - 1, -1, -1):
                    if radius >> c & 1:
                        equal = equal & counts[c]
                    else:
                        more, equal = more | equal & counts[c], equal & ~counts[c]
                stay = more != _ALL
                if b == 63 or not stay.all():
                    row, word, over = row[stay], word[stay], (more if b == 63 else over | more)[stay]
                    counts = [c[stay] for c in counts]
                if not len(row):
                    break
        if len(row):
            at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64))
            far = sum(((counts[c][at] >> lane.astype(np.uint64) & np.uint64(1)).astype(np.int64) << c for c in range(bits)), np.zeros(len(at), np.int64))
            yield row[at], word[at] * 64 + lane, far


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lists joined, and where each begins and the last one ends."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.empty(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges that join what bit-sliced comparison finds linked in each bucket: each fingerprint and its first later neighbour, and those that this leaves apart."""
    for batch in batches:
        values, ends = _flat(list(batch["fps"]))
        fps = values.view(np.uint64)
        hi = np.repeat(ends[1:], np.diff(ends))
        label, us, vs = np.arange(len(fps)), [], []
        for i, j, _ in close_pairs(fps, np.arange(1, len(fps) + 1), hi, planes_of(fps)):
            while len(i):
                # Hook the larger label of every edge that is left to the smallest one it meets; each hook is an edge of a spanning forest.
                a, b = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
                order = np.lexsort((b, a))
                new = order[np.r_[True, a[order][1:] != a[order][:-1]]]
                new = new[a[new] != b[new]]
                us.append(values[i[new]])
                vs.append(values[j[new]])
                label[a[new]] = b[new]
                while (label != label[label]).any():
                    label = label[label]
                left = label[i] != label[j]
                i, j = i[left], j[left]
        yield pd.DataFrame({"a": np.concatenate(us), "b": np.concatenate(vs)} if us else {"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})


def _met(keyed: DataFrame, label: str) -> DataFrame:
    """Rows of ``keyed`` (key, fp) whose key several share, and how many (``n``)."""
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{label}-buckets")
    return materialise(keyed.join(sizes, "key"), f"{label}-met")


def _tables(value: Column, width: int) -> Column:
    """Which two of its four blocks of ``width`` bits agree: six (table, key) of a value of 4 * ``width`` bits."""
    mask = (1 << width) - 1
    blocks = [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit(mask).cast("long")) for i in range(4)]
    return F.array(*(F.struct(F.lit(t).alias("t"), (blocks[i] * (mask + 1) + blocks[j]).alias("k"), (blocks[x] * (mask + 1) + blocks[y]).alias("rest")) for t, (i, j, x, y) in enumerate(_SPLITS)))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges among the distinct fingerprints ``fp`` whose components are
    those of the graph of all pairs within two bits."""
    keyed = fps.select("fp", F.explode(_tables(F.col("fp"), 16)).alias("x")).select("fp", F.struct("x.t", "x.k").alias("key"), F.col("x.rest").alias("rest"))
    met = _met(keyed, "simhash")
    # What a hot bucket leaves open is 32 bits; two that differ in two of them agree in two of four parts again.
    parts = met.where(F.col("n") > bucket).select("fp", "key", F.explode(_tables(F.col("rest"), 8)).alias("x"))
    finer = _met(parts.select("fp", F.struct("key", "x.t", "x.k").alias("key")), "simhash-finer")
    # Such a part holds 2^16 fingerprints at most: tiles of it meet in pairs.
    tiles = F.ceil(F.col("n") / bucket).cast("int")
    at = finer.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = at.select("fp", F.col("key").alias("part"), "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiled = dealt.select("fp", F.struct("part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).alias("key"))
    found = None
    for rows in (met.where(F.col("n") <= bucket), tiled):
        groups = rows.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        one = groups.mapInPandas(_bucket_links, "a bigint, b bigint")
        found = one if found is None else found.union(one)
    return found.distinct()


def _marked_and_named(docs: DataFrame, text: str, key: str, size: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) for every row and (fp, its least key ``rep``, component, component_id) for every fingerprint."""
    marked = materialise(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), text_of("text"), "fp", size, keep=["key"]), "simhash-fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("key").alias("rep")), "simhash-nodes")
    found = materialise(links(nodes.select("fp"), bucket), "simhash-links")
    grouped = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = nodes.join(grouped.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labelled = materialise(labelled, "simhash-labelled")
    names = materialise(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "simhash-names")
    named = materialise(labelled.join(names, "component").select("fp", "rep", "component", "component_id"), "simhash-named")
    return marked, named


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint as long ``fp``, ``component_id``) for every row."""
    marked, named = _marked_and_named(docs, text, key, size, bucket)
    return marked.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies: five-word shingles of Jaccard 0.8 or more (``near_copies``)."""
    from loomgraph.llm import near_copies

    return near_copies.keep(docs, text, key)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
