"""SimHash as a stage: one row of each group of texts whose five-word shingles have a Jaccard of 0.8 or more.

At that similarity fingerprints of 64 bits differ in some ten bits, up to 16 or
so, and block tables of bits cannot search that far. So fingerprints meet in
other blocks here: a text has ``BANDS`` keys, each made of the least values of
``BAND_ROWS`` hash functions over its shingles, and two texts of Jaccard 0.8
share one of them with a chance of 0.9998. Within a block fingerprints are
compared by bit planes as in ``op10_simhash``, at a radius of ``RADIUS``; what
is within it is a candidate, and two texts are linked if their whole sets of
shingles have the Jaccard. A task has the sets of its block at hand, so only
links are given back, and of those only what joins components: fewer than the
block has texts. Candidates are held against each other nearest first, and those
that are joined by then need not be. Blocks of the same texts are one.

A block over ``TILE`` texts or ``TILE_SHINGLES`` shingles is dealt into tiles,
each with the block's first text, which costs its size. Where a large block
still has several components, all its tiles meet those texts that are not in
the largest one: so no candidate is lost.

Edge cases: a null text is an empty one; texts of the same lower-cased words
are one node; with fewer words than a shingle has, the whole sequence is the one
shingle; the row kept has the least id of its group; a null id stands for a
group only if no id is there; of rows that repeat id and words one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.op10_simhash import _LOWER, _UPPER, _majority, close_pairs, planes_of, shingle_hashes
from loomgraph.llm.textstats import text_of, words
from loomgraph.operators.components import components
from loomgraph.plans.storage import fresh, materialise

#: Jaccard of NUM / DEN or more over shingles of SHINGLE words.
SHINGLE, NUM, DEN = 5, 4, 5
#: Keys of a text, hash functions of a key, and differing bits of a candidate.
BANDS, BAND_ROWS, RADIUS = 16, 4, 18
#: Texts, and shingles, of a block that one task compares at once, about.
TILE, TILE_SHINGLES = 4096, 4_000_000
#: Candidates of a text that are held against it at first; then four times as many, and so on.
FIRST_HELD = 16
#: Most rows of a table of ids that is sent to all executors; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def node(text: Column | str) -> Column:
    return F.xxhash64(F.array_join(words(F.translate(text_of(text), _UPPER, _LOWER)), " "))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each run of ``values`` between ``offsets``; an empty run has all ones as its least values."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(offsets) - 1, band + 1, np.uint64)
        for r in range(BAND_ROWS):
            least = np.full(len(offsets) - 1, _NONE)
            if len(full):
                x = values * _FACTORS[band * BAND_ROWS + r]
                least[full] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), offsets[full])
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ least)
        out[:, band] = key
    return out


def _marked(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(node, key, fp, size, blocks) of every row; ``size`` counts shingles, repeats included."""
    schema = docs.select(node(text).alias("node"), F.col(key).alias("key"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("size"), F.array().cast("array<long>").alias("blocks")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                lists = b.column(2)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
                offsets = offsets - offsets[0]
                keys = band_keys(values.view(np.uint64), offsets).view(np.int64)
                blocks = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_majority(values, offsets).view(np.int64)), pa.array(np.diff(offsets).astype(np.int32)), blocks], names=schema.names)

    return docs.select(node(text).alias("node"), F.col(key).alias("key"), shingle_hashes(text_of(text), SHINGLE).alias("s")).mapInArrow(run, schema)


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few longs, marked for broadcast if it is within ``BROADCAST_ROWS``."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _links(nodes: np.ndarray, fps: np.ndarray, parts: np.ndarray | None, asks: np.ndarray | None, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components (``parts``; without them every text is one) of a tile's texts.

    Those who ask are held against those who do not; without ``asks`` all against all.
    """
    m = len(nodes)
    ids = np.unique(flat, return_inverse=True)[1]
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(len(flat) + 1, bool)
    label = np.arange(m) if parts is None else np.unique(parts, return_inverse=True)[1]
    if asks is None:
        q, other, lo, hi = np.arange(m), np.arange(m), np.arange(1, m + 1), np.full(m, m)
    else:
        q, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(other))
    out: list[tuple[int, int]] = []
    for i, j, far in close_pairs(fps[q], lo, hi, planes_of(fps[other]), RADIUS):
        i, j = q[i], other[j]
        could = (label[i] != label[j]) & (DEN * np.minimum(sizes[i], sizes[j]) >= NUM * np.maximum(sizes[i], sizes[j]))
        i, j, far = i[could], j[could], far[could]
        order = np.lexsort((far, i))
        i, j = i[order], j[order]
        for one, left in zip(i[np.r_[True, i[1:] != i[:-1]]] if len(i) else (), np.split(j, np.flatnonzero(np.diff(i)) + 1)):
            own, held = ids[begin[one] : begin[one] + sizes[one]], FIRST_HELD
            mark[own] = True
            while len(left):
                left = left[label[left] != label[one]]
                some, left = left[:held], left[held:]
                if len(some):
                    n = sizes[some]
                    at = np.arange(int(n.sum())) + np.repeat(begin[some] - np.cumsum(n) + n, n)
                    both = np.add.reduceat(mark[ids[at]], np.cumsum(n) - n, dtype=np.int64)
                    hits = some[DEN * both >= NUM * (sizes[one] + n - both)]
                    for part, k in zip(*np.unique(label[hits], return_index=True)):
                        out.append((int(nodes[one]), int(nodes[hits[k]])))
                        label[label == part] = label[one]
                held = min(held * 4, max(1, 2_000_000 // int(sizes[one] + 1)))
            mark[own] = False
    return out


def _tile_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: list[tuple[int, int]] = []
        for r in batch.itertuples(index=False):
            parts, asks = (np.asarray(r.parts, np.int64), np.asarray(r.asks, bool)) if hasattr(r, "parts") else (None, None)
            found += _links(np.asarray(r.nodes, np.int64), np.asarray(r.fps, np.int64).view(np.uint64), parts, asks, np.asarray(r.sizes, np.int64), np.asarray(r.flat, np.int64))
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _labels(edges: DataFrame) -> DataFrame:
    return materialise(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "near-labels")


def near_components(nodes: DataFrame, texts: DataFrame, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(node, component) for every text that is similar to another one.

    ``nodes``: (node, rep, fp, size, blocks), a row for each text; ``texts``:
    (node, key, text) of all rows, of which those of the key ``rep`` are read.
    """
    keyed = nodes.select("node", "rep", "size", F.explode("blocks").alias("block"))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("node").alias("first")).where("n > 1")
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("shingles") / tile_shingles)).cast("int")
    met = materialise(keyed.join(materialise(sizes.withColumn("tiles", tiles), "near-blocks"), "block"), "near-met")
    there = materialise(met.select("node", "rep").distinct(), "near-there")
    own = texts.join(_small(there), "node").where(F.col("key").eqNullSafe(F.col("rep"))).select("node", shingle_hashes(F.col("text"), SHINGLE).alias("s"))
    own = own.select("node", F.array_distinct("s").alias("s")).dropDuplicates(["node"])
    sets = materialise(own.join(nodes.select("node", "fp"), "node"), "near-sets")
    lists = (F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps"), F.collect_list(F.size("s")).alias("sizes"), F.flatten(F.collect_list("s")).alias("flat"))

    each = met.groupBy("block", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile")).agg(F.sort_array(F.array_union(F.collect_list("node"), F.array(F.first("first")))).alias("nodes"))
    groups = materialise(each.select("nodes").where(F.size("nodes") > 1).distinct().select(F.xxhash64("nodes").alias("cell"), F.explode("nodes").alias("node")), "near-tiles")
    edges = materialise(groups.join(sets, "node").groupBy("cell").agg(*lists).drop("cell").mapInPandas(_tile_links, "a long, b long").distinct(), "near-edges")
    labels = _labels(edges)

    large = met.where("tiles > 1").select("block", "node", "tiles")
    if large.isEmpty():
        return labels
    told = materialise(large.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-told")
    parts = told.groupBy("block", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("block").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("n > most.n")
    split = materialise(split.select("block", F.col("most.component").alias("most"), ((F.col("n") - F.col("most.n")) / F.col("n")).alias("few")), "near-split")
    rows = told.join(split, "block").withColumn("ys", F.ceil(F.col("few") * F.col("tiles")).cast("int"))
    place = F.xxhash64("node")
    held = rows.withColumn("x", F.pmod(place, "tiles").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1))).withColumn("asks", F.lit(False))
    ask = rows.where("component <> most").withColumn("y", F.pmod(place, "ys").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("asks", F.lit(True))
    dealt = held.unionByName(ask).select("block", "x", "y", "node", "component", "asks").join(sets, "node")
    across = dealt.groupBy("block", "x", "y").agg(*lists, F.collect_list("component").alias("parts"), F.collect_list("asks").alias("asks")).drop("block", "x", "y")
    more = materialise(across.mapInPandas(_tile_links, "a long, b long").distinct(), "near-across")
    return _labels(edges.union(more))


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id", tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row of each group: that with the least id, or any one text of it if none has an id."""
    marked = materialise(_marked(docs, text, key), "near-marked")
    each = marked.groupBy("node", "key").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("fp", "size", "blocks")))
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "n")).alias("m")
    nodes = materialise(each.groupBy("node").agg(least, F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("fp", "size", "blocks"))).select("node", F.col("m.key").alias("rep"), F.col("m.n").alias("again"), "n", "fp", "size", "blocks"), "near-nodes")
    labels = near_components(nodes, docs.select(node(text).alias("node"), F.col(key).alias("key"), text_of(text).alias("text")), tile, tile_shingles)
    named = nodes.select("node", "rep", "again", "n").join(labels, "node", "left")
    best = labels.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("m"))
    at, rep, again, stays = (fresh(x, docs) for x in ("node", "rep", "again", "stays"))
    stay = named.join(best.select(F.col("m.node").alias("node")).withColumn("best", F.lit(True)), "node", "left")
    stay = stay.where((F.col("n") > 1) | F.col("component").isNotNull()).select(
        F.col("node").alias(at), F.col("rep").alias(rep), (F.col("again") > 1).alias(again), (F.col("component").isNull() | F.col("best").isNotNull()).alias(stays)
    )
    # Texts that nothing else resembles need no row here, and most texts are such.
    told = _small(materialise(stay, "near-stay"))
    rows = docs.withColumn(at, node(text)).join(told, at, "left")
    mine = F.col(stays) & rows[key].eqNullSafe(rows[rep])
    single = rows.where(F.col(stays).isNull() | (mine & ~F.col(again))).select(docs.columns)
    repeated = rows.where(mine & F.col(again)).groupBy(at).agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), F.xxhash64(*(docs[c] for c in docs.columns))).alias(at + "_row"))
    return single.unionAll(repeated.select(*(F.col(f"{at}_row")[c].alias(c) for c in docs.columns)))
