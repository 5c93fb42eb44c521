"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes round the features in
turn; each step fits a shallow tree over one feature's bins to the residuals
and adds it, shrunken, to that feature's lookup table. Then the pairs of
features whose joint bins explain most of what is left get two-way tables in
the same manner. A score adds one number per table by array lookups in
DataFrame expressions: scoring needs no Python worker and copies no text.

The fit takes at most ``FIT_ROWS`` labelled documents, those with the smallest
hash of their id (an id that is null is never learned from); features and scores cover every document. Only counts taken
from the text are inputs.

Edge cases: a null text is an empty one, and empty texts get the score of
all-zero features; without usable labels every score is 0.5; repeated rows each
get a score; a document with several labels counts as their minimum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.textstats import let, stats, text_of
from loomgraph.plans.storage import materialise, table

FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, MIN_LEAF = 150, 60, 0.15, 3, 20
CUTOFF = 0.3
FEATURES = ("words", "word_length", "symbols", "upper", "line_words", "dup_lines", "repeats")


def features(s: Column) -> list[Column]:
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return [
        s["n_words"].cast("double").alias("words"),
        ratio(s["word_chars"], s["n_words"]).alias("word_length"),
        ratio(s["n_symbols"], s["word_chars"]).alias("symbols"),
        ratio(s["n_upper"], s["word_chars"]).alias("upper"),
        ratio(s["n_words"], s["n_lines"]).alias("line_words"),
        ratio(s["n_dup_lines"], s["n_lines"]).alias("dup_lines"),
        ratio(s["n_repeat_words"], s["n_words"]).alias("repeats"),
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="left")]
        for a, b, ea, eb, t in self.pairs:
            z += t[np.searchsorted(ea, x[:, a], side="left"), np.searchsorted(eb, x[:, b], side="left")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins; a value's bin is the number of cuts below it."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower")) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves over ordered bins."""
    parts = [(0, len(g))]

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, -1
        G, H, N = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(n[lo:hi])
        left = G[:-1] ** 2 / (H[:-1] + 1) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1) - G[-1] ** 2 / (H[-1] + 1)
        left[(N[:-1] < MIN_LEAF) | (N[-1] - N[:-1] < MIN_LEAF)] = 0
        k = int(np.argmax(left))
        return float(left[k]), lo + k + 1

    while len(parts) < leaves:
        gain, at, which = max((*best(*p), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        lo, hi = parts.pop(which)
        parts += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cross cut (one cut on each axis) of a two-way histogram, and its gain."""
    G, H, N = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h, n))
    best, out = 0.0, np.zeros_like(g)
    whole = G[-1, -1] ** 2 / (H[-1, -1] + 1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            cells = []
            for X in (G, H, N):
                a, b, c = X[i, j], X[i, -1] - X[i, j], X[-1, j] - X[i, j]
                cells.append(np.array([a, b, c, X[-1, -1] - a - b - c]))
            if cells[2][cells[2] > 0].min() < MIN_LEAF:
                continue
            gain = float((cells[0] ** 2 / (cells[1] + 1)).sum() - whole)
            if gain > best:
                best, v = gain, cells[0] / (cells[1] + 1)
                out = np.zeros_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on logistic loss; ``x`` rows by features, ``y`` 0 or 1."""
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))), [np.empty(0)] * k, [np.zeros(1)] * k, [])
    p = y.mean()
    base, edges = float(np.log(p / (1 - p))), [_edges(x[:, j], BINS) for j in range(k)]
    at = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    sizes = [np.bincount(a, minlength=len(t)) for a, t in zip(at, tables)]
    for _ in range(ROUNDS):
        for j in range(k):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[j], g, len(tables[j])), np.bincount(at[j], h, len(tables[j])), sizes[j], LEAVES)
            tables[j] += step
            z += step[at[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    cell = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(coarse)]

    def histogram(a: int, b: int, w: np.ndarray | None) -> np.ndarray:
        na, nb = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(cell[a] * nb + cell[b], w, na * nb).reshape(na, nb).astype(float)

    g, h = slopes()
    gains = {(a, b): _pair_tree(histogram(a, b, g), histogram(a, b, h), histogram(a, b, None))[1] for a in range(k) for b in range(a)}
    chosen = [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS] if gains[p] > 0]
    grids = {p: np.zeros_like(histogram(*p, None)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            g, h = slopes()
            step = RATE * _pair_tree(histogram(a, b, g), histogram(a, b, h), histogram(a, b, None))[0]
            grids[a, b] += step
            z += step[cell[a], cell[b]]
    return Model(base, edges, tables, [(a, b, coarse[a], coarse[b], t) for (a, b), t in grids.items()])


def learnable(key: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(False))


def labelled(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, quality): the least usable label of each document that may be learned from."""
    usable = labels.where(F.col("quality").isin(0, 1) & learnable(F.col(key)))
    return usable.groupBy(key).agg(F.min("quality").alias("quality"))


def place(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30))


def some(rows: DataFrame, by: Column, n: int = FIT_ROWS) -> DataFrame:
    """Rows of the ``n`` smallest hashes, and some more: what is left to sort does not grow with the input."""
    count = rows.count()
    share = min(1.0, 1.2 * (n + 100) / max(count, 1))
    return rows.where(place(by) < int(share * (1 << 30)))


def train(counted: DataFrame, truth: DataFrame, key: str = "doc_id") -> Model:
    """``counted``: key and the struct ``s`` of each row that may be learned from, at least; ``truth``: ``labelled`` documents."""
    joined = counted.join(truth, key).select(place(F.col(key)).alias("_order"), *features(F.col("s")), "quality")
    rows = joined.orderBy("_order", *FEATURES).limit(FIT_ROWS).toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float))


def score_of(s: Column, model: Model) -> Column:
    """The model's score of a struct of counts, by array lookups."""

    def bins(x: Column, edges: np.ndarray) -> Column:
        return F.size(F.filter(F.lit(edges), lambda e: e < x)) if len(edges) else F.lit(0)

    def total(x: Column) -> Column:
        z = F.lit(float(model.base))
        for j, (e, t) in enumerate(zip(model.edges, model.tables)):
            z = z + F.get(F.lit(t), bins(F.get(x, F.lit(j)), e))
        for a, b, ea, eb, t in model.pairs:
            z = z + F.get(F.lit(t.ravel()), bins(F.get(x, F.lit(a)), ea) * t.shape[1] + bins(F.get(x, F.lit(b)), eb))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))

    return let(F.array(*features(s)), total)


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", cutoff: float = CUTOFF, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose score reaches the cutoff.

    The model learns from the labelled rows of ``learn_from``, or of ``docs``.
    Behind another filter ``docs`` may hold one label only, which teaches
    nothing; the unfiltered table belongs in ``learn_from`` then.
    """
    source = docs if learn_from is None else learn_from
    truth = labelled(labels, key).join(source.select(key).distinct(), key, "left_semi")
    truth = materialise(some(materialise(truth, "gam-truth"), F.col(key)), "gam-sample")
    # Some 24,000 ids at most: only their texts are counted, and no text is shuffled.
    model = train(source.join(F.broadcast(truth.select(key)), key, "left_semi").select(key, stats(text_of(text)).alias("s")), truth, key)
    return docs.where(let(stats(text_of(text)), lambda s: score_of(s, model) >= cutoff))


def op8_gam_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", stats(text_of("text")).alias("s"))
    counted = materialise(docs, "gam-counts")
    truth = materialise(labelled(table(spark, sf_dir, "labels")).join(counted.select("doc_id").distinct(), "doc_id", "left_semi"), "gam-truth")
    model = train(counted, some(truth, F.col("doc_id")))
    found = counted.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), score_of(F.col("s"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
