"""Language identification: sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 code points of the lower-cased
text, words marked off by one space). A text's weight for an n-gram is its share
of the text's n-grams times the n-gram's inverse document frequency. Weights are
learned by follow-the-regularised-leader with elastic-net penalties, which keeps
them sparse, and scores are softened by a temperature fitted on documents set
aside from the learning sample.

Document frequencies are counted over all documents that may be learned from.
The fit (weights, temperature) takes at most ``FIT_PER_LANG`` documents of each
language, those with the smallest hash of their id. Since a text's weight
is a sum over its n-grams, prediction adds one table row per n-gram of the whole
text, in bounded pieces, without building its vector.

Edge cases: a null text or one without a letter is ``und`` with score 0; if no
language can be learned every text is ``und``; documents without a language or
an id are not learned from; repeated rows are each predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import table

BITS, ORDERS = 16, 3
FIT_PER_LANG, HELD_SHARE = 600, 0.2
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-4, 1e-4, 4
#: Parts of a language when its sample is drawn.
SALTS = 64
#: Code points handled at a time.
PIECE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Signs such as ½ or Ⅷ are words to a pattern but no letters."""
    first = _LETTER.search(text)
    return first is not None and (first.group().isalpha() or any(map(str.isalpha, set(text))))


_SPACES = re.compile(r"\s+")


def _prepared(text: str) -> str:
    return f" {_SPACES.sub(' ', text.lower()).strip()} "


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams that start at each place, order by order."""
    h = np.zeros(len(points), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, code points) of bounded pieces that overlap by ORDERS - 1 points."""
    for i, t in enumerate(texts):
        points = np.frombuffer(_prepared(t).encode("utf-32-le", "replace"), np.uint32)
        for at in range(0, max(len(points) - ORDERS + 1, 1), PIECE):
            yield i, points[at : at + PIECE + ORDERS - 1]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, shares) of one whole text."""
    total = np.zeros(1 << BITS, np.int64)
    for _, points in _pieces([text]):
        for g in grams(points):
            total += np.bincount(g, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at] / max(int(total.sum()), 1)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its calibrated probability for whole texts."""
        n, k = len(texts), len(self.langs)
        known = [t is not None and k > 0 and has_letter(t) for t in texts]
        z, size = np.zeros((n, max(k, 1))), np.zeros(n)
        rows = [i for i in range(n) if known[i]]
        for j, points in _pieces([texts[i] for i in rows]):
            for g in grams(points):
                z[rows[j]] += self.table[g].sum(0, dtype=np.float64)
                size[rows[j]] += len(g)
        z = (z / np.maximum(size, 1)[:, None] + (self.bias if k else 0)) / self.temperature
        p = softmax(z)
        best = p.argmax(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, p[np.arange(n), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 3, corpus: tuple[np.ndarray, int] | None = None) -> Model:
    """FTRL-proximal over (n-grams, shares, language) samples.

    ``corpus`` has the document frequency of every n-gram and the number of
    documents; without it they are counted on the samples.
    """
    langs = sorted({s[2] for s in samples})
    k, dims = len(langs), 1 << BITS
    if k == 0:
        return Model([], np.zeros((dims, 1), np.float32), np.zeros(1), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held, used = order[: int(len(order) * HELD_SHARE)], order[int(len(order) * HELD_SHARE) :]
    df, total = corpus or (np.zeros(dims), len(used))
    if corpus is None:
        for i in used:
            df[samples[i][0]] += 1
    idf = np.log((1 + total) / (1 + df)) + 1
    z, n = np.zeros((dims + 1, k)), np.zeros((dims + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = [(np.append(a, dims), np.append(s * idf[a] * SCALE, 1.0), langs.index(lang)) for a, s, lang in samples]
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            at, x, y = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(dims + 1))
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in held]).reshape(-1, k)
    truth = np.array([rows[i][2] for i in held], np.int64)
    return Model(langs, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], temperature(logits, truth))


#: Shares are small numbers; this brings them near one.
SCALE = 100.0


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(truth)), truth], 1e-12)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def learnable(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 != 1, F.lit(False))


def document_frequencies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, int]:
    """(documents that hold each n-gram, documents) over all learnable rows with a text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One more place holds the number of documents.
        df = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            for t in b["t"]:
                seen = np.zeros(len(df), bool)
                seen[-1] = True
                for _, points in _pieces([t]):
                    for g in grams(points):
                        seen[g] = True
                df += seen
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": df[at]})

    own = docs.where(learnable(F.col(key)) & F.col(text).isNotNull()).select(F.col(text).alias("t"))
    found = own.mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return df[:-1], int(df[-1])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    own = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where(learnable(F.col("k")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    # A language may hold most rows: the first ranking splits each into SALTS parts, the second sees few rows.
    # Rows are ranked, not ids: an id may repeat any number of times.
    own = own.withColumn("h", F.xxhash64("t"))
    order = [F.xxhash64("k"), F.col("k"), F.col("h")]
    part = F.row_number().over(Window.partitionBy("l", "s").orderBy(*order))
    few = own.select("k", "l", "h", F.pmod(F.xxhash64(F.lit(1), "k", "h"), F.lit(SALTS)).alias("s")).withColumn("r", part).where(F.col("r") <= FIT_PER_LANG)
    rank = F.row_number().over(Window.partitionBy("l").orderBy(*order))
    chosen = few.select("k", "l", "h").withColumn("r", rank).where(F.col("r") <= FIT_PER_LANG).select("k", "l", "h").distinct()

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*counts(t), name) for t, name in zip(b["t"], b["l"])]
            yield pd.DataFrame({"at": [r[0] for r in rows], "share": [r[1] for r in rows], "l": [r[2] for r in rows]})

    # The chosen texts are few: at most FIT_PER_LANG of each language.
    once = own.join(F.broadcast(chosen), ["k", "l", "h"], "left_semi").dropDuplicates(["k", "l", "h"])
    sample = once.mapInPandas(featurise, "at array<int>, share array<double>, l string")
    rows = sorted(((np.asarray(r["at"], np.int64), np.asarray(r["share"]), r["l"]) for r in sample.collect()), key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))
    return fit(rows, corpus=document_frequencies(docs, text, key))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores = model.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": langs, "score": scores})

    held_out = (~learnable(F.col("doc_id"))).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")
