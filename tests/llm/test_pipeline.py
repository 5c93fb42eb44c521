"""The chain of the pipeline against brute force, near copies included."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import near_copies
from loomgraph.llm import op06_packing as packing
from loomgraph.llm.tokens import encoder


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike(x, y):
    a, b = shingles(x), shingles(y)
    return x.lower().split() == y.lower().split() or bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)


def first_ids(rows):
    """The least id of each component of similar texts, by all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def changed(rng, words, n):
    """``words`` with n of them replaced, far from each other."""
    out = list(words)
    for p in range(n):
        out[5 + p * (len(words) // n) + rng.randrange(5)] = f"new{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 220))]
        texts.append(" ".join(words))
        for n in rng.sample(range(1, 8), 3):
            texts.append(" ".join(changed(rng, words, n)))
    passage = [f"p{i}" for i in range(40)]
    texts += [" ".join(passage + [f"x{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("tile", [near_copies.TILE, 3])
def test_near_copies_equal_brute_force(spark, tile):
    rows = corpus()
    pairs = [len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) for i, (_, x) in enumerate(rows) for _, y in rows[:i]]
    assert sum(0.8 <= p <= 0.95 for p in pairs) > 20 and sum(0.6 < p < 0.8 for p in pairs) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "") if tile == near_copies.TILE else near_copies.keep(docs, tile=tile)
    assert sorted(r["doc_id"] for r in got.collect()) == first_ids(rows)


def test_near_copies_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a c"), (5, long), (None, long + " end"), (None, "only here"), (None, "only here"), (7, long)]
    got = near_copies.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, [(1, None), (3, "a b"), (5, "a c"), (5, long), (None, "only here")]))
    assert near_copies.keep(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_in_one_large_group(spark):
    """Copies that hang together by chains, beside texts that resemble them but not enough."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words)]
    for _ in range(80):
        texts.append(" ".join(changed(rng, rng.choice(texts).split(), rng.randrange(1, 4))))
    texts += [" ".join(changed(rng, words, n)) for n in (6, 8, 10, 12) for _ in range(10)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_copies.keep(docs, tile=16).collect()) == first_ids(rows)


def test_band_keys_and_empty_runs():
    values = np.array([5, 7, 9, 7, 9, 5], np.uint64)
    keys = near_copies.band_keys(values, np.array([0, 3, 3, 6]))
    assert (keys[0] == keys[2]).all() and (keys[0] != keys[1]).all() and len(set(keys[0])) == near_copies.BANDS


def test_chain_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus() + [(1000, "too short"), (1001, "over and over " * 50), (1002, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = []

    def recorded(df, name, write=corpus_pipeline.materialise):
        out = write(df, name)
        stages.append((name, sorted(tuple(r) for r in out.select("doc_id", "text").collect())))
        return out

    monkeypatch.setattr(corpus_pipeline, "materialise", recorded)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # Without labels no cutoff is certified and nothing is learned: the base rule alone rejects.
    good = sorted(r for r in rows if r[0] < 1000)
    firsts = set(first_ids(good))
    want = [good, good, [r for r in good if r[0] in firsts]]
    assert [name for name, _ in stages] == [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]]
    assert [found for _, found in stages] == want and len(want[2]) < len(good) - 20
    tokens = encoder(packing.TOKENIZER, False)
    for key, text in want[2]:
        ids = [*tokens.encode([text])[0].tolist(), packing.END_ID]
        parts = packed[packed.doc_id == key].sort_values("start")
        assert [i for p in parts.ids for i in p] == ids
        assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in parts.itertuples())
    assert set(packed.doc_id) == firsts
    for _, part in packed.groupby("sequence_id"):
        n = part.length.sum()
        assert n <= packing.TOKENS and len(part) <= packing.SEGMENTS and n & (n - 1) == 0
