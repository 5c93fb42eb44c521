"""Each operator against a brute-force version, and its edge cases."""

import base64
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import op01_warc as warc
from loomgraph.llm import op02_ann as ann
from loomgraph.llm import op03_quality_rules as rules
from loomgraph.llm import op04_sharding as sharding
from loomgraph.llm import op05_token_file as tokenfile
from loomgraph.llm import op06_packing as packing
from loomgraph.llm import op07_sampled_pieces as pieces
from loomgraph.llm import op08_gam_classifier as gam
from loomgraph.llm import op09_language_id as language
from loomgraph.llm import op10_simhash as simhash
from loomgraph.llm.tokens import WordEncoder, encoder, slices
from loomgraph.plans.storage import new_path

random.seed(5)
WORDS = [f"w{i}" for i in range(400)]
TEXTS = [" ".join(random.choice(WORDS) for _ in range(random.randrange(1, 120))) for _ in range(120)]
#: Null, empty, blank, repeated, very long and odd texts.
ODD = [None, "", " \n\t ", "a", "A a", "a b\na b\n", "same text here", "same text here", "word " * 30_000, "é ß ’ 中文   x\x1cy", "<|endoftext|> # | $"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + TEXTS
    rows = [(i, t, "en", "src", 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (3, "a", "en", "src", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def empty(df):
    return df.limit(0)


# -- 1 -------------------------------------------------------------------------
def test_warc_round_trip(spark):
    html = [None, "", "x" * 70_000, "é" * 9000, "WARC/1.1\r\n\r\n", "same", "same", "same", "x" * 70_000]
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(html)] + [(7, "http://a/7", "same"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "t-warc")
    warc.write(pages, path)
    got = [(r["record_id"].split(":")[2], r["record_type"], r["payload_bytes"], r["payload_digest"], (r["refers_to"] or "::").split(":")[2], r["ok"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.read_payloads(spark, path).collect()]
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = i is not None and i != top
        want.append(("" if i is None else str(i), "revisit" if revisit else "response", len(body), digest, str(top) if revisit else "", True, None if revisit else body))
    assert sorted(got, key=str) == sorted(want, key=str)
    records = warc.read(spark, path)
    assert records.where("record_type = 'continuation'").count() > 0
    assert records.where("segment > 0").groupBy(F.coalesce("origin_id", "record_id")).count().count() == 1
    lost = warc.reassemble(records.where("segment <> 2"))
    assert {r["reason"] for r in lost.where("not ok").collect()} == {"segments missing"}
    warc.write(empty(pages), new := new_path(spark, "t-warc"))
    assert warc.read_payloads(spark, new).count() == 0
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab")


# -- 2 -------------------------------------------------------------------------
def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:1100] = x[700]  # a hot vector
    x[1499, 3:] = 0  # given with three components only
    rows = [(i, [float(v) for v in x[i][: 3 if i == 1499 else 16]]) for i in range(len(x))] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (None, [1.0] * 16), (5005, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    use = ann.usable(df, "vec_id", "embedding")
    got = ann.search(use, "key % 50 = 0 or key = 1499").toPandas()
    assert got.groupby("query_id").size().eq(20).all() and got.vec_id.max() < 1500 and (got.query_id != got.vec_id).all()
    assert len(got) == 31 * 20 and not got.duplicated(["query_id", "vec_id"]).any()
    hit = total = 0
    d = x.astype(float)
    for q, part in got.sort_values("rank").groupby("query_id"):
        score = d @ d[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(d)), -score))[:20]
        hit, total = hit + len(set(best) & set(part.vec_id)), total + 20
        assert np.allclose(part.score, score[part.vec_id.to_numpy()], atol=1e-9) and (np.diff(part.score) <= 1e-12).all()
    assert hit / total >= 0.9
    whole = ann.search(use, "key % 100 = 0", coverage=1.0).toPandas()
    copies = [i for i in whole[whole.query_id == 700].sort_values("rank").vec_id if 700 < i < 1100]
    assert len(copies) > 2 and copies == list(range(701, 701 + len(copies)))  # ties to smaller ids
    few = use.where("key < 5")
    assert ann.search(few, "true").count() == 5 * 4
    assert ann.search(empty(use), "true").count() == 0
    twice = ann.search(use.where("key < 3").union(use.where("key = 1")), "key = 1").collect()
    assert sorted((r["rank"], r["vec_id"]) for r in twice)[:2] == [(1, 1), (1, 1)] and len(twice) == 6


def test_ann_scan_abandons_nothing_that_is_nearer():
    rng = np.random.default_rng(1)
    plain = rng.standard_normal((900, 40)) + 3 * rng.standard_normal((900, 1))
    top, turn = float((plain**2).sum(1).max()), ann.rotation(41)
    x = np.column_stack([plain, np.sqrt(top - (plain**2).sum(1))]) @ turn
    asked = plain[:30]
    q = np.column_stack([asked, np.zeros(30)]) @ turn
    allowed = rng.random((30, 900)) < 0.7
    exact = np.where(allowed, asked @ plain.T, -np.inf)
    for limits in (np.full(30, -np.inf), np.sort(exact, axis=1)[:, -40]):
        qi, xi, score = ann.scan(x, plain, np.arange(900), q, asked, allowed, limits, top, 20)
        hit = sum(len(set(xi[qi == i]) & set(np.argsort(-exact[i])[:20])) for i in range(30))
        assert hit >= 0.97 * 600 and allowed[qi, xi].all() and np.allclose(score, exact[qi, xi])


# -- 3 -------------------------------------------------------------------------
def _stats(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts_and_thresholds(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(100)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = rules.op3_quality_rules(spark, str(tmp_path)).collect()
    texts = docs.collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted((r["doc_id"] if r["doc_id"] is not None else -1, *_stats(r["text"])) for r in texts)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # too few labels to certify a cutoff
    kept = rules.keep(docs.withColumn("quality", F.lit(1)), labels)
    assert kept.count() == sum(r["kept"] for r in got) and kept.columns[-1] == "quality"
    assert rules.keep(empty(docs), empty(labels)).count() == 0


def test_hypergeometric_counts_of_large_populations():
    rng = np.random.default_rng(2)
    draws, good, bad = 1_000_000_000, 3_000_000_000, 7_000_000_000
    got = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(200)], float)
    sd = (draws * 0.3 * 0.7 * (good + bad - draws) / (good + bad - 1)) ** 0.5
    assert abs(got.mean() - 300_000_000) < 5 * sd / 200**0.5 and 0.8 * sd < got.std() < 1.2 * sd
    assert sharding._hypergeometric(rng, 2_000_000_000, 0, 7) == 7 and 0 <= sharding._hypergeometric(rng, 3, 2_000_000_000, 2_000_000_000) <= 3
    small = [sharding._hypergeometric(rng, 2_000_000_000, 2, 2_000_000_001) for _ in range(20)]
    assert all(1_999_999_999 <= x <= 2_000_000_000 for x in small)


def test_binomial_tail(spark):
    rows = [(n, k) for n in (10, 500, 90_000) for k in (0, 1, int(n * 0.01) - 1) if k >= 0]
    got = spark.createDataFrame(rows, "n long, k long").withColumn("p", rules.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect()
    for r in got:
        if r["k"] >= r["n"] * 0.01:
            assert r["p"] == 1.0
        else:
            want = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.01) + (r["n"] - i) * math.log(0.99)) for i in range(r["k"] + 1))
            assert r["p"] == pytest.approx(want, rel=1e-6)


# -- 4 -------------------------------------------------------------------------
def test_sharding(spark, docs):
    got = sharding.shuffle(docs.withColumn("shard", F.lit("x")), 8).toPandas()
    n = docs.count()
    assert len(got) == n and set(got.groupby("_shard").size()) <= {n // 8, n // 8 + 1}
    for _, part in got.groupby("_shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sorted(got.text.dropna()) == sorted(r["text"] for r in docs.collect() if r["text"] is not None)
    assert sharding.shuffle(empty(docs)).count() == 0
    few = sharding.shuffle(docs.limit(3)).toPandas()
    assert len(few) == 3 and set(few.slot) == {0}
    counts = np.array([5, 0, 90, 7])
    total = np.zeros((4, 8))
    for seed in range(300):
        m = sharding.communication_matrix(counts, 8, seed)
        assert (m.sum(1) == counts).all() and m.sum(0).max() - m.sum(0).min() <= 1
        total += m
    assert np.allclose(total / 300, np.outer(counts, [13] * 6 + [12] * 2) / 102, atol=0.6)


# -- 5 and 6 -------------------------------------------------------------------
def test_encoder_learns_words_together():
    words = ["the", " cat", "'s", "42", " 7", "é", "__", "\n", "\n \t", "ﬁ", " 東京", "☃"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e, calls = WordEncoder(name, spaced), []
        library = e._library
        e._library = lambda texts: calls.append(len(texts)) or library(texts)
        own = [w for w in words if spaced or not w.isspace()]
        if not spaced:
            own = [w.strip() for w in own]
        e._learn(own)
        want = library(own)
        assert [e.flat[a : a + n].tolist() for a, n in zip(e.starts, e.sizes[: len(own)])] == want
        assert calls == ([1, 2] if spaced else [1])  # white space alone goes word by word


def test_encoder_merges_latin_words_directly():
    signs = "".join(map(chr, range(256)))
    texts = [signs, signs.lower() * 2, "THE The the I'M i'm 12 x12 12x \x00a \x7f <|endoftext|> " + "ab" * 2000, "\x01\x02 \x03", "a\x00b"]
    texts += ["".join(random.choice(signs[:28] + signs[32:178] + signs[180:185] + signs[186:188] + signs[191:]) for _ in range(40)) for _ in range(300)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e, calls = WordEncoder(name, spaced), []
        library = e._library
        e._library = lambda texts: calls.append(texts) or library(texts)
        e._learn(["the", "Cat", "'s", "__", "ÉTÉ", "weiß"])
        assert not calls  # no cutting by the library
        e = WordEncoder(name, spaced)
        ids, at = e.encode(texts)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == library(texts)


def test_slices_hold_few_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1201)), pa.array(["a"] * 1201)], names=["k", "t"])
    got = list(slices(iter([batch, batch])))
    assert max(len(k) for k, _ in got) == 500 and [x for k, _ in got for x in k] == [*range(1201)] * 2


def test_encoder_equals_library():
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = encoder(name, spaced)
        texts = [t or "" for t in ODD[:8] + ODD[9:]] + ["".join(random.choice("ab'sSRE1²½é́ \n\t _.,!İß9٣\xa0\x1d中") for _ in range(12)) for _ in range(500)]
        ids, at = e.encode(texts)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [list(ids[at[i] : at[i + 1]]) for i in range(len(texts))] == want


def _ids(texts, name, spaced, end):
    e = encoder(name, spaced)
    ids, at = e.encode([t or "" for t in texts])
    return [np.append(ids[at[i] : at[i + 1]], np.uint32(end)) for i in range(len(texts))]


def test_token_file(spark, docs, tmp_path):
    path = f"{tmp_path}/tokens"
    tokenfile.write(docs, path)
    got = tokenfile.read(spark, path).toPandas()
    rows = [(tokenfile.NO_ID if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(k, len(t), zlib.crc32(t.astype("<u4").tobytes())) for (k, _), t in zip(rows, _ids([t for _, t in rows], tokenfile.TOKENIZER, True, 0))]
    assert sorted(zip(got.doc_id, got.n_tokens, got.ids_crc32)) == sorted(want)
    order = got.sort_values(["file", "local_start"])
    assert order.doc_id.is_monotonic_increasing
    import glob

    import zstandard

    for f in glob.glob(f"{path}/*.txt"):
        data = open(f, "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(plain) == sum(x[2] for x in tokenfile.seek_table(data))
        for _, n, first, last, _ in tokenfile.file_index(data):
            assert n > 0 and first <= last
    data = next(d for d in (open(f, "rb").read() for f in glob.glob(f"{path}/*.txt")) if any(a <= 5 <= b for _, _, a, b, _ in tokenfile.file_index(d)))
    assert [len(x) for x in tokenfile.read_documents(data, {5})[5]] == list(got[got.doc_id == 5].n_tokens)
    broken = bytearray(data)
    broken[40] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.read_frame(bytes(broken), tokenfile.seek_table(data)[0])
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    tokenfile.write(empty(docs), f"{tmp_path}/none")
    assert tokenfile.read(spark, f"{tmp_path}/none").count() == 0


def _check_packing(sequences, sizes, limits):
    at = {}
    for s in sequences:
        n = sum(p[2] for p in s)
        assert n <= limits[0] and len(s) <= limits[1] and sum(p[3] for p in s) <= limits[2]
        assert n == limits[0] or n & (n - 1) == 0
        for d, start, size, _ in s:
            at.setdefault(d, []).append((start, size))
    for d, n, _ in sizes:
        end = 0
        for start, size in sorted(at.pop(d)):
            assert start == end and size > 0
            end += size
        assert end == n
    assert not at


def test_packing_limits():
    for limits in ((64, 100, 64), (64, 3, 64), (64, 8, 20), (2048, 64, 2048)):
        sizes = [(i, n, random.randrange(0, n + 1)) for i, n in enumerate(random.randrange(1, 300) for _ in range(400))]
        _check_packing(list(packing.pack(iter(sizes), limits, 64)), sizes, limits)
    assert list(packing.pack(iter([]))) == []


def test_packed_documents(spark, docs):
    got = packing.pack_documents(docs.withColumn("start", F.lit(1))).toPandas()
    texts = docs.collect()
    ids = _ids([r["text"] for r in texts], packing.TOKENIZER, False, 1)
    assert got.length.sum() == sum(map(len, ids))
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset.to_numpy() == np.concatenate([[0], part.length.cumsum().to_numpy()[:-1]])).all() and part.length.sum() <= 2048
    for r, own in zip(texts, ids):
        if r["doc_id"] not in (None, 3):
            for p in got[got.doc_id == r["doc_id"]].itertuples():
                assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].astype("<u4").tobytes())
    assert packing.pack_documents(empty(docs)).count() == 0


def test_packed_documents_with_loss_and_ids(spark):
    rows = [(i, " ".join(random.choice(WORDS) for _ in range(40)), None if i == 0 else 10_000 if i == 1 else i % 30) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer long").coalesce(1)
    limits = (512, 64, 40)
    own = dict(zip(range(60), _ids([t for _, t, _ in rows], packing.TOKENIZER, False, 1)))
    want = {k: len(own[k]) if n is None else min(n, len(own[k])) for k, _, n in rows}
    for loss in ("answer", F.col("answer") + 0):
        got = packing.pack_documents(docs, limits=limits, loss=loss).toPandas()
        assert (got.groupby("sequence_id").loss_tokens.sum() <= 40).all()
        assert got.sequence_id.nunique() > packing.pack_documents(docs, limits=(512, 64, 512), ids=False).select("sequence_id").distinct().count()
        assert got.groupby("doc_id").loss_tokens.sum().to_dict() == want
        for p in got.itertuples():
            ids = np.array(p.ids, np.int64)
            assert (ids == own[p.doc_id][p.start : p.start + p.length]).all() and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
    assert "ids" not in packing.pack_documents(docs, ids=False).columns


# -- 7 -------------------------------------------------------------------------
def test_sampled_pieces(spark, docs):
    m = pieces.model(pieces.MODEL)

    def every(word):
        arcs, out = m.lattice(word), []

        def go(at, ids, p):
            if at == len(word):
                out.append((tuple(ids), p))
                return
            for e, i, s in arcs[at]:
                go(e, ids + list(i), p + s)

        go(0, [], 0.0)
        return dict(out)

    found = every("▁the")
    assert sum(math.exp(p) for p in found.values()) == pytest.approx(1)
    first = pd.Series([tuple(m.sample("the", 1, i)[0][0]) for i in range(4000)]).value_counts(normalize=True)
    for ids, p in found.items():
        assert first.get(ids, 0) == pytest.approx(math.exp(p), abs=0.03)
    both = m.sample("the", 50, 1)
    assert {tuple(x[0]) for x in both} == set(found) and all(x[3] == 1.0 for x in both)
    assert m.sample("", 4, 1) == [([], 0.0, pytest.approx(m.sample("", 4, 1)[0][2]), 1.0)]
    out = pieces.sample_pieces(docs.where("doc_id <> 8 or doc_id is null"), ["doc_id"], "text").toPandas()
    assert (out.groupby(["doc_id", "sample"]).size() >= 1).all() and out[out.doc_id == 20].ids.map(tuple).nunique() == 4
    assert set(out[out.doc_id == 20].decoded) == {TEXTS[20 - len(ODD)]}
    assert (out.inclusion.between(0, 1)).all() and pieces.sample_pieces(empty(docs), ["doc_id"], "text").count() == 0


def test_sampled_pieces_draw_without_replacement():
    m, n = pieces.model(pieces.MODEL), 20_000
    every = {(): 0.0}
    for word in ("▁the", "▁a"):
        arcs = m.lattice(word)

        def go(at, ids, p):
            if at == len(word):
                yield ids, p
            else:
                for e, i, s in arcs[at]:
                    yield from go(e, ids + i, p + s)

        every = {a + b: p + q for a, p in every.items() for b, q in go(0, (), 0.0)}
    drawn = m.sample_all(["the a"] * n, 3, list(range(n)))
    pairs = pd.Series([(tuple(x[0][0]), tuple(x[1][0])) for x in drawn]).value_counts(normalize=True)
    checked = 0
    for a, p in every.items():
        for b, q in every.items():
            chance = math.exp(p + q) / (1 - math.exp(p))
            if a != b and chance * n > 20:
                checked += 1
                assert pairs[(a, b)] == pytest.approx(chance, abs=4 * math.sqrt(chance / n))
    assert checked >= 2
    # Weighting by inclusion scores gives unbiased totals.
    assert np.mean([sum(math.exp(p) / i for _, p, _, i in x) for x in drawn]) == pytest.approx(1, abs=0.01)
    assert len({tuple(x[0]) for x in m.sample("the a", 99, 5)}) == len(every)
    assert all([x[2] for x in s] == sorted((x[2] for x in s), reverse=True) for s in drawn[:100])


def test_sampled_pieces_do_not_depend_on_their_batch():
    m = pieces.model(pieces.MODEL)
    texts = [*TEXTS[:6], "", "x" * 300, "½ é 漢字 \U0001f600 a\nb", "  lead  two", "one\ttwo"]
    got = m.sample_all(texts, 4, list(range(len(texts))))
    for i, t in enumerate(texts):
        assert [(a.tolist(), *rest) for a, *rest in got[i]] == m.sample(t, 4, i)
        for ids, *_ in got[i]:
            assert m.decode(ids).decode() == m.sp.decode(ids.tolist()) == m.sp.decode(m.sp.encode(t))


def test_sampled_pieces_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, "a text"), (None, None, None)], "_hash long, ids long, _text string")
    out = pieces.sample_pieces(df, ["_hash", "ids"], "_text").toPandas()
    assert list(out.columns) == ["_hash", "ids", "sample", "log_prob", "perturbed", "inclusion", "_ids", "decoded"]
    assert set(out[out["ids"] == 2].decoded) == {"a text"} and len(out[out["ids"].isna()]) == 1


def test_sampled_pieces_cover_documents_and_conversations(spark, tmp_path):
    texts = [(0, "some words of a text"), (1, None), (2, "word " * 3000), (None, "no id")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 0, "a first turn"), (7, 1, "another one")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = pieces.op7_sampled_pieces(spark, str(tmp_path)).toPandas()
    docs = out[out.conv_id.isna()]
    assert dict(docs.groupby("doc_id", dropna=False).size().items()).get(2) == 4 and len(docs) == 1 + 3 * pieces.SAMPLES
    assert (docs[docs.doc_id == 2].n_pieces >= 3000).all() and len(out) - len(docs) == 2 * pieces.SAMPLES



# -- 8 and 9 -------------------------------------------------------------------
def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x, y)
    test = rng.random((2000, 3))
    truth = (test[:, 0] > 0.5) ^ (test[:, 1] > 0.5)
    assert ((m.score(test) > 0.5) == truth).mean() > 0.9 and m.pairs
    assert gam.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert gam.fit(x, np.ones(len(x))).score(x[:1])[0] > 0.9


def test_gam_scores_without_python_workers(spark, docs):
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(gam.FEATURES))) * [400, 10, 0.1, 0.2, 20, 1, 1]
    m = gam.fit(x, ((x[:, 0] > 200) ^ (x[:, 1] > 5)).astype(float))
    s = docs.select(gam.stats(gam.text_of("text")).alias("s"))
    got = s.select(*gam.features(F.col("s")), gam.score_of(F.col("s"), m).alias("score")).toPandas()
    assert m.pairs and np.allclose(got["score"], m.score(got[list(gam.FEATURES)].to_numpy(float)), rtol=1e-12, atol=0)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = gam.keep(docs, labels)
    assert "Arrow" not in kept._jdf.queryExecution().toString() and kept.columns == docs.columns
    one = gam.fit(x, np.ones(len(x)))  # one label: tables without cuts
    assert s.select(gam.score_of(F.col("s"), one).alias("score")).where("score < 0.99").count() == 0


def test_gam_on_documents(spark, docs):
    bad = [(1000 + i, "BAD!! | " * 40, "en", "s", 0) for i in range(60)]
    good = [(2000 + i, " ".join(random.choice(WORDS) for _ in range(80)), "en", "s", 0) for i in range(60)]
    more = docs.unionByName(spark.createDataFrame(bad + good, docs.schema))
    labels = spark.createDataFrame([(r[0], 0) for r in bad] + [(r[0], 1) for r in good], "doc_id long, quality int")
    kept = {r["doc_id"] for r in gam.keep(more.withColumn("score", F.lit(0)), labels).select("doc_id").collect()}
    assert kept >= {r[0] for r in good} and not kept & {r[0] for r in bad}
    assert gam.keep(empty(docs), empty(labels)).columns == docs.columns
    # Input whose labels are all 1 teaches nothing; the unfiltered table does.
    later = more.where(F.col("doc_id") >= 1030)
    known = labels.where("doc_id < 1030 or quality = 1")
    taught = {r["doc_id"] for r in gam.keep(later, known, learn_from=more).select("doc_id").collect()}
    assert taught == {r[0] for r in good} and gam.keep(later, known).count() == later.count()


def test_language(spark):
    en, de = ["the and of that with this", "is to in that the for"], ["der die und das nicht mit", "ist ein zu den von sich"]
    rows = [(i, " ".join(random.choice(en if i % 2 else de) for _ in range(20)), "en" if i % 2 else "de", "s") for i in range(120)] + [(500, None, "en", "s"), (501, "12 34 !", "en", "s"), (None, "the and", "en", "s")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = language.train(docs_)
    assert m.langs == ["de", "en"]
    got, score = m.predict([r[1] for r in rows])
    assert [g for g, r in zip(got, rows) if r[0] is not None and r[0] < 500] == [r[2] for r in rows[:120]]
    assert got[120] == got[121] == "und" and score[120] == 0 and ((score >= 0) & (score <= 1)).all()
    assert (m.table == 0).mean() > 0.9  # sparse
    assert language.train(empty(docs_)).predict(["the", None])[0] == ["und", "und"]
    assert m.predict(["½ ² ³ Ⅷ", "½ the"])[0] == ["und", "en"]
    long = "the and of " * 60_000
    assert m.predict([long])[0] == ["en"]


def test_language_sample_is_bounded_when_an_id_repeats(spark, monkeypatch):
    held = []
    monkeypatch.setattr(language, "fit", lambda rows, **_: held.append(len(rows)))
    same = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(same, f"the text {i}", "en") for i in range(2000)] + [(same, "der text", "de")] * 1500
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert held == [language.FIT_PER_LANG + 1]


def test_language_document_frequencies_cover_all_rows(spark):
    rows = [(i, f"text {'qqq' if i % 50 == 0 else 'abc'} {i}", "en") for i in range(3000)] + [(None, "no id", "en"), (0, None, "en")]
    df, total = language.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    own = [t for k, t, _ in rows if k is not None and t is not None and zlib.crc32(str(k).encode()) % 3 != 1]
    want = np.zeros(1 << language.BITS, np.int64)
    for t in own:
        want[language.counts(t)[0]] += 1
    assert total == len(own) > language.FIT_PER_LANG and (df == want).all()


# -- 10 ------------------------------------------------------------------------
def _fingerprint(text):
    import re

    import xxhash

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(spark, docs):
    got = {(r["doc_id"], r["fp"] & (2**64 - 1)) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(r["doc_id"], _fingerprint(r["text"])) for r in docs.collect()}
    kept = simhash.keep(docs.withColumn("fp", F.lit(1)))
    assert kept.columns[-1] == "fp" and kept.where("text = 'same text here'").count() == 1 and kept.where("doc_id = 3").count() == 1
    assert kept.where("trim(coalesce(text, '')) = ''").count() <= 2 and kept.where("doc_id = 0").count() == 1
    assert simhash.near_duplicates(empty(docs)).count() == 0 and simhash.keep(empty(docs)).count() == 0


def test_simhash_keep_tells_rows_of_one_id_apart(spark):
    one, two, three = (" ".join(random.choice(WORDS) for _ in range(80)) for _ in range(3))
    rows = [(1, one), (1, two), (1, two), (2, two), (3, three), (4, one), (None, three)]
    kept = simhash.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, two), (3, three)])


@pytest.mark.parametrize("bucket", [4096, 8, 2])
def test_simhash_links(spark, bucket):
    """With a small bucket the crowded neighbourhoods are split and tiled."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:8]:
        now = base
        for _ in range(25):
            now ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.add(now)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in fps}
    root = {x: x for x in fps}
    for r in found:
        a, b = find(r["a"] & (2**64 - 1)), find(r["b"] & (2**64 - 1))
        root[max(a, b)] = min(a, b)
    assert {x: find(x) for x in fps} == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 11, 18])
def test_bit_sliced_comparison(radius, monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(130)]
    fps += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(2 * radius + 3))) for x in fps]
    rng.shuffle(fps)
    a, lo = np.array(fps, np.uint64), np.arange(1, len(fps) + 1)
    hi = np.array([100] * 100 + [len(fps)] * 160)  # two groups
    got = {(int(x), int(y), int(d)) for i, j, far in simhash.close_pairs(a, lo, hi, simhash.planes_of(a), radius) for x, y, d in zip(i, j, far)}
    assert got == {(i, j, d) for i in range(len(fps)) for j in range(i + 1, hi[i]) if (d := (fps[i] ^ fps[j]).bit_count()) <= radius}
