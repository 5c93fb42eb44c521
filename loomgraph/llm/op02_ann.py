"""Approximate nearest neighbours by adaptive dimension scan in an inverted file.

Vectors get one more component that turns the largest inner product into the
least distance, are rotated at random and assigned to the list of their nearest
centroid. Neighbouring lists stand on one shelf, a shelf over ``CELL_ROWS``
vectors is dealt into several cells, and a task holds one cell at a time while
the queries that probe it stream by; so vectors move once a wave, and a query
once for each cell that it probes, not for each list.

Lists are probed in three waves: the nearest list, the next ones up to an eighth
of all probes, then the rest. A wave starts with the k-th best score that the
waves before have found for a query. Within a cell, squared distances of a block
of queries to a block of vectors are built up from column blocks of the rotated
vectors; after each, a candidate whose partial distance, scaled to all
dimensions, exceeds the query's limit by more than the test's margin is
abandoned: under a random rotation that is a test of the hypothesis that it is
nearer. Survivors get their exact inner product in double precision from the
original vectors; a task keeps the k best of each query, and what a wave gives
back is what beats its limits, some dozens of rows a query at any size.

Centroids are fitted on at most ``FIT_ROWS`` vectors, those with the smallest
hash of their id; every vector is indexed. List sizes, norms and the number of
lists (the square root of the row count, up to ``LISTS``) come from all rows.
How many lists a query probes is measured on the sample: as many as hold
``COVERAGE`` of its exact nearest neighbours.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; shorter vectors count as continued with zeros; a query
probes on until the lists it has seen hold enough candidates; ties go to the
smaller id; rows that repeat an id are separate candidates and separate queries,
and only a query's own row is none of its candidates; a row without an id takes
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialise, table

K, QUERY_EVERY = 20, 20
FIT_ROWS, LISTS, FIT_ROUNDS = 20_000, 4096, 8
#: Share of sampled nearest neighbours whose lists are to be probed; it sets how many are.
COVERAGE, COVERAGE_QUERIES = 0.97, 400
#: Lists of a shelf, and vectors of a cell, about.
SHELF, CELL_ROWS = 8, 32_768
#: Vectors and queries that are matched at a time.
BLOCK, QUERY_BLOCK = 4096, 256
#: Rows that a task holds before it cuts them down to the k best of each query.
HELD_ROWS = 400_000
#: Columns added at a time, and the margin of the test in standard deviations.
COLUMNS, MARGIN, SEED = 16, 2.1, 7
#: Share of candidates left below which they are followed one by one.
SPARSE = 1 / 16
FOUND = "query_no long, query_id long, vec_id long, score double"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & fine)


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, n: int, rounds: int = FIT_ROUNDS, seed: int = SEED) -> np.ndarray:
    """Lloyd's algorithm from random rows; an emptied centre keeps its place."""
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums, sizes = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out, norms = np.empty(len(x), np.int64), (c**2).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin(norms - 2 * x[i : i + 4096] @ c.T, axis=1)
    return out


def probes_needed(sample: np.ndarray, turned, centres: np.ndarray, k: int, coverage: float) -> int:
    """Lists to visit so that ``coverage`` of the k nearest in the sample lie in them.

    Neighbours in a sample are farther away than those in the whole table, so
    the figure is on the safe side.
    """
    q = sample[:COVERAGE_QUERIES]
    products = q @ sample.T
    products[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-products, axis=1)[:, : min(k, max(len(sample) - 1, 0))]
    place = np.argsort(np.argsort((centres**2).sum(1) - 2 * turned(q, True) @ centres.T, axis=1), axis=1)
    home = nearest(turned(sample), centres)
    depth = np.take_along_axis(place, home[near], axis=1)
    return int(np.quantile(depth, coverage)) + 1 if depth.size else 1


def matrix(column, d: int) -> np.ndarray:
    """The vectors of a column as rows, continued with zeros."""
    out = np.zeros((len(column), d))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, by query, best first."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[place < k]


def scan(x: np.ndarray, plain: np.ndarray, ids: np.ndarray, q: np.ndarray, q_plain: np.ndarray, allowed: np.ndarray, limits: np.ndarray, ceiling: float, k: int) -> tuple[np.ndarray, ...]:
    """(places in ``q``, places in ``x``, inner products) of each query's best among the block.

    ``limits``: the k-th best inner product known for each query, or minus
    infinity; where none is known the block's own k-th best stands in.
    ``|q - x|^2 = |q|^2 + ceiling - 2 <q, x>`` in the rotated space.
    """
    d, own, limits = x.shape[1], (q_plain**2).sum(1), limits.copy()
    none = np.flatnonzero(np.isneginf(limits) & (allowed.sum(1) > k))
    if len(none):
        products = np.where(allowed[none], q_plain[none] @ plain.T, -np.inf)
        limits[none] = np.partition(products, len(plain) - k, axis=1)[:, len(plain) - k]
    slack = 1e-9 * (own + ceiling)
    far = own + ceiling - 2 * limits + slack
    part, alive, done = np.zeros(allowed.shape), allowed, 0
    qi = xi = None
    while done < d:
        to = min(done + COLUMNS, d)
        a, b = q[:, done:to], x[:, done:to]
        if qi is None:
            part += (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
        else:
            left += ((a[qi] - b[xi]) ** 2).sum(1)
        done = to
        bound = far * (done / d) * (1 + MARGIN / np.sqrt(done)) ** 2 if done < d else far
        if qi is None:
            alive = alive & (part <= bound[:, None])
            if done < d and np.count_nonzero(alive) < SPARSE * alive.size:
                qi, xi = np.nonzero(alive)
                left = part[qi, xi]
        else:
            stay = left <= bound[qi]
            qi, xi, left = qi[stay], xi[stay], left[stay]
    if qi is None:
        qi, xi = np.nonzero(alive)
    score = np.empty(len(qi))
    for i in range(0, len(qi), 65_536):
        score[i : i + 65_536] = np.einsum("ij,ij->i", q_plain[qi[i : i + 65_536]], plain[xi[i : i + 65_536]])
    near = score >= limits[qi] - slack[qi]
    qi, xi, score = qi[near], xi[near], score[near]
    best = best_of(qi, ids[xi], score, k)
    return qi[best], xi[best], score[best]


def search(rows: DataFrame, wanted: Column | str, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query.

    ``rows``: (key long, v array<double>) of usable vectors; those that meet the
    condition ``wanted`` are queries too.
    """
    spark = rows.sparkSession
    wanted = F.expr(wanted) if isinstance(wanted, str) else wanted
    rows = materialise(rows.withColumn("no", F.monotonically_increasing_id()), "ann-rows")
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top, d = rows.agg(F.count("*"), F.max(squared), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix([r["v"] for r in rows.select("v", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(FIT_ROWS).select("v").collect()], d)
    turn = rotation(d + 1)

    def turned(x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x**2).sum(1), 0))
        return np.column_stack([x, extra]) @ turn

    centres = centroids(turned(sample), int(min(LISTS, max(1, round(n**0.5)))))
    shelf = nearest(centres, centroids(centres, -(-len(centres) // SHELF)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["v"], d)
            yield pd.DataFrame({"no": b["no"], "key": b["key"], "list": nearest(turned(x), centres), "vector": [v.tobytes() for v in x]})

    stored = materialise(rows.mapInPandas(assign, "no long, key long, list int, vector binary"), "ann-lists")
    filled = np.zeros(len(centres), np.int64)
    for r in stored.groupBy("list").count().collect():  # a row per list, LISTS at most
        filled[r["list"]] = r["count"]
    held = np.bincount(shelf, filled, minlength=shelf.max() + 1)
    slots = np.maximum(np.ceil(held / CELL_ROWS).astype(np.int64), 1)
    first_cell = np.cumsum(slots) - slots
    places = spark.createDataFrame([(i, int(first_cell[s]), int(slots[s])) for i, s in enumerate(shelf)], "list int, first long, slots long")
    cell = F.col("first") + F.pmod(F.xxhash64("no"), F.col("slots"))
    vectors = stored.join(places, "list").select(cell.alias("cell"), F.lit(0).alias("kind"), "no", "key", F.array("list").alias("lists"), F.lit(None).cast("double").alias("limit"), "vector")
    vectors = materialise(vectors, "ann-vectors")
    queries = stored.where(wanted).select("no", "key", "vector")
    probes = probes_needed(sample, turned, centres, k, coverage)
    ends = sorted({1, -(-probes // 8), probes})

    def route(start: int, end: int):
        """Each query once for every cell that holds lists of its places ``start`` to ``end``; the last wave goes on until there are enough candidates."""
        last = end == ends[-1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for lo in range(0, len(whole), QUERY_BLOCK):
                    b = whole.iloc[lo : lo + QUERY_BLOCK]
                    x = np.frombuffer(b"".join(b["vector"])).reshape(-1, d)
                    order = np.argsort((centres**2).sum(1) - 2 * turned(x, True) @ centres.T, axis=1, kind="stable")
                    enough = (np.cumsum(filled[order], axis=1) < k + 1).sum(1) + 1
                    stop = np.minimum(np.maximum(enough, end) if last else np.full(len(b), end), len(centres))
                    out = []
                    for i, (no, key, limit, vector) in enumerate(zip(b["no"], b["key"], b["limit"], b["vector"])):
                        lists = order[i, start : stop[i]]
                        lists = lists[filled[lists] > 0]
                        for s in np.unique(shelf[lists]):
                            own = lists[shelf[lists] == s]
                            out += [(int(c), 1, no, key, own, limit, vector) for c in range(first_cell[s], first_cell[s] + slots[s])]
                    yield pd.DataFrame(out, columns=["cell", "kind", "no", "key", "lists", "limit", "vector"])

        return run

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelved: list[pd.DataFrame] = []
        limits: dict[int, float] = {}
        found: list[tuple[np.ndarray, ...]] = []
        at, size = None, 0
        columns = ["query_no", "query_id", "vec_id", "score"]

        def trimmed() -> pd.DataFrame:
            whole = [np.concatenate(c) for c in zip(*found)]
            best = best_of(whole[0], whole[2], whole[3], k)
            return pd.DataFrame({c: v[best] for c, v in zip(columns, whole)})

        for b in batches:
            for (c, kind), part in b.groupby(["cell", "kind"], sort=True):
                if kind == 0:
                    if at is None or at[0] != c:
                        at, shelved = (c, None), []
                    shelved.append(part[["no", "key", "lists", "vector"]])
                    continue
                if at is None or at[0] != c:
                    continue
                if at[1] is None:
                    whole = pd.concat(shelved)
                    plain = np.frombuffer(b"".join(whole["vector"])).reshape(-1, d)
                    lists = np.array([x[0] for x in whole["lists"]])
                    at, shelved = (c, (whole["no"].to_numpy(), whole["key"].to_numpy(), lists, plain, turned(plain))), []
                nos, ids, lists, plain, x = at[1]
                for lo in range(0, len(part), QUERY_BLOCK):
                    p = part.iloc[lo : lo + QUERY_BLOCK]
                    q_plain = np.frombuffer(b"".join(p["vector"])).reshape(-1, d)
                    q, q_no, q_id = turned(q_plain, True), p["no"].to_numpy(), p["key"].to_numpy()
                    known = np.array([max(limits.get(i, -np.inf), -np.inf if pd.isna(v) else v) for i, v in zip(q_no, p["limit"])])
                    probed = np.zeros((len(p), len(centres)), bool)
                    for i, own in enumerate(p["lists"]):
                        probed[i, own] = True
                    for j in range(0, len(ids), BLOCK):
                        s = slice(j, j + BLOCK)
                        allowed = probed[:, lists[s]] & (q_no[:, None] != nos[s])
                        if not allowed.any():
                            continue
                        qi, xi, score = scan(x[s], plain[s], ids[s], q, q_plain, allowed, known, top, k)
                        if not len(qi):
                            continue
                        found.append((q_no[qi], q_id[qi], ids[s][xi], score))
                        size += len(qi)
                        full = np.bincount(qi, minlength=len(p)) == k
                        worst = np.full(len(p), np.inf)
                        np.minimum.at(worst, qi, score)
                        known[full] = np.maximum(known[full], worst[full])
                    if len(limits) > HELD_ROWS:
                        limits.clear()  # known again from what each row brings
                    limits.update(zip(q_no.tolist(), known.tolist()))
                    if size > HELD_ROWS:
                        less = trimmed()
                        found, size = [tuple(less[c].to_numpy() for c in columns)], len(less)
                        if size > HELD_ROWS // 2:
                            yield less
                            found, size, limits = [], 0, {}
        if found:
            yield trimmed()

    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    seen = None
    for start, end in zip([0, *ends], ends):
        if seen is None:
            asked = queries.withColumn("limit", F.lit(None).cast("double"))
        else:
            known = seen.where(F.col("rank") == k).select(F.col("query_no").alias("no"), F.col("score").alias("limit"))
            asked = queries.join(known, "no", "left").select("no", "key", "vector", "limit")
        routed = asked.mapInPandas(route(start, end), vectors.schema)
        met = vectors.union(routed).repartition("cell").sortWithinPartitions("cell", "kind", "lists")
        more = met.mapInPandas(visit, FOUND)
        if seen is not None:
            more = more.union(seen.drop("rank"))
        seen = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if end != ends[-1]:
            seen = materialise(seen, "ann-found")
    return seen.select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("key") % QUERY_EVERY == 0)
