"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing
tokens. Whole sequences are cut from long documents first. What is left is
packed in pools of bounded size: an open sequence takes, of the pieces that fit
all limits, the one whose demand has the largest dot product with the room
left, both in shares of the limits; when none fits, the piece that gives the
largest dot product is cut to fill the room. What a pool cannot fill is carried
to the next pool, and a task's last tokens are cut into powers of two, which
need no padding. Tasks pack on their own, so nothing is shuffled.

Edge cases: a null text is an empty one, whose document is its end id alone;
repeated rows are separate documents; an empty table gives no rows. A sequence
closes when a limit is met, so with few segments or little loss allowed it may
be short of tokens; it is then cut at a power of two as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.textstats import text_of
from loomgraph.plans.storage import table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
TOKENS, SEGMENTS, LOSS = 2048, 64, 2048
#: Pieces looked at when a sequence is filled.
POOL = 512

#: Of a pool: document, start in it, tokens, loss-bearing tokens.
Piece = tuple[int, int, int, int]


def _loss_cut(length: int, loss: int, take: int) -> int:
    """Loss-bearing tokens of the first ``take``: they are a document's last ones."""
    return max(0, take - (length - loss))


def fill(pool: list[Piece], limits: tuple[int, int, int], last: bool) -> Iterator[list[Piece]]:
    """Sequences from ``pool``, which keeps what is left; with ``last`` all of it is packed."""
    cap = np.array(limits, float)
    doc, start, length, loss = (np.array(x, np.int64) for x in zip(*pool)) if pool else (np.empty(0, np.int64),) * 4
    there = np.ones(len(pool), bool)
    total = int(length.sum())
    pool.clear()
    while total if last else total >= limits[0] and there.sum() > POOL // 2:
        target = limits[0] if total >= limits[0] else 1 << (total.bit_length() - 1)
        room, out = np.array([target, limits[1], limits[2]], np.int64), []
        while room.min() > 0 and there.any():
            at = np.flatnonzero(there)
            demand = np.stack([length[at], np.ones(len(at), np.int64), loss[at]], 1)
            score = (demand / cap) @ (room / cap)
            fits = (demand <= room).all(1)
            if fits.any():
                i = at[np.argmax(np.where(fits, score, -1))]
                take = int(length[i])
            else:
                i = at[np.argmax(score)]
                take = int(min(length[i], room[0], room[2] + length[i] - loss[i]))
            bears = _loss_cut(int(length[i]), int(loss[i]), take)
            out.append((int(doc[i]), int(start[i]), take, bears))
            room -= (take, 1, bears)
            total -= take
            start[i] += take
            length[i] -= take
            loss[i] -= bears
            there[i] = length[i] > 0
        yield from _even(out, limits[0])
    pool += [(int(doc[i]), int(start[i]), int(length[i]), int(loss[i])) for i in np.flatnonzero(there)]


def _even(pieces: list[Piece], limit: int) -> Iterator[list[Piece]]:
    """The sequence, or its parts at powers of two if it is not full."""
    total = sum(p[2] for p in pieces)
    while total:
        size = limit if total >= limit else 1 << (total.bit_length() - 1)
        part, left = [], size
        while left:
            d, s, n, b = pieces[0]
            take = min(n, left)
            bears = _loss_cut(n, b, take)
            part.append((d, s, take, bears))
            left -= take
            if take == n:
                pieces = pieces[1:]
            else:
                pieces = [(d, s + take, n - take, b - bears), *pieces[1:]]
        total -= size
        yield part


def pack(sizes: Iterator[tuple[int, int, int]], limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), pool_size: int = POOL) -> Iterator[list[Piece]]:
    """Sequences of pieces from (document, tokens, loss-bearing tokens)."""
    pool: list[Piece] = []
    for doc, n, loss in sizes:
        at = 0
        while n - at >= limits[0] and loss <= limits[2] + n - at - limits[0]:
            bears = _loss_cut(n - at, loss, limits[0])
            if bears > limits[2]:
                break
            yield [(doc, at, limits[0], bears)]
            at, loss = at + limits[0], loss - bears
        if n > at:
            pool.append((doc, at, n - at, loss))
        if len(pool) >= pool_size:
            yield from fill(pool, limits, False)
    yield from fill(pool, limits, True)


def pack_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, end_id: int = END_ID, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS),
    loss: Column | str | None = None, ids: bool = True,
) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence, its
    loss-bearing tokens and, with ``ids``, its token ids.

    ``loss`` says how many of a document's last tokens, the end id among them,
    bear loss; null stands for all, and numbers are held between 0 and all.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * ids
    loss = F.lit(None) if loss is None else F.col(loss) if isinstance(loss, str) else loss

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loomgraph.llm.tokens import encoder, slices

        held: dict[int, tuple[int | None, np.ndarray]] = {}
        left: dict[int, int] = {}
        rows: list[tuple] = []

        def documents() -> Iterator[tuple[int, int, int]]:
            k = 0
            for keys, texts, bears in slices(batches):
                found, at = encoder(tokenizer, False).encode(texts)
                for j, name in enumerate(keys):
                    own = np.append(found[at[j] : at[j + 1]], np.uint32(end_id))
                    held[k], left[k] = (name, own), len(own)
                    yield k, len(own), len(own) if bears[j] is None else min(max(bears[j], 0), len(own))
                    k += 1

        first = TaskContext.get().partitionId() << 40
        for n, pieces in enumerate(pack(documents(), limits)):
            offset = 0
            for d, start, size, bears in pieces:
                name, whole = held[d]
                own = whole[start : start + size].astype("<u4")
                rows.append((name, start, size, zlib.crc32(own.tobytes()), len(whole), first + n, offset, bears) + (own.astype(np.int32),) * ids)
                offset += size
                left[d] -= size
                if not left[d]:
                    del held[d], left[d]
            if len(rows) >= (1_000 if ids else 10_000):
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t"), loss.cast("long").alias("l")).mapInArrow(place, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    kind = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for c, t in zip(zip(*rows), kinds)], names=list(names))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), ids=False).drop("loss_tokens")
