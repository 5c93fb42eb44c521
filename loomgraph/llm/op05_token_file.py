"""Token ids in independent zstandard frames with a trailing seek table.

A file is a series of zstd frames, then an index frame and a seek table, both
skippable, so any zstd decoder reads the file and a reader that wants a few
documents decompresses only their frames. The seek table is the public seekable
format: for each frame its compressed and decompressed size and the low 32 bits
of the XXH64 of its content. Files are written by Spark's own writer, which
reaches any store Spark reaches and commits whole tasks; it puts a separator
after each row, so every frame but the last ends with the head of a one-byte
skippable frame and the separator is that byte, and for the last it is the
table's own last byte.

A frame's content: the number of documents (uint64), their ids (int64), their
token counts (uint64), then all token ids (uint32), little-endian.
The index frame (magic 0x184D2A50) holds (frame number, documents, first and last
id, tokens) for each data frame, five 64-bit numbers each.

Edge cases: a null text is an empty one, whose document is its end id alone; a
null document id sorts first and is stored as the least long; repeated rows are
separate documents; an empty table writes no data frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.textstats import text_of
from loomgraph.plans.storage import materialise, new_path, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Token ids after which a frame is closed, and the zstd level.
FRAME_IDS, LEVEL = 1 << 18, 3
#: Bytes of text that a file should hold.
FILE_BYTES = 64 << 20
NO_ID = -(1 << 63)
_SKIP, _INDEX, _TABLE, _MAGIC = 0x184D2A51, 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def _frame(ids: list[int], counts: list[int], tokens: list[np.ndarray]) -> bytes:
    return b"".join([struct.pack("<Q", len(ids)), np.asarray(ids, "<i8").tobytes(), np.asarray(counts, "<u8").tobytes(), *(t.astype("<u4").tobytes() for t in tokens)])


def pack_file(documents: Iterator[tuple[int, np.ndarray]]) -> Iterator[bytes]:
    """The rows of one file, each without its separator byte (0x8F)."""
    import xxhash
    import zstandard

    table_rows: list[tuple[int, int, int]] = []
    index: list[tuple[int, int, int, int, int]] = []
    ids: list[int] = []
    counts: list[int] = []
    tokens: list[np.ndarray] = []
    held = 0

    def close() -> bytes:
        nonlocal ids, counts, tokens, held
        content = _frame(ids, counts, tokens)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(content)
        index.append((len(table_rows), len(ids), ids[0], ids[-1], sum(counts)))
        table_rows.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        table_rows.append((9, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        ids, counts, tokens, held = [], [], [], 0
        return packed + struct.pack("<II", _SKIP, 1)

    for key, t in documents:
        ids.append(key)
        counts.append(len(t))
        tokens.append(t)
        held += len(t)
        if held >= FRAME_IDS:
            yield close()
    if ids:
        yield close()
    body = b"".join(struct.pack("<QQqqQ", *x) for x in index)
    head = struct.pack("<II", _INDEX, len(body)) + body
    table_rows.append((len(head), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    entries = b"".join(struct.pack("<III", *x) for x in table_rows)
    seek = entries + struct.pack("<IBI", len(table_rows), 0x80, _MAGIC)
    yield (head + struct.pack("<II", _TABLE, len(seek)) + seek)[:-1]


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, decompressed size, checksum) of each frame, from the file's end."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _MAGIC or flags != 0x80:
        raise ValueError("no seek table")
    start = len(data) - 9 - 12 * n
    if struct.unpack("<II", data[start - 8 : start]) != (_TABLE, 12 * n + 9):
        raise ValueError("seek table has a wrong size")
    out, at = [], 0
    for a, b, c in struct.iter_unpack("<III", data[start : start + 12 * n]):
        out.append((at, a, b, c))
        at += a
    return out


def file_index(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(frame, documents, first id, last id, tokens) of each data frame."""
    at, size, _, _ = seek_table(data)[-1]
    return list(struct.iter_unpack("<QQqqQ", data[at + 8 : at + size]))


def read_frame(data: bytes, entry: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, token ids) of one frame; checks its checksum."""
    import xxhash
    import zstandard

    at, size, plain, check = entry
    content = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=plain)
    if len(content) != plain or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
        raise ValueError("frame does not match its checksum")
    n = struct.unpack_from("<Q", content)[0]
    return np.frombuffer(content, "<i8", n, 8), np.frombuffer(content, "<u8", n, 8 + 8 * n).astype(np.int64), np.frombuffer(content, "<u4", -1, 8 + 16 * n)


def read_documents(data: bytes, wanted: set[int]) -> dict[int, list[np.ndarray]]:
    """The token ids of the wanted documents; other frames are not decompressed."""
    frames, out = seek_table(data), {}
    for frame, _, first, last, _ in file_index(data):
        if not any(first <= w <= last for w in wanted):
            continue
        ids, counts, tokens = read_frame(data, frames[frame])
        for i, part in zip(ids, np.split(tokens, np.cumsum(counts)[:-1])):
            if int(i) in wanted:
                out.setdefault(int(i), []).append(part)
    return out


def write(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode ``docs`` in ascending order of ``key`` into files in ``path``; file names sort like ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.tokens import encoder, slices

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            for keys, texts in slices(batches):
                ids, at = encoder(tokenizer, True).encode(texts)
                for j, key_ in enumerate(keys):
                    yield key_, np.append(ids[at[j] : at[j + 1]], np.uint32(end_id))

        for row in pack_file(documents()):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["value"])

    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), text_of(text).alias("t"))
    size = own.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    files = max(1, -(-size // FILE_BYTES), own.sparkSession.sparkContext.defaultParallelism)
    ordered = own.repartitionByRange(int(files), "k").sortWithinPartitions("k", "t")
    rows = ordered.mapInArrow(encode, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\x8f").option("encoding", "ISO-8859-1").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, local_start, n_tokens, ids_crc32) of every stored document."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                data, run = bytes(data), 0
                frames = seek_table(data)
                for frame, *_ in file_index(data):
                    ids, counts, tokens = read_frame(data, frames[frame])
                    ends, raw = np.cumsum(counts), memoryview(tokens.tobytes())
                    crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "doc_id": ids, "local_start": run + ends - counts, "n_tokens": counts, "ids_crc32": crc})
                    run += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInPandas(walk, "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    found = materialise(read(spark, path), "tokens-read")
    run, starts = 0, []
    for r in found.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect():  # a row per file
        starts.append((r["file"], run))
        run += r["n"]
    firsts = spark.createDataFrame(starts, "file string, first long")
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return found.join(firsts, "file").select(doc_id, (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
