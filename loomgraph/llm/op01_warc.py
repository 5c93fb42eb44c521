"""WARC archives: writing, segment reassembly and chunked transfer decoding.

The writer frames each payload by chunked transfer coding inside an HTTP
message and splits messages over ``SEGMENT`` bytes: the first part is the
record itself with segment number 1, the others are continuation records that
name its id. Files go through Spark's own writer, so they reach any store Spark
reaches and a lost task leaves nothing behind.

The reader walks records by their Content-Length, groups segments by the id of
their origin, orders them by number, checks that numbers are gapless and the
total length is the declared one, and decodes the chunks. Only segmented
records are shuffled, and a group is one record's bytes.

Edge cases: a null payload is an empty one; repeated rows (same id and payload)
write repeated records and come back as often; a null id is written as an empty
one and comes back null; among equal payloads the largest id is the response
and every row that repeats it is a response too; a record that fails its checks
has ``ok`` false and a reason, and no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialise, new_path, table

CHUNK, SEGMENT = 8192, 32768
#: Records per file at most; with SEGMENT it bounds a file's size.
FILE_RECORDS = 2000
CRLF = "\r\n"
RECORD = "record_id string, record_type string, refers_to string, payload_digest string, origin_id string, segment int, total_length long, declared long, block binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits at a time from the hex form."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _raw(x: Column) -> Column:
    return x.cast("binary")


def _parts(body: Column, size: int) -> Column:
    """``body`` (binary) cut into pieces of ``size`` bytes; one empty piece if it is empty."""
    last = F.greatest(F.ceil(F.length(body) / size), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def chunked(payload: Column, size: int = CHUNK) -> Column:
    """Chunked transfer framing of binary ``payload``."""
    framed = F.transform(_parts(payload, size), lambda c: F.concat(F.lower(F.hex(F.length(c))), F.lit(CRLF), c.cast("string"), F.lit(CRLF)))
    return F.when(F.length(payload) == 0, F.lit("0\r\n\r\n")).otherwise(F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n")))


def responses(pages: DataFrame, key: str, payload: Column, url: Column) -> DataFrame:
    """Each row with its digest and, if a larger id has the same payload, that id."""
    own = pages.select(F.col(key).alias("id"), F.coalesce(_raw(payload), F.lit(b"")).alias("payload"), F.coalesce(url, F.lit("")).alias("url"))
    marked = own.withColumn("digest", base32_sha1(F.col("payload")))
    groups = marked.select("id", "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("first")).where("n > 1")
    repeated = materialise(groups.select("digest", "first"), "warc-repeated")
    return marked.join(repeated, "digest", "left").withColumn("refers", F.when(F.col("first") > F.coalesce("id", F.lit(-(1 << 63))), F.col("first")))


def write(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", segment: int = SEGMENT) -> None:
    """Write one record per row of ``pages``, and continuation records, to ``path``."""
    rows = responses(pages, key, F.col(payload), F.col(url))

    def record_id(i: Column) -> Column:
        return F.concat(F.lit("<urn:record:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))

    revisit = F.col("refers").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"),
        F.when(revisit, F.concat(F.lit("Content-Length: "), F.length("payload").cast("string"))).otherwise(F.lit("Transfer-Encoding: chunked")),
        F.lit("\r\n\r\n"),
    )
    message = F.when(revisit, head).otherwise(F.concat(head, chunked(F.col("payload"))))
    cut = rows.select(
        record_id(F.col("id")).alias("record_id"), F.when(revisit, record_id(F.col("refers"))).alias("refers_to"), "digest", F.regexp_replace("url", r"\s", "%20").alias("url"), _raw(message).alias("message")
    ).select("*", F.length("message").alias("total"), F.posexplode(_parts(F.col("message"), segment)).alias("i", "block"))
    many, first = F.col("total") > segment, F.col("i") == 0
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.when(first, F.col("record_id")).otherwise(F.concat(F.rtrim(F.col("record_id"), F.lit(">")), F.lit(";"), (F.col("i") + 1).cast("string"), F.lit(">")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), F.col("refers_to"))),
        F.when(many, F.concat(F.lit("WARC-Segment-Number: "), (F.col("i") + 1).cast("string"))),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), F.col("record_id"))),
        F.when(many & ((F.col("i") + 1) * segment >= F.col("total")), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.length("block").cast("string")),
    ]
    # The writer ends each row with its separator, the second line end after a record.
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit("\r\n\r\n"), F.col("block").cast("string"), F.lit(CRLF))
    cut.select(record.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive, in RECORD's order."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.decode() for k, v in _FIELD.findall(data, data.index(b"\r\n", at) + 2, end + 2)}
        n = int(fields[b"content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError(f"record at byte {at} is cut short")
        total = fields.get(b"warc-segment-total-length")
        yield (
            fields[b"warc-record-id"], fields[b"warc-type"], fields.get(b"warc-refers-to"), fields.get(b"warc-payload-digest"),
            fields.get(b"warc-segment-origin-id"), int(fields.get(b"warc-segment-number", 0)), int(total) if total else None, n, block,
        )
        at = end + 4 + n + 4


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, segments apart."""
    names = [x.split()[0] for x in RECORD.split(",")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = list(parse(unpacked(content)))
                for i in range(0, len(rows), 1000):
                    yield pd.DataFrame(rows[i : i + 1000], columns=names)

    return _files(spark, path).mapInPandas(walk, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """A row per logical record: (record_id, record_type, refers_to, payload_digest, block, ok, reason)."""
    whole = records.where("segment = 0").select("record_id", "record_type", "refers_to", "payload_digest", "block", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    parts = records.where("segment > 0").withColumn("origin", F.coalesce("origin_id", "record_id"))
    groups = parts.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.count_if(F.col("segment") == 1).alias("copies"),
        F.max("total_length").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "refers_to", "payload_digest")),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.length(p["block"]))
    gapless = numbers == F.sequence(F.lit(1), F.size("parts"))
    reason = F.when(~gapless, "segments missing").when(F.col("total").isNull() | (length != F.col("total")), "wrong total length")
    joined = _raw(F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), ""))
    again = groups.withColumn("reason", reason).select(
        F.col("origin").alias("record_id"), "record_type", "refers_to", "payload_digest", F.when(F.col("reason").isNull(), joined).alias("block"), F.col("reason").isNull().alias("ok"), "reason",
        F.explode(F.array_repeat(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))).alias("_copy"),
    ).drop("_copy")
    return whole.unionByName(again)


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = end + 2
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + n])
        at += n + 2


def _payload(block: bytes, revisit: bool) -> tuple[bytes | None, int, str | None]:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None, 0, "no HTTP header"
    fields = {k.lower(): v for k, v in _FIELD.findall(head + b"\r\n", head.find(b"\r\n") + 2)}
    if revisit:
        return None, int(fields.get(b"content-length", 0)), None
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        try:
            body = dechunk(body)
        except ValueError as e:
            return None, 0, str(e)
    return body, len(body), None


_OUT = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, ok boolean, reason string"


def _decoded(rid, kind, refers, digest, block, ok, reason) -> tuple:
    """_OUT's columns of a whole record, then its payload (None for revisits)."""
    body, n = None, 0
    if ok:
        body, n, reason = _payload(bytes(block), kind == "revisit")
        digest = digest.removeprefix("sha1:") if digest else None
        if body is not None:
            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if digest is not None and own != digest:
                body, reason = None, "wrong digest"
            digest = own
    return rid, kind, refers, digest, n, reason is None, reason, body


def read_payloads(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Decoded records: _OUT's columns and, if asked for, ``payload``.

    Archives are parsed once. Whole records are decoded as they are met; only
    segments keep their bytes until they are put together.
    """
    more = ", payload binary" * with_payload
    names = [x.split()[0] for x in (_OUT + more).split(", ")]
    kept = f"{_OUT}{more}, origin_id string, segment int, total_length long, block binary"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for rid, kind, refers, digest, origin, segment, total, _, block in parse(unpacked(content)):
                    if segment:
                        rows.append((rid, kind, refers, digest, None, None, None, *([None] * with_payload), origin, segment, total, block))
                    else:
                        rows.append((*_decoded(rid, kind, refers, digest, block, True, None)[: len(names)], None, 0, None, None))
                yield pd.DataFrame(rows, columns=[*names, "origin_id", "segment", "total_length", "block"]).astype({"payload_bytes": "Int64", "total_length": "Int64"})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = b[["record_id", "record_type", "refers_to", "payload_digest", "block", "ok", "reason"]]
            yield pd.DataFrame([_decoded(*r)[: len(names)] for r in columns.itertuples(index=False)], columns=names)

    found = materialise(_files(spark, path).mapInPandas(first, kept), "warc-records")
    segmented = reassemble(found.where("segment > 0")).mapInPandas(again, _OUT + more)
    return found.where("segment = 0").select(names).unionByName(segmented)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    found = read_payloads(spark, path, with_payload=False)

    def page(record_id: str) -> Column:
        return F.regexp_extract(record_id, r"^<urn:record:(-?\d*):", 1).try_cast("long")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "ok")
