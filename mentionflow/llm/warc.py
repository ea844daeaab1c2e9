"""WARC archives with revisit records for payloads that are stored already.

1. Headers alone, page id, digest and length, are shuffled by digest: the largest page id of a
   payload is its original. Partial maxima make a payload of any number of pages one row a task.
2. Originals become response records with their payload; other pages of a payload become revisit
   records that name the original. Every record gets fresh headers.
3. Records are written as lines of text whose separator is the blank lines that end a record, so
   Spark's own writer makes the archives, in any file system and safe against lost tasks.
4. Reading parses archives by their lengths, and joins revisits to their originals.

An archive is one partition of records; both sizes follow the session's partition sizes.

Defined results: a null payload is empty, and empty payloads are payloads; a page without id is a
response, as no record could refer to it, and is nobody's original; equal rows are equal records,
all responses if their id is the largest; an empty table gives no records; other columns don't
matter; a null address becomes a urn, and blanks and controls in addresses are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_END = "\r\n\r\n"
# Fixed value: the name the standard gives to revisits with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:page:{}>"
BATCH_BYTES = 8 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four letters for each five hex digits."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)
    ]
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.concat(*groups), digits, letters)


def _lines(*headers: Column | str) -> Column:
    return F.concat_ws("\r\n", *[F.lit(h) if isinstance(h, str) else h for h in headers])


def _record(kind: str, block: Column, *headers: Column) -> Column:
    """A record without the blank lines that end it."""
    record_id = F.format_string(ID.replace("{}", "%s"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    address = F.coalesce(F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "_"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    head = _lines(
        "WARC/1.1", f"WARC-Type: {kind}", F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Date: "), F.col("__date")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), *headers,
        "Content-Type: application/http;msgtype=response", F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return F.concat(head, F.lit("\r\n\r\n"), block)


def _http(length: Column) -> Column:
    return F.concat(
        _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), length)), F.lit("\r\n\r\n")
    )


def records(
    pages: DataFrame, date: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0
) -> DataFrame:
    """One column, ``record``; payloads of fewer than ``least_bytes`` are never revisited."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("html"), F.lit(date).alias("__date"),
    )
    binary = F.col("html").cast("binary")
    rows = rows.withColumns({"digest": base32_sha1(binary), "length": F.octet_length("html").cast("long")})
    headers = rows.select("page_id", "url", "__date", "digest", "length").filter(
        F.col("page_id").isNotNull() & (F.col("length") >= least_bytes)
    )
    originals = headers.groupBy("digest").agg(F.max("page_id").alias("original"))

    revisits = headers.join(originals, "digest").filter("page_id != original")
    names = F.concat(F.lit("WARC-Refers-To: "), F.format_string(ID.replace("{}", "%s"), F.col("original").cast("string")))
    revisits = revisits.select(_record("revisit", _http(F.lit("0")), names, F.lit(f"WARC-Profile: {PROFILE}")).alias("record"))

    kept = originals.select(F.col("original").alias("page_id"), "digest", F.lit(True).alias("first"))
    always = F.col("page_id").isNull() | (F.col("length") < least_bytes)
    responses = rows.join(kept, ["page_id", "digest"], "left").filter(F.col("first") | always)
    block = F.concat(_http(F.col("length").cast("string")), F.col("html"))
    return responses.select(_record("response", block).alias("record")).union(revisits)


def write(records_: DataFrame, path: str) -> None:
    records_.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _unzipped(content: bytes) -> Iterator[bytes]:
    inflate = zlib.decompressobj(wbits=31)
    for at in range(0, len(content), 1 << 20):
        piece = content[at : at + (1 << 20)]
        while piece:
            yield inflate.decompress(piece, 4 << 20)
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive given in pieces."""
    pending, need = bytearray(), 0
    for piece in pieces:
        pending += piece
        at = 0
        while True:
            head = pending.find(b"\r\n\r\n", at)
            if head < 0 or len(pending) < need:
                break
            lines = pending[at:head].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:80]!r}")
            named = dict(x.split(": ", 1) for x in lines[1:])
            end = head + 4 + int(named["Content-Length"])
            if len(pending) < end + len(RECORD_END):
                need = end + len(RECORD_END)
                break
            yield named, bytes(pending[head + 4 : end])
            at, need = end + len(RECORD_END), 0
        del pending[:at]
        need = max(0, need - at)
    if pending:
        raise ValueError("an archive ends within a record")


def _page(name: str | None) -> int | None:
    m = re.fullmatch(ID.replace("{}", "(-?[0-9]+)"), name or "")
    return int(m[1]) if m else None


_READ = "page_id long, record_type string, url string, payload_digest string, refers_to long, payload_bytes long, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record; revisits have neither payload nor payload_bytes. A response whose payload
    doesn't have its digest is an error. ``payload=False`` leaves payloads behind once checked."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files["content"]:
                rows, size = [], 0
                for headers, block in parsed(_unzipped(content.as_py())):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    body = None
                    if headers["WARC-Type"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't have its digest")
                    rows.append((
                        _page(headers["WARC-Record-ID"]), headers["WARC-Type"], headers["WARC-Target-URI"], digest,
                        _page(headers.get("WARC-Refers-To")), None if body is None else len(body), body if payload else None,
                    ))
                    size += len(block)
                    if size > BATCH_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(task, _READ)


def resolved(found: DataFrame) -> DataFrame:
    """``found`` with the size of the original's payload on revisits."""
    originals = found.filter("record_type = 'response' and page_id is not null").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest"
    ).agg(F.max("payload_bytes").alias("original_bytes"))
    rows = found.filter("record_type = 'revisit'").join(originals, ["refers_to", "payload_digest"], "left")
    rows = rows.withColumn("payload_bytes", F.col("original_bytes")).select(*found.columns)
    return rows.union(found.filter("record_type <> 'revisit'"))
