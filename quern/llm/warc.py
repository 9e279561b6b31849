"""WARC archives with revisit records.

Revisits are resolved by shuffling headers alone (page, address, digest, length; no payload) by payload digest: the
smallest page_id of a digest is the response, the others become revisit records that refer to it. Headers are summed by
page, address and digest first, so one digest may have any share of the rows. Archives written elsewhere are read too, and
:func:`resolve` joins their revisit records to the responses with the same payload digest; :func:`rewrite` writes what an
archive holds as new, deduplicated archives with fresh headers.

Each record is a gzip member of its own. A task packs members into files of about ``FILE_BYTES`` (one larger record stands
alone) through Spark's text writer, whose line separator is the zero byte that ends every member (the highest byte of its
length; an empty member is added where that is not zero), so any file system that Spark knows and its commit protocol
serve. Reading decompresses a file record by record.

A response's block is an HTTP response; a revisit's block is its HTTP header alone, which still gives the full payload's
length. Digests are upper-case base32 SHA-1. Record ids hang on page, address and payload, so they are the same in every run;
rows that repeat all three get random ones. Revisits name the address and date of the record that they revisit, and its
record id unless that is a random one.

Defined cases: a null html is an empty payload; payloads shorter than ``least`` bytes are all responses; repeated rows of
the smallest page_id are all responses; rows without page_id are responses that nothing refers to; line breaks in a url
become %0D and %0A; other columns play no part; no pages make no records. Read records of other kinds than response and
revisit have no payload; a block without an HTTP header is all payload; headers that are missing are null; what is no
record at all raises Damaged.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, lean, only, scratch, workers

FILE_BYTES = 32 << 20
CHUNK = 1 << 20  # read at once
END = "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from five hexadecimal digits (four base32 digits) at a time."""
    hexa = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(hexa, 1 + 5 * i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def _uuid(of: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(of.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _id(page: Column, url: Column, of: Column) -> Column:
    """A record id from page, address and payload digest: the same in every run."""
    return _uuid(F.concat_ws(" ", F.lit("page"), F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("")), of))


def _first(headers: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(digest, bytes, first, first_url, first_again of payloads that several pages have, page_id, url, digest of repeated
    rows), as written tables, from ``headers`` (page_id, url, digest, bytes)."""
    rows = keep(headers.groupBy("page_id", "url", "digest", "bytes").agg(F.count("*").alias("n")))
    named = rows.where(F.col("page_id").isNotNull() & (F.col("bytes") >= least))
    least_ = F.min(F.struct("page_id", "url", "n")).alias("x")
    first = named.groupBy("digest", "bytes").agg(least_, F.max("page_id").alias("last")).where("x.page_id < last")
    first = keep(first.select("digest", "bytes", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"), (F.col("x.n") > 1).alias("first_again")))
    again = keep(rows.where("n > 1").select("page_id", "url", "digest", F.lit(True).alias("again")))
    drop(rows)
    return first, again


def _headers(revisit: bool, date: str) -> Column:
    """A record's WARC and HTTP headers, up to its payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = lambda url: F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    refers = []
    if revisit:
        to = F.when(~F.col("first_again"), line("WARC-Refers-To", _id(F.col("first"), F.col("first_url"), F.col("digest"))))
        refers = [line("WARC-Profile", F.lit(PROFILE)), F.coalesce(to, F.lit("")), line("WARC-Refers-To-Target-URI", clean(F.col("first_url"))), line("WARC-Refers-To-Date", F.lit(date)), line("X-Refers-To-Page-ID", F.col("first").cast("string"))]
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.lit("revisit" if revisit else "response")),
        line("WARC-Record-ID", F.when(F.col("again"), _uuid(F.uuid())).otherwise(_id(F.col("page_id"), F.col("url"), F.col("digest")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        *refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + (0 if revisit else F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
        http,
    )


def member(record: bytes) -> bytes:
    """A gzip member (two for records of 16 MB and more) whose last byte is zero."""
    out = gzip.compress(record, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def _archive(records: DataFrame, path: str, file_bytes: int) -> None:
    """Write ``records`` (head, payload) as archives under ``path``: a row of packed members is a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])
        parts, size = [], 0
        for b in batches:
            for head, payload in zip(b.column("head"), b.column("payload"), strict=True):
                one = member(head.as_py().encode() + (payload.as_py() or b"") + END.encode())
                if parts and size + len(one) > file_bytes:
                    yield row(parts)
                    parts, size = [], 0
                parts.append(one)
                size += len(one)
        if parts:
            yield row(parts)

    files = records.select("head", "payload").mapInArrow(lean(run), "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html: text or bytes) as archives under ``path``, dated now or ``date``.

    Revisit records are made of headers alone; payloads move only if the payloads that several pages have are too many to
    be broadcast (by Spark's own size check) to where the payloads lie.
    """
    workers(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = only(pages, page_id="long", url="string", html="binary").withColumn("payload", F.coalesce("html", F.lit("").cast("binary")))
    rows = rows.select("page_id", "url", "payload", digest(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    first, again = _first(rows.select("page_id", "url", "digest", "bytes"), least)
    known = rows.join(first, ["digest", "bytes"], "left")
    same = known["page_id"].eqNullSafe(again["page_id"]) & known["url"].eqNullSafe(again["url"]) & (known["digest"] == again["digest"])
    known = known.join(again, same, "left").select(*[known[c] for c in known.columns], F.coalesce(again["again"], F.lit(False)).alias("again"))
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    _archive(known.select(F.when(revisit, _headers(True, date)).otherwise(_headers(False, date)).alias("head"), F.when(~revisit, F.col("payload")).alias("payload")), path, file_bytes)
    drop(first, again)


class Damaged(ValueError):
    """An archive that does not hold what its headers say."""


def _pieces(data: bytes) -> Iterator[bytes]:
    """The content of an archive, decompressed (where it is compressed) piece by piece."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), CHUNK):
            yield data[at : at + CHUNK]
        return
    left = data
    while left:
        one = zlib.decompressobj(31)
        piece = one.decompress(left, CHUNK)
        while piece or not one.eof:
            yield piece
            if one.eof:
                break
            if not one.unconsumed_tail and not piece:
                raise Damaged("a gzip member ends too early")
            piece = one.decompress(one.unconsumed_tail, CHUNK)
        left = one.unused_data


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; no more than a record and a piece is held beside ``data``."""
    end, held, pieces = END.encode(), bytearray(), _pieces(data)

    def need(n: int) -> bool:
        while len(held) < n:
            if (piece := next(pieces, None)) is None:
                return False
            held.extend(piece)
        return True

    while need(1):
        at = 0
        while (to := held.find(end, max(0, at - 3))) < 0:
            at = len(held)
            if not need(at + 1):
                raise Damaged("no end of a record's headers")
        if not held.startswith(b"WARC/"):
            raise Damaged("no record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[:to].decode("utf-8", "replace").split("\r\n")[1:])}
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            raise Damaged("a record without a length") from None
        start = to + len(end)
        if not need(start + size + len(end)) or held[start + size : start + size + len(end)] != end:
            raise Damaged("a record's length is wrong")
        yield headers, bytes(held[start : start + size])
        del held[: start + size + len(end)]


def page(headers: dict[str, str], block: bytes) -> tuple:
    """The values of _READ for a record; the payload of a response with a SHA-1 digest is checked."""
    kind = headers.get("warc-type")
    http = block.startswith(b"HTTP/")
    head, _, payload = block.partition(END.encode()) if http else (b"", b"", block)
    said, number = headers.get("warc-payload-digest"), lambda name: int(headers[name]) if name in headers else None
    size = None
    if kind == "response":
        size = len(payload)
        if said and said.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != said[5:].upper():
            raise Damaged(f"payload of {headers.get('warc-record-id')} is not what its digest says")
    elif kind == "revisit":
        length = next((x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        size = int(length) if length.strip().isdigit() else None
    named = (said.partition(":")[2] or said) if said else None
    return (
        number("x-page-id"), headers.get("warc-target-uri"), size, named, kind, number("x-refers-to-page-id"), headers.get("warc-record-id"), headers.get("warc-date"),
        headers.get("warc-refers-to"), headers.get("warc-refers-to-target-uri"), headers.get("warc-refers-to-date"), payload if kind == "response" else None,
    )


_READ = {
    "page_id": ("long", pa.int64()), "url": ("string", pa.string()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "record_type": ("string", pa.string()), "refers_to": ("long", pa.int64()), "record_id": ("string", pa.string()), "date": ("string", pa.string()),
    "refers_to_id": ("string", pa.string()), "refers_to_url": ("string", pa.string()), "refers_to_date": ("string", pa.string()), "payload": ("binary", pa.binary()),
}


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row of _READ for each record of the archives under ``path``; payloads only where asked for (null for revisits)."""
    workers(spark)
    names = [n for n in _READ if payload or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _READ[n][1]) for i, n in enumerate(names)], names=names)
        for b in batches:
            for data in b.column("content"):
                rows, size = [], 0
                for r in records(data.as_py()):
                    rows.append(page(*r))
                    size += len(r[1]) if payload else 100
                    if size > CHUNK:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("content")
    return files.mapInArrow(lean(run), ", ".join(f"{n} {_READ[n][0]}" for n in names))


def resolve(found: DataFrame) -> DataFrame:
    """The revisit records among ``found`` (as :func:`read` gives them, of any archive) with ``original_id`` and
    ``original_url``: of the responses with the same payload digest the one that the revisit names by its id, else by its
    address, else the one with the smallest id; null where there is none.

    Only headers are shuffled, and responses are brought down to one for each digest and address first.
    """
    headers = found.select("record_id", "url", "payload_digest", "record_type", "refers_to_id", "refers_to_url", "date")
    responses = headers.where("record_type = 'response' and payload_digest is not null").groupBy("payload_digest", "url").agg(F.min("record_id").alias("id"))
    revisits = headers.where("record_type = 'revisit'").drop("record_type")
    any_ = responses.groupBy("payload_digest").agg(F.min(F.struct("id", "url")).alias("least"))
    at = responses.select(F.col("payload_digest").alias("d"), F.col("url").alias("u"), F.col("id").alias("by_url"))
    ids = headers.where("record_type = 'response'").select(F.col("record_id").alias("by_id"), F.col("url").alias("by_id_url")).dropDuplicates(["by_id"])
    out = revisits.join(any_, "payload_digest", "left").join(at, (F.col("payload_digest") == F.col("d")) & (F.col("refers_to_url") == F.col("u")), "left").join(ids, F.col("refers_to_id") == F.col("by_id"), "left")
    return out.select(
        "record_id", "url", "payload_digest", "date",
        F.coalesce("by_id", "by_url", "least.id").alias("original_id"),
        F.when(F.col("by_id").isNotNull(), F.col("by_id_url")).when(F.col("by_url").isNotNull(), F.col("u")).otherwise(F.col("least.url")).alias("original_url"),
    )


def rewrite(spark: SparkSession, source: str, path: str, least: int = 0) -> None:
    """Write the pages of the archives under ``source`` as new archives: equal payloads once, the rest as revisits of them,
    all with fresh headers. Pages are numbered by a hash of record id and address; a revisit whose original is not there
    is left out, as nobody can tell its payload."""
    found = keep(read(spark, source, payload=True))
    number = F.xxhash64("record_id", "url")
    have = found.where("record_type = 'response'").select(number.alias("page_id"), "url", F.col("payload").alias("html"), "record_id")
    lost = resolve(found).where("original_id is not null").select(number.alias("page_id"), "url", "original_id")
    again = lost.join(have.select(F.col("record_id").alias("original_id"), "html"), "original_id").select("page_id", "url", "html")
    write(keep(have.drop("record_id").unionByName(again)), path, least)
    drop(found)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    path = scratch(pages.sparkSession)
    write(pages, path, least)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
