"""Content-addressed web archive: payload bytes once, exact record headers apart.

A record is a header and a payload. The header has the WARC fields and the HTTP head in
front of the payload; a revisit has an HTTP head alone, under the profile of records with an
identical payload digest. Payloads are addressed by their SHA-256 digest
and stored once, compressed; headers are stored for every record and name the digest.
Reading joins the two, checks the digest of what it got against the address and against
the SHA-1 digest in the header, and so gives back every record as it was.

Of records with equal payloads the one with the smallest page id is the response; the
others are revisits that refer to it. A null payload is an empty one. Rows that repeat a
page id are records of their own (all of them responses if theirs is the smallest id), and
so have record ids of their own, made of the page id and the row's place in the staged
table. A null page id is never the smallest unless all are null.

Digest groups are aggregated to their smallest id before they are shuffled, and a payload
is one row whatever the number of its records, so a page with a third of all copies costs
a third of the headers and no more; the join's adaptive split deals them out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import stage, utf8

_DIGESTS = "page_id long, url string, content string, sha1 string, payload_bytes long"
# Fixed value of the WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = "[\\x00-\\x20\\x7f]"


@dataclass(frozen=True)
class Archive:
    """headers: page_id, content, header. payloads: content, data (zstd)."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [p or b"" for p in utf8(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
             pa.array([base32_sha1(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64())],
            ["page_id", "url", "content", "sha1", "payload_bytes"],
        )


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        payloads = [p or b"" for p in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
             pa.array([pack(p) for p in payloads], pa.binary())], ["first", "content", "data"],
        )


def write_archive(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """One record per row of ``pages`` (page_id, url, html), as staged tables of headers and payloads."""
    pages = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    records = pages.mapInArrow(_digests, _DIGESTS).withColumn("place", F.monotonically_increasing_id())
    records = stage(records, "warc-digests")
    smallest = F.min(F.struct(F.col("page_id").isNull(), "page_id", "place"))
    firsts = records.groupBy("content").agg(smallest.alias("least"))
    firsts = stage(firsts.select("content", F.col("least.page_id").alias("first"), F.col("least.place").alias("first_place")), "warc-firsts")

    def urn(page: str, place: str) -> Column:
        name = F.concat_ws(" ", F.lit("page"), F.coalesce(F.col(page).cast("string"), F.lit("-")), F.col(place).cast("string"))
        return F.concat(F.lit("<urn:sha256:"), F.sha2(name, 256), F.lit(">"))

    record_id, first_id = urn("page_id", "place"), urn("first", "first_place")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), _CONTROL, "%20")  # a header line has no control characters
    http = F.concat_ws(
        "\r\n",
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=UTF-8"),
        F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")),
        F.lit(""),
        F.lit(""),
    )
    block = F.octet_length(http) + F.when(is_first, F.col("payload_bytes")).otherwise(F.lit(0))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_first, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~is_first, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(~is_first, F.concat(F.lit("WARC-Refers-To: "), first_id)),
        F.when(~is_first, F.concat(F.lit("Refers-To-Page: "), F.col("first").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
        F.lit(""),
        http,
    )
    headers = records.join(firsts, "content").select("page_id", "content", lines.cast("binary").alias("header"))

    # The row with the smallest id brings the bytes; rows that repeat this id bring the same ones.
    payloads = pages.select("page_id", "html").mapInArrow(_compressed, "first long, content string, data binary")
    wanted = firsts.select(F.col("first").alias("own"), F.col("content").alias("address"))
    same = (F.col("content") == F.col("address")) & F.col("first").eqNullSafe(F.col("own"))
    payloads = payloads.join(wanted, same).select("content", "data").dropDuplicates(["content"])
    return Archive(stage(headers, "warc-headers"), stage(payloads, "warc-payloads"))


def read_archive(archive: Archive) -> DataFrame:
    """Every record again: page_id, header, payload, with the fields of its header.

    A missing payload, or one that doesn't have its digests, is an error.
    """
    joined = archive.headers.join(archive.payloads, "content", "left")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["data"] is None:
                    raise ValueError(f"record {row['page_id']}: no payload {row['content']}")
                payload = unpack(row["data"])
                fields = header_fields(row["header"])
                digest = base32_sha1(payload)
                if hashlib.sha256(payload).hexdigest() != row["content"] or fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"record {row['page_id']}: the payload doesn't have its digest")
                refers = fields.get("Refers-To-Page")
                rows.append((row["page_id"], row["header"], payload, digest, fields["WARC-Type"], refers and int(refers)))
            page_id, header, payload, digest, kind, refers = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(page_id, pa.int64()), pa.array(header, pa.binary()), pa.array(payload, pa.binary()),
                 pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64())],
                ["page_id", "header", "payload", "payload_digest", "record_type", "refers_to"],
            )

    return joined.mapInArrow(
        restore,
        "page_id long, header binary, payload binary, payload_digest string, record_type string, refers_to long",
    )


def header_fields(header: bytes) -> dict[str, str]:
    """The WARC fields of a header, without those of the HTTP head."""
    lines = header.decode().partition("\r\n\r\n")[0].split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC header")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the record as it stands in a WARC file: header, payload of a response, two line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
