import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from larkspool.llm import warc

PAGES = [
    (5, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (2, "http://a/2", "same"),
    (3, "http://b/\r\nEvil: 1", None), (4, "http://b", ""), (7, "http://c", "é" * 100_000), (None, "http://d", "only"),
    (None, "http://e", "same"),
]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, content string")
    return warc.write_archive(pages.repartition(3))


def test_records_come_back_as_they_were(archive):
    rows = warc.read_archive(archive).collect()
    want = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page_id, payload, digest, "response" if page_id == first else "revisit", None if page_id == first else first))
    key = lambda x: (repr(x[0]), x[2])
    got = [(r["page_id"], bytes(r["payload"]), r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_payloads_are_stored_once(archive):
    assert archive.headers.count() == len(PAGES)
    assert archive.payloads.count() == len({p[2] or "" for p in PAGES})


def test_record_bytes_parse(archive):
    for r in warc.record_bytes(warc.read_archive(archive)).collect():
        header, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = warc.header_fields(header + b"\r\n\r\n")
        assert rest.endswith(b"\r\n\r\n") and len(rest) - 4 == int(fields["Content-Length"])
        assert "Evil" not in fields


def test_records_have_their_own_ids_and_an_http_head(archive):
    fields = []
    for r in warc.read_archive(archive).collect():
        own, _, http = bytes(r["header"]).partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and http.endswith(b"\r\n\r\n")
        assert b"Content-Length: %d\r\n" % len(r["payload"]) in http
        fields.append(warc.header_fields(own))
    responses = {f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"}
    assert len({f["WARC-Record-ID"] for f in fields}) == len(PAGES)
    for f in fields:
        revisit = f["WARC-Type"] == "revisit"
        assert (f.get("WARC-Profile") == warc.REVISIT_PROFILE) == revisit
        assert not revisit or f["WARC-Refers-To"] in responses


def test_a_changed_payload_is_found(archive):
    other = archive.payloads.agg(F.max("data")).first()[0]
    broken = warc.Archive(archive.headers, archive.payloads.withColumn("data", F.lit(other)))
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_archive(broken).collect()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(warc.write_archive(pages)).count() == 0
