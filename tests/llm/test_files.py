import base64
import gzip
import hashlib
import io
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import media, warc
from tests.compare import DATA

from .cases import frame, odd_rows

# media


def test_payloads():
    assert media.payload_of(None) == media.payload_of("") == b"\xff" * 576
    assert len(media.payload_of("a" * 576)) == 576 and len(media.payload_of("é" * 289)) == 1152
    for text in ("", "x", "日本" * 5000):
        data = media.png(media.payload_of(text))
        assert media.png_payload(data) == media.payload_of(text)
        width, height, depth = media.png_header(data[: media.HEADER_BYTES])
        assert (width * height, depth) == (len(media.payload_of(text)), 8)
    with pytest.raises(ValueError):
        media.png_header(b"no image".ljust(33))
    with pytest.raises(ValueError):
        media.png_payload(data[:60] + b"!" + data[61:])


def test_media_odd_rows(spark, tmp_path):
    rows = odd_rows()
    root = f"file://{tmp_path}/shards"
    got = media.media_columns(frame(spark, rows).repartition(3), root).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        p = media.payload_of(t)
        want.setdefault(i, set()).add((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
        with tarfile.open(tmp_path / "shards" / r.shard) as tar:
            member = next(m for m in tar.getmembers() if m.offset_data == r.offset)
            stored = tar.extractfile(member).read()
        assert member.name == f"{r.media_sha256}.png" and len(stored) == r.length == r.media_bytes
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256
    assert len({(r.shard, r.offset) for r in got}) == len({r.media_sha256 for r in got})
    assert media.media_columns(frame(spark, []), root).count() == 0


def test_headers_are_read_alone(spark, tmp_path):
    """A shard whose images are cut after their headers still gives the metadata, and only that."""
    root = f"file://{tmp_path}/shards"
    places = media.addresses(media.store(frame(spark, [(1, "some text")]), root))
    row = places.first()
    path = tmp_path / "shards" / row.shard
    path.write_bytes(path.read_bytes()[: row.offset + media.HEADER_BYTES])
    headed = media.with_headers(places, root)
    assert (headed.first().width, headed.first().height) == (576, 1)
    with pytest.raises(Exception, match="truncated"):
        media.with_features(headed, root).collect()


def test_media_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = media.op7_media_columns(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        p = media.payload_of(texts[r.doc_id])
        assert r.width * r.height == r.payload_bytes and r.length == r.media_bytes and r.offset > 0 and r.shard.endswith(".tar")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), media.feature_of(p))


# WARC

PAGE = "<html><title>A\n title</title><body><h1>Head</h1><p>Text &amp; more</p><a href='/x'>l</a><a class=k href=\"http://y/\">m</a></body></html>"


def test_records_round_trip():
    raw = warc.response_record("http://a/é b\r\nInjected: x", PAGE, key="1")
    record = warc.read_record(raw)
    assert record.to_bytes() == raw and record.get("warc-type") == "response"
    assert record.get("WARC-Target-URI") == "http://a/é b Injected: x" and record.get("Injected") is None
    status, headers, payload = warc.http_parts(record.block)
    assert (status, payload.decode()) == ("HTTP/1.1 200 OK", PAGE) and dict(headers)["Content-Length"] == str(len(payload))
    assert record.get("WARC-Payload-Digest") == warc.digest(payload)
    for broken in (b"", b"HTTP/1.1 200", raw[:200], raw.replace(b"Text", b"Tex!")):
        with pytest.raises(ValueError):
            warc.read_record(broken)
    assert warc.read_record(b"WARC/1.0\r\nWARC-Type: x\r\nA: b\r\n  c\r\nContent-Length: 0\r\n\r\n\r\n\r\n").get("a") == "b c"


def test_derivatives_refer_to_their_response():
    source = warc.read_record(warc.response_record("http://a/", PAGE, date="2024-01-02T03:04:05Z"))
    metadata, conversion, error = warc.derive(source)
    assert error is None
    for r in (metadata, conversion):
        assert warc.read_record(r.to_bytes()).block == r.block
        assert (r.get("WARC-Refers-To"), r.get("WARC-Date"), r.get("WARC-Target-URI")) == (source.get("WARC-Record-ID"), "2024-01-02T03:04:05Z", "http://a/")
    assert len({r.get("WARC-Record-ID") for r in (source, metadata, conversion)}) == 3
    fields = metadata.block.decode().split("\r\n")
    assert {"title: A title", "outlink: /x", "outlink: http://y/", "source-header-content-type: text/html; charset=utf-8", f"source-payload-digest: {source.get('WARC-Payload-Digest')}"} <= set(fields)
    assert conversion.block.decode() == "Head\nText & more\nlm"


def test_warc_on_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = warc.op6_warc_derivatives(spark, DATA).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        page = pages[r.page_id]
        source = warc.read_record(warc.response_record(page.url, page.html, key=str(r.page_id)))
        record = warc.derive(source)[r.record_type == "conversion"]
        assert (r.record_id, r.refers_to, r.target_uri, r.content_length, r.block_digest) == (record.get("WARC-Record-ID"), source.get("WARC-Record-ID"), page.url, len(record.block), warc.digest(record.block))
        assert r.source_payload_digest == warc.digest(page.html.encode())


def test_warc_query_gives_the_records(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in warc.op6_warc_derivatives(spark, DATA).collect():
        source = warc.read_record(warc.response_record(pages[r.page_id].url, pages[r.page_id].html, key=str(r.page_id)))
        assert bytes(r.record) == warc.derive(source)[r.record_type == "conversion"].to_bytes()


def test_warc_odd_rows_and_files(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", PAGE), (3, "u", PAGE), (4, "u", "<p>x</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("refers_to", F.lit(None).cast("string"))
    records = warc.derivatives(warc.responses(pages))
    assert records.count() == 12
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    other = spark.createDataFrame([(1, None), (2, bytearray(warc.derive(warc.read_record(warc.response_record("u", "x")))[0].to_bytes()))], "page_id long, record binary")
    assert warc.derivatives(other).count() == 0
    want = sorted(bytes(r.record) for r in records.collect())
    places = warc.write_files(records, f"file://{tmp_path}/out").collect()
    read = []
    for r in places:
        raw = (tmp_path / "out" / r.file).read_bytes()[r.offset : r.offset + r.length]
        read.append(gzip.GzipFile(fileobj=io.BytesIO(raw)).read())
    assert sorted(read) == want


def _raw(http, payload, uri="http://a/", kind="response", record_id="<urn:uuid:0a>"):
    """A record written by hand, without digests of its block."""
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(b"%s: %s\r\n" % h for h in http) + b"\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _chunks(data, size=7):
    return b"".join(b"%x;x=y\r\n%s\r\n" % (len(p), p) for p in (data[i : i + size] for i in range(0, len(data), size))) + b"0\r\n\r\n"


PLAIN = "<title>Caf&eacute;</title><p>Café à la carte</p><a href='/a?b&amp;c'>x</a>"
HTML = (b"Content-Type", b"text/html")


@pytest.mark.parametrize(
    ("http", "payload"),
    [
        ([(b"Content-Type", b"text/html; charset=iso-8859-1")], PLAIN.encode("latin-1")),
        ([(b"content-type", b'text/html; Charset="UTF-8"')], PLAIN.encode()),
        ([HTML], b"\xff\xfe" + PLAIN.encode("utf-16-le")),
        ([HTML], b"<meta charset='windows-1252'>" + PLAIN.encode("cp1252")),
        ([(b"Content-Type", b"text/html; charset=no-such"), (b"Content-Encoding", b"gzip")], gzip.compress(PLAIN.encode())),
        ([(b"Transfer-Encoding", b"chunked")], _chunks(PLAIN.encode())),
        ([HTML, (b"Transfer-Encoding", b"chunked"), (b"Content-Encoding", b"gzip")], _chunks(gzip.compress(PLAIN.encode()))),
        ([HTML, (b"Content-Encoding", b"deflate")], zlib.compress(PLAIN.encode())),
        ([HTML, (b"Content-Encoding", b"deflate")], zlib.compress(PLAIN.encode())[2:-4]),
    ],
)
def test_warc_payloads_by_hand(spark, http, payload):
    rows = warc.derivatives(spark.createDataFrame([(1, bytearray(_raw(http, payload)))], "page_id long, record binary")).collect()
    metadata, conversion = sorted(rows, key=lambda r: r.record_type, reverse=True)
    assert (metadata.record_type, conversion.record_type, metadata.error, conversion.error) == ("metadata", "conversion", None, None)
    head, _, rest = bytes(conversion.record).partition(b"\r\n\r\n")
    block = "Café à la carte\nx".encode()
    assert rest == block + b"\r\n\r\n"
    lines = head.decode().split("\r\n")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    want = ["WARC-Type: conversion", "WARC-Refers-To: <urn:uuid:0a>", "WARC-Date: 2024-05-06T07:08:09Z", "WARC-Target-URI: http://a/", "Source-Status: HTTP/1.1 200 OK", "Source-Payload-Digest: sha1:ABC", f"WARC-Block-Digest: {digest}", f"Content-Length: {len(block)}"]
    want += [f"Source-Header-{'-'.join(w.capitalize() for w in k.decode().split('-'))}: {v.decode()}" for k, v in http]
    assert set(want) <= set(lines)
    fields = bytes(metadata.record).partition(b"\r\n\r\n")[2].decode().split("\r\n")
    assert fields[0] == "source-status: HTTP/1.1 200 OK" and {"title: Café", "outlink: /a?b&c", "source-payload-digest: sha1:ABC"} <= set(fields)
    assert {f"source-header-{k.decode().lower()}: {v.decode()}" for k, v in http} <= set(fields)
    assert (conversion.source_payload_digest, conversion.source_block_digest, metadata.n_outlinks) == ("sha1:ABC", None, 1)


def test_warc_broken_records_are_told(spark):
    bad = [b"", b"no record", _raw([HTML], b"x").replace(b"Content-Length: ", b"Content-Length: 9"), _raw([HTML], b"x").replace(b"Content-Length: ", b"Content-Length: q")]
    half = [_raw([(b"Content-Encoding", b"gzip")], b"\x1f\x8bno gzip"), _raw([(b"Content-Encoding", b"br")], b"x"), _raw([(b"Transfer-Encoding", b"chunked")], b"5\r\nab"), _raw([(b"Content-Encoding", b"deflate")], b"??")]
    rows = [(i, bytearray(r)) for i, r in enumerate([*bad, *half])] + [(99, bytearray(_raw([HTML], b"<p>fine")))]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    by = {i: [r for r in got if r.page_id == i] for i, _ in rows}
    for i in range(len(bad)):
        assert [(r.record_type, r.record) for r in by[i]] == [(None, None)] and by[i][0].error
    for i in range(len(bad), len(bad) + len(half)):
        assert [r.record_type for r in by[i]] == ["metadata", "conversion"] and all(r.error for r in by[i])
        assert bytes(by[i][1].record).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"source-error: " in bytes(by[i][0].record)
    assert [r.error for r in by[99]] == [None, None]


def test_warc_repeated_rows_have_ids_of_their_own(spark):
    rows = [(3, "u", PAGE)] * 5 + [(4, "u", PAGE), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 16 and len({r.record_id for r in got}) == 16 and len({r.refers_to for r in got}) == 8


def test_a_digest_is_written_once_for_each_image(spark, monkeypatch):
    written, before = {}, media.materialize
    monkeypatch.setattr(media, "materialize", lambda df, name: written.setdefault(name, before(df, name)))
    got = media.media_columns(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string"))
    assert got.columns[-2:] == ["media_sha256", "feature"] and len({r.media_sha256 for r in got.collect()}) == 3
    assert [r.media_sha256 for r in got.orderBy("doc_id").collect()] == [hashlib.sha256(media.png(media.payload_of(t))).hexdigest() for t in ("a", "b", "a", None)]
    assert not any("media_sha256" in df.columns for df in written.values())
