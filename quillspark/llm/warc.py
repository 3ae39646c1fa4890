"""WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices, table
from .html_blocks import leaf_blocks

VERSION = b"WARC/1.0"
EPOCH = "1970-01-01T00:00:00Z"
#: Name space of record ids that are derived from what a record says.
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_ANCHOR = re.compile(r"<a(?=\s)", re.I)
_HREF = re.compile(r"\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_META = re.compile(rb"<meta\s[^>]{0,400}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
# Byte order marks, and a name that browsers read as another.
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_SAME = {"iso8859-1": "cp1252", "ascii": "cp1252"}
_TITLE, _TITLE_END = re.compile(r"<title", re.I), re.compile(r"</title", re.I)
#: A payload that grows beyond this when it is decoded is an error of its record.
MOST_BYTES = 256 << 20


def digest(data: bytes) -> str:
    """A labelled digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        name = name.lower()
        return next((v for k, v in self.headers if k.lower() == name), None)

    def to_bytes(self) -> bytes:
        head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in self.headers)])
        return head + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def read_record(raw: bytes) -> Record:
    """One uncompressed record; checks version, length and, where given, the block's sha1."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in b" \t" and headers:  # continues the header before
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.decode('utf-8', 'replace').strip()}")
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers.append((name.strip(), value.strip()))
    record = Record(headers, b"")
    n = int(record.get("Content-Length") or -1)
    if n < 0 or len(rest) < n:
        raise ValueError("Content-Length does not fit the block")
    record.block = rest[:n]
    said = record.get("WARC-Block-Digest")
    if said and said.startswith("sha1:") and said != digest(record.block):
        raise ValueError("WARC-Block-Digest does not fit the block")
    return record


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", " ", text).strip()


def response_record(url: str | None, page: str | None, date: str = EPOCH, key: str = "") -> bytes:
    """A response record for a page; the same bytes for the same arguments. Null counts as empty."""
    target, payload = _one_line(url or ""), (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, f'response {key} {target} {digest(payload)}')}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block))),
    ]
    return Record(headers, block).to_bytes()


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked message; one that breaks off raises."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        size = int(data[at:line].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        if size < 0 or len(data) < line + 2 + size:
            raise ValueError("a chunk is shorter than its size")
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size + 2


def _inflated(data: bytes, coding: str, most: int = MOST_BYTES) -> bytes:
    """data without its content coding; one of more than `most` bytes raises before it is held whole."""
    if coding in ("gzip", "x-gzip"):
        out = gzip.GzipFile(fileobj=io.BytesIO(data)).read(most + 1)
    elif coding == "deflate":  # with or without zlib's header
        inflater = zlib.decompressobj() if data[:1] and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0 else zlib.decompressobj(-15)
        out = inflater.decompress(data, most + 1)
        if not inflater.eof and len(out) <= most:
            raise ValueError("the payload breaks off")
    elif coding == "zstd":
        out = zstandard.ZstdDecompressor().stream_reader(data).read(most + 1)
    elif coding in ("", "identity"):
        out = data
    else:
        raise ValueError(f"content coding {coding} is not known")
    if len(out) > most:
        raise ValueError(f"the payload has more than {most} bytes")
    return out


def page_title(page: str) -> str | None:
    """What stands in the first title element that is closed; each character is looked at a bounded number of times."""
    start = _TITLE.search(page)
    begin = page.find(">", start.end()) if start else -1
    end = _TITLE_END.search(page, begin + 1) if begin >= 0 else None
    return page[begin + 1 : end.start()] if end else None


def page_links(page: str) -> list[str]:
    """The href of each a element, in order: each is looked for up to the next element of that name."""
    starts = [m.end() for m in _ANCHOR.finditer(page)]
    found = [_HREF.match(page, a, b) for a, b in zip(starts, [*starts, len(page)][1:], strict=True)]
    return [m.group(1) or m.group(2) or m.group(3) or "" for m in found if m]


def body(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without transfer and content codings; raises ValueError where these do not hold."""
    said = lambda name: [c.strip().lower() for k, v in http if k.lower() == name for c in v.split(",")]
    try:
        if "chunked" in said("transfer-encoding"):
            payload = _unchunked(payload)
        for coding in reversed(said("content-encoding")):
            payload = _inflated(payload, coding)
    except (OSError, EOFError, zlib.error, zstandard.ZstdError) as e:
        raise ValueError(f"the payload cannot be decoded: {e}") from e
    return payload


def decoded(http: list[tuple[str, str]], data: bytes) -> str:
    """Text of a page: by its byte order mark, the charset of its Content-Type or of its meta element, else UTF-8."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    header = next((m.group(1) for k, v in http if k.lower() == "content-type" and (m := _CHARSET.search(v))), None)
    meta = _META.search(data, 0, 4096)  # where pages must say it
    for name in (header, meta.group(1).decode() if meta else None):
        try:
            found = codecs.lookup(name).name if name else ""
        except LookupError:
            continue
        if found and codecs.lookup(found)._is_text_encoding:
            return data.decode(_SAME.get(found, found), "replace")
    return data.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """All text blocks of a page, one on each line."""
    return "\n".join(b[0] for b in leaf_blocks(page))


def _derived(kind: str, source: Record, content_type: str, block: bytes, more: Sequence[tuple[str, str]] = ()) -> Record:
    origin = source.get("WARC-Record-ID") or ""
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, f'{kind} {origin}')}>"), ("WARC-Date", source.get("WARC-Date") or EPOCH), ("WARC-Target-URI", source.get("WARC-Target-URI") or ""),
        ("WARC-Refers-To", origin), ("Content-Type", content_type), *more, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block))),
    ]
    return Record(headers, block)


def derive(source: Record) -> tuple[Record, Record, str | None]:
    """The metadata and the conversion record of a response, and what is wrong with its payload, if anything.

    Both refer to the response, keep its date and target and have its status, HTTP
    headers and digests: the metadata as fields, beside the title and the
    outlinks, the conversion as headers of its own (Source-...). The conversion's
    block is the page's text, which may be empty, and is where the payload cannot
    be decoded.
    """
    status, http, payload = http_parts(source.block)
    error = None
    try:
        page = decoded(http, body(http, payload))
    except ValueError as e:
        page, error = "", str(e)
    origin = [("source-status", _one_line(status))]
    origin += [(f"source-header-{k.lower()}", _one_line(v)) for k, v in http]
    origin += [(name, value) for name, key in (("source-payload-digest", "WARC-Payload-Digest"), ("source-block-digest", "WARC-Block-Digest")) if (value := source.get(key))]
    fields = [*origin, ("title", _one_line(html.unescape(page_title(page) or "")))]
    fields += [("outlink", _one_line(html.unescape(link))) for link in page_links(page)]
    if error:
        fields.append(("source-error", _one_line(error)))
    block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    more = [("-".join(w.capitalize() for w in k.split("-")), v) for k, v in origin]
    text = plain_text(page).encode("utf-8", "replace")
    return _derived("metadata", source, "application/warc-fields", block), _derived("conversion", source, "text/plain; charset=utf-8", text, more), error


_SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_block_digest string, n_outlinks long, record binary, error string"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): a response record for each row; null url or html count as empty.

    A record's id comes from what the row says. Of rows that say the same, each has
    the place where it was read in its id too, as no two records may share one.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, "html"):
                rows = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
                records = [response_record(u, h, key=str(i) if c is None else f"{i} copy {c}") for i, u, h, c in rows]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(records, pa.binary())], ["page_id", "record"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    said = F.xxhash64("page_id", "url", "html")
    repeated = materialize(rows.groupBy(said.alias("said")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("said"), "repeated")
    if repeated.limit(1).count():
        marked = rows.withColumn("said_here", said).withColumn("place", F.monotonically_increasing_id())
        rows = marked.join(repeated, F.col("said_here") == F.col("said"), "left").select("page_id", "url", "html", F.when(F.col("said").isNotNull(), F.col("place")).alias("copy"))
    else:
        rows = rows.withColumn("copy", F.lit(None).cast("long"))
    return rows.mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each response in records (page_id, record).

    error says what is wrong with the payload (null: nothing); a record that cannot
    be read gives one row with nothing but page_id and error. Other record types and
    null records give no rows. Repeated rows give repeated rows; an empty table
    gives an empty table.
    """
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.int64(), pa.binary(), pa.string()]

    def of(page_id, raw):
        try:
            source = read_record(raw)
        except ValueError as e:
            return [(page_id, *[None] * 12, str(e))]
        if source.get("WARC-Type") != "response":
            return []
        *made, error = derive(source)
        origin = source.get("WARC-Payload-Digest"), source.get("WARC-Block-Digest")
        links = made[0].block.count(b"\r\noutlink: ")
        said = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
        return [(page_id, *map(r.get, said), len(r.block), r.get("WARC-Block-Digest"), *origin, n, r.to_bytes(), error) for r, n in zip(made, (links, 0), strict=True)]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "record"):
                rows = [row for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if raw is not None for row in of(i, raw)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return records.select("page_id", "record").mapInArrow(run, _SCHEMA)


def write_files(records: DataFrame, root: str) -> DataFrame:
    """Write records (page_id, record) as .warc.gz files below root, a gzip member each: (page_id, file, offset, length).

    root is a URI that all executors can write. Files are named anew in each
    attempt of a task; only what the returned rows name counts.
    """

    def run(batches):
        where, path = fs.FileSystem.from_uri(root)
        where.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        at = 0
        with where.open_output_stream(f"{path}/{name}", compression=None) as out:
            for b in batches:
                places = []
                for raw in b.column(1).to_pylist():
                    data = gzip.compress(raw, mtime=0)
                    out.write(data)
                    places.append((at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(places), pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], ["page_id", "file", "offset", "length"])

    return records.select("page_id", "record").mapInArrow(run, "page_id long, file string, offset long, length long")


def op6_warc_derivatives(spark, sf_dir):
    return derivatives(responses(table(spark, sf_dir, "pages")))
