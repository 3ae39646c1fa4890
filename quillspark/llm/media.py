"""Media columns: content-addressed payloads in tar shards.

A payload is kept as the samples of an 8-bit grey PNG. A table row carries only
the digest, the shard, and the offset and length of the PNG in it. Metadata
columns are filled by range reads of the PNG's first 33 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed, materialize, scratch_path, slices, table

#: Samples in a row of the image; a payload is a multiple of it.
WIDTH = 576
FILL = b"\xff"
#: A shard is closed at this size.
SHARD_BYTES = 128 << 20
#: Images that one task reads back.
PART_BYTES = 16 << 20
#: Signature, and the IHDR chunk with its length, name and checksum.
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text, filled up with bytes 255 to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return raw + FILL * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(payload: bytes, level: int = 6) -> bytes:
    """The payload as an 8-bit grey image, without loss; the same bytes each time."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row with filter type 0 in front
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def png_payload(stored: bytes) -> bytes:
    """The samples of an image that png() made; checks every chunk."""
    width, height, _ = png_header(stored[:HEADER_BYTES])
    at, data = 8, []
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        name, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if name == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that png() does not write")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, entropy in bits, and a 64-bit hash of which 64ths of the samples are above the mean."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    some = share[share > 0]
    edges = np.arange(64) * len(samples) // 64
    parts = np.add.reduceat(samples.astype(np.int64), edges) / np.diff(np.append(edges, len(samples)))
    mean = float(samples.mean())
    bits = int("".join("1" if p > mean else "0" for p in parts), 2)
    return f"mean={mean:.4f};entropy={max(0.0, -float((some * np.log2(some)).sum())):.4f};blocks={bits:016x}"


class _Shards:
    """Writes tar shards of one task; equal images in a shard are kept once."""

    def __init__(self, root: str):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.fs.create_dir(self.root, recursive=True)
        self.out = None

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.size, self.seen = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, {}
        if digest not in self.seen:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            header = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(header + data + b"\0" * (-len(data) % 512))
            self.seen[digest] = (self.name, self.size + len(header), len(data))
            self.size += len(header) + len(data) + -len(data) % 512
        place = self.seen[digest]
        if self.size >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's payload to tar shards below root: (doc_id, n_bytes, digest, shard, offset, length).

    root is a URI that all executors can write. A task that is tried again
    writes shards of new names, and only rows of tasks that ended count. A
    payload is kept once in a shard; addresses() makes its rows point to one.
    """

    def run(batches):
        shards = _Shards(root)
        for whole in batches:
            for b in slices(whole):
                texts = b.column(1).to_pylist()
                rows = []
                for t in texts:
                    data = png(payload_of(t))
                    digest = hashlib.sha256(data).hexdigest()
                    rows.append((len((t or "").encode()), digest, *shards.add(digest, data)))
                n, digest, shard, offset, length = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return materialize(keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media")


def addresses(rows: DataFrame) -> DataFrame:
    """One place (digest, shard, offset, length) for each digest, in the order of the shards."""
    place = F.min(F.struct("shard", "offset", "length")).alias("at")
    return rows.groupBy("digest").agg(place).select("digest", "at.*").repartitionByRange("shard", "offset")


def in_parts(places: DataFrame) -> DataFrame:
    """places dealt by shard and offset into parts of about PART_BYTES of images, for steps that read them whole."""
    size = places.agg(F.sum("length")).first()[0] or 0
    return places.repartitionByRange(max(1, -(-size // PART_BYTES)), "shard", "offset")


class _Reader:
    """Range reads; keeps the last shard open."""

    def __init__(self, root: str):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def with_headers(places: DataFrame, root: str) -> DataFrame:
    """places with width, height and bit_depth, from range reads of the headers alone."""

    def run(batches):
        reader = _Reader(root)
        for b in batches:
            heads = [png_header(reader.read(s, o, min(n, HEADER_BYTES))) for s, o, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            more = [pa.array([h[k] for h in heads], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "width", "height", "bit_depth"])

    places = places.select("digest", "shard", "offset", "length")
    return places.mapInArrow(run, "digest string, shard string, offset long, length long, width long, height long, bit_depth long")


def with_features(places: DataFrame, root: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of the stored images.

    places has width and height, against which what is read is checked; so are
    the digests.
    """

    def run(batches):
        reader = _Reader(root)
        for b in batches:
            rows = []
            for digest, shard, offset, length, width, height in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                stored = reader.read(shard, offset, length)
                payload = png_payload(stored)
                sha = hashlib.sha256(stored).hexdigest()
                if sha != digest or len(payload) != width * height:
                    raise ValueError(f"{shard} at {offset}: not what was stored")
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha, feature_of(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    places = places.select("digest", "shard", "offset", "length", "width", "height")
    return places.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard, offset, length, width, height, and the columns of with_features().

    One row per row of docs. Null and empty texts are WIDTH bytes 255; a null id
    stays null; repeated rows share a payload; an empty table gives no rows and
    no shards.
    """
    root = root or scratch_path(docs.sparkSession, "payloads")
    rows = store(docs, root, id_col, text_col)
    places = materialize(with_headers(addresses(rows), root), "places")
    read = materialize(with_features(in_parts(places), root).drop("media_sha256"), "features")  # was checked to be the digest
    found = materialize(places.select("digest", "shard", "offset", "length", "width", "height").join(read, "digest"), "media_index")
    found = rows.select("doc_id", "n_bytes", "digest").join(found, "digest").withColumnRenamed("digest", "media_sha256")
    return found.select("doc_id", "n_bytes", "shard", "offset", "length", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_media_columns(spark, sf_dir):
    rows = media_columns(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height")
