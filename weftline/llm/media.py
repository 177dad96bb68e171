"""Media columns: content-addressed payloads in tar shards, rows of digest, shard, offset and length.

A payload is a text's UTF-8 bytes, zero-padded to whole rows of 64 samples, stored as a greyscale PNG of
8-bit samples, 64 wide.  Each task appends the images that it has not stored yet to tar shards in the shared
folder; a digest that several tasks meet has several copies there, and the index keeps one place a digest (the
least), which is what rows refer to.  A task that is run again writes shards of new names, and the index names
those of the attempt that counted.  Metadata columns (width, height, depth) come from range reads of the first
bytes of an image, features from a full read.

Cases: null or empty text is one row of zeros.  Equal texts share one image.  Repeated rows keep their rows; a null
doc_id is kept.  Very long texts are stored whole, as higher images.  An empty table gives an empty result and no
shard.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import fresh, open_store, small_batches, table, texts

WIDTH, SHARD, HEAD, LEVEL = 64, 64 << 20, 33, 6
_SIGN = b"\x89PNG\r\n\x1a\n"
REFS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = "digest string, width int, height int, depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """Greyscale PNG, 8 bits a sample, rows of WIDTH."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEAD bytes."""
    if first[:8] != _SIGN or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def decode(media: bytes) -> bytes:
    """The samples of an image that encode() wrote."""
    width, height, _ = header(media)
    at, data = 8, []
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean sample, distinct samples, entropy in bits, and the largest of 16 equal bands."""
    a = np.frombuffer(payload, np.uint8)
    n = np.bincount(a, minlength=256)
    p = n[n > 0] / len(a)
    return f"rows={len(a) // WIDTH};mean={a.mean(dtype=np.float64):.6f};distinct={len(p)};entropy={abs(-(p * np.log2(p)).sum()):.6f};band={int(n.reshape(16, 16).sum(axis=1).argmax())}"


class _Shards:
    """Tar shards of one task attempt; the stream of an earlier attempt is never touched."""

    def __init__(self, where: str, limit: int):
        self.fs, self.path = open_store(where)
        self.fs.create_dir(self.path, recursive=True)
        self.limit, self.out, self.name = limit, None, ""

    def put(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        place = self.at + len(head)
        self.at = place + len(data) + -len(data) % 512
        return self.name, place, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, where: str, shard_bytes: int = SHARD) -> DataFrame:
    """Write the images of all texts; a row of REFS each.  Materialise the result before reading it twice."""
    small_batches(docs.sparkSession)

    def run(batches):
        shards, held = _Shards(where, shard_bytes), {}
        try:
            for b in batches:
                out = []
                for i, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    payload = pad(raw)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in held:
                        held[digest] = shards.put(f"{digest.hex()}.png", encode(payload))
                    out.append((i, len(raw), digest.hex(), *held[digest]))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in REFS.split(", ")])
        finally:
            shards.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, REFS)


def index(refs: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place a digest."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    return refs.groupBy("digest").agg(place).select("digest", "p.shard", "p.offset", "p.length")


def read(places: DataFrame, where: str) -> DataFrame:
    """Columns of READ for each row of an index."""

    def run(batches):
        fs, path = open_store(where)
        file, name = None, None
        for b in batches:
            out = []
            for digest, shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    file, name = fs.open_input_file(f"{path}/{shard}"), shard
                meta = header(file.read_at(HEAD, offset))
                media = file.read_at(length, offset)
                payload = decode(media)
                out.append((digest, *meta, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if out:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return places.sort("shard", "offset").mapInArrow(run, READ)


def media_columns(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    where = fresh(docs.sparkSession, "shards")
    refs = table(store(docs, where, shard_bytes), "refs")
    features = read(index(refs), where)  # not written: the join keeps them once
    return refs.select("doc_id", "n_bytes", "digest").join(features, "digest")


def op4_media(spark, sf_dir: str) -> DataFrame:
    m = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")
