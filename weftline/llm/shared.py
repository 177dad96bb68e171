"""Helpers that the corpus operators share: the shared folder, lineage cuts, vectorised word hashing."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Multiplier of the polynomial word hash and its inverse modulo 2^64.
MUL = 0x9E3779B97F4A7C15
INV = pow(MUL, -1, 1 << 64)
CHUNK = 1 << 20
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session names none."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir().rstrip("/")


def open_store(where: str):
    """(file system, path) of a folder in the shared store, for reads and writes outside Spark's own."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", where))


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small result in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """As cut(), as compressed Parquet; for results that may be large."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(prefix: str, columns: Iterable[str]) -> str:
    """The prefix, behind as many more underscores as it takes until no column begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = "_" + prefix
    return prefix


def draw(rows: DataFrame, each: int, counts: dict) -> list[tuple]:
    """(key, h): the `each` smallest different h of every key; rows: key, h (a hash, 0 or more), counts: rows by key.

    Of most rows only the hash is looked at: what is above a generous bound takes no part, unless a key comes short.
    """
    top = Window.partitionBy("key").orderBy("h")

    def least(part: DataFrame) -> list[tuple]:
        return [tuple(r) for r in part.distinct().withColumn("r", F.row_number().over(top)).where(F.col("r") <= each).select("key", "h").collect()]  # each * keys rows

    if not counts:
        return []
    whole = (1 << 63) - 1
    bound = {k: min(whole, whole * (4 * each + 100) // n) for k, n in counts.items()}
    limit = F.create_map(*(F.lit(x) for kv in bound.items() for x in kv))
    got = least(rows.where(F.col("h") <= F.try_element_at(limit, F.col("key"))))
    have = Counter(k for k, _ in got)
    short = [k for k in counts if have[k] < each and bound[k] < whole]
    if short:
        got = [g for g in got if g[0] not in short] + least(rows.where(F.col("key").isin(short)))
    return sorted(got)


def hash_of(*cols):
    """A hash of 63 bits, 0 or more."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and bytes: texts may be long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "m" not in _powers or len(_powers["m"]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in (("m", MUL), ("i", INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["m"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    m, inv = _power(len(buf) + 1)
    prefix = np.empty(len(buf) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[buf] * m[: len(buf)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64)), start, end


def block_words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of some texts, and the offset of each text's first (with the end)."""
    return placed_words(docs)[:2]


def placed_words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As block_words, with each word's first and last byte place, and the bytes."""
    buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    bounds = np.cumsum([0, *(len(d) + 1 for d in docs)])
    hashes, starts, ends, at = [], [], [], 0
    while at < len(buf):
        to = min(len(buf), at + CHUNK)
        while to < len(buf):
            back = np.flatnonzero(_SPACE[buf[max(at, to - 65536) : to]])
            if len(back):
                to = max(at, to - 65536) + int(back[-1]) + 1
                break
            to = min(len(buf), to + 65536)
        h, s, e = _hash_words(buf[at:to])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    starts = np.concatenate([np.empty(0, np.int64), *starts])
    return np.concatenate([np.empty(0, np.uint64), *hashes]), np.searchsorted(starts, bounds), starts, np.concatenate([np.empty(0, np.int64), *ends]) - 1, buf


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, by doubling; the windows of the words that begin at each place."""
    out, width = h, 1
    for bit in bin(n)[3:]:
        if len(out) <= width:
            return np.empty(0, np.uint64)
        out = mix(out[:-width] * np.uint64(MUL + 2 * width) + out[width:])
        width *= 2
        if bit == "1":
            if len(h) <= width:
                return np.empty(0, np.uint64)
            k = min(len(out), len(h) - width)
            out = mix(out[:k] * np.uint64(MUL + 2 * width) + h[width : width + k])
            width += 1
    return out


def in_blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of about size bytes, a longer text alone in its block."""
    ids, docs, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            doc = text.encode("utf-8", "surrogatepass")
            if ids and held + len(doc) > size:
                yield ids, docs
                ids, docs, held = [], [], 0
            ids.append(i)
            docs.append(doc)
            held += len(doc)
    if ids:
        yield ids, docs
