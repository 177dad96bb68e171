"""Counting by exchange of sorted key blocks.

A task reads its documents in blocks of bounded size and asks, for each block, about the distinct keys
(hashes of words or windows) in it: one row per block and bucket of the key space, keys sorted and delta
coded.  A reducer sees all rows of a bucket, and answers each row with one value a key, in the same order, so
that answers carry no keys.  Answers are written by reading task into the shared folder, where the task that
reads the same documents again finds them.  A hot key costs one entry per block, never one per occurrence.

The documents are read again by each pass and are told apart by partition and position, so the input must
give the same rows in the same partitions each time, as a scan of files does whose number of splits is fixed; another
input is first written to the shared folder (`stable`).  A check sum of the keys is kept with each answer, and a differing one raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import fresh, in_blocks, open_store, small_batches

ASK = "bucket int, pid int, block int, n int, crc long, keys binary, vals binary"
TELL = "pid int, block int, bucket int, n int, crc long, vals binary"
_SPLITS, EIGHT = "spark.sql.files.minPartitionNum", 8
_ASK = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("crc", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
_TELL = pa.schema([("pid", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("crc", pa.int64()), ("vals", pa.binary())])


def stable(docs: DataFrame) -> DataFrame:
    """doc_id and text with partitions that stay; anything but a plain scan of files is written first.

    How a scan of files is split follows the cores that are alive, unless the session fixes the least number of
    splits; it is fixed here at what it is now, so that executors may come and go between passes.
    """
    return settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def settled(docs: DataFrame) -> DataFrame:
    """As stable(), with all columns."""
    spark = docs.sparkSession
    if not spark.conf.get(_SPLITS, None):
        spark.conf.set(_SPLITS, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    if _plain(docs):
        return docs
    path = fresh(spark, "stable")
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def _plain(docs: DataFrame) -> bool:
    """Whether the plan is a scan of files with nothing but projections and filters that give the same each time."""
    ran = docs._jdf.queryExecution()
    node = ran.sparkPlan()
    while node.getClass().getSimpleName() in ("ProjectExec", "FilterExec", "ColumnarToRowExec"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "FileSourceScanExec" and ran.analyzed().deterministic()


def sizes(docs: DataFrame, bucket_bytes: int, block_bytes: int) -> tuple[int, int]:
    """How many buckets, and the bytes of a block.

    Each block sends a row to each bucket that it has keys in.  So that rows do not become as many as keys, buckets and
    blocks grow with the text beyond 4096 and 16384 of them, up to EIGHT times; memory stays bounded.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket = min(max(bucket_bytes, size // 4096), bucket_bytes * EIGHT)
    return max(12, -(-size // bucket)), min(max(block_bytes, size // 16384), block_bytes * EIGHT)


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, the first of each value first: leading zeros then compress to nothing."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1) if len(a) else b""


def from_planes(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not raw:
        return np.empty(0, kind)
    b = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(b.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint64), dtype=np.uint64)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted ones."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def asked(pid: int, block: int, first: int, buckets: int, keys: np.ndarray, *vals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Request rows for sorted distinct keys; vals go with them, several side by side."""
    at = bounds(keys, buckets)
    rows = []
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        k = keys[s]
        rows.append((first + int(b), pid, block, len(k), zlib.crc32(k), pack_keys(k), b"".join(len(p).to_bytes(4, "little") + p for p in (planes(v[s]) for v in vals))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ASK, strict=True)], schema=_ASK)


def split_vals(raw: bytes) -> list[bytes]:
    out = []
    while raw:
        n = int.from_bytes(raw[:4], "little")
        out.append(raw[4 : 4 + n])
        raw = raw[4 + n :]
    return out


class Answers:
    """What reducers told this task, by block."""

    def __init__(self, where: str, pid: int):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, path = open_store(where)
        self.rows: dict[int, list] = {}
        for f in fs.get_file_info(pafs.FileSelector(f"{path}/pid={pid}", allow_not_found=True)):
            if f.base_name.endswith(".parquet"):
                t = pq.ParquetFile(fs.open_input_file(f.path)).read()
                for block, bucket, n, crc, vals in zip(*(t.column(c).to_pylist() for c in ("block", "bucket", "n", "crc", "vals")), strict=True):
                    self.rows.setdefault(block, []).append((bucket, n, crc, vals))

    def of(self, block: int, first: int, buckets: int, keys: np.ndarray, kind) -> np.ndarray:
        """One value for each of the sorted distinct keys that the block asked about."""
        got = sorted(r for r in self.rows.get(block, ()) if first <= r[0] < first + buckets)
        at = bounds(keys, buckets)
        out = [np.empty(0, kind)]
        want = {first + int(b): keys[at[b] : at[b + 1]] for b in np.flatnonzero(np.diff(at))}
        if [r[0] for r in got] != sorted(want):
            raise RuntimeError("the documents differ from those of the pass before; write them to a table first")
        for bucket, n, crc, vals in got:
            if n != len(want[bucket]) or crc != zlib.crc32(want[bucket]):
                raise RuntimeError("the documents differ from those of the pass before; write them to a table first")
            out.append(from_planes(vals, kind))
        return np.concatenate(out)


def scan(docs: DataFrame, work: Callable, schema: str, told: list[str], block_bytes: int) -> DataFrame:
    """work(pid, block, ids, texts, answers) over the blocks of each partition, yielding record batches."""
    small_batches(docs.sparkSession)

    def run(batches):
        pid = TaskContext.get().partitionId()
        answers = [Answers(t, pid) for t in told]
        for block, (ids, raw) in enumerate(in_blocks(batches, block_bytes)):
            yield from work(pid, block, ids, raw, answers)

    return docs.mapInArrow(run, schema)


def reduce_asked(requests: DataFrame, answer: Callable, name: str) -> tuple[str, DataFrame]:
    """answer(bucket, [(keys, vals)]) -> ([values by request], meta); gives the answers' folder and the meta rows.

    meta is a dict of string to number, one row each, under block -1 and a negative pid.
    """
    spark = requests.sparkSession

    def run(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("bucket", "pid", "block", "n", "crc", "keys", "vals")]
        rows = list(zip(*cols, strict=True))
        bucket = rows[0][0]
        told, meta = answer(bucket, [(unpack_keys(r[5]), split_vals(r[6])) for r in rows])
        out = [(r[1], r[2], bucket, r[3], r[4], planes(v)) for r, v in zip(rows, told, strict=True)]
        out += [(-1 - bucket % 32, -1, bucket, 0, 0, f"{k}={v!r}".encode()) for k, v in meta.items()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TELL, strict=True)], schema=_TELL)

    path = fresh(spark, name)
    requests.groupBy("bucket").applyInArrow(run, TELL).repartition("pid").write.partitionBy("pid").parquet(path)
    meta = spark.read.schema(TELL).parquet(path).where("pid < 0").select(F.split(F.col("vals").cast("string"), "=").alias("kv"))
    return path, meta.groupBy(F.col("kv")[0].alias("name")).agg(F.sum(F.col("kv")[1].cast("double")).alias("value"))


def keep_rows(docs: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """The rows of a settled table that `kept` names, where they stand; texts are not moved.

    kept: row (as monotonically_increasing_id numbers them: partition and place) and doc_id.  Each task reads the places of
    its partition from the shared folder; a row whose doc_id is another than the kept one's raises.
    """
    import pyarrow.compute as pc

    path = fresh(docs.sparkSession, name)
    place = F.col("row").bitwiseAND((1 << 33) - 1)
    kept.select(F.shiftright("row", 33).cast("int").alias("pid"), place.alias("at"), F.col("doc_id").cast("long").alias("doc_id")).repartition("pid").write.partitionBy("pid").parquet(path)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, where = open_store(path)
        files = [f for f in fs.get_file_info(pafs.FileSelector(f"{where}/pid={TaskContext.get().partitionId()}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
        told = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f.path)).read(["at", "doc_id"]) for f in files]).sort_by("at") if files else pa.table({"at": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64())})
        at, ids, done = told.column("at").to_numpy(), told.column("doc_id").combine_chunks(), 0
        for b in batches:
            lo, hi = np.searchsorted(at, [done, done + b.num_rows])
            mine = b.take(pa.array(at[lo:hi] - done))
            had = mine.column("doc_id").cast(pa.int64())
            same = pc.fill_null(pc.equal(had, ids.slice(lo, hi - lo)), False)
            none = pc.and_(pc.is_null(had), pc.is_null(ids.slice(lo, hi - lo)))
            if not pc.all(pc.or_(same, none), min_count=0).as_py():
                raise RuntimeError("the documents differ from those of the pass before; write them to a table first")
            done += b.num_rows
            if mine.num_rows:
                yield mine
        if len(at) and at[-1] >= done:
            raise RuntimeError("the documents differ from those of the pass before; write them to a table first")

    return docs.mapInArrow(run, docs.schema)
