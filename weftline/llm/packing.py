"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths.

The plan works on counts: lengths from long to short, each placed into the open sequences of least remaining
room that still hold it, many at a time.  Its input is at most `capacity` counts, and its size depends on the
number of distinct lengths, not of documents.  Documents then take the planned slots by their rank within their
length; ranks are taken within (length, salt) and shifted by the counts of smaller salts.  Salts are dealt by a piece's
place in the written table, whatever it holds, and a length of n pieces has about the square root of n, so neither a
length nor equal pieces are ranked in one task.

Cases: null or empty text is one token, the end id.  Only longer documents than the capacity are cut; the first
piece takes the remainder.  Repeated rows are packed as often as they stand there.  A null doc_id is kept.  Very
long texts are tokenised whole.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import free, small_batches, table, texts

CAPACITY, END = 2048, 0
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space that a look-ahead would treat otherwise than a plain run.
_RUNS = re.compile(r"\s\s+\S")
_held: dict = {}


def tokenizer(path: str):
    """Ids of a text by the byte-level BPE in a tokenizers file; the same vocabulary as ranks, if beside it, is faster.

    Splitting without look-ahead gives the same pieces where no run of white space stands before a word; such
    texts take the full pattern, and texts that name a special token the tokenizers library itself.
    """
    if path not in _held:
        import os

        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        plain = lambda t: whole.encode(t, add_special_tokens=False).ids
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                mergeable = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            full = tiktoken.Encoding("full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mergeable, special_tokens={})
            fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=mergeable, special_tokens={})

            def ids(t: str) -> list[int]:
                if any(s in t for s in special):
                    return plain(t)
                return (full if _RUNS.search(t) else fast).encode_ordinary(t)

        else:
            ids = plain
        _held[path] = ids
    return _held[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: its start among its document's ids, its length and the check sum of its ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        encode = tokenizer(path)
        for b in batches:
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids = np.array([*encode(t), END], "<u4")
                at, no = 0, 0
                while at < len(ids):
                    to = (len(ids) - 1) % capacity + 1 if at == 0 else at + capacity
                    out.append((i, no, at, to - at, zlib.crc32(ids[at:to])))
                    at, no = to, no + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit over counts: for each length, runs (first rank, first sequence, how many in each, offset).

    A run goes on to the next one's first rank; its ranks fill each sequence with `how many` pieces in turn.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    room: dict[int, list[list[int]]] = defaultdict(list)  # remaining room -> [first sequence, sequences]
    rooms: list[int] = []  # sorted rooms that have sequences
    made = 0

    def keep(r: int, first: int, n: int) -> None:
        if r > 0 and n > 0:
            if not room[r]:
                rooms.insert(bisect_left(rooms, r), r)
            room[r].append([first, n])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                first, n, r = made, -(-left // each), capacity
                made += n
            else:
                r = rooms[at]
                first, n = room[r].pop()
                if not room[r]:
                    rooms.pop(at)
                each = r // length
            used = min(n, -(-left // each))
            keep(r, first + used, n - used)
            runs[length].append((rank, first, each, capacity - r))
            full = min(used, left // each)
            keep(r - each * length, first, full)
            rest = left - full * each if full < used else 0
            if rest:
                keep(r - rest * length, first + full, 1)
            rank += full * each + rest
            left -= full * each + rest
    return dict(runs)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row (column length, 1 to capacity) its sequence_id and offset; all other columns stay."""
    rows = rows.drop("sequence_id", "offset")
    w = free("_w_", rows.columns)
    deal, salt, salts, rank, n, shift = (w + x for x in ("deal", "salt", "salts", "rank", "n", "before"))
    rows = table(rows.withColumn(deal, F.xxhash64(F.monotonically_increasing_id())), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    planned = plan(counts, capacity)
    each = rows.sparkSession.createDataFrame([(x, math.isqrt(n - 1) + 1) for x, n in counts.items()], f"`{w}length` long, `{salts}` long")
    salted = rows.join(F.broadcast(each), F.col("length") == F.col(w + "length")).withColumn(salt, F.pmod(deal, salts))  # as many rows as counts
    before = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    before = before.select("length", salt, (F.sum(n).over(Window.partitionBy("length").orderBy(salt)) - F.col(n)).alias(shift))
    within = F.row_number().over(Window.partitionBy("length", salt).orderBy(deal)) - 1
    ranked = salted.withColumn(rank, within.cast("long")).join(before, ["length", salt])
    ranked = ranked.select(*(c for c in rows.columns if c != deal), (F.col(rank) + F.col(shift)).alias(rank))
    keep = ranked.columns[:-1]
    told = ranked.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in planned.items()})

    def run(batches):
        for b in batches:
            length, at = b.column("length").to_numpy(), b.column(rank).to_numpy()
            seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for x in np.unique(length):
                mine = length == x
                runs = told.value[int(x)]
                r = runs[np.searchsorted(runs[:, 0], at[mine], side="right") - 1]
                k = at[mine] - r[:, 0]
                seq[mine] = r[:, 1] + k // r[:, 2]
                off[mine] = r[:, 3] + k % r[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != rank)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
