"""SimHash near-duplicates: fingerprints, and links within a Hamming distance found by the generalised pigeonhole.

Fingerprints are taken to distinct ones first, so exact copies cost one row.  Bits are grouped into partitions
so that correlated bits stand together.  With thresholds t_1..t_m that sum to distance - m + 1, two
fingerprints within the distance agree up to t_i bits in some partition i (t_i = -1: partition not probed).
Dynamic programming picks the thresholds of least estimated work, from histograms of all projections.
Each fingerprint is then sent to the keys within t_i of its projection; the fingerprints that meet under a key
are compared by exact popcount, and only a spanning star of each linked set leaves the task.

A key with more than `limit` fingerprints is never compared in one task: its members are dealt again by the bits
outside the partition (four equal parts, of which a close pair must share one), and keys that are still larger
are cut into chunks, each pair of chunks one task.  Nothing is dropped; a key that n fingerprints share even then costs
n^2 / (limit / 2) rows, in tasks of bounded size.

Cases: null or empty text has fingerprint 0 and links like any other.  Repeated rows each keep their row.  A
null doc_id takes part; it is a component's id only if the component holds no other.  Very long texts are hashed
whole, in pieces.  An empty table gives an empty result.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import keep_rows, settled
from weftline.llm.components import components
from weftline.llm.shared import batch_of, cut, free, small_batches, table, texts

SEED, WORDS, DISTANCE, PARTS, LIMIT = 42, 3, 3, 4, 2000
_FP = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("row", pa.int64())])
_SIG = pa.schema([("sig", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) word shingles, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    dig, n, counts = xxhash.xxh64_intdigest, max(1, len(w) - words + 1), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = w[at : at + (1 << 16) + words - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.array([dig(s, SEED) for s in joined], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, row: str | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, row): the text's xxhash64, the fingerprint as a signed long, and the column that tells rows apart, if any."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in texts(b)], np.uint64).view(np.int64)
            yield batch_of(_FP, b.column("doc_id"), b.column("text_hash"), pa.array(fp), b.column("row"))

    text = F.col("text").cast("string")
    mark = F.col(row) if row else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), mark.cast("long").alias("row")).mapInArrow(run, "doc_id long, text_hash long, fp long, row long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(len(fp), 8), axis=1, bitorder="little")


def _project(fp: np.ndarray, bits) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    u = fp.view(np.uint64)
    for j, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def _column(batches) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(b.column("fp").to_numpy(zero_copy_only=False) for b in batches)])


def bit_groups(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The 64 bits in groups of equal size, each grown by the bit that correlates most with it."""

    def run(batches):
        s = np.zeros((64, 64))
        n = 0
        for b in batches:
            x = _bits(b.column("fp").to_numpy()).astype(np.float32)
            s += x.T @ x
            n += len(x)
        if n:
            i = np.append(np.arange(4096), -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.append(s.ravel(), n).astype(np.int64))], names=["at", "n"])

    got = {r.at: r.n for r in fps.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # 4097 rows
    n = max(1, got.get(-1, 0))
    s = np.array([got.get(i, 0) for i in range(4096)], float).reshape(64, 64) / n
    p = np.diag(s)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((s - np.outer(p, p)) / np.outer(sd, sd))
    left, out = list(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        group = [max(left, key=lambda b: (corr[b, left].sum() - corr[b, b], -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def _ball(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)]


def thresholds(hist: list[np.ndarray], distance: int = DISTANCE) -> list[int]:
    """Thresholds that sum to distance - parts + 1, of least estimated comparisons and signatures."""
    m = len(hist)
    cost: list[dict[int, float]] = []
    for h in hist:
        w, c = len(h).bit_length() - 1, {-1: 0.0}
        for t in range(min(distance, 2) + 1):
            ball = _ball(w, t)
            met = sum(h[np.arange(len(h)) ^ b] for b in ball).astype(float)
            c[t] = float((met * met).sum() / 2 + 8 * h.sum() * len(ball))
        cost.append(c)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (sofar, picks) in best.items():
            for t, x in c.items():
                if total + t not in step or sofar + x < step[total + t][0]:
                    step[total + t] = (sofar + x, [*picks, t])
        best = step
    return best[distance - m + 1][1]


def _histograms(fps: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each projection: 2^16 counts a partition at most."""

    def run(batches):
        fp = _column(batches)
        for g, bits in enumerate(groups):
            if len(fp):
                k, n = np.unique(_project(fp, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k | (g << 32)), pa.array(n.astype(np.int64))], names=["sig", "n"])

    got = fps.mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).toArrow()
    sig, n = got.column("sig").to_numpy(), got.column("n").to_numpy()
    out = []
    for g, bits in enumerate(groups):
        h = np.zeros(1 << len(bits), np.int64)
        mine = (sig >> 32) == g
        h[sig[mine] & 0xFFFFFFFF] = n[mine]
        out.append(h)
    return out


def _star(keys: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of the linked fingerprints among those with one key; keys are sorted."""
    n = len(keys)
    last = np.searchsorted(keys, keys, side="right")
    i, a, b, d = np.arange(n), [], [], 1
    while len(i := i[i + d < last[i]]):
        hit = i[np.bitwise_count((fp[i] ^ fp[i + d]).view(np.uint64)) <= distance]
        a.append(hit)
        b.append(hit + d)
        d += 1
    if not a or not sum(map(len, a)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, label = np.concatenate(a), np.concatenate(b), np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _compare(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Edges among rows that share the keys; a key has a bounded number of rows.

    Rows are dealt by a hash of the keys.  Dealt by the keys themselves after a join on them, Spark drops the exchange for the join's
    own, which adaptive execution may then split or read by mapper, as mapInArrow asks for no distribution; rows of a key would not all meet.
    """

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(parts):
            k, f = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, v = _star(k, f, distance)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGE)

        tag, seen = 0, None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in keys]
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            first = tuple(int(c[0]) for c in cols)
            new[0] = first != seen
            seen = tuple(int(c[-1]) for c in cols)
            k = tag + np.cumsum(new)
            tag = int(k[-1])
            f = batch.column("fp").to_numpy()
            begin = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if new.any():
                held.append((k[:begin], f[:begin]))
                yield from flush(held)
                held = []
            held.append((k[begin:], f[begin:]) if new.any() else (k, f))
        if held:
            yield from flush(held)

    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS, limit: int = LIMIT) -> DataFrame:
    """(u, v): edges whose components are those of all distinct fingerprints (column fp) within the distance."""
    spark = fps.sparkSession
    groups = bit_groups(fps, parts)
    t = thresholds(_histograms(fps, groups), distance)

    def signatures(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            for g, bits in enumerate(groups):
                if t[g] >= 0:
                    k = _project(fp, bits) | (g << 32)
                    for x in _ball(len(bits), t[g]):
                        yield pa.RecordBatch.from_arrays([pa.array(k ^ x), pa.array(fp)], schema=_SIG)

    sigs = fps.mapInArrow(signatures, "sig long, fp long")
    many = cut(sigs.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    if many.isEmpty():
        return _compare(sigs, ["sig"], distance)
    edges = _compare(sigs.join(many, "sig", "left_anti"), ["sig"], distance)

    def parts_again(batches):
        for b in batches:
            sig, fp = b.column("sig").to_numpy(), b.column("fp").to_numpy()
            for g, bits in enumerate(groups):
                mine = (sig >> 32) == g
                if mine.any():
                    rest = [x for x in range(64) if x not in bits]
                    cuts = np.array_split(rest, distance + 1)
                    for j, piece in enumerate(cuts):
                        k = _project(fp[mine], piece) | (j << 48)
                        yield pa.RecordBatch.from_arrays([pa.array(sig[mine]), pa.array(k), pa.array(fp[mine])], names=["sig", "sub", "fp"])

    finer = sigs.join(many, "sig", "left_semi").mapInArrow(parts_again, "sig long, sub long, fp long")
    sizes = cut(finer.groupBy("sig", "sub").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    edges = edges.union(_compare(finer.join(sizes, ["sig", "sub"], "left_anti"), ["sig", "sub"], distance))
    if not sizes.isEmpty():
        chunks = sizes.withColumn("c", F.ceil(F.col("n") / (limit // 2)).cast("long"))
        pairs = (
            finer.join(chunks, ["sig", "sub"])
            .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("c")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
            .select("sig", "sub", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
        )
        edges = edges.union(_compare(pairs, ["sig", "sub", "lo", "hi"], distance))
    return edges


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, parts: int = PARTS, limit: int = LIMIT, row: str | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, row, root, component_id): root is a component's own, component_id the smallest doc_id that links reach."""
    rows = table(fingerprints(docs, words, row), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = cut(least)
    roots = components(links(distinct.select("fp"), distance, parts, limit)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "row", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay if each component keeps one: a row of its smallest doc_id (none comes last), and of these the first.

    Rows are told apart by their place, and filtered where they stand.
    """
    docs = settled(docs)
    row = free("_w_", docs.columns) + "row"
    groups = near_duplicates(docs.withColumn(row, F.monotonically_increasing_id()), words, distance, row=row)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row")).alias("k"))
    return keep_rows(docs, first.select("k.row", "k.doc_id"), "kept")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
