"""Exact substring dedup by level-wise doubling.

A window of `window` words is removed if its word sequence also starts earlier.  Short windows are looked at
first: from each full window the seed of least hash is picked (so two equal windows pick the same seed), and
seeds that repeat anywhere are candidates.  Candidates are extended to twice their length, those whose longer
window stands alone fall away, and so on up to the full window; only then is the earliest place of each sequence
asked for.  Work at every level is over the candidates that the level before left; without any, nothing is sent.

Keys are 64-bit hashes of word sequences.  They are exchanged in blocks (blocks.py): one entry per key and
block, so a passage that very many documents share costs each block one entry, and answers are one bit a key.

Cases: null or empty text has no words; kept_sha256 is that of no bytes.  Texts of fewer words than a window stay
whole.  Repeated rows with equal doc_id stand at the same place: neither is earlier than the other.  A null doc_id
comes after all others.  Very long texts are windowed whole.  An empty table gives an empty result.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.blocks import ASK, asked, from_planes, reduce_asked, scan, sizes, stable
from weftline.llm.shared import block_words, grams, mix

WINDOW, SEED, BLOCK, BUCKET_BYTES = 20, 5, 4_000_000, 16_000_000
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
LATE = (1 << 63) - 1


def levels(window: int, seed: int = SEED) -> list[int]:
    """Window lengths: the seed doubled while below the window, then the window."""
    out = [min(seed, window)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def seeds(h: np.ndarray, ends: np.ndarray, length: int, window: int) -> np.ndarray:
    """Starts of the seeds of least hash in each full window that stays within its document."""
    if len(h) < window:
        return np.empty(0, np.int64)
    g, n = grams(h, length), len(h) - window + 1
    wide = np.lib.stride_tricks.sliding_window_view(g, window - length + 1)
    starts = np.flatnonzero(np.arange(n) + window <= ends[:n])
    return np.unique(np.concatenate([s + wide[s].argmin(axis=1) for s in np.array_split(starts, len(starts) // 100_000 + 1)]))


def extend(at: np.ndarray, length: int, longer: int, window: int, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the longer windows that a repeated shorter one can stand in."""
    shifts = (0, longer - length) if longer < window and 2 * longer - length - 1 <= window else range(longer - length + 1)
    mark = np.zeros(len(h), bool)
    for s in shifts:
        x = at - s
        x = x[x >= begins[at]]
        mark[x[x + longer <= ends[x]]] = True
    return np.flatnonzero(mark)


def repeated(rows: list):
    keys = np.concatenate([k for k, _ in rows])
    counts = np.concatenate([from_planes(v[0], np.uint8) for _, v in rows])
    _, inv = np.unique(keys, return_inverse=True)
    told = (np.bincount(inv, weights=counts) > 1)[inv].astype(np.uint8)
    return np.split(told, np.cumsum([len(k) for k, _ in rows])[:-1]), {}


def earliest(rows: list):
    keys = np.concatenate([k for k, _ in rows])
    doc = np.concatenate([from_planes(v[0], np.int64) for _, v in rows])
    at = np.concatenate([from_planes(v[1], np.int64) for _, v in rows])
    order = np.lexsort((at, doc, keys))
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    told = np.empty(len(keys), np.uint8)
    told[order] = (doc[order] == doc[first]) & (at[order] == at[first])
    return np.split(told, np.cumsum([len(k) for k, _ in rows])[:-1]), {}


class Block:
    """Words of some documents and, level by level, the starts that are still candidates."""

    def __init__(self, ids: list, raw: list[bytes], window: int, seed: int):
        self.h, off = block_words(raw)
        n = np.diff(off)
        self.off, self.begins, self.ends = off, np.repeat(off[:-1], n), np.repeat(off[1:], n)
        self.doc = np.repeat(np.array([LATE if i is None else i for i in ids], np.int64), n)
        self.window, self.lengths = window, levels(window, seed)
        self.starts = seeds(self.h, self.ends, self.lengths[0], window)

    def keys(self, level: int):
        g = grams(self.h, self.lengths[level])
        # Seeds are least hashes; mixed again, they spread evenly over the buckets.
        return np.unique(mix(g[self.starts]), return_inverse=True, return_counts=True) if len(self.starts) else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))

    def narrow(self, level: int, told: np.ndarray, inv: np.ndarray) -> None:
        at = self.starts[told[inv].astype(bool)]
        self.starts = extend(at, self.lengths[level], self.lengths[level + 1], self.window, self.h, self.begins, self.ends)

    def firsts(self, inv: np.ndarray, n: int):
        """The earliest place of each key among this block's."""
        place = self.starts - self.begins[self.starts]
        order = np.lexsort((place, self.doc[self.starts], inv))
        new = np.ones(len(order), bool)
        new[1:] = inv[order][1:] != inv[order][:-1]
        first = order[new]
        return self.doc[self.starts[first]], place[first], place


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET_BYTES, texts: bool = False) -> DataFrame:
    """Remove the words that earlier-seen windows cover; columns of KEPT, and kept_text if `texts`."""
    docs = stable(docs)
    n, block_bytes = sizes(docs, bucket_bytes, block_bytes)
    lengths = levels(window, seed)
    told: list[str] = []

    def walk(block, ids, raw, answers, upto):
        b = Block(ids, raw, window, seed)
        for level in range(upto):
            u, inv, _ = b.keys(level)
            b.narrow(level, answers[level].of(block, 0, n, u, np.uint8), inv)
        return b

    for level in range(len(lengths)):
        last = level == len(lengths) - 1

        def ask(pid, block, ids, raw, answers, level=level, last=last):
            b = walk(block, ids, raw, answers, level)
            u, inv, count = b.keys(level)
            if last:
                doc, place, _ = b.firsts(inv, len(u))
                yield from asked(pid, block, 0, n, u, doc, place.astype(np.int64))
            else:
                yield from asked(pid, block, 0, n, u, np.minimum(count, 2).astype(np.uint8))

        path, _ = reduce_asked(scan(docs, ask, ASK, list(told), block_bytes), (lambda _, rows: earliest(rows)) if last else (lambda _, rows: repeated(rows)), f"level{lengths[level]}")
        told.append(path)

    schema = KEPT + ", kept_text string" * texts

    def remove(pid, block, ids, raw, answers):
        b = walk(block, ids, raw, answers, len(lengths) - 1)
        u, inv, _ = b.keys(len(lengths) - 1)
        cover = np.zeros(len(b.h) + 1, np.int64)
        if len(u):
            first = answers[-1].of(block, 0, n, u, np.uint8).astype(bool)
            doc, at, place = b.firsts(inv, len(u))
            mine = (b.doc[b.starts] == doc[inv]) & (place == at[inv])
            gone = b.starts[~(mine & first[inv])]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
        drop = np.cumsum(cover[:-1]) > 0
        out = []
        for k, (i, t) in enumerate(zip(ids, raw, strict=True)):
            w, d = t.split(), drop[b.off[k] : b.off[k + 1]]
            removed = int(d.sum())
            kept = b" ".join([x for x, y in zip(w, d.tolist(), strict=True) if not y] if removed else w)
            out.append((i, len(w), removed, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] * texts)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return scan(docs, remove, schema, told, block_bytes)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Windows as strings, each with its earliest place; a word goes if a window that stands earlier too covers it.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM p),
f AS (SELECT doc_id, s, first_value((doc_id, s)) OVER (PARTITION BY k ORDER BY doc_id, s) AS e FROM g),
c AS (SELECT DISTINCT doc_id, s + o AS place FROM f, range(0, 20) AS r(o) WHERE (doc_id, s) > e),
r AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m,
        CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
