"""Katz backoff language model over words: Good-Turing discounted counts, exactly normalised backoff.

Tokens are the lower-cased (A-Z) words of a text and one end.  A token's probability given the `order` - 1 before (starts
stand in front of a text) is the discounted relative count if the n-gram was seen, else the context's backoff weight
times the token's probability given one token less, and so on down to the unigram; a token never seen takes the unigram
mass that discounting freed.  Weights are set so that each context's probabilities sum to one over all known
tokens and one unknown.

Counts up to KATZ are discounted by Good-Turing, with Katz's renormalisation, over smoothed counts of counts: the
log-linear fit of those of the order, each averaged over the gap around it, up to LAST.  Counts of counts as they are
give factors above 1 wherever documents occur several times.  With fewer than two different counts the slope is -2
(Zipf's law); a slope above -1, which leaves no mass to free, is taken as -1, where the factors have a limit.

Counts, and then the backoff weights of each order, are tables in the shared folder, partitioned by the task whose
documents ask for them (see blocks.py); counts of a hot context are spread by the hash of the n-gram.  The texts are
read once for counts, once an order above the first for weights, and once to score.

Cases: null or empty text is its end alone.  A null doc_id counts as the empty id.  Repeated rows are counted and
scored as often as they stand there.  Very long texts are scored whole.  No training tokens: all
probabilities are one.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import ASK, asked, from_planes, reduce_asked, scan, sizes, stable
from weftline.llm.shared import MUL, block_words, mix

START, STOP = np.uint64(0x5354415254), np.uint64(0x53544F50)
KATZ, LAST, ORDER, BLOCK, BUCKET_BYTES = 5, 40, 2, 4_000_000, 8_000_000
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id, mod: int, rest: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == rest


def slope(n: dict[int, float], last: int = LAST) -> float:
    """Slope of the log-linear fit of the counts of counts, each averaged over the gap around it."""
    r = sorted(k for k, v in n.items() if v > 0 and k <= last)
    if len(r) < 2:
        return -2.0
    gap = [((r[i + 1] if i + 1 < len(r) else 2 * r[i] - r[i - 1]) - (r[i - 1] if i else 0)) / 2 for i in range(len(r))]
    x, y = np.log(r), np.log([n[k] / g for k, g in zip(r, gap, strict=True)])
    x = x - x.mean()
    return min(-1.0, float(x @ y / (x @ x)))


def discounts(n: dict[int, float], katz: int = KATZ) -> np.ndarray:
    """Factor for each count 1..katz (place 0 unused), from the numbers n[r] of n-grams seen r times."""
    b = slope(n) + 1
    if b > -1e-9:
        return np.array([0.0, *(1 - math.log(1 + 1 / r) / math.log(katz + 1) for r in range(1, katz + 1))])
    common = (katz + 1.0) ** b
    return np.array([0.0, *(((1 + 1 / r) ** b - common) / (1 - common) for r in range(1, katz + 1))])


def apply_discount(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1).astype(np.int64)], 1.0)


class Unigram:
    """Discounted unigram probabilities and the additive base."""

    def __init__(self, meta: dict[str, float]):
        self.n, self.v = int(meta.get("N", 0)), int(meta.get("V", 0))
        counts = counts_of_counts(meta, 1)
        self.d = discounts(counts)
        freed = sum((1 - self.d[r]) * r * counts[r] for r in range(1, KATZ + 1))
        self.total, self.unknown = (self.n, freed) if freed > 0 else (self.n + 1, 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, apply_discount(c.astype(float), self.d), self.unknown) / self.total

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def counts_of_counts(meta: dict[str, float], m: int) -> dict[int, float]:
    return {r: meta.get(f"{m}_{r}", 0) for r in range(1, LAST + 1)}


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, a place of each, and the number of each key among them."""
    u, inv = np.unique(keys, return_inverse=True)
    at = np.empty(len(u), np.int64)
    at[inv] = np.arange(len(keys))
    return u, at, inv


class Grams:
    """The tokens of a block, the keys of the n-grams that end at each, and what is known of them."""

    def __init__(self, ids: list, raw: list[bytes], order: int):
        h, off = block_words([t.lower() for t in raw])
        tok = np.insert(h, off[1:], STOP)
        self.start = off[:-1] + np.arange(len(ids))
        self.size = np.diff(np.append(self.start, len(tok)))
        held = np.array([held_out(i, 10, 0) for i in ids], bool)
        self.held, self.train = held, ~np.repeat(held, self.size)
        padded = np.insert(tok, np.repeat(self.start, order - 1), START)
        real = np.arange(len(tok)) + np.repeat(np.arange(1, len(ids) + 1) * (order - 1), self.size)
        gram = padded
        #: Keys by order; contexts by the order of the n-grams that they begin.
        self.keys, self.contexts = {1: tok}, {}
        for m in range(2, order + 1):
            before = np.concatenate([[START], gram[:-1]])
            self.contexts[m] = before[real]
            gram = mix(before * np.uint64(MUL) + padded)
            self.keys[m] = gram[real]
        self.blank = np.zeros(len(tok), np.int64)
        self.blank[self.start] = 1
        self.order, self.of, self.own, self.weight = order, {}, {}, {}
        self.distinct = {m: distinct(k) for m, k in self.keys.items()}

    def learn_counts(self, answers, block: int, n: int) -> None:
        for m, (u, _, inv) in self.distinct.items():
            told = answers.of(block, (m - 1) * n, n, u, np.uint64)
            self.own[m] = (told & np.uint64(1)).astype(bool)
            self.of[m] = (told >> np.uint64(1)).astype(float)[inv]
        self.ends = float(self.of[1][-1])  # a block ends with a text's end

    def followed(self, m: int) -> np.ndarray:
        """How often the context of each n-gram of order m was followed in training: its count; before a text, the number of ends."""
        last = np.concatenate([[0.0], self.of[m - 1][:-1]])
        return np.where(self.blank == 1, self.ends, last)

    def learn_weights(self, answers, block: int, n: int, m: int) -> None:
        u, inv = np.unique(self.contexts[m], return_inverse=True)
        self.weight[m] = answers.of(block, 0, n, u, np.float64)[inv]

    def p(self, m: int, uni: Unigram, d: dict[int, np.ndarray]) -> np.ndarray:
        """Probability of each token given the m - 1 before, by recursion on m."""
        if m == 1:
            return uni.p(self.of[1])
        w = self.weight[m]
        total = self.followed(m) + (w < 0)
        return np.where(self.of[m] > 0, apply_discount(self.of[m], d[m]) / np.maximum(total, 1), np.abs(w) * self.p(m - 1, uni, d))


def counted(rows: list, m: int):
    """Totals of each key, as answers to each row: doubled, plus 1 in the one row that owns the key."""
    keys = np.concatenate([k for k, _ in rows])
    counts = np.concatenate([from_planes(v[0], np.uint32) for _, v in rows]).astype(np.int64)
    _, inv = np.unique(keys, return_inverse=True)
    total = np.bincount(inv, weights=counts).astype(np.uint64)
    told = total[inv] * np.uint64(2)
    if m > 1:
        seen = np.flatnonzero(counts > 0)
        _, first = np.unique(inv[seen], return_index=True)
        told[seen[first]] += np.uint64(1)
    small = np.bincount(np.minimum(total, LAST + 1).astype(np.int64), minlength=LAST + 2)
    meta = {f"{m}_{r}": int(small[r]) for r in range(1, LAST + 1) if small[r]}
    if m == 1:
        meta |= {"N": int(total.sum()), "V": int((total > 0).sum())}
    return np.split(told, np.cumsum([len(k) for k, _ in rows])[:-1]), meta


def weigh(rows: list):
    """Backoff weight of each context; negative if its probabilities are over one more than its count."""
    keys = np.concatenate([k for k, _ in rows])
    cols = [np.concatenate([from_planes(v[i], np.float64) for _, v in rows]) for i in range(3)]
    _, inv = np.unique(keys, return_inverse=True)
    s1, s2 = (np.bincount(inv, weights=c) for c in cols[:2])
    c = np.zeros(len(s1))
    np.maximum.at(c, inv, cols[2])
    left, rest = c - s1, np.maximum(1 - s2, 1e-12)
    more = left <= 1e-9 * c
    w = np.where(c > 0, np.where(more, -1 / ((c + 1) * rest), left / (np.maximum(c, 1) * rest)), 1.0)[inv]
    return np.split(w, np.cumsum([len(k) for k, _ in rows])[:-1]), {}


def score(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Train n-grams up to `order` (1 or more) on the documents that are not held out and score all; columns of SCORES."""
    docs = stable(docs)
    n, block_bytes = sizes(docs, bucket_bytes, block_bytes)

    def ask_counts(pid, block, ids, raw, _):
        g = Grams(ids, raw, order)
        for m, (u, _, inv) in g.distinct.items():
            yield from asked(pid, block, (m - 1) * n, n, u, np.bincount(inv, weights=g.train, minlength=len(u)).astype(np.uint32))

    counts, meta = reduce_asked(scan(docs, ask_counts, ASK, [], block_bytes), lambda b, rows: counted(rows, b // n + 1), "counts")
    meta = {r["name"]: r["value"] for r in meta.collect()}  # LAST rows an order, and 2
    uni, d = Unigram(meta), {m: discounts(counts_of_counts(meta, m)) for m in range(2, order + 1)}
    told = [counts]

    for level in range(2, order + 1):

        def ask_weights(pid, block, ids, raw, answers, m=level):
            g = Grams(ids, raw, order)
            g.learn_counts(answers[0], block, n)
            for lower in range(2, m):
                g.learn_weights(answers[lower - 1], block, n, lower)
            _, at, _ = g.distinct[m]
            at = at[g.own[m]]
            u, first, where = distinct(g.contexts[m])
            s1 = np.bincount(where[at], weights=apply_discount(g.of[m][at], d[m]), minlength=len(u))
            s2 = np.bincount(where[at], weights=g.p(m - 1, uni, d)[at], minlength=len(u))
            yield from asked(pid, block, 0, n, u, s1, s2, g.followed(m)[first])

        told.append(reduce_asked(scan(docs, ask_weights, ASK, list(told), block_bytes), lambda b, rows: weigh(rows), f"weights{level}")[0])

    def evaluate(pid, block, ids, raw, answers):
        g = Grams(ids, raw, order)
        g.learn_counts(answers[0], block, n)
        for m in range(2, order + 1):
            g.learn_weights(answers[m - 1], block, n, m)
        add = lambda x: np.add.reduceat(x, g.start)
        known = (g.of[1] > 0).astype(np.int64)
        cols = (ids, g.held, g.size, add(known), np.full(len(ids), uni.n), add(uni.base(g.of[1])), add(np.log10(g.p(order, uni, d))))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return scan(docs, evaluate, SCORES, told, block_bytes)


def op3_katz(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
