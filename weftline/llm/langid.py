"""Language identification in two steps: the family first, then the languages within it.

Features are hashed byte bigrams and trigrams of the lower-cased text.  Families are found, not given: the
languages' mean feature vectors are merged by average linkage until about the square root of their number is
left.  One-versus-one linear support vector machines (squared hinge) choose the family, and others the language
within the chosen family.  They are fitted on a bounded sample (`sample` texts, the same number of each language: those of
least hash, copies once, and at least one of each); prediction reads every text whole.

Cases: null text or text without a letter is `und`, score 0.  A null lang teaches nothing.  Without labels every
text is `und`.  One language or one family needs no machine and has score 1.  A null doc_id counts as the
empty id.  Repeated rows are predicted each.  An empty table gives an empty result.  lang, source and doc_id are no
inputs; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import batch_of, draw, hash_of, small_batches, texts

DIM, SAMPLE, UND = 4096, 2400, "und"
_KEEP = np.full(256, 32, np.uint32)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, of unit length."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    n = np.zeros(DIM, np.int64)
    for at in range(0, len(raw), 1 << 20):
        b = _KEEP[raw[at : at + (1 << 20) + 2]]
        two = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ b[2:] * np.uint32(0x27D4EB2F)
        for g in (two, three):
            n += np.bincount(g >> np.uint32(20), minlength=DIM)
    x = np.sqrt(n).astype(np.float32)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, steps: int = 150, c: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge, by accelerated gradient; y is 1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x1.shape[1], np.float32)
    lr = 1 / (1 + 4 * c)
    for k in range(steps):
        v = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x1 @ v)) * share * y
        last, w = w, v - lr * (v / 100 - 2 * c * (x1.T @ slack))
    return w


def families(means: np.ndarray) -> list[list[int]]:
    """Average-linkage groups of the rows; about the square root of their number."""
    groups = [[i] for i in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    near = unit @ unit.T
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: (near[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] = sorted(groups[a] + groups[b])
        groups.pop(b)
    return groups


class Model:
    """Machines for pairs of families and for pairs of languages in a family."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str]):
        self.names = names
        self.families = families(np.stack([x[y == i].mean(axis=0) for i in range(len(names))])) if names else []
        of = np.zeros(max(1, len(names)), np.int64)
        for f, group in enumerate(self.families):
            of[group] = f
        fam = of[y]
        self.rows, weights = [], []
        for level, label, groups in [(-1, fam, range(len(self.families))), *((f, y, g) for f, g in enumerate(self.families))]:
            for a, b in combinations(groups, 2):
                use = (label == a) | (label == b)
                self.rows.append((level, a, b))
                weights.append(svm(x[use], np.where(label[use] == a, 1.0, -1.0).astype(np.float32)))
        self.w = np.stack(weights) if weights else np.zeros((0, DIM + 1), np.float32)

    def _vote(self, p: np.ndarray, level: int, groups) -> tuple[int, float]:
        share = dict.fromkeys(groups, 0.0)
        for (at, a, b), q in zip(self.rows, p, strict=True):
            if at == level:
                share[a] += q
                share[b] += 1 - q
        best = max(share, key=lambda g: (share[g], -g))
        return best, share[best] / max(1, len(share) - 1) if len(share) > 1 else 1.0

    def predict(self, text: str) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UND, 0.0
        p = 1 / (1 + np.exp(-2 * np.clip(self.w[:, :-1] @ features(text) + self.w[:, -1], -15, 15)))
        f, s = self._vote(p, -1, range(len(self.families)))
        i, t = self._vote(p, f, self.families[f])
        return self.names[i], float(s * t)


def _fold(mod: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on `sample` different texts, evenly over the languages, and one a language at least; docs: text, lang."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    counts = {r["key"]: r["n"] for r in docs.groupBy("key").agg(F.count("*").alias("n")).collect()}  # one row a language
    chosen = draw(docs.select("key", hash_of("text").alias("h")), max(1, sample // max(1, len(counts))), counts)
    if not chosen:
        return Model(np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), [])

    def run(batches):
        seen = set()  # no more than were chosen
        for b in batches:
            lang, h, x = [], [], []
            for k, i, t in zip(b.column("key").to_pylist(), b.column("h").to_pylist(), texts(b), strict=True):
                if (k, i) not in seen:
                    seen.add((k, i))
                    lang.append(k)
                    h.append(i)
                    x.append(features(t).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(x, pa.binary())], names=["key", "h", "x"])

    few = F.broadcast(spark.createDataFrame(chosen, "key string, h long"))  # `sample` rows
    got = docs.withColumn("h", hash_of("text")).join(few, ["key", "h"]).mapInArrow(run, "key string, h long, x binary")
    got = got.groupBy("key", "h").agg(F.first("x").alias("x")).toArrow().sort_by([("key", "ascending"), ("h", "ascending")])
    lang = got.column("key").to_pylist()
    names = sorted(set(lang))
    x = np.empty((got.num_rows, DIM), np.float32)
    for k, v in enumerate(got.column("x")):
        x[k] = np.frombuffer(v.as_buffer(), np.float16)
    del got
    at = {n: i for i, n in enumerate(names)}
    return Model(x, np.array([at[n] for n in lang], np.int64), names)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights a pair of languages

    def run(batches):
        for b in batches:
            got = [told.value.predict(t) for t in texts(b)]
            yield batch_of(_OUT, b.column("doc_id"), b.column("held_out"), [g[0] for g in got], [g[1] for g in got])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (_fold(5) == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that have no language."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([told.value.predict(t)[0] != UND for t in texts(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(_fold(5) != 0)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(train_rows(docs)))
